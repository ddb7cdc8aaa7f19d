"""Files of a store that both the driver and tasks reach, by URI."""

from __future__ import annotations

import re

from pyarrow import fs as pafs


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain local path."""
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:/", path) else f"file://{path}")


def listed(path: str, suffix: str, skip: tuple[str, ...] = ()) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files below a folder whose name ends in `suffix`, in order of their names.

    Folders named in `skip` are left out with all that is in them.
    """
    fs, root = opened(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [(root, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    out, folders = [], [root]
    while folders:
        found = fs.get_file_info(pafs.FileSelector(folders.pop(), recursive=not skip))
        out += [(f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.endswith(suffix)]
        if skip:
            folders += [f.path for f in found if f.type == pafs.FileType.Directory and f.base_name not in skip]
    return sorted(out)
