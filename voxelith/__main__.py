"""Single tasks from a shell: `python -m voxelith create IN OUT`, `lod:auto` and `lod:auto-chunk`, or `run FILE` for a document."""

from __future__ import annotations

import argparse
from pathlib import Path

from voxelith.plans.tasks import run
from voxelith.session import session


def document(args: argparse.Namespace) -> str | dict:
    """The task document of parsed arguments."""
    if args.command == "run":
        return Path(args.file).read_text()
    middle = {
        "lod:auto": lambda: [{"id": "lod", "type": "AutoLod", "config": {"input": "c", "output": "c", "ratio": args.ratio}}],
        "lod:auto-chunk": lambda: [{"id": "lod", "type": "AutoChunkLod", "config": {"input": "c", "output": "c", "type": args.type, "maxChunkCounts": args.max_chunk_counts}}],
    }.get(args.command, list)()
    ends = [{"id": "in", "type": "Read", "config": {"inputs": [args.input], "output": "c"}}, {"id": "out", "type": "Write", "config": {"input": "c", "output": args.output}}]
    return {"version": 1, "tasks": [ends[0], *middle, ends[1]]}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="voxelith")
    sub = top.add_subparsers(dest="command", required=True)
    sub.add_parser("run").add_argument("file")
    for name in ("create", "lod:auto", "lod:auto-chunk"):
        p = sub.add_parser(name)
        p.add_argument("input")
        p.add_argument("output")
        if name == "lod:auto":
            p.add_argument("--ratio", type=float, default=0.3)
        if name == "lod:auto-chunk":
            p.add_argument("--type", default="parquet")
            p.add_argument("--max-chunk-counts", type=int, default=400_000)
    return top


if __name__ == "__main__":
    run(session(), document(parser().parse_args()))
