"""Tables written to the folder that all executors share, to cut lineage in a way that survives lost executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a row group of a written table.
ROW_GROUP = 16 << 20
#: Files of a table of few rows, and rows for each file of a larger one.
FILES, FILE_ROWS = 48, 250_000
_own: dict[str, str] = {}
_paths: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master without that setting gets a temporary one."""
    conf = spark.sparkContext.getConf()
    if path := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir"):
        return path.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="voxelith-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _paths.append(path)
    return path


def materialise(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes `df` as Parquet to the shared folder and returns the table that was written.

    Row groups are small, since a writer holds one in memory. `rows` bounds the rows of `df` from above, if that's known:
    then no more files are written than such a table needs, nor more tasks run in the stage that writes them.
    """
    path = fresh_path(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(FILES, rows // FILE_ROWS))
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many paths fresh_path() has given out."""
    return len(_paths)


def sweep(keep: DataFrame, since: int) -> None:
    """Deletes what was written after written() was `since`, but for the table `keep`."""
    spark = keep.sparkSession
    kept = {f.rpartition("/")[0].rpartition("/")[2] for f in keep.inputFiles()}
    for p in _paths[since:]:
        if p.rpartition("/")[2] not in kept:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _paths[since:] = [p for p in _paths[since:] if p.rpartition("/")[2] in kept]


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote. Call it once everything that reads them is itself written."""
    for t in tables:
        spark = t.sparkSession
        for top in {f.rpartition("/")[0] for f in t.inputFiles()}:
            if top.removeprefix("file:").lstrip("/").startswith(shared_dir(spark).removeprefix("file:").lstrip("/") + "/"):
                path = spark._jvm.org.apache.hadoop.fs.Path(top)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clashless(df: DataFrame, stem: str) -> str:
    """A column name that starts with `stem` and that `df` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def columns(df: DataFrame) -> list[Column]:
    """The columns of `df`, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns of `df`, by which rows that differ anywhere can be told apart and put in order."""
    return F.xxhash64(*(F.to_json(F.struct(c)) if "map<" in kind else c for c, (_, kind) in zip(columns(df), df.dtypes)))
