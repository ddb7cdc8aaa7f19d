"""Python work on the texts of a table, in Arrow batches; all other columns pass untouched."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Characters of texts that are worked on together, and bytes of the batches that they come in.
CHUNK, BATCH = 1_000_000, 2 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, rows) of runs of `texts` of about CHUNK bytes; a longer text is the last of its run."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size > CHUNK:
            yield start, i + 1 - start
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts) - start


def with_columns(df: DataFrame, text: Column, make: Callable[[], Callable[[list[str]], list[list]]], new: list[tuple[str, str, pa.DataType]], keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `df` (all by default) and the new ones, `(name, SQL type, Arrow type)` each.

    make() is called once in each task and gives a function from texts to the new columns' values; null texts come as
    empty ones. Columns of `df` with a new column's name are replaced. The session's Arrow batches are made smaller if
    they are larger than BATCH, since a worker holds a few of them.
    """
    now = df.sparkSession.conf.get(BATCH_CONF).removesuffix("b")
    if not now.isdigit() or int(now) > BATCH:
        df.sparkSession.conf.set(BATCH_CONF, f"{BATCH}b")
    gone = {n.lower() for n, _, _ in new}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in gone]
    kinds = [k for _, _, k in new]
    cols = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    out = StructType(list(df.select(cols).schema) + list(StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t, _ in new))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            for start, n in chunks(b.column(b.num_columns - 1)):
                some = b.slice(start, n)
                arrays = [pa.array(v, k) for v, k in zip(work(some.column(b.num_columns - 1).to_pylist()), kinds)]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *arrays], names=out.names)

    # mapInArrow() looks its input's columns up by name, which fails for names with dots.
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(cols)), F.coalesce(text, F.lit("")).alias("given")).mapInArrow(run, out)
