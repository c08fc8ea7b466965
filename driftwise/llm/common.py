"""Helpers shared by the operators: table reads, materialised intermediate tables, Arrow conversions."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back.

    It cuts the lineage reliably: what follows reads files that outlive executors, each row is made once, and
    values that depend on the task (``monotonically_increasing_id``) are fixed from here on. The path is added to ``paths``.
    """
    path = scratch_path(df.sparkSession, f"llm-{name}")
    if paths is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete stored tables, once nothing that reads them is still to run; ``paths`` is empty afterwards."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def utf8(col: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()
    return [b if b is not None else b"" for b in col.cast(kind).to_pylist()]


def strings(col: pa.ChunkedArray | pa.Array) -> list[str]:
    return [s if s is not None else "" for s in col.to_pylist()]


def row_count(df: DataFrame) -> int:
    return int(df.count())


def slices(total: int, rows_per_slice: int) -> int:
    """How many slices of about ``rows_per_slice`` hold ``total`` rows; grows with the data, at least 1."""
    return max(1, -(-int(total) // int(rows_per_slice)))


def widen(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Only the named columns, in order; extra columns of the input, whatever they are called, end here."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called that (whatever the case)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def carried(df: DataFrame, without: Sequence[str]) -> tuple[Column, list[str]]:
    """All columns but ``without`` as one column, so that none of their names can meet an operator's own, and their names."""
    gone = {w.lower() for w in without}
    names = [c for c in df.columns if c.lower() not in gone]
    return F.struct(*[F.col(f"`{n}`") for n in names]) if names else F.lit(True), names


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
