"""Helpers that several text operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The same class in Java's notation.
WORD_SQL = r"[^\x20\x09-\x0D]+"
SPACE_SQL = r"[\x20\x09-\x0D]+"
#: What stands between words, to be trimmed; as a value, since a SQL literal knows no \f.
SPACES = " \t\n\v\f\r"
#: A-Z only, unlike str.lower().
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> Column:
    """The words of a text column as an array; a null or blank text has none."""
    inner = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_SQL))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about max_bytes of text, or one row."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(column)).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        if start < len(sizes):
            yield batch.slice(start)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where it is unset (tests, one machine) a folder below the warehouse is used and set."""
    import uuid

    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/glossarion-{uuid.uuid4().hex}"
