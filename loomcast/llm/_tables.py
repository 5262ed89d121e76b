"""Cutting lineage: intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


class _Written(threading.local):
    """The tables that a thread has written: queries that run beside each other don't delete each other's."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and all tasks run in this process, as in tests, a temporary folder is made and set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if now.isDefined():
            found = now.get()
        elif re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="checkpoint-")
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def written(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame | str) -> None:
    """Deletes written tables that nothing will read again."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t if isinstance(t, str) else t._written_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A point in time, for ``discard_since``."""
    return len(_written.paths)


def discard_since(spark: SparkSession, when: int, keep: DataFrame | list[DataFrame]) -> None:
    """Deletes all tables written since then but some; their readers must be done."""
    kept = [t._written_at for t in (keep if isinstance(keep, list) else [keep])]
    discard(spark, *(p for p in _written.paths[when:] if p not in kept))
    _written.paths[when:] = kept


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def row_key(text: Column) -> Column:
    """Tells rows with the same doc_id apart by their text; equal rows stay equal."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while stem in taken:
        stem += "_"
    return stem
