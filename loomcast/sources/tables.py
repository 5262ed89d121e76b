"""Stored tables: lineage cuts, forecast stores, keyed logs, readers of result files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all tasks run in this process, as in tests."""
    found, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="checkpoint-"))
    return found or context.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from Parquet in the shared folder: a lost executor does not compute them again, and unlike a checkpoint
    nothing is worked out twice to be stored."""
    path = fresh_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def store_forecasts(forecast: DataFrame, path: str, by: tuple[str, ...] = ("dataset",), mode: str = "append") -> None:
    """Forecast rows as Parquet, one folder for each value of ``by``: later reads of some datasets prune the rest."""
    forecast.write.partitionBy(*by).mode(mode).parquet(path)


def wide_forecasts(forecast: DataFrame, horizon: int) -> DataFrame:
    """(series, h_1..h_n): one row a series."""
    return forecast.groupBy("series").agg(*[F.max(F.when(F.col("h") == h, F.col("pred"))).alias(f"h_{h}") for h in range(1, horizon + 1)])


def pending(tasks: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The tasks whose keys a log at ``path`` does not have; all of them if there is no log yet."""
    spark = tasks.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return tasks
    return tasks.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Adds the rows whose keys a log at ``path`` does not have; a run that was stopped goes on where it was."""
    pending(rows, path, keys).write.mode("append").parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """A few rows, such as best parameters, as JSON lines in one file."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def write_csv_file(rows: DataFrame, folder: str, name: str) -> None:
    """A few rows as one CSV file of a given name."""
    spark, path = rows.sparkSession, rows.sparkSession._jvm.org.apache.hadoop.fs.Path
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    rows.coalesce(1).write.csv(part, header=True)
    files = path(part).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    written = next(s.getPath() for s in files.listStatus(path(part)) if s.getPath().getName().startswith("part-"))
    files.rename(written, path(f"{folder}/{name}"))
    files.delete(path(part), True)


def write_list(rows: DataFrame, column: str, path: str, by: str | None = None) -> None:
    """The values of a column, in order, each followed by a tab, as one line of text (one for each ``by``)."""
    line = F.concat(F.array_join(F.sort_array(F.collect_list(F.col(column).cast("string"))), "\t"), F.lit("\t")).alias("value")
    (rows.groupBy(by) if by else rows.groupBy()).agg(line).select("value").write.mode("overwrite").text(path)


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; computed and written there if it is not there yet, or was not written to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_matrix(spark: SparkSession, path: str, prefix: str = "T") -> DataFrame:
    """(series, h, value) of a text file with one series a line and white space between values; series are named by line, blank lines don't count.

    A file of this kind is one forecast table, read as a whole so that line numbers are known.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: x.rlike(r"\S"))).alias("line", "value"))
    cells = lines.select(F.concat(F.lit(prefix), F.col("line") + 1).alias("series"), F.posexplode(F.split(F.trim("value"), r"\s+")).alias("at", "value"))
    return cells.select("series", (F.col("at") + 1).alias("h"), F.col("value").try_cast("double").alias("value"))


def read_seeds(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Result files of several seeds, by a path with wildcards; ``seed`` is the number that ends a file's name."""
    rows = spark.read.csv(pattern, header=True, schema=schema)
    return rows.withColumn("seed", F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)\.csv$", 1).try_cast("int")).where("seed is not null")


def table_lines(wide: DataFrame, key: str, columns: list[str], digits: int = 3) -> DataFrame:
    """(key, line): one typeset row for each row, columns parted by ampersands, the least value in bold."""
    least = F.least(*columns)
    cells = [F.when(F.col(c).isNull(), "--").when(F.col(c) == least, F.concat(F.lit("\\textbf{"), F.format_number(c, digits), F.lit("}"))).otherwise(F.format_number(c, digits)) for c in columns]
    return wide.select(key, F.concat(F.concat_ws(" & ", key, *cells), F.lit(" \\\\")).alias("line"))
