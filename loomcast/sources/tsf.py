"""Series collections in text files: a header of @attributes, then one line a series: ``name[:attribute...]:v,v,?,v``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TRUE = ("y", "yes", "t", "true", "on", "1")
FALSE = ("n", "no", "f", "false", "off", "0")


def parse_bool(token: str) -> bool:
    t = token.strip().lower()
    if t in TRUE:
        return True
    if t in FALSE:
        return False
    raise ValueError(f"not a truth value: {token!r}")


def read_tsf(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(series table with ``series_value`` array<double>, metadata). Missing values ('?') are null.

    The header's lines are read on the driver; the series stay distributed. Raises ValueError for a malformed header; a
    malformed row fails the job that reads it.
    """
    text = spark.read.option("encoding", "windows-1252").text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    attributes, meta = [], {"frequency": None, "horizon": None, "missing": None, "equallength": None}
    data = False
    for (line,) in text.where(F.trim("value").startswith("@")).select(F.trim("value")).collect():
        parts = line.split()
        name = parts[0][1:].lower()
        if name == "data":
            data = True
        elif name == "attribute":
            if len(parts) != 3:
                raise ValueError(f"invalid attribute: {line}")
            if parts[2] not in ("numeric", "string", "date"):
                raise ValueError(f"invalid attribute type: {parts[2]}")
            attributes.append((parts[1], parts[2]))
        elif name in meta:
            if len(parts) != 2:
                raise ValueError(f"invalid metadata: {line}")
            meta[name] = {"horizon": int, "missing": parse_bool, "equallength": parse_bool}.get(name, str)(parts[1])
    if not attributes:
        raise ValueError("no attribute section")
    if not data:
        raise ValueError("no @data section")
    cells = F.split(F.trim("value"), ":")
    header = F.trim("value").startswith("@")  # asked again below: the order in which filters run is not given
    rows = text.where(~header).withColumn("cells", F.when(header, F.lit(None)).when(F.size(cells) == len(attributes) + 1, cells).otherwise(F.raise_error(F.concat(F.lit("wrong number of fields: "), F.substring("value", 1, 80)))))
    kinds = {"numeric": lambda c: c.try_cast("bigint"), "string": lambda c: c, "date": lambda c: F.to_timestamp_ntz(c, F.lit("yyyy-MM-dd HH-mm-ss"))}
    values = F.transform(F.split(F.element_at("cells", -1), ","), lambda x: F.nullif(F.trim(x), F.lit("?")).try_cast("double"))
    known = F.when(F.col("cells").isNull(), F.lit(None)).when(F.exists(values, lambda x: x.isNotNull()), values).otherwise(F.raise_error(F.lit("all values of a series are missing")))
    return rows.select(*[kinds[k](F.col("cells")[i]).alias(n) for i, (n, k) in enumerate(attributes)], known.alias("series_value")), meta


def write_tsf(panel: DataFrame, path: str, frequency: str, horizon: int, start: bool = False) -> None:
    """Writes (series, index, y) rows as one text directory; header and data are parts of it. ``start``: with each series' first timestamp."""
    spark = panel.sparkSession
    head = ["@attribute series_name string", *["@attribute start_timestamp date"] * start, f"@frequency {frequency}", f"@horizon {horizon}", "@missing true", "@equallength false", "@data"]
    first = [F.date_format(F.min("timestamp"), "yyyy-MM-dd HH-mm-ss").alias("first")] if start else [F.lit(None).cast("string").alias("first")]
    rows = panel.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("index", "y"))).alias("v"), *first).select(F.concat("series", F.coalesce(F.concat(F.lit(":"), "first"), F.lit("")), F.lit(":"), F.array_join(F.transform("v", lambda s: F.coalesce(s["y"].cast("string"), F.lit("?"))), ",")).alias("value"))
    spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.mode("overwrite").text(path)
    rows.write.mode("append").text(path)


def explode_series(collection: DataFrame, name: str = "series_name", value: str = "series_value") -> DataFrame:
    """(series, index, y) of a series table."""
    return collection.select(F.col(name).alias("series"), F.posexplode(value).alias("i", "y")).select("series", F.col("i").cast("long").alias("index"), "y")
