"""Bounded, balanced and repeatable training samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of each label value that a model is fitted on, bytes of all of them together, and the number of label values.
SAMPLE_PER_LABEL, SAMPLE_BYTES, MAX_LABELS = 2000, 128 << 20, 1000


def remainder(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled_sample(documents: DataFrame, labels: DataFrame | None, label: str, allowed, per_label: int | dict = SAMPLE_PER_LABEL, total_bytes: int = SAMPLE_BYTES) -> tuple[list[tuple[str, object]], dict]:
    """(text, label) pairs for a model, at most ``per_label`` of each value and ``total_bytes`` in all, and the count of every value.

    ``per_label``: one bound for all values, or a bound for each of them. Each value has an equal share of ``total_bytes``; a text that does
    not fit in what is left of it makes room for the next. Texts are whole, whatever their length.

    ``allowed`` is the condition on doc_id that a row must meet to be learnt from. Rows are picked by a hash of their id, so
    the same table gives the same sample however it is partitioned. ``labels`` None: the label is a column of documents.
    Rows with a null label, id or text are left out. More than ``MAX_LABELS`` label values are refused.
    """
    source = documents if labels is None else labels
    source = source.where(allowed & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_label"))
    bound = per_label.get if isinstance(per_label, dict) else lambda value, _: per_label
    counts = {r[0]: r[1] for r in source.groupBy("_label").count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} values of {label}")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in counts.items():
        share = min(1.0, (1.3 * bound(value, SAMPLE_PER_LABEL) + 50) / n)
        keep = keep | ((F.col("_label") == F.lit(value)) & (draw < F.lit(int(share * (1 << 30)))))
    if labels is None:
        rows = documents.select("doc_id", "text", F.col(label).alias("_label")).where(allowed & keep)
    else:
        picked = source.where(keep)  # bounded by per_label: safe to broadcast
        rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = rows.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).withColumn("_draw", draw).withColumn("_key", F.xxhash64("text"))
    # sizes first, so that the texts that come to the driver are known to fit
    left, chosen = {}, {}
    for r in sorted(rows.select("_draw", "doc_id", "_key", "_label", F.octet_length("text").alias("size")).collect()):
        value, room = r["_label"], left.get(r["_label"], total_bytes // max(1, len(counts)))
        if r["size"] <= room and len(chosen.setdefault(value, [])) < bound(value, SAMPLE_PER_LABEL):
            chosen[value].append((r["doc_id"], r["_key"]))
            left[value] = room - r["size"]
    if not any(chosen.values()):
        return [], counts
    wanted = documents.sparkSession.createDataFrame([x for some in chosen.values() for x in set(some)], "doc_id long, _key long")
    texts = {(r["doc_id"], r["_key"]): r["text"] for r in rows.join(F.broadcast(wanted), ["doc_id", "_key"], "left_semi").select("doc_id", "_key", "text").collect()}
    return [(texts[x], value) for value in sorted(chosen) for x in chosen[value]], counts
