"""License scans: fixed phrases, and an exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is any run of consecutive words, wherever lines end, of a template's block length: ``ceil(words / THRESHOLD)``. A template is
contained in a block if at least ``THRESHOLD`` of its distinct words are there, and ``scan`` finds every such block. Words are put in order
of their frequency in the corpus, rarest first (counted over all documents, for the templates' words). A block with n - p + 1 of a
template's n words has one of the p rarest, so only places of these prefix words are candidates: they are joined with an index of
(prefix word, template), a few rows for each template. A candidate stands for the blocks around it of which its word is the rarest
common one. The length filter drops it if there are too few template words around it, the positional filter if too few of
them come from its word on in the global order; what is left is compared block by block. All these filters are exact.

Long texts are cut into pieces of ``PIECE`` words that overlap by the longest block, so that a task holds one piece's candidates
at a time, and all work grows with the number of words.

Defined cases: null, empty and wordless texts have no words and match nothing; equal rows give equal results, also with equal or null ids; ties of
frequency go by the word; very long texts are cut as said, with the same results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm._tables import lower_ascii, row_key, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD, PIECE = 0.9, 4096
#: Phrases and the labels they stand for.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Sentences that common licenses and their notices are known by.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "lgpl": "licensed under the gnu lesser general public license",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}


def words_of(text: Column) -> Column:
    """The text's words, A-Z lower-cased (other letters may be, which changes no word's place); no words give an empty array."""
    text = F.coalesce(text, F.lit(""))
    # of all other letters, only the Kelvin sign and the dotted capital I become ASCII letters
    small = F.when(text.contains("\u212a") | text.contains("\u0130"), lower_ascii(text)).otherwise(F.lower(text))
    return F.array_remove(F.split(small, SEPARATORS), "")


def _starts(words: Column, phrase: str) -> Column:
    """Numbers of the words at which a phrase starts."""
    first, *others = phrase.split()

    def here(w: Column, i: Column) -> Column:
        hit = w == first
        for k, other in enumerate(others, 1):
            hit = hit & (F.get(words, i + k) == other)
        return F.when(hit, i.cast("long"))

    return F.array_compact(F.transform(words, here))


def word_order(documents: DataFrame, templates: dict[str, str]) -> list[str]:
    """The templates' words, rarest in the corpus first (by number of places, then the word itself)."""
    known = sorted({w for t in templates.values() for w in t.split()})
    rows = documents.select(F.explode(words_of(F.col("text"))).alias("w")).where(F.col("w").isin(known)).groupBy("w").count().collect()
    n = {r[0]: r[1] for r in rows}  # at most one row for a template word
    return sorted(known, key=lambda w: (n.get(w, 0), w))


def prefix_index(templates: dict[str, str], order: list[str], threshold: float) -> list[tuple]:
    """(word, template, its words, need, block length) for each word of each template's prefix."""
    rank = {w: i for i, w in enumerate(order)}
    out = []
    for name, text in templates.items():
        own = sorted(set(text.split()), key=rank.get)
        need = math.ceil(threshold * len(own) - 1e-9)
        out += [(w, name, own, need, block_words(text, threshold)) for w in own[: len(own) - need + 1]]
    return out


def block_words(template: str, threshold: float) -> int:
    return math.ceil(len(template.split()) / threshold - 1e-9)


def hits(words: Column, rare: list[str], reach: int) -> Column:
    """array<struct<w, near, at>>: places of prefix words with the ``reach`` words before and after each; ``at``: its number there."""
    place = lambda w, i: F.when(w.isin(rare), F.struct(w.alias("w"), F.slice(words, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1).alias("near"), F.least(i, F.lit(reach)).alias("at")))
    return F.array_compact(F.transform(words, place))


def survivors(candidates: DataFrame, order: list[str]) -> DataFrame:
    """The candidates (w, near, at, own, need, size) that pass the length and the positional filter."""
    around = F.slice("near", F.greatest(F.col("at") - F.col("size") + 1, F.lit(0)) + 1, F.least(F.col("at") + 1, F.col("size")) + F.col("size") - 1)
    ranked = F.array_intersect(F.array(*map(F.lit, order)), around)
    # positions are among the block's template words in global order; the candidate's word is to be the first common one
    return candidates.withColumn("_ranked", ranked).where((F.size("_ranked") >= F.col("need")) & (F.size("_ranked") - F.array_position("_ranked", F.col("w")) + 1 >= F.col("need"))).drop("_ranked")


def overlap(near: Column, at: Column, own: Column, size: Column) -> Column:
    """The largest number of a template's distinct words in a block of ``size`` words around place ``at``."""
    low = F.greatest(at - size + 1, F.lit(0))
    return F.array_max(F.transform(F.sequence(low, at), lambda s: F.size(F.array_intersect(F.slice(near, s + 1, size), own))))


def matched(pieces: DataFrame, templates: dict[str, str], threshold: float, order: list[str]) -> DataFrame:
    """(doc_id, key, template, containment): the best block of each template contained in a text, of rows (doc_id, key, hits)."""
    spark = pieces.sparkSession
    index = spark.createDataFrame(prefix_index(templates, order, threshold), "w string, template string, own array<string>, need int, size int")
    places = pieces.select("doc_id", "key", F.explode("hits").alias("h")).select("doc_id", "key", "h.w", "h.near", "h.at")
    met = survivors(places.join(F.broadcast(index), "w"), order)  # the index has some rows a template, whatever the corpus
    found = met.withColumn("common", overlap(F.col("near"), F.col("at"), F.col("own"), F.col("size"))).where(F.col("common") >= F.col("need"))
    return found.groupBy("doc_id", "key", "template").agg(F.max(F.col("common") / F.size("own")).alias("containment"))


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score: the largest containment, 1 where a phrase is found, 0 where nothing is.
    """
    order = word_order(documents, templates)
    rare = sorted({r[0] for r in prefix_index(templates, order, threshold)})
    reach = max((block_words(t, threshold) for t in templates.values()), default=1) - 1
    rows = documents.select("doc_id", row_key(F.col("text")).alias("key"), words_of(F.col("text")).alias("words"))
    starts = lambda w: F.struct(*[_starts(w, p).alias(f"at{k}") for k, p in enumerate(PHRASES)])
    # pieces overlap, so that every block is whole in one
    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PIECE)), lambda s: F.struct(s.alias("s"), F.slice("words", s + 1, PIECE + reach).alias("words")))
    rows = rows.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), starts(F.col("words")).alias("p"), F.explode(cuts).alias("c"))
    first = F.col("c.s") == 0
    rows = written(rows.select("doc_id", "key", F.when(first, F.col("n_words")).alias("n_words"), F.when(first, F.col("p")).alias("p"), hits(F.col("c.words"), rare, reach).alias("hits")))
    best = matched(rows.where(F.size("hits") > 0), templates, threshold, order).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k"))
    best = best.agg(F.collect_list("template").alias("more"), F.max("containment").alias("best"))  # at most one entry a template
    rows = rows.where(F.col("n_words").isNotNull()).select("doc_id", "key", "n_words", "p.*")
    rows = rows.join(best, rows["doc_id"].eqNullSafe(best["d"]) & (rows["key"] == best["k"]), "left")
    at = F.concat(*[f"at{k}" for k in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(x)) for k, x in enumerate(PHRASES.values())]))
    more = F.coalesce("more", F.array().cast("array<string>"))
    return rows.select("doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"), F.array_join(F.array_sort(base), ",").alias("base_labels"),
                       F.array_join(F.array_sort(F.array_distinct(F.concat(base, more))), ",").alias("labels"), F.when(F.size(at) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))


def _sql_rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


ORACLE_SQL = f"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, lower_text FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text FROM documents)),
listed AS (SELECT r, doc_id, regexp_extract_all(lower_text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
placed AS (SELECT r, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM listed),
phrases(label, p1, p2, p3) AS (VALUES {", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (label, *(phrase.split() + [None])[:3])) + ")" for phrase, label in PHRASES.items())}),
base AS (
  SELECT a.r, a.i, label FROM placed a JOIN phrases ON a.w = p1 JOIN placed b ON b.r = a.r AND b.i = a.i + 1 AND b.w = p2
  LEFT JOIN placed c ON c.r = a.r AND c.i = a.i + 2 AND c.w = p3 WHERE p3 IS NULL OR c.w IS NOT NULL),
templates(label, size, w) AS (VALUES {_sql_rows([(name, block_words(t, THRESHOLD), w) for name, t in TEMPLATES.items() for w in sorted(set(t.split()))])}),
sizes AS (SELECT label, count(*) AS n FROM templates GROUP BY label),
places AS (SELECT r, i, label, size, w FROM placed JOIN templates USING (w)),
blocks AS (SELECT a.r, a.label, a.i, count(DISTINCT b.w) AS common FROM places a JOIN places b ON a.r = b.r AND a.label = b.label AND b.i >= a.i AND b.i < a.i + a.size GROUP BY ALL),
found AS (SELECT r, label, max(common / n) AS containment FROM blocks JOIN sizes USING (label) WHERE common >= ceil({THRESHOLD} * n - 1e-9) GROUP BY ALL),
counted AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
labelled AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM found) GROUP BY r),
best AS (SELECT r, max(containment) AS best FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM listed LEFT JOIN counted USING (r) LEFT JOIN labelled USING (r) LEFT JOIN best USING (r)
"""
