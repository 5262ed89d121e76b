r"""Personal data: fixed patterns, and bootstrapped contextual extraction on top of them. DataFrame functions only.

Seed entities are the matches of the fixed patterns, and of the other tokens with a digit or an at sign (the candidates) those whose form
alone tells a secret: access key ids, hexadecimal digests, values assigned to a word for a secret. Each occurrence of a seed or
candidate has lexical patterns: one and two words left of it, one and two right of it, the words on both sides together, the name
inside the token that a value is assigned to, and its shape (character classes and length). In the graph of patterns and distinct instances, a
pattern's confidence in a kind is the share of its instances that the kind's scores hold, and an instance's score is the noisy-or of
its patterns' confidences. Some rounds of this, in Spark, score both. Secret seeds become spans of kind ``secret``; other candidates of high score,
where they occur with a pattern of high confidence, are identifiers that no form told, and become spans of kind ``found``.

Matches are located without a user function: a text split at a pattern gives the stretches between its matches, and the running
sums of their lengths give the places, in work that grows with the number of matches. The expressions are possessive and anchored at the
start of a run of the class they begin with, which finds the same leftmost matches without going back over long runs. A
candidate that overlaps a fixed match is left out, and so is one that overlaps a match that failed its check though of the kind's length (a card
number with a wrong check digit is known not to be one); this is counted on sorted places.

Defined cases: null reads as empty, which has no spans; equal rows give equal results, also with equal or null ids; an identifier that
occurs often counts once in the graph; very long texts are read whole, a context has at most ``CONTEXT`` characters and ends at the next
match; extra columns are ignored; an empty table gives an empty result; places are code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm._arrays import bound, numbers_below, sums_before
from loomcast.llm._tables import discard_since, lower_ascii, mark, row_key, written

_LOCAL = "A-Za-z0-9._%+-"
_WS = r"\t\n\x0B\f\r "
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "other": rf"(?<![^{_WS}])[^{_WS}0-9@]*+[0-9@][^{_WS}]*+",
}
#: What a seed of kind ``secret`` looks like, lower-cased; by form, and by the word that it is assigned to.
SECRETS = (r"^a[ks]ia[0-9a-z]{16}$", r"^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$", rf"^[a-z_-]*(password|passwd|pwd|secret|token|api_?key|access_?key)[^a-z0-9{_WS}]{{1,3}}[^{_WS}]{{8,}}$")
ROUNDS, LEAST_CONFIDENCE, LEAST_SUPPORT, LEAST_SCORE, CONTEXT = 3, 0.6, 5, 0.8, 48
_MATCHES = "array<struct<start:bigint,end:bigint,value:string,left:string,right:string,ok:boolean>>"


def _luhn(digits: Column) -> Column:
    def add(total, i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    """Whether a match counts: true, false if it fails though of the right length, null if it is something else."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return bound(F.translate(m, " -", ""), lambda plain: F.when(F.length(plain).between(14, 19), _luhn(plain)))
    return F.length(F.regexp_replace(m, "[^0-9]", "")).between(10, 15) if kind == "phone" else F.lit(True)


def _located(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, left, right, ok>> of the matches that are valid, or fail though of the right length."""
    pattern = PATTERNS[kind]

    def place(s: Column) -> Column:
        m, gaps = s["m"], s["gaps"]
        sizes = F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))

        def at(before: Column) -> Column:
            def one(x: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(gaps, i))
                return bound(start, lambda b: F.struct(b.alias("start"), (b + F.length(x)).alias("end"), x.alias("value"), F.substring(F.get(gaps, i), -CONTEXT, CONTEXT).alias("left"), F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("right"), _valid(kind, x).alias("ok")))

            return F.transform(m, one)

        return F.filter(bound(sums_before(sizes), at), lambda x: x["ok"].isNotNull())

    none = F.array().cast(_MATCHES)
    some = lambda m: F.when(F.size(m) > 0, bound(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("gaps")), place)).otherwise(none)
    sign = {"email": text.contains("@"), "phone": text.contains("+"), "other": text.rlike("[0-9@]")}.get(kind, text.rlike("[0-9]"))
    return F.when(sign, bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), some)).otherwise(none)


def _apart(other: Column, known: Column) -> Column:
    """The candidates that overlap no known match; both are lists of places, the candidates in order and apart from each other."""

    def keep(s: Column) -> Column:
        begun = numbers_below(F.transform(s["known"], lambda k: k["start"]), F.transform(s["other"], lambda c: c["end"]), False)
        ended = numbers_below(F.transform(s["known"], lambda k: k["end"]), F.transform(s["other"], lambda c: c["start"]), True)
        return bound(F.struct(begun.alias("begun"), ended.alias("ended")), lambda n: F.filter(s["other"], lambda c, i: F.get(n["begun"], i) == F.get(n["ended"], i)))

    return F.when((F.size(other) > 0) & (F.size(known) > 0), bound(F.struct(other.alias("other"), known.alias("known")), keep)).otherwise(other)


def entities(documents: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, other): the located fixed matches, and the candidates outside them."""
    base = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = base.select("doc_id", row_key(F.col("text")).alias("key"), *[_located(F.col("text"), k).alias(k) for k in PATTERNS])
    known = F.concat(*[F.transform(k, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"))) for k in KINDS])
    return found.select("doc_id", "key", *[F.filter(k, lambda e: e["ok"]).alias(k) for k in KINDS], _apart(F.col("other"), known).alias("other"))


def _shape(value: Column) -> Column:
    classes = [F.when(value.rlike(c), F.lit(x)).otherwise("") for c, x in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "9"), ("[^A-Za-z0-9]", "."))]
    return F.concat(F.lit("S:"), *classes, F.length(value).cast("string"))


def _patterns(value: Column, left: Column, right: Column) -> Column:
    """The lexical patterns of an occurrence: names of words and shapes, digits masked."""
    plain = lambda x: F.regexp_replace(lower_ascii(x), "[0-9]+", "0")
    word, gap = f"[^{_WS}]+", f"[{_WS}]"

    def around(s: Column) -> Column:
        l1, l2 = F.regexp_extract(s["l"], f"({word}){gap}*$", 1), F.regexp_extract(s["l"], f"({word}{gap}+{word}){gap}*$", 1)
        r1, r2 = F.regexp_extract(s["r"], f"^{gap}*({word})", 1), F.regexp_extract(s["r"], f"^{gap}*({word}{gap}+{word})", 1)
        name = F.regexp_extract(lower_ascii(value), "^([a-z_-]{2,20})[=:]", 1)
        both = bound(F.struct(l1.alias("l1"), r1.alias("r1")), lambda w: F.when((w["l1"] != "") & (w["r1"] != ""), F.concat(F.lit("LR:"), w["l1"], F.lit(" "), w["r1"])))
        named = lambda k: lambda w: F.when(w != "", F.concat(F.lit(k), w))
        some = [bound(x, named(k)) for k, x in (("L1:", l1), ("L2:", l2), ("R1:", r1), ("R2:", r2), ("P:", name))]
        return F.array_compact(F.array(*some, both, _shape(value)))

    return bound(F.struct(plain(left).alias("l"), plain(right).alias("r")), around)


def _core(value: Column) -> Column:
    """A token without the marks around it."""
    return F.regexp_replace(F.regexp_replace(value, "^[^A-Za-z0-9+]+", ""), "(?<=[A-Za-z0-9])[^A-Za-z0-9]+$", "")


def candidates(found: DataFrame, secrets: tuple[str, ...] = SECRETS) -> DataFrame:
    """(doc_id, key, start, end, instance, secret, left, right) of the candidates."""
    rows = found.select("doc_id", "key", F.explode("other").alias("e")).select("doc_id", "key", "e.start", "e.value", "e.left", "e.right", _core(F.col("e.value")).alias("instance"))
    # a number of a card's length with a wrong check digit is known not to be one, also where the fixed pattern ran it together with another
    wrong = F.when(F.col("instance").rlike("^[0-9]{14,19}$"), ~_luhn(F.col("instance"))).otherwise(False)
    rows = rows.where(F.col("instance").rlike("[A-Za-z0-9]") & ~wrong)
    start = F.col("start") + F.length(F.regexp_extract("value", "^[^A-Za-z0-9+]*", 0))
    low = lower_ascii(F.col("instance"))
    secret = low.rlike("|".join(secrets)) & low.rlike("[a-z]")
    return rows.select("doc_id", "key", start.alias("start"), (start + F.length("instance")).alias("end"), "instance", secret.alias("secret"), "left", "right")


def discover(found: DataFrame, rounds: int = ROUNDS, secrets: tuple[str, ...] = SECRETS) -> DataFrame:
    """(doc_id, key, start, end, kind): secret seeds, and candidates that the bootstrapped patterns accept."""
    typed = lambda k: lambda e: F.struct(F.lit(k).alias("kind"), e["value"].alias("instance"), e["left"].alias("left"), e["right"].alias("right"))
    kinds = F.concat(*[F.transform(k, typed(k)) for k in KINDS])
    seen = found.select(F.explode(kinds).alias("x")).select("x.*")
    other = written(candidates(found, secrets))
    began = mark()
    seeds = written(seen.select("instance", "kind").union(other.where("secret").select("instance", F.lit("secret"))).distinct().withColumn("score", F.lit(1.0)))
    listed = _patterns(F.col("instance"), F.col("left"), F.col("right"))
    edges = written(seen.select("instance", "left", "right").union(other.select("instance", "left", "right")).select("instance", F.explode(listed).alias("pattern")).distinct())
    degree = written(edges.groupBy("pattern").agg(F.count("*").alias("degree")).where(F.col("degree") >= LEAST_SUPPORT))
    instances, patterns = seeds, None
    for _ in range(rounds):
        held = edges.join(instances, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("support")).where(F.col("support") >= LEAST_SUPPORT)
        patterns = written(held.join(degree, "pattern").select("pattern", "kind", (F.col("support") / (F.col("degree") + 1)).alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE))
        reached = edges.join(patterns, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
        instances = written(reached.unionByName(seeds).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    good = instances.where(F.col("score") >= LEAST_SCORE).select("instance", "kind")
    # one row an (instance, pattern), so that frequent words multiply nothing
    accepted = written(edges.join(patterns.select("pattern", "kind"), "pattern").join(good, ["instance", "kind"]).select("instance", "pattern").distinct())
    discard_since(found.sparkSession, began, accepted)
    shown = other.where("not secret").select("doc_id", "key", "start", "end", "instance", F.explode(listed).alias("pattern"))
    new = shown.join(accepted, ["instance", "pattern"], "left_semi").select("doc_id", "key", "start", "end").distinct()
    return other.where("secret").select("doc_id", "key", "start", "end", F.lit("secret").alias("kind")).distinct().union(new.withColumn("kind", F.lit("found")))


def spans(documents: DataFrame, secrets: tuple[str, ...] = SECRETS) -> DataFrame:
    """(doc_id, n_email.., base, spans): arrays of struct<start, rank, kind, end>, in order of start and kind."""
    found = written(entities(documents))
    rank = F.when(F.col("kind") == "secret", len(KINDS)).otherwise(len(KINDS) + 1)
    extra = discover(found, secrets=secrets).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end")).alias("extra"))
    placed = lambda r, k: lambda e: F.struct(e["start"].alias("start"), F.lit(r).alias("rank"), F.lit(k).alias("kind"), e["end"].alias("end"))
    base = F.sort_array(F.concat(*[F.transform(k, placed(r, k)) for r, k in enumerate(KINDS)]))
    sizes = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    rows = found.select("doc_id", "key", *sizes, base.alias("base"))
    rows = rows.join(extra, rows["doc_id"].eqNullSafe(extra["d"]) & (rows["key"] == extra["k"]), "left")
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], "base", F.sort_array(F.concat("base", F.coalesce("extra", F.slice("base", 1, 0)))).alias("spans"))


def joined(spans_column: str) -> Column:
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and n_secret, n_found and n_spans."""
    of = lambda k: lambda s: s["kind"] == k
    more = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in ("secret", "found")]
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), *more, F.size("spans").cast("long").alias("n_spans"))


def _sql_round(k: int) -> str:
    """One round of scoring in SQL: patterns p{k} from the instances i{k-1}, then instances i{k}."""
    return f"""
p{k} AS MATERIALIZED (SELECT pattern, kind, support / (degree + 1) AS confidence FROM (SELECT pattern, kind, sum(score) AS support FROM edges JOIN i{k - 1} USING (instance) GROUP BY ALL) JOIN degree USING (pattern)
  WHERE support >= {LEAST_SUPPORT} AND degree >= {LEAST_SUPPORT} AND support / (degree + 1) >= {LEAST_CONFIDENCE}),
i{k} AS MATERIALIZED (SELECT instance, kind, max(score) AS score FROM (SELECT instance, kind, 1 - exp(sum(ln(1 - confidence))) AS score FROM edges JOIN p{k} USING (pattern) GROUP BY ALL UNION ALL FROM i0) GROUP BY ALL)"""


def _sql_luhn(digits: str) -> str:
    return f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN 2 * CAST(c AS INTEGER) - 9 ELSE 2 * CAST(c AS INTEGER) END)) % 10 = 0"


def _sql_kind(kind: str, rank: int, rx: str) -> str:
    return f"SELECT r, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{rx}') AS m, string_split_regex(t, '{rx}') AS gaps FROM texts"


_SQL_WS = r"\t\n\x0B\f\r "
_SQL_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "other": rf"[^{_SQL_WS}0-9@]*[0-9@][^{_SQL_WS}]*",
}
_SQL_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = f"""
WITH texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matched AS ({" UNION ALL ".join(_sql_kind(k, n, rx) for n, (k, rx) in enumerate(_SQL_PATTERNS.items()))}),
listed AS (SELECT r, rank, kind, unnest(m) AS v, unnest(gaps[:len(m)]) AS gap, unnest(gaps[2:]) AS after, generate_subscripts(m, 1) AS k FROM matched WHERE len(m) > 0),
places AS (SELECT *, coalesce(sum(length(gap) + length(v)) OVER (PARTITION BY r, rank ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(gap) AS a, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM listed),
judged AS MATERIALIZED (
  SELECT r, rank, kind, v, right(gap, {CONTEXT}) AS l, left(after, {CONTEXT}) AS rt, CAST(a AS BIGINT) AS a, CAST(a + length(v) AS BIGINT) AS z,
    CASE kind WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0
      WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
      WHEN 'card' THEN CASE WHEN length(digits) BETWEEN 14 AND 19 THEN {_sql_luhn('digits')} END
      ELSE true END AS ok FROM places),
base AS (SELECT * FROM judged WHERE rank < {len(KINDS)} AND ok),
tokens AS (SELECT o.r, o.a + length(regexp_extract(o.v, '^[^A-Za-z0-9+]*')) AS a, regexp_replace(regexp_replace(o.v, '^[^A-Za-z0-9+]+', ''), '[^A-Za-z0-9]+$', '') AS v, o.l, o.rt FROM judged o
  WHERE o.rank = {len(KINDS)} AND NOT EXISTS (SELECT 1 FROM judged b WHERE b.r = o.r AND b.rank < {len(KINDS)} AND b.ok IS NOT NULL AND b.a < o.z AND o.a < b.z)),
other AS MATERIALIZED (SELECT r, a, a + length(v) AS z, v, l, rt, regexp_matches(translate(v, {_SQL_LOW}), '{"|".join(SECRETS)}') AND regexp_matches(v, '[A-Za-z]') AS secret FROM tokens
  WHERE regexp_matches(v, '[A-Za-z0-9]') AND NOT CASE WHEN regexp_matches(v, '^[0-9]{{14,19}}$') THEN NOT ({_sql_luhn('v')}) ELSE false END),
occ AS (SELECT v AS instance, l, rt FROM base UNION ALL SELECT v, l, rt FROM other),
plain AS (SELECT DISTINCT instance, regexp_replace(translate(l, {_SQL_LOW}), '[0-9]+', '0', 'g') AS l, regexp_replace(translate(rt, {_SQL_LOW}), '[0-9]+', '0', 'g') AS rt FROM occ),
words AS (SELECT instance, regexp_extract(l, '([^{_SQL_WS}]+)[{_SQL_WS}]*$', 1) AS l1, regexp_extract(l, '([^{_SQL_WS}]+[{_SQL_WS}]+[^{_SQL_WS}]+)[{_SQL_WS}]*$', 1) AS l2,
  regexp_extract(rt, '^[{_SQL_WS}]*([^{_SQL_WS}]+)', 1) AS r1, regexp_extract(rt, '^[{_SQL_WS}]*([^{_SQL_WS}]+[{_SQL_WS}]+[^{_SQL_WS}]+)', 1) AS r2, regexp_extract(translate(instance, {_SQL_LOW}), '^([a-z_-]{{2,20}})[=:]', 1) AS name FROM plain),
edges AS MATERIALIZED (SELECT DISTINCT instance, pattern FROM (SELECT instance, unnest([CASE WHEN l1 <> '' THEN 'L1:' || l1 END, CASE WHEN l2 <> '' THEN 'L2:' || l2 END, CASE WHEN r1 <> '' THEN 'R1:' || r1 END, CASE WHEN r2 <> '' THEN 'R2:' || r2 END,
  CASE WHEN l1 <> '' AND r1 <> '' THEN 'LR:' || l1 || ' ' || r1 END, CASE WHEN name <> '' THEN 'P:' || name END,
  'S:' || CASE WHEN regexp_matches(instance, '[a-z]') THEN 'a' ELSE '' END || CASE WHEN regexp_matches(instance, '[A-Z]') THEN 'A' ELSE '' END || CASE WHEN regexp_matches(instance, '[0-9]') THEN '9' ELSE '' END || CASE WHEN regexp_matches(instance, '[^A-Za-z0-9]') THEN '.' ELSE '' END || length(instance)]) AS pattern FROM words) WHERE pattern IS NOT NULL),
degree AS (SELECT pattern, count(*) AS degree FROM edges GROUP BY pattern),
i0 AS MATERIALIZED (SELECT DISTINCT v AS instance, kind, 1.0::DOUBLE AS score FROM base UNION SELECT v, 'secret', 1.0::DOUBLE FROM other WHERE secret),{",".join(_sql_round(k) for k in range(1, ROUNDS + 1))},
accepted AS (SELECT DISTINCT instance, pattern FROM edges JOIN p{ROUNDS} p USING (pattern) JOIN i{ROUNDS} i USING (instance, kind) WHERE score >= {LEAST_SCORE}),
shown AS (SELECT r, a, z, v AS instance, regexp_replace(translate(l, {_SQL_LOW}), '[0-9]+', '0', 'g') AS l, regexp_replace(translate(rt, {_SQL_LOW}), '[0-9]+', '0', 'g') AS rt FROM other WHERE NOT secret),
found AS (SELECT DISTINCT r, a, z FROM shown s JOIN accepted USING (instance) WHERE pattern[:2] IN ('P:', 'S:') OR pattern = 'L1:' || regexp_extract(l, '([^{_SQL_WS}]+)[{_SQL_WS}]*$', 1) OR pattern = 'L2:' || regexp_extract(l, '([^{_SQL_WS}]+[{_SQL_WS}]+[^{_SQL_WS}]+)[{_SQL_WS}]*$', 1)
  OR pattern = 'R1:' || regexp_extract(rt, '^[{_SQL_WS}]*([^{_SQL_WS}]+)', 1) OR pattern = 'R2:' || regexp_extract(rt, '^[{_SQL_WS}]*([^{_SQL_WS}]+[{_SQL_WS}]+[^{_SQL_WS}]+)', 1)
  OR pattern = 'LR:' || regexp_extract(l, '([^{_SQL_WS}]+)[{_SQL_WS}]*$', 1) || ' ' || regexp_extract(rt, '^[{_SQL_WS}]*([^{_SQL_WS}]+)', 1)),
spans AS (SELECT r, a, rank, kind, z FROM base UNION ALL SELECT DISTINCT r, a, {len(KINDS)}, 'secret', z FROM other WHERE secret UNION ALL SELECT r, a, {len(KINDS) + 1}, 'found', z FROM found),
texted AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in (*KINDS, "secret", "found"))}, count(*) AS n_spans, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank, z) AS spans,
  string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, rank, z) FILTER (rank < {len(KINDS)}) AS base FROM spans GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*KINDS, "secret", "found", "spans"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN texted USING (r)
"""
