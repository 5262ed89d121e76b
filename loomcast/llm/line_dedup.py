"""Line dedup: a segment-partition edit join. DataFrame functions only.

Lines of at least ``MIN_CHARS`` characters take part. A line is removed if an equal line, or one at an edit distance of at most
``MAX_EDITS``, comes earlier in the order of (doc_id, line number); so the first of each kind stays.

Equal lines meet in one aggregation by 128 bits of hash. For near ones, every distinct line is cut into MAX_EDITS + 1 segments,
of which one must occur unchanged in any line within that distance; its segments are the index, keyed by length, number
and hash. A line probes, for each shorter length within reach, only the few places at which a shared segment can start. Pairs that
meet are compared by a banded bit-parallel edit distance: one machine word holds the band around the diagonal, and each
character of the shorter line moves it by a handful of word operations.

Frequent segments: two lines within the distance that share a segment are still within it without that segment. So what is left is
cut again the same way, ``LEVELS`` times in all, and a key is a chain of segments: lines meet only if they share most of their
characters, not merely a common beginning or end. A key with more than ``CROWD`` indexed lines is hot: it emits no pairs, and what its lines
have left is cut again, until keys are no longer hot or the indexed line has at most MAX_EDITS characters left. There all indexed lines of a key
are within the distance, so that each is paired with the earliest one only. So a line has at most CROWD candidates a key, and no key
emits all its pairs, whatever beginning or end lines have in common.

``clean`` also lets shorter lines that are not blank take part in the exact aggregation, but not in the near one (``short``). ``report`` does not by
default: it follows ORACLE_SQL, where short lines stay.

Defined cases: null reads as empty; blank lines stay; equal rows of the table are one row here and get equal results; extra columns
are kept by ``clean`` and ignored by ``removed``; an empty table gives an empty result. A text that loses all its lines, having lost at
least one, is dropped by ``clean``: nothing but repetition was in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.llm._tables import discard_since, free_name, mark, row_key, written

MIN_CHARS, MAX_EDITS, LEVELS, CROWD, MAX_BROADCAST_ROWS = 24, 1, 2, 8, 500_000


def _bounds(length: Column, number: int, parts: int) -> tuple[Column, Column]:
    """Start (from 1) and size of a segment of a line of this length; the last length % parts ones are longer by one."""
    base, more = F.floor(length / parts), length % parts
    before = F.greatest(F.lit(number) - (parts - more), F.lit(0))
    return base * number + before + 1, base + F.when(F.lit(number) >= parts - more, 1).otherwise(0)


def probes(max_edits: int) -> list[tuple[int, int, int]]:
    """(length difference, segment number, shift): all places where a line must be looked up."""
    out = []
    for gap in range(max_edits + 1):
        for i in range(1, max_edits + 2):
            low = max(-(i - 1), gap - (max_edits + 1 - i))
            high = min(i - 1, gap + (max_edits + 1 - i))
            out += [(gap, i - 1, shift) for shift in range(low, high + 1)]
    return out


def chains(line: Column, size: Column, max_edits: int, levels: int) -> list[tuple[bool, int, Column, Column, Column]]:
    """(in the index, length difference, key, rest of the line, length of the indexed line's rest) of each key of a line."""
    parts = max_edits + 1

    def below(rest: Column, indexed: Column, gap: int, seen: list[Column], left: int) -> list[tuple]:
        if not left:
            return [(gap == 0, gap, F.xxhash64(*seen), rest, indexed)]
        out = []
        for _, i, shift in (x for x in probes(max_edits) if x[0] == gap):
            start, n = _bounds(indexed, i, parts)
            start, n = (start + shift).cast("int"), n.cast("int")
            out += [(own and shift == 0, *more) for own, *more in below(_without(rest, start, n), indexed - n, gap, [*seen, F.lit(i), F.substring(rest, start, n)], left - 1)]
        return out

    return [x for gap in range(max_edits + 1) for x in below(line, size - gap, gap, [size - gap], levels)]


def _without(rest: Column, start: Column, n: Column) -> Column:
    return F.concat(F.substring(rest, F.lit(1), start - 1), F.substring(rest, start + n, F.length(rest)))


def keys(line: Column, size: Column, max_edits: int, levels: int) -> tuple[list[Column], list[Column]]:
    """The hashes under which a line is in the index, and the others under which it looks for lines."""
    found = chains(line, size, max_edits, levels)
    return [x[2] for x in found if x[0]], [x[2] for x in found if not x[0]]


def within(a: Column, b: Column, most: int) -> Column:
    """Whether the edit distance of two strings is at most ``most``: banded, bit-parallel.

    A word's bits are the cells of one column of the matrix around its diagonal, ``most`` above and below it, the lowest row highest. VP
    and VN say where a cell is one more or less than the one above. The distance is followed along the band's lower edge, then
    along the last row.
    """
    width = 2 * most + 2
    top, full = 1 << (width - 1), (1 << width) - 1
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)

    def distance(p: Column, t: Column) -> Column:
        n, m = F.size(p), F.size(t)

        def step(s, j):
            x = F.lit(0)
            for bit in range(width):
                row = j + most - (width - 1) + bit
                x = x + F.when((row >= 0) & (row < n) & (F.get(p, row) == F.get(t, j)), 1 << bit).otherwise(0)
            return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), x.cast("int").alias("x"), j.alias("j"))

        def move(s):
            d0 = (((s["x"].bitwiseAND(s["vp"]) + s["vp"]).bitwiseXOR(s["vp"])).bitwiseOR(s["x"]).bitwiseOR(s["vn"])).bitwiseAND(F.lit(full))
            return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"), d0.alias("d0"), s["j"].alias("j"))

        def settle(s):
            hp = s["vn"].bitwiseOR(F.bitwise_not(s["d0"].bitwiseOR(s["vp"])).bitwiseAND(F.lit(full)))
            hn = s["d0"].bitwiseAND(s["vp"])
            half = F.shiftright(s["d0"], 1)
            # column j: the lower edge of the band is row j + most; from column n - most on, row n - 1 is followed
            back = s["j"] - (n - most) + 1
            cell = F.lit(top)
            for k in range(1, width):
                cell = F.when(back == k, F.lit(top >> k)).otherwise(cell)
            lower = F.when(s["d0"].bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            last = F.when(hp.bitwiseAND(cell) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(cell) != 0, 1).otherwise(0)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(half.bitwiseOR(hp)).bitwiseAND(F.lit(full))).cast("int").alias("vp"),
                half.bitwiseAND(hp).cast("int").alias("vn"),
                (s["d"] + F.when(back > 0, last).otherwise(lower)).cast("int").alias("d"),
            )

        start = ((1 << (most + 1)) - 1) << (width - 1 - most)
        first = F.struct(F.lit(start & full).alias("vp"), F.lit(0).alias("vn"), F.lit(most).alias("d"))

        def one(s, j):
            # each transform binds an expression once, so that it is not computed again for every use
            a = F.transform(F.array(step(s, j)), move)
            return F.get(F.transform(a, settle), 0)

        return F.aggregate(F.sequence(F.lit(0), m - 1), first, one)["d"]

    return F.when(F.length(long) - F.length(short) > most, False).when(F.length(short) <= most, F.levenshtein(a, b) <= most).otherwise(F.get(F.transform(F.array(F.struct(F.split(short, "").alias("p"), F.split(long, "").alias("t"))), lambda s: distance(s["p"], s["t"])), 0) <= most)


def lines_of(documents: DataFrame, min_chars: int, short: bool = False) -> DataFrame:
    """(id, id2, size, line, doc_id, key, pos, at) of every line that takes part; ``short``: all that are not blank.

    ``at`` is doc_id and line number in one number: a fixed-width value, so that its minimum needs no sort.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    wanted = F.length("line") >= min_chars
    wanted = wanted | F.col("line").rlike(r"\S") if short else wanted
    rows = documents.select("doc_id", row_key(F.col("text")).alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(wanted)
    at = F.coalesce("doc_id", F.lit(-(1 << 62))).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + F.col("pos").cast("decimal(10,0)")
    return rows.select(F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("id2"), F.length("line").alias("size"), "line", "doc_id", "key", "pos", at.cast("decimal(36,0)").alias("at"))


def distinct_lines(lines: DataFrame, max_edits: int) -> DataFrame:
    """(id, id2, size, k0.., first, n): one row for equal lines, with their keys, first place and number."""
    own, others = keys(F.col("line"), F.col("size"), max_edits, LEVELS)
    named = [k.alias(f"k{i}") for i, k in enumerate([*own, *others])]
    return lines.select("id", "id2", "size", "at", *named).groupBy("id", "id2", "size", *[f"k{i}" for i in range(len(named))]).agg(F.min("at").alias("first"), F.count("*").alias("n"))


def _met(index: DataFrame, probe: DataFrame) -> DataFrame:
    pairs = index.select("id", "key").alias("i").join(probe.select("id", "key").alias("p"), (F.col("i.key") == F.col("p.key")) & (F.col("i.id") != F.col("p.id")))
    return pairs.select(F.least("i.id", "p.id").alias("a"), F.greatest("i.id", "p.id").alias("b"))


def hot_keys(index: DataFrame) -> tuple[DataFrame, int]:
    """The keys with more than ``CROWD`` indexed lines, and their number."""
    found = written(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("key"))
    return found, found.count()


def branched(rows: DataFrame, max_edits: int) -> DataFrame:
    """The next level's (id, first, own, gap, key, rest, size) rows: what is left of the lines is cut once more."""
    out = []
    for gap, i, shift in probes(max_edits):
        start, n = _bounds(F.col("size"), i, max_edits + 1)
        start, n = (start + shift).cast("int"), n.cast("int")
        child = F.struct((F.col("own") & F.lit(shift == 0)).alias("own"), "gap", F.xxhash64("key", F.lit(i), F.substring("rest", start, n)).alias("key"), _without(F.col("rest"), start, n).alias("rest"), (F.col("size") - n).cast("int").alias("size"))
        out.append(F.when(F.col("gap") == gap, child))
    return rows.select("id", "first", F.explode(F.array_compact(F.array(*out))).alias("x")).select("id", "first", "x.*")


def exhausted(rows: DataFrame, max_edits: int) -> DataFrame:
    """(a, b) under hot keys with at most ``max_edits`` characters left: each line with the earliest, and the longer lines' ones.

    For one edit a longer line's two characters name the one indexed line each that has this character; for more, its pairs with the
    indexed lines, at most one for each string of ``max_edits`` characters, all come out.
    """
    own, others = rows.where("own"), rows.where("not own")
    least = own.groupBy("key").agg(F.min(F.struct("first", "id"))["id"].alias("a"))
    star = own.join(least, "key").where("a <> id").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    if max_edits == 1:
        own = own.select("id", F.xxhash64("key", "rest").alias("key"))
        others = others.select("id", F.explode(F.when(F.col("size") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(F.split("rest", "")))).alias("c"), "key").select("id", F.xxhash64("key", "c").alias("key"))
    return star.union(_met(own, others))


def near_pairs(distinct: DataFrame, lines: DataFrame, max_edits: int, min_chars: int = 0) -> DataFrame:
    """(a, b): hashes of distinct lines of at least ``min_chars`` that meet under a key; a < b.

    A key's hash holds all its segments, so that the keys of all rounds go in one table and meet in the same few joins: the driver's plan does not grow with the rounds.
    """
    distinct = distinct.where(F.col("size") >= min_chars)
    shape = [(own, gap) for own, gap, *_ in chains(F.lit(""), F.lit(0), max_edits, LEVELS)]
    named = [c for c in distinct.columns if c[0] == "k"]
    n_own = sum(own for own, _ in shape)
    index = distinct.select("id", F.explode(F.array(*named[:n_own])).alias("key"))
    probe = distinct.select("id", F.explode(F.array(*named)).alias("key"))
    hot, n_hot = hot_keys(index)
    if not n_hot:
        return _met(index, probe).distinct()
    ids = written(probe.join(_small(hot, n_hot), "key", "left_semi").select("id").distinct())
    texts = lines.where(F.col("size") >= min_chars).join(_small(ids), "id", "left_semi").groupBy("id", "line").agg(F.min("at").alias("first"))
    parts = [F.struct(F.lit(own).alias("own"), F.lit(gap).alias("gap"), key.alias("key"), rest.alias("rest"), size.cast("int").alias("size")) for own, gap, key, rest, size in chains(F.col("line"), F.length("line"), max_edits, LEVELS)]
    rows = texts.select("id", "first", F.explode(F.array(*parts)).alias("x")).select("id", "first", "x.*")
    rows = written(rows.join(_small(hot, n_hot), "key", "left_semi").select("id", "first", "own", "gap", "key", "rest", "size"))
    every_hot, n_every, last = hot, n_hot, rows.where(F.col("size") <= max_edits)
    while n_hot:
        rows = written(branched(rows.where(F.col("size") > max_edits).join(_small(hot, n_hot), "key", "left_semi"), max_edits))
        hot, n_hot = hot_keys(rows.where("own"))
        every_hot, n_every, last = every_hot.union(hot), n_every + n_hot, last.unionByName(rows.where(F.col("size") <= max_edits))
        index, probe = index.union(rows.where("own").select("id", "key")), probe.union(rows.select("id", "key"))
    every_hot = _small(every_hot, n_every)
    last = written(last.join(every_hot, "key", "left_semi"))
    return _met(index.join(every_hot, "key", "left_anti"), probe).union(exhausted(last, max_edits)).distinct()


def _small(table: DataFrame, rows: int | None = None) -> DataFrame:
    """A written table, to be broadcast if its rows (a few numbers each) are counted to be few enough; ``rows``: their number, if it is known."""
    return F.broadcast(table) if (table.count() if rows is None else rows) <= MAX_BROADCAST_ROWS else table


def removed(documents: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS, short: bool = False) -> DataFrame:
    """(doc_id, key, gone): the numbers of the lines to remove from each row that has any; ``short``: exact repeats of any length."""
    began = mark()
    lines = lines_of(documents, min_chars, short)
    distinct = written(distinct_lines(lines, max_edits))
    pairs = written(near_pairs(distinct, lines, max_edits, min_chars if short else 0))
    ends = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = written(lines.join(_small(ends), "id", "left_semi").groupBy("id", "id2", "line").agg(F.min("at").alias("first")))
    left = texts.select(F.col("id").alias("a"), F.col("line").alias("la"), F.col("first").alias("fa"), F.col("id2").alias("a2"))
    right = texts.select(F.col("id").alias("b"), F.col("line").alias("lb"), F.col("first").alias("fb"), F.col("id2").alias("b2"))
    near = pairs.join(left, "a").join(right, "b").where((F.abs(F.length("la") - F.length("lb")) <= max_edits) & (F.col("fa") != F.col("fb")) & within(F.col("la"), F.col("lb"), max_edits))
    later = F.col("fa") < F.col("fb")
    beaten = near.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(later, F.col("b2")).otherwise(F.col("a2")).alias("id2")).distinct().withColumn("near", F.lit(True))
    judged = distinct.select("id", "id2", "first", "n").join(written(beaten), ["id", "id2"], "left").where((F.col("n") > 1) | F.col("near"))
    judged = written(judged.select("id", "id2", "first", F.coalesce("near", F.lit(False)).alias("near")))
    discard_since(documents.sparkSession, began, judged)
    gone = lines.select("id", "id2", "at", "doc_id", "key", "pos").join(_small(judged), ["id", "id2"]).where(F.col("near") | (F.col("at") != F.col("first")))
    return gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))


def report(documents: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS) -> DataFrame:
    """(doc_id, n_lines, n_kept, removed) of every row; ``removed``: line numbers from 0, comma-joined."""
    gone = removed(documents, min_chars, max_edits).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "gone")
    rows = documents.select("doc_id", row_key(F.col("text")).alias("key"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines"))
    both = rows.join(gone, rows["doc_id"].eqNullSafe(gone["d"]) & (rows["key"] == gone["k"]), "left")
    numbers = F.coalesce("gone", F.array().cast("array<int>"))
    return both.select("doc_id", "n_lines", (F.col("n_lines") - F.size(numbers)).alias("n_kept"), F.array_join(numbers.cast("array<string>"), ",").alias("removed"))


def clean(documents: DataFrame, min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS, short: bool = True) -> DataFrame:
    """The documents, all columns, without the removed lines, and without the texts that have nothing left."""
    mine, d, k, gone, left = (free_name(documents, x) for x in ("_key", "_d", "_k", "_gone", "_text"))
    away = removed(documents, min_chars, max_edits, short).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.col("gone").alias(gone))
    both = documents.withColumn(mine, row_key(F.col("text")))
    both = both.join(away, both["doc_id"].eqNullSafe(away[d]) & (both[mine] == away[k]), "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    both = both.withColumn(left, F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept))
    both = both.where(F.col(gone).isNull() | (F.trim(F.regexp_replace(left, r"\s+", " ")) != ""))
    return both.select(*[F.col(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in documents.columns])


ORACLE_SQL = f"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT DISTINCT doc_id, text AS t, pos, line FROM (
    SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line FROM rows)
  WHERE length(line) >= {MIN_CHARS}),
firsts AS (SELECT line, length(line) AS size, min((doc_id, pos)) AS f FROM lines GROUP BY line),
halves AS (
  SELECT line, size, f, left(line, CAST(size // 2 AS INTEGER)) AS h, 0 AS side, size // 2 AS hs FROM firsts
  UNION ALL SELECT line, size, f, right(line, CAST(size - size // 2 AS INTEGER)), 1, size - size // 2 FROM firsts
  UNION ALL SELECT line, size, f, left(line, CAST((size - 1) // 2 AS INTEGER)), 0, (size - 1) // 2 FROM firsts
  UNION ALL SELECT line, size, f, right(line, CAST((size - 1) - (size - 1) // 2 AS INTEGER)), 1, (size - 1) - (size - 1) // 2 FROM firsts),
near AS (
  SELECT DISTINCT b.line FROM halves a JOIN halves b ON a.h = b.h AND a.side = b.side AND a.line <> b.line AND abs(a.size - b.size) <= 1
  WHERE a.f < b.f AND levenshtein(a.line, b.line) <= {MAX_EDITS}),
gone AS (
  SELECT l.doc_id, l.t, l.pos FROM lines l JOIN firsts f USING (line) LEFT JOIN near n USING (line)
  WHERE n.line IS NOT NULL OR (l.doc_id, l.pos) <> f.f),
lists AS (SELECT doc_id, t, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id, t)
SELECT r.doc_id, CAST(len(string_split(r.text, chr(10))) AS BIGINT) AS n_lines,
  CAST(len(string_split(r.text, chr(10))) - coalesce(g.n, 0) AS BIGINT) AS n_kept, coalesce(g.removed, '') AS removed
FROM rows r LEFT JOIN lists g ON g.doc_id = r.doc_id AND g.t = r.text
"""
