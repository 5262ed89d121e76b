"""MinHash near-dedup by a chosen-path set similarity join.

A text's set is its distinct shingles of ``WORDS`` words (hashed to 64 bits). Texts with equal sets are one class, and a class has ``TOKENS``
minwise tokens: token i is (i, the least i-th hash of the set). Independent trees branch the classes recursively: a node selects
token numbers by its own hash, and a class goes to the child of each selected token that it has, so that two classes share a child with
their similarity as probability. Nodes of at most ``SMALL`` classes are compared exhaustively; larger ones branch again, each to ``BRANCHES``
tokens. From level ``DEPTH`` on, nodes of at most ``BLOCK`` classes are compared, and larger ones branch to one token or, a quarter of them, to two:
1.25 on average, so that a pair of similarity 0.8 keeps one common node on average while the number of rows grows slowly. A node that
keeps ``STUCK`` of its parent's classes holds near-equal ones that no token parts: it goes as a whole to the full comparison, as do the last level's nodes
over ``BLOCK``: no pair of them is lost. Two classes of similarity 0.8 meet in a leaf with a probability of over 1 - 1e-6 if their nodes get small
at the first level, and over 0.999 if they go on.

Comparison estimates the similarity from the tokens; what it lets through (``ESTIMATE``, four standard errors below the threshold) makes
a forest of candidate links for each leaf, and the forests' components are candidate groups. A group's texts meet once: all pairs that
the estimate lets through and that no link connects yet are compared on full sets, in memory, and only links that span the group's
components come out. A group over ``BLOCK`` classes or ``BLOCK_SHINGLES`` shingles is compared in two steps. First it is split into blocks, each a task
with the group's ``PIVOTS`` pivots added, so that copies of one text come together with one copy of each text sent. Then only the classes
outside the group's largest component still have open pairs: they, in blocks, meet every block of the group, each such pair of blocks in a task of its own.
Components come from repeated least labels with shortcuts; no link or component leaves the executors.

Defined cases: null, empty and wordless texts have empty sets and link with nothing; rows of null id have kept false; in
``without_copies`` one of them stays where no row of their component has an id; rows of equal id are separate rows with the same id, of which
``without_copies`` keeps those of one text (rows equal in id and text stay together); repeated rows are exact copies; very long texts are read
whole, and one over the bounds of a block is a block of its own; extra columns are ignored; an empty table gives an empty result. Class ids are 64-bit
hashes of the set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from loomcast.llm import _text
from loomcast.llm._tables import discard, discard_since, free_name, mark, row_key, written

WORDS, PERCENT = 4, 80
TOKENS, TREES, BRANCHES, DEPTH, SMALL, BLOCK, BLOCK_SHINGLES, ESTIMATE = 64, 6, 2, 3, 64, 4096, 4_000_000, 0.6
MOST_LEVELS, STUCK, PIVOTS = 16, 0.9, 8
MAX_BROADCAST_ROWS = 500_000
_SALTS = _text.mix(np.arange(1, TOKENS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_MULTIPLY = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingles(raw: np.ndarray, off: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and the texts' bounds among them."""
    mapped = _text.SPACED[raw]
    w = _text.words(mapped, off)
    h = _text.span_hashes(mapped, w.start, w.end)
    n = w.counts
    grams = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    for k in range(words):
        grams += h[k : len(h) - words + 1 + k] * _MULTIPLY[k % 8] if len(grams) else grams
    grams = _text.mix(grams)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i, (a, z) in enumerate(zip(w.bounds[:-1].tolist(), w.bounds[1:].tolist(), strict=True)):
        if z - a >= words:
            own = grams[a : z - words + 1].copy()
            own.sort()
            if len(own) > 1:
                own = own[np.append(True, own[1:] != own[:-1])]
        elif z > a:
            own = np.array([z - a], np.uint64)
            for k in range(a, z):
                own = _text.mix(own * _MULTIPLY[1] + h[k : k + 1])
        else:
            continue
        out.append(own)
        sizes[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(sizes)))


def _ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set; 0 for empty ones."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_text.mix(sets ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    sums = total[bounds[1:]] - total[bounds[:-1]]
    ids = _text.mix(sums + np.diff(bounds).astype(np.uint64)).view(np.int64)
    return np.where(np.diff(bounds) > 0, np.where(ids == 0, 1, ids), 0)


def _tokens(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, TOKENS): the upper halves of the least hashes."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((len(bounds) - 1, TOKENS), np.uint32)
    if len(full):
        starts = bounds[:-1][full]
        for k in range(TOKENS):
            x = (sets ^ _SALTS[k]) * _MULTIPLY[k % 8]
            x ^= x >> np.uint64(31)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            out[full, k] = (np.minimum.reduceat(x, starts) >> np.uint64(32)).astype(np.uint32)
    return out


def signatures(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, n_shingles, class, tokens) of every row; class null for empty sets."""
    def run(batches):
        for b in _text.small(batches, 2):
            n, c, t = [], [], []
            for _, _, raw, off in _text.chunks(b.column(2)):
                sets, bounds = shingles(raw, off, words)
                n.append(np.diff(bounds))
                c.append(_ids(sets, bounds))
                t += [x.tobytes() for x in _tokens(sets, bounds)]
            c = np.concatenate(c) if c else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n) if n else c, pa.int64()), pa.array(c, pa.int64(), mask=c == 0), pa.array(t, pa.binary())], names=["doc_id", "key", "n_shingles", "class", "tokens"])

    return documents.select("doc_id", row_key(F.col("text")).alias("key"), "text").mapInArrow(_text.released(run), "doc_id long, key long, n_shingles long, class long, tokens binary")


def _rows(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.array([np.frombuffer(x, np.uint32) for x in column.to_pylist()], np.uint32).reshape(len(column), TOKENS)


def _children(nodes: np.ndarray, tokens: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The child of each row under the token number that its node selects in a draw."""
    number = (_text.mix(nodes + draw * _MULTIPLY[2]) % np.uint64(TOKENS)).astype(np.int64)
    value = tokens[np.arange(len(tokens)), number].astype(np.uint64)
    return _text.mix(nodes * _MULTIPLY[0] + value * _MULTIPLY[3] + number.astype(np.uint64) + np.uint64(1)).view(np.int64)


def _branch(rows: DataFrame, level: int) -> DataFrame:
    """(class, node, above) of all children of (class, tokens, node, size); level 0 starts all trees. ``above``: the size of the node above."""

    def run(batches):
        for b in batches:
            tokens = _rows(b.column(1))
            for start in range(TREES) if level == 0 else (0,):
                nodes = np.full(len(tokens), _SALTS[start], np.uint64) if level == 0 else b.column(2).to_numpy().view(np.uint64)
                above = pa.array(np.zeros(len(tokens), np.int64)) if level == 0 else b.column(3)
                for k in range(BRANCHES):
                    # from level DEPTH on, only a quarter of the nodes go to more than one child
                    taken = np.ones(len(tokens), bool) if level < DEPTH or k == 0 else _text.mix(nodes ^ _MULTIPLY[4]) % np.uint64(4) == 0
                    yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_children(nodes, tokens, np.uint64(k + 1)), pa.int64()), above], names=["class", "node", "above"]).filter(pa.array(taken))

    return rows.select("class", "tokens", *([] if level == 0 else ["node", "size"])).mapInArrow(_text.released(run), "class long, node long, above long")


def leaves(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(class, node): the members of all leaves to compare, of two classes or more each; and (class, node) of the larger nodes that no token parts."""
    out = large = None
    rows = _branch(classes, 0)
    for level in range(1, MOST_LEVELS + 1):
        rows = written(rows.distinct() if level > 1 else rows)
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        met = rows.join(sizes, "node")
        fits = F.col("size") <= (SMALL if level < DEPTH else BLOCK)
        whole = F.lit(level == MOST_LEVELS) | (F.lit(level >= DEPTH) & (F.col("size") >= STUCK * F.col("above")))
        small, stuck = met.where(fits).select("class", "node"), met.where(~fits & whole).select("class", "node")
        out = small if out is None else out.unionByName(small)
        large = stuck if large is None else large.unionByName(stuck)
        open_ = met.where(~fits & ~whole)
        if level == MOST_LEVELS or (level >= DEPTH and open_.isEmpty()):
            break
        rows = _branch(open_.join(classes, "class"), level)
    return out, large


def stars(large: DataFrame) -> DataFrame:
    """(a, b): the least class of each node, and each of its other ones. These candidate links keep a node together without comparing it."""
    least = large.groupBy("node").agg(F.min("class").alias("a"))
    return large.join(least, "node").where("class <> a").select("a", F.col("class").alias("b"))


def _similar(n: np.ndarray, tokens: np.ndarray, at: int) -> np.ndarray:
    """The places after ``at`` whose estimated similarity and size fit."""
    same = (tokens[at + 1 :] == tokens[at]).sum(axis=1)
    size = n[at + 1 :]
    return np.flatnonzero((same >= ESTIMATE * TOKENS) & (np.minimum(size, n[at]) * 100 >= np.maximum(size, n[at]) * PERCENT)) + at + 1


def _merge(label: np.ndarray, at: int, near: np.ndarray) -> list[int]:
    """Joins the labels of ``near`` to that of ``at``; one place of each label that was another."""
    other, first = np.unique(label[near], return_index=True)
    out = []
    for x, i in zip(other.tolist(), first.tolist(), strict=True):
        if x != label[at]:
            out.append(int(near[i]))
            label[label == x] = label[at]
    return out


def _runs(batches, key: str, compare):
    """Calls ``compare`` with the rows of each key, of batches sorted by it; a key may go over several batches."""
    held: list[pa.RecordBatch] = []

    def flush(last: bool):
        nonlocal held
        t = pa.Table.from_batches(held).combine_chunks()
        keys = t[key].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        end = np.append(edge[1:], len(keys))
        if not last:  # the last key may go on
            held = t.slice(int(edge[-1])).to_batches()
            edge, end = edge[:-1], end[:-1]
        found = {p for a, z in zip(edge.tolist(), end.tolist(), strict=True) if z - a > 1 for p in compare(t.slice(a, z - a))}
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= BLOCK:
            yield flush(False)
    if held:
        yield flush(True)


def candidates(members: DataFrame) -> DataFrame:
    """(a, b) of (class, node, n, tokens) rows: in each leaf, a forest that spans what the estimates connect."""

    def compare(t: pa.Table) -> list[tuple[int, int]]:
        c, n, tokens = t["class"].to_numpy(), t["n"].to_numpy(), _rows(t["tokens"])
        order = np.argsort(c, kind="stable")
        c, n, tokens, label, out = c[order], n[order], tokens[order], np.arange(len(c)), []
        for j in range(len(c) - 1):
            near = _similar(n, tokens, j)
            out += [(int(c[j]), int(c[i])) for i in _merge(label, j, near)]
        return out

    return members.repartition("node").sortWithinPartitions("node").mapInArrow(_text.released(lambda batches: _runs(batches, "node", compare)), "a long, b long").distinct()


class _Sets:
    """The sets of one task; ``common`` counts what one of them shares with others."""

    def __init__(self, sets: np.ndarray, bounds: np.ndarray):
        self.sets, self.bounds, self.posting = sets, bounds, None

    def common(self, at: int, others: np.ndarray) -> np.ndarray:
        own = self.sets[self.bounds[at] : self.bounds[at + 1]]
        if len(others) < 16:
            return np.array([len(np.intersect1d(own, self.sets[self.bounds[i] : self.bounds[i + 1]], assume_unique=True)) for i in others], np.int64)
        if self.posting is None:  # rows by element, in one order
            order = np.argsort(self.sets, kind="stable")
            self.element = self.sets[order]
            self.posting = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[order]
        low, high = np.searchsorted(self.element, own, "left"), np.searchsorted(self.element, own, "right")
        many = high - low
        rows = self.posting[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)]
        return np.bincount(rows, minlength=len(self.bounds) - 1)[others]


def confirmed(groups: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b) of (class, task, text) rows: the links, on full sets, that span each task's components."""

    def compare(t: pa.Table) -> list[tuple[int, int]]:
        order = np.argsort(t["class"].to_numpy(), kind="stable")
        c = t["class"].to_numpy()[order]
        parts = [shingles(raw, off, words) for _, _, raw, off in _text.chunks(t["text"].combine_chunks().take(pa.array(order)))]
        n = np.concatenate([np.diff(b) for _, b in parts])
        sets, bounds = np.concatenate([s for s, _ in parts]), np.concatenate(([0], np.cumsum(n)))
        full, tokens, label, out = _Sets(sets, bounds), _tokens(sets, bounds), np.arange(len(c)), []
        for j in range(len(c) - 1):
            near = _similar(n, tokens, j)
            near = near[label[near] != label[j]]
            if len(near):
                common = full.common(j, near)
                near = near[100 * common >= PERCENT * (n[j] + n[near] - common)]
                out += [(int(c[j]), int(c[i])) for i in _merge(label, j, near)]
        return out

    return groups.repartition("task").sortWithinPartitions("task").mapInArrow(_text.released(lambda batches: _runs(batches, "task", compare)), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(class, label) of every class in a link (a, b): the least class that it reaches. Labels only fall, so that the rounds end."""
    spark = links.sparkSession
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "class"))
    before = labels
    while True:
        near = edges.join(labels.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near.withColumnRenamed("a", "class"), "class").select("class", "label", F.least("label", "near").alias("to"))
        jump = labels.select(F.col("class").alias("to"), F.col("label").alias("further"))
        moved = written(least.join(jump, "to", "left").select("class", F.col("label").alias("was"), F.least("to", F.coalesce("further", "to")).alias("label")))
        discard(spark, before)
        labels, before = moved.select("class", "label"), moved
        if moved.where("label <> was").isEmpty():
            discard(spark, edges)
            return labels


def _texts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text of each class in ``wanted`` (class, doc_id, key and more), with its other columns."""
    wanted = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_ROWS else wanted  # a few numbers a row, counted
    return documents.select("doc_id", row_key(F.col("text")).alias("key"), "text").join(wanted, ["doc_id", "key"]).dropDuplicates(["class"])


def linked_classes(documents: DataFrame, rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(class, label): the components of all classes with a link; rows: written signatures."""
    first = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"))
    picked = rows.join(first, ["class", "doc_id"]).groupBy("class", "doc_id").agg(F.min("key").alias("key"))
    classes = written(rows.join(picked, ["class", "doc_id", "key"]).groupBy("class").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.first("n_shingles").alias("n"), F.first("tokens").alias("tokens")))
    small, large = leaves(classes.select("class", "n", "tokens"))
    members = written(small.join(classes.select("class", "n", "tokens"), "class"))
    groups = components(candidates(members).unionByName(stars(large)).distinct()).withColumnRenamed("label", "group").join(classes.select("class", "doc_id", "key", "n"), "class")
    groups = written(groups)
    sizes = groups.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = written(groups.join(sizes, "group").select("class", "doc_id", "key", "group", "blocks", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int").alias("block")))
    links = written(confirmed(_first_tasks(_texts(documents, placed), placed), words))
    if placed.where("blocks > 1").isEmpty():
        return components(links)
    more = confirmed(_open_tasks(documents, placed, components(links)), words)
    return components(links.unionByName(more).distinct())


def _first_tasks(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """(class, text, task): groups, or their blocks; a group's pivots, those of least hash, go to all its blocks."""
    # partial lists of PIVOTS classes are merged: no task holds a group
    drawn = placed.where("blocks > 1").select("group", "class", F.xxhash64("class", F.lit(5)).alias("draw"))
    ranked = drawn.withColumn("part", F.pmod("draw", F.lit(64)))
    for key in (["group", "part"], ["group"]):
        ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("draw", "class"))).where(F.col("rank") <= PIVOTS)
    pivots = ranked.select("class", F.lit(True).alias("pivot"))
    rows = texts.join(pivots, "class", "left")
    blocks = F.when(F.col("blocks") == 1, F.array("group")).when(F.col("pivot"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.xxhash64("group", x))).otherwise(F.array(F.xxhash64("group", "block")))
    return rows.select("class", "text", F.explode(blocks).alias("task"))


def _open_tasks(documents: DataFrame, placed: DataFrame, labels: DataFrame) -> DataFrame:
    """(class, text, task) of the pairs that blocks and pivots leave open: classes outside a group's largest component against all of it."""
    split = placed.where("blocks > 1").join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    split = written(split)
    counted = split.groupBy("group", "label").agg(F.count("*").alias("n"))
    largest = counted.groupBy("group").agg(F.max(F.struct("n", "label"))["label"].alias("largest"), F.sum("n").alias("all"), F.max("n").alias("most"))
    open_ = written(split.join(largest.where("all > most"), "group").select("class", "doc_id", "key", "group", "blocks", "block", (F.col("label") != F.col("largest")).alias("outside"), F.ceil((F.col("all") - F.col("most")) * F.col("blocks") / F.col("all")).cast("int").alias("parts")))
    texts = _texts(documents, open_)
    part = F.pmod(F.xxhash64("class", F.lit(3)), F.col("parts")).cast("int")
    # a class outside is in its part with every block; any class is in its block with every part
    rows = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.xxhash64("group", x, part))
    columns = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.xxhash64("group", "block", x))
    tasks = F.array_distinct(F.when(F.col("outside"), F.concat(rows, columns)).otherwise(columns))
    return texts.select("class", "text", F.explode(tasks).alias("task"))


def near_duplicates(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return judged(documents, words).select("doc_id", "n_shingles", "component_id", "kept")


def judged(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, key, n_shingles, label, component_id, kept) of every row; of the tables on the way, only the two that it reads stay."""
    began = mark()
    rows = written(signatures(documents, words))
    labels = linked_classes(documents, rows, words)
    least = rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    known = written(named.join(ids, "label").select("class", "label", "component_id"))
    discard_since(documents.sparkSession, began, [rows, known])
    out = rows.select("doc_id", "key", "n_shingles", "class").join(known, "class", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", "label", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def without_copies(documents: DataFrame, words: int = WORDS) -> DataFrame:
    """The documents, all columns, that stay: of each component the text of least id and key; rows without a set all stay."""
    mine, d, k = free_name(documents, "_key"), free_name(documents, "_d"), free_name(documents, "_k")
    every = judged(documents, words)
    least = every.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("s")).select("s.doc_id", "s.key")
    stay = least.unionByName(every.where("label is null").select("doc_id", "key").distinct()).select(F.col("doc_id").alias(d), F.col("key").alias(k)).distinct()
    both = documents.withColumn(mine, row_key(F.col("text")))
    return both.join(stay, both["doc_id"].eqNullSafe(stay[d]) & (both[mine] == stay[k]), "left_semi").select(*[F.col(f"`{c}`") for c in documents.columns])


#: The exact join: all pairs of sets that share a shingle, counted; the trees must find every link of it.
ORACLE_SQL = f"""
WITH RECURSIVE docs AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) >= {WORDS} THEN list_sort(list_distinct(list_transform(range(1, CAST(len(ws) - {WORDS} + 2 AS BIGINT)), lambda k: array_to_string(list_slice(ws, k, k + {WORDS} - 1), ' '))))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM docs),
classes AS MATERIALIZED (SELECT row_number() OVER () AS c, s, len(s) AS n, min(doc_id) AS least FROM sets WHERE len(s) > 0 GROUP BY s),
postings AS MATERIALIZED (SELECT c, n, unnest(s) AS g FROM classes),
links AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM postings a JOIN postings b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT c, c AS t FROM classes UNION SELECT r.c, b FROM reach r JOIN edges e ON e.a = r.t),
least AS (SELECT r.c, min(t.least) AS component_id FROM reach r JOIN classes t ON t.c = r.t GROUP BY r.c)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(coalesce(component_id, d.doc_id) = d.doc_id, false) AS kept
FROM sets d LEFT JOIN classes k ON k.s = d.s LEFT JOIN least USING (c)
"""
