"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about ``SHARD_BYTES`` in one partition. Its words become integers and an FM-index is built
over them: suffix order, Burrows-Wheeler transform, wavelet matrix for rank and access, and every ``SAMPLE_STEP``-th
suffix position. All benchmark windows are searched backwards at once; each occurrence is located by walking to the next
sampled position; the covered words are merged to removal spans. Words outside the benchmark's vocabulary part the text, and
stretches between them that are shorter than the shortest window are not indexed: no occurrence can lie there. So a shard's index answers
the benchmark that it was made for, not any other.

Defined cases: null and empty texts have no words and no hits; null or wordless items have no window; an item id that
occurs twice counts once; the windows of items with a null id hit, but such items are not counted or listed; repeated rows give repeated results;
a very long text is a shard of its own; extra columns are ignored; empty tables give an empty result or no hits; a benchmark over ``MAX_BENCHMARK_BYTES`` is searched
in parts, one pass over the documents for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcast.llm import _text
from loomcast.llm._tables import free_name, row_key, written

WINDOW, SHARD_BYTES, SAMPLE_STEP, MAX_BENCHMARK_BYTES = 13, 32 << 20, 8, 16 << 20


class WaveletMatrix:
    """Rank and access over symbols in 0..2**levels-1."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.ones, self.zeros = len(symbols), levels, [], []
        self.bits = []
        now = symbols
        for level in range(levels - 1, -1, -1):
            bit = ((now >> level) & 1).astype(bool)
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.bits.append(bit)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            now = np.concatenate((now[~bit], now[bit]))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.ones[k][at]
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position."""
        return self._down(symbol, at) - self._down(symbol, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            bit, ones = self.bits[k][at], self.ones[k][at]
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return symbol


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling, to the depth at which all suffixes differ."""
    n, step = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if new[order[-1]] == n - 1:
            return order
        rank, step = new, step * 2


class FMIndex:
    """Over stretches of symbols 1..n_symbols; ``bounds`` are the stretches' starts in ``symbols`` and its length."""

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray, n_symbols: int):
        runs = len(bounds) - 1
        text = np.zeros(len(symbols) + runs, np.int64)
        own = np.arange(len(symbols)) + np.repeat(np.arange(runs), np.diff(bounds))
        text[own] = symbols
        marks = bounds[1:] + np.arange(runs)  # each stretch ends with a separator; all of them differ for the order
        self.of_text = np.full(len(text), -1, np.int64)
        self.of_text[own] = np.arange(len(symbols))
        keyed = text + runs
        keyed[marks] = np.arange(runs)
        order = suffix_order(keyed)
        bwt = text[order - 1]
        self.first = runs + np.concatenate(([0, 0], np.cumsum(np.bincount(symbols, minlength=n_symbols + 1)[1:])))
        self.tree = WaveletMatrix(bwt, max(1, int(n_symbols).bit_length()))
        before = np.zeros(len(text), bool)
        before[0] = True
        before[marks[:-1] + 1] = True
        self.sampled = (order % SAMPLE_STEP == 0) | before[order]
        self.at = np.where(self.sampled, order, -1)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of all patterns, given right-aligned, by backward search."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.tree.n, np.int64)
        live = np.arange(len(patterns))
        for back in range(1, patterns.shape[1] + 1):
            live = live[(low[live] < high[live]) & (lengths[live] >= back)]
            if not len(live):
                break
            c = patterns[live, -back].astype(np.int64)
            both = self.tree.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in ``symbols`` where the suffixes of these rows start."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            out[live[done]] = self.at[rows[live[done]]] + steps[live[done]]
            live = live[~done]
            c = self.tree.access(rows[live])
            rows[live] = self.first[c] + self.tree.rank(c, rows[live])
            steps[live] += 1
        return self.of_text[out]


class Benchmark:
    """The distinct windows of all items as rows of word numbers, and the items of each window, in a few arrays.

    Made once, on the driver, from at most ``MAX_BENCHMARK_BYTES`` of items; workers get the arrays.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        hashes, counts = [], []
        for _, _, raw, off in _text.chunks(pa.array([t for _, t in items], pa.string())):
            mapped = _text.ALNUM[raw]
            w = _text.words(mapped, off)
            hashes.append(_text.span_hashes(mapped, w.start, w.end))
            counts.append(w.counts)
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.hashes, numbers = np.unique(words, return_inverse=True)
        self.size, self.ids = len(self.hashes), np.arange(1, len(self.hashes) + 1)
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        # a row a window: right-aligned, with zeros before the words of an item shorter than a window
        padded = np.concatenate((np.zeros(window, np.int32), numbers.astype(np.int32) + 1))
        ends = np.concatenate(([0], np.cumsum(n)))
        own = np.maximum(n - window + 1, 1) * (n > 0)
        item = np.repeat(np.arange(len(n)), own)
        last = np.minimum(ends[item] + window, ends[item + 1]) + np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        rows = np.lib.stride_tricks.sliding_window_view(padded, window)[last] if len(item) else np.zeros((0, window), np.int32)
        length = np.minimum(n[item], window)
        rows = np.where(np.arange(window) >= window - length[:, None], rows, 0).astype(np.int32)
        key = np.ascontiguousarray(rows).view(np.dtype((np.void, 4 * window))).ravel()
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        self.patterns, self.lengths = rows[first], length[first].astype(np.int64)
        self.least = int(self.lengths.min()) if len(first) else 0
        # the items of each window; an item of null id has windows, but no name
        self.items = sorted({str(i) for i, _ in items if i is not None})
        rank = {x: k for k, x in enumerate(self.items)}
        names = np.array([-1 if i is None else rank[str(i)] for i, _ in items], np.int64)
        named = names[item] >= 0
        pair = np.unique(which.ravel()[named] * max(1, len(self.items)) + names[item][named])
        self.owners = pair % max(1, len(self.items))
        self.owner_at = np.searchsorted(pair // max(1, len(self.items)), np.arange(len(first) + 1))

    def numbered(self, hashes: np.ndarray) -> np.ndarray:
        """The word numbers, 0 for words that no item has."""
        out = np.zeros(len(hashes), np.int64)
        if self.size:
            maybe = np.flatnonzero(self.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), self.size - 1)
            same = self.hashes[at] == hashes[maybe]
            out[maybe[same]] = self.ids[at[same]]
        return out


class Shard:
    """Collects the stretches of a run of documents, then searches them all."""

    def __init__(self, benchmark: Benchmark):
        self.b, self.bytes, self.rows, self.kept, self.n_words = benchmark, 0, 0, [], []

    def add(self, raw: np.ndarray, off: np.ndarray) -> None:
        mapped = _text.ALNUM[raw]
        w = _text.words(mapped, off)
        self.bytes += len(raw)
        self.n_words.append(w.counts)
        if self.b.least:
            ids = self.b.numbered(_text.span_hashes(mapped, w.start, w.end))
            row = w.rows
            change = np.ones(len(ids) + 1, bool)
            change[1:-1] = ((ids[1:] > 0) != (ids[:-1] > 0)) | (row[1:] != row[:-1])
            edge = np.flatnonzero(change)
            length = np.diff(edge)
            good = (length >= self.b.least) & (ids[np.minimum(edge[:-1], max(len(ids) - 1, 0))] > 0) if len(ids) else np.zeros(len(length), bool)
            take = np.repeat(good, length) if len(ids) else np.zeros(0, bool)
            at = np.flatnonzero(take)
            if len(at):
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                start = chars[off[row[at]]]
                self.kept.append((ids[at], row[at] + self.rows, at - w.bounds[row[at]], chars[w.start[at]] - start, chars[w.end[at]] - start, length[good]))
        self.rows += len(off) - 1

    def result(self) -> list[dict]:
        """n_words, spans [first word, end word, first character, end character] and items of each document."""
        n_words = np.concatenate(self.n_words) if self.n_words else np.zeros(0, np.int64)
        out = [{"n_words": int(n), "spans": [], "items": []} for n in n_words]
        if not self.kept:
            return out
        ids, row, word, begin, end, length = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        index = FMIndex(ids, np.concatenate(([0], np.cumsum(length))), self.b.size)
        low, high = index.search(self.b.patterns, self.b.lengths)
        many = np.maximum(high - low, 0)
        window = np.repeat(np.arange(len(low)), many)
        if not len(window):
            return out
        rows = np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        place = index.locate(rows)
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, place, 1)
        np.add.at(cover, place + self.b.lengths[window], -1)
        hit = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        new = np.ones(len(hit), bool)
        new[1:] = (row[hit[1:]] != row[hit[:-1]]) | (word[hit[1:]] != word[hit[:-1]] + 1)
        first, last = hit[new], hit[np.append(np.flatnonzero(new)[1:] - 1, len(hit) - 1)]
        for a, z in zip(first.tolist(), last.tolist(), strict=True):
            out[row[a]]["spans"].append([int(word[a]), int(word[z]) + 1, int(begin[a]), int(end[z])])
        pair = np.unique(row[place] * len(low) + window)
        doc, window = pair // len(low), pair % len(low)
        count = np.diff(self.b.owner_at)[window]
        own = self.b.owners[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.b.owner_at[window], count)]
        for x in np.unique(np.repeat(doc, count) * len(self.b.items) + own).tolist():
            out[x // len(self.b.items)]["items"].append(self.b.items[x % len(self.b.items)])
        return out


def _merged(spans: list) -> list:
    out: list = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = [out[-1][0], s[1], out[-1][2], s[3]]
        else:
            out.append(list(s))
    return out


_STATE = "doc_id long, text string, n_words long, spans array<array<long>>, items array<string>"


def _pass(documents: DataFrame, items: list, window: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(Benchmark(items, window))  # arrays of a bounded benchmark, read once by each worker

    def run(batches):
        bench, shard, held = shared.value, None, []

        def flush():
            at = 0
            results = shard.result()
            for b in held:
                part = results[at : at + b.num_rows]
                at += b.num_rows
                for r, spans, names in zip(part, b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    if spans:
                        r["spans"] = _merged(r["spans"] + spans)
                    if names:
                        r["items"] = sorted({*r["items"], *names})
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r["n_words"] for r in part], pa.int64()), pa.array([r["spans"] for r in part], pa.list_(pa.list_(pa.int64()))), pa.array([r["items"] for r in part], pa.list_(pa.string()))], names=["doc_id", "text", "n_words", "spans", "items"])

        for b in _text.small(batches, 1):
            shard = shard or Shard(bench)
            for _, _, raw, off in _text.chunks(b.column(1)):
                shard.add(raw, off)
            held.append(b)
            if shard.bytes >= SHARD_BYTES:
                yield from flush()
                shard, held = None, []
        if held:
            yield from flush()

    return documents.mapInArrow(_text.released(run), _STATE)


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_bytes: int = MAX_BENCHMARK_BYTES) -> DataFrame:
    """(doc_id, text, n_words, spans, items) of every document; spans and items as in ``Shard.result``.

    The benchmark goes to every executor, ``max_bytes`` of it at most at a time: a larger one is taken in parts by a hash
    of its ids, and the state between two passes is written to the shared folder.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    parts = int(size // max_bytes) + 1
    out = documents.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<array<long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for k in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == k)
        out = _pass(out if k == 0 else written(out), [(r[0], r[1]) for r in some.collect()], window)
    return out


def digest(found: DataFrame) -> DataFrame:
    """The counts, the item list's SHA-256 and the verdict of each document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def cut(text: str, spans: list) -> str:
    """The text without its removal spans."""
    for s in reversed(spans):
        text = text[: s[2]] + text[s[3] :]
    return text


def brute_force(documents: list, items: list, window: int = WINDOW) -> list:
    """Plain reference for tests: rows of (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    import re

    def tokens(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    wins: dict = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).update([] if i is None else [str(i)])
    sizes = sorted({len(w) for w in wins})
    out = []
    for d, t in documents:
        w, hit, names = tokens(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (own := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    names |= own
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_broadcast_rows: int = 500_000) -> DataFrame:
    """The documents, all columns, without the contaminated ones (see ``digest``)."""
    found = find(documents, benchmark, window)
    mine, d, k = (free_name(documents, x) for x in ("_key", "_d", "_k"))
    bad = digest(found.withColumn("doc_id", F.struct("doc_id", row_key(F.col("text")).alias("key")))).where("contaminated").select(F.col("doc_id.doc_id").alias(d), F.col("doc_id.key").alias(k))
    bad = written(bad.distinct())
    if bad.count() <= max_broadcast_rows:  # two numbers a row, counted
        bad = F.broadcast(bad)
    both = documents.withColumn(mine, row_key(F.col("text")))
    return both.join(bad, both["doc_id"].eqNullSafe(bad[d]) & (both[mine] == bad[k]), "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_SQL_WORDS} AS ws FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, list_slice(ws, k, k + least(len(ws), {WINDOW}) - 1) AS w
  FROM (SELECT item, ws, unnest(range(1, CAST(greatest(len(ws) - {WINDOW} + 1, 1) AS BIGINT) + 1)) AS k FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, ws, n, unnest(range(1, CAST(len(ws) - n + 2 AS BIGINT))) AS k FROM docs, sizes WHERE len(ws) >= n),
found AS (SELECT r, k, p.n, item FROM places p JOIN windows w ON w.n = p.n AND w.w = list_slice(p.ws, k, k + p.n - 1)),
hits AS (SELECT r, count(DISTINCT word) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS word FROM found) GROUP BY r),
named AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM docs LEFT JOIN hits USING (r) LEFT JOIN named USING (r)
"""
