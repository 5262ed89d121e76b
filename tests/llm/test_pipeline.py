"""The pipeline against a plain version of all its stages, and what its stages leave behind."""

import glob
import os
import re

from pyspark.sql import functions as F

import corpus_pipeline
from loomcast.llm import _tables, _text, decontam, pieces, quality, queries
from loomcast.llm._sampling import remainder

SF = "/root/testdata/sf0.001"


def _within_one(a, b):
    """Edit distance of at most one, by the first place that differs."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def _without_repeated_lines(docs):
    places = sorted((d, k, line) for d, t in docs for k, line in enumerate(t.split("\n")) if re.search(r"\S", line))
    first, gone = {}, set()
    for d, k, line in places:
        if line in first:
            gone.add((d, k))
        else:
            first[line] = (d, k)
    lines = [x for x in first if len(x) >= 24]
    by_length = {}
    for x in lines:
        by_length.setdefault(len(x), []).append(x)
    near = {x for x in lines for n in (len(x) - 1, len(x), len(x) + 1) for y in by_length.get(n, []) if first[y] < first[x] and _within_one(x, y)}
    gone |= {(d, k) for d, k, line in places if line in near}
    out = []
    for d, t in docs:
        parts = t.split("\n")
        kept = [x for k, x in enumerate(parts) if (d, k) not in gone]
        if len(kept) == len(parts) or "".join(kept).strip(" \t\n\x0b\f\r"):
            out.append((d, "\n".join(kept)))
    return out


def _first_of_near_copies(docs, words=5):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    owners = {}
    for d, s in sets.items():
        shared = {}
        for g in s:
            for o in owners.get(g, []):
                shared[o] = shared.get(o, 0) + 1
            owners.setdefault(g, []).append(d)
        for o, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = sorted((root(d), root(o)))
                label[b] = a
    return [(d, t) for d, t in docs if root(d) == d]


def test_pipeline_equals_plain_stages(spark):
    docs = sorted(map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()))
    assert len({d for d, _ in docs}) == len(docs) and all(t is not None for _, t in docs)
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"), remainder(3) != 1)
    import pyarrow as pa

    good = [(d, t) for d, t in docs if model.score(*_text.utf8(pa.array([t])))[0] >= 0.5]
    once = _first_of_near_copies(_without_repeated_lines(good))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in decontam.brute_force(once, items) if r[-1]}
    codec = pieces.Codec(pieces.read_vocabulary(queries.PIECE_MODEL))
    want = {d: codec.encode(t) for d, t in once if d not in bad}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, SF).collect()}
    assert len(good) < len(docs) and len(want) < len(good) and got == want


def test_stages_leave_only_their_output_behind(spark):
    folder = _tables.shared_folder(spark)
    before = set(glob.glob(f"{folder}/table-*"))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0
    left = set(glob.glob(f"{folder}/table-*")) - before
    assert len(left) == len(corpus_pipeline.STAGES) - 1 and all(os.path.exists(f"{x}/_SUCCESS") for x in left)
    assert out.where(~F.col("round_trip")).count() == 0


def test_queries_side_by_side_keep_their_tables(spark):
    """Operators that delete their tables in one thread leave those of another alone."""
    from concurrent.futures import ThreadPoolExecutor

    names = ["op2_minhash_near_dedup", "op3_personal_data", "op5_line_dedup"] * 2
    with ThreadPoolExecutor(6) as pool:
        results = list(pool.map(lambda n: queries.queries()[n](spark, SF).count(), names))
    assert results == [200] * 6
