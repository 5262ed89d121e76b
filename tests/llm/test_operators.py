"""Text operators: against brute force, on the corner cases their docstrings define, and on held-out rows."""

import hashlib
import random
import re
import textwrap
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.llm import decontam, langid, licenses, line_dedup, media, near_dup, pieces, pii, quality, queries, toxicity
from loomcast.llm._sampling import remainder

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
#: null, empty, blank, one word, very long, repeated rows, and columns of clashing names
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, "same text here for all of us"), (6, "same text here for all of us"), (7, "x" * 50_000), (None, "no id"), (8, "▁mark ▁ and 日本 \U0001f600")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(d, t, None, "s", 1, 2, 3) for d, t in EDGE], "doc_id long, text string, lang string, source string, key int, score int, class int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def _bench(spark, rows=((1, "a b c"), (2, None), (3, "?!"), (3, "same text here"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _each(spark, docs):
    """All operators on one table."""
    return {
        1: quality.score(docs, quality.fit(docs, _labels(spark), remainder(3) != 1)), 2: near_dup.near_duplicates(docs), 3: pii.digest(pii.spans(docs)), 4: licenses.scan(docs),
        5: line_dedup.report(docs), 6: media.media_columns(docs), 7: decontam.digest(decontam.find(docs, _bench(spark))), 8: toxicity.score(docs, toxicity.fit(docs, _labels(spark), remainder(5) != 0)),
        9: langid.predict(docs, langid.fit(docs, remainder(4) != 2)), 10: pieces.encode(docs, queries.PIECE_MODEL),
    }


def test_edge_rows(spark, edge):
    for n, df in _each(spark, edge).items():
        assert len(df.collect()) == len(EDGE), n


def test_empty_table(spark, empty):
    for n, df in _each(spark, empty).items():
        assert df.count() == 0, n


def test_queries_on_the_small_table(spark):
    for name, f in queries.queries().items():
        assert f(spark, SF).count() == 200, name


def test_line_dedup_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, line_dedup.report(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "n_kept", "n_lines", "removed").collect())) == sorted(c.sql(f"select doc_id, n_kept, n_lines, removed from ({line_dedup.ORACLE_SQL})").fetchall())


def test_line_dedup_distances(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(24, 40))) for _ in range(12)]
    lines = []
    for b in base:
        for _ in range(6):
            t = list(b)
            for _ in range(rng.randint(0, 2)):
                i, op = rng.randrange(len(t)), rng.random()
                if op < 0.34:
                    t.insert(i, "z")
                elif op < 0.67:
                    del t[i]
                else:
                    t[i] = "y"
            lines.append("".join(t))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in line_dedup.report(docs).collect()}
    d = {(r.i, r.j) for r in docs.alias("a").join(docs.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).where(F.levenshtein("a.text", "b.text") <= 1).select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j")).collect()}
    gone = {j for i, j in d if len(lines[i]) >= 24 and len(lines[j]) >= 24}
    assert {k for k, v in got.items() if v} == gone and gone


@pytest.mark.parametrize("n", [4000, 40_000])
def test_line_dedup_hot_keys(spark, n):
    """Lines with equal beginnings of three quarters give candidates in proportion to their number, not all pairs."""
    lines = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("2026-11-26 10:00:00 INFO worker started a new request with identity "), F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**12)).cast("string"), 20, "0")).alias("text"))
    parts = line_dedup.lines_of(lines, 24)
    assert line_dedup.near_pairs(line_dedup.distinct_lines(parts, 1), parts, 1).count() < 2 * n


def test_line_dedup_plan_does_not_grow_with_the_rounds(spark):
    """Lines that share most of their characters are cut in more rounds the longer they are; their pairs meet in the same joins."""
    def shuffles(size):
        lines = line_dedup.lines_of(spark.createDataFrame([(i, f"{'a common beginning ' * size}{i:04d}") for i in range(40)], "doc_id long, text string"), 24)
        found = line_dedup.near_pairs(line_dedup.distinct_lines(lines, 1), lines, 1)
        return found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"), found.count()

    (few, n), (many, m) = shuffles(2), shuffles(60)
    assert n and m and few == many


def test_line_dedup_hot_keys_lose_nothing(spark, monkeypatch):
    """Every key is hot: all levels down to single characters, against all pairs."""
    rng = random.Random(6)
    lines = {"".join(["common beginning of a line ", *(rng.choice("ab") for _ in range(rng.randint(3, 6)))]) for _ in range(200)}
    lines |= {f"{x[:5]}{c}{x[5 + d:]}" for x in list(lines)[:20] for c in "xyz" for d in (0, 1)}
    docs = list(enumerate(sorted(lines, key=lambda x: rng.random())))
    near = {j for i, a in docs for j, b in docs if i < j and abs(len(a) - len(b)) <= 1 and _distance(a, b) <= 1}
    for crowd in (0, 1, 2, 8):
        monkeypatch.setattr(line_dedup, "CROWD", crowd)
        got = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).where("removed <> ''").select("doc_id").collect()
        assert {r[0] for r in got} == near, crowd


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_distance(spark, most):
    rng = random.Random(most)
    rows = [("".join(rng.choice("ab") for _ in range(rng.randint(0, 9))), "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b string").select(line_dedup.within(F.col("a"), F.col("b"), most).alias("x"), (F.levenshtein("a", "b") <= most).alias("y"))
    assert all(r.x == r.y for r in df.collect())


def test_line_dedup_clean_drops_emptied_texts(spark):
    line = "this very line comes again and again"
    docs = spark.createDataFrame([(1, line, "k"), (2, line, "k"), (3, f"new beginning of another text\n{line}", "k")], "doc_id long, text string, key string")
    assert {(r.doc_id, r.text, r.key) for r in line_dedup.clean(docs).collect()} == {(1, line, "k"), (3, "new beginning of another text", "k")}


def test_line_dedup_clean_removes_short_repeats(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.\n\nfirst"), (2, "second\n\nAll rights reserved."), (3, "All rights reserved!")], "doc_id long, text string")
    assert {tuple(r) for r in line_dedup.clean(docs).collect()} == {(1, "All rights reserved.\n\nfirst"), (2, "second\n"), (3, "All rights reserved!")}


def _components(docs, words=4):
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[d] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[label[a]] for a in sets):
            break
    return {(d, len(sets[d]), label[d], label[d] == d) for d in sets}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    docs = []
    for g in range(6):
        base = [rng.choice(words) for _ in range(60)]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(60)] = rng.choice(words)
            docs.append((len(docs), " ".join(t)))
    docs += [(100, ""), (101, None), (102, "a b"), (103, "A  b")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = _components(docs)
    assert {tuple(r) for r in near_dup.near_duplicates(df).collect()} == want
    for name, value in (("SMALL", 3), ("BLOCK", 4)):  # deep trees, and groups split into blocks
        monkeypatch.setattr(near_dup, name, value)
    assert {tuple(r) for r in near_dup.near_duplicates(df).collect()} == want
    assert near_dup.without_copies(df).count() == sum(k for *_, k in want)


def test_without_copies_keeps_one_text_of_shared_and_null_ids(spark):
    base = " ".join(f"w{i}" for i in range(80))
    near = base.replace("w79", "other")
    rows = [(1, base), (1, near), (2, base), (None, base), (None, "only null ids have this one"), (None, "only null  ids have this one"), (None, None), (None, "")]
    got = [tuple(r) for r in near_dup.without_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sum(bool(t) and t.startswith("w0") for _, t in got) == 1 and (1 in [d for d, _ in got])
    assert sum(bool(t) and t.startswith("only") for _, t in got) == 1 and len(got) == 4


def test_large_nodes_lose_no_pair(spark, monkeypatch):
    for name, value in (("SMALL", 2), ("BLOCK", 4), ("DEPTH", 1), ("TREES", 1)):
        monkeypatch.setattr(near_dup, name, value)
    rng, words = random.Random(9), [f"w{i}" for i in range(80)]
    docs = [(i, " ".join([*words[:70], *rng.sample(words[70:], 2)])) for i in range(30)]  # one group, larger than a block
    got = {tuple(r) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _components(docs) and {c for _, _, c, _ in got} == {0}


def test_pii_equals_regular_expressions(spark):
    texts = ["mail a.b@c.de_f@g.hi, 1.2.3.4.5 and 256.1.1.1 0001.2.3.255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112", "call +1 (375) 555-4393 . now +12 3", "ééé +49 30 1234567 x@y.z", "@@ a@b 1", "4207051279108084" * 2]
    rx = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(k, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(v - 9 if v > 9 else v for v in (int(x) * (1 + i % 2) for i, x in enumerate(reversed(d)))) % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in m.split(".")) if k == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[k]

    got = {r["doc_id"]: r["base_sha256"] for r in pii.digest(pii.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for i, t in enumerate(texts):
        s = sorted((m.start(), n, k, m.end()) for n, (k, p) in enumerate(rx.items()) for m in re.finditer(p, t) if good(k, m[0]))
        assert got[i] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, _, k, z in s).encode()).hexdigest(), t


def test_pii_discovers_by_context(spark):
    docs = [(i, f"please write to user{i}@site{i}.org today") for i in range(12)] + [(50, "please write to agent77 today"), (51, "nothing about room 12 here")]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(pii.spans(spark.createDataFrame(docs, "doc_id long, text string"))).collect()}
    assert got[50] == "found:16:23" and got[51] == "" and got[0].startswith("email:")


def test_pii_equals_sql(spark):
    """All columns, found spans included; near misses, marks around tokens, repeated rows, no text."""
    rng = random.Random(8)
    words = ["write", "to", "the", "badge", "of", "Éva", "room\x0b", "card:", "no.\t"]
    some = [lambda: f"user{rng.randrange(40)}@site{rng.randrange(9)}.org", lambda: f"agent{rng.randrange(99)}", lambda: "4111 1111 1111 1111", lambda: "4111111111111112", lambda: f"{rng.randrange(400)}.1.{rng.randrange(300)}.2",
            lambda: "+1 (375) 555-4393", lambda: f'token = "{rng.getrandbits(160):040x}"', lambda: f"(password={rng.getrandbits(40):010x})!", lambda: str(rng.randrange(3000)), lambda: "a@b", lambda: "+@@ @", lambda: "AKIA" + "Q7" * 8]
    docs = [(i, " ".join(x for _ in range(rng.randint(0, 12)) for x in (rng.choice(words), rng.choice(words), rng.choice(some)()))) for i in range(300)]
    docs += [(400 + i, f"please write to user{i}@site{i}.org today") for i in range(12)] + [(450, "please write to agent77 today"), (451, None), (452, ""), (452, ""), (453, docs[0][1]), (None, docs[1][1]), (0, docs[0][1])]
    got = pii.digest(pii.spans(spark.createDataFrame(docs, "doc_id long, text string")))
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", docs)
    key = lambda r: str(r)
    names = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*names).collect()), key=key)
    assert rows == sorted(c.sql(f"select {', '.join(names)} from ({pii.ORACLE_SQL})").fetchall(), key=key)
    assert sum(r[names.index("n_found")] for r in rows) > 0 and sum(r[names.index("n_secret")] for r in rows) > 20


def test_pii_work_grows_with_the_text(spark):
    """Fifty thousand numbers in one text: places and overlaps are not looked for pair by pair."""
    n = 50_000
    text = " ".join(f"{i} 10.0.{i % 256}.{i % 100}" if i % 5 == 0 else str(i) for i in range(n))
    began = time.time()
    r = pii.digest(pii.spans(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert r.n_ip == n // 5 and time.time() - began < 60


def test_pii_finds_held_out_secrets(spark):
    """With only some digests as seeds, their contexts find the others; documents without identifiers stay without spans."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    secret = r"(?<![0-9a-zA-Z])[0-9a-f]{40}(?![0-9a-zA-Z])"
    some = docs.where(F.col("text").rlike(secret)).union(docs.limit(500))
    found = pii.spans(some, secrets=("^[0-9ab][0-9a-f]{39}$",)).withColumn("found", F.filter("spans", lambda x: x["kind"] == "found"))
    rows = found.join(docs, "doc_id").select("doc_id", "found", "text").distinct().collect()
    hit = [r.text[x["start"] : x["end"]] for r in rows for x in r.found]
    held = [m for r in rows for m in re.findall(secret, r.text) if m[0] in "cdef"]
    assert len(held) >= 10 and len([x for x in hit if x in held]) >= 0.9 * len(held) and len([x for x in hit if x in held]) >= 0.9 * len(hit)


def test_licenses(spark):
    t = "CC-BY, cc by\nAll Rights Reserved\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    r = licenses.scan(spark.createDataFrame([(1, t), (2, "cc byte")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert (r[0].n_base, r[0].first_word, r[0].last_word, r[0].base_labels, r[0].labels, r[0].score) == (3, 0, 4, "cc-by,reserved", "cc-by,mit,reserved", 1.0)
    assert (r[1].n_base, r[1].first_word, r[1].labels, r[1].score) == (0, None, "", 0.0)


@pytest.mark.parametrize("width", [9, 40, 72, 80])
def test_licenses_wrapped(spark, width):
    """Every template is found if it wraps over lines, with comment marks and other text around; its words far apart are not."""
    def wrapped(t):
        return "\n".join(f" * {x}" for x in textwrap.wrap(f"some text before it {t} and some after it", width, break_long_words=False))

    rows = [(i, f"/*\n{wrapped(t)}\n */\n") for i, t in enumerate(licenses.TEMPLATES.values())]
    far = "\n".join(f"{w} {'word ' * 60}" for w in licenses.TEMPLATES["mit"].split())
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame([*rows, (99, far)], "doc_id long, text string")).collect()}
    assert all(name in got[i] for i, name in enumerate(licenses.TEMPLATES)) and got[99] == [""]


def _license_rows(docs, templates=None, threshold=None):
    """The contract's columns by plain regular expressions and every block of every text."""
    templates, threshold = templates or licenses.TEMPLATES, threshold or licenses.THRESHOLD
    out = {}
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        at = [(i, x) for p, x in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        best = {}
        for name, text in templates.items():
            own, size = set(text.split()), licenses.block_words(text, threshold)
            most = max((len(own & set(w[i : i + size])) for i in range(len(w))), default=0)
            if most >= threshold * len(own) - 1e-9:
                best[name] = most / len(own)
        places, base = [i for i, _ in at], {x for _, x in at}
        out[d] = (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | set(best))), 1.0 if at else max(best.values(), default=0.0))
    return out


def test_licenses_equal_brute_force(spark, monkeypatch):
    """Also with cut texts; random texts over few words have blocks at, above and under the threshold."""
    rng = random.Random(5)
    templates = {"a": "p q r s t u v w x y z", "b": "k k l m n o", "c": "m p z"}
    known = sorted({w for t in templates.values() for w in t.split()})
    docs = [(i, " ".join(rng.choice([*known, "of", "the"]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    for i in range(60):
        t = rng.choice(list(templates.values())).split()
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice(["of", *t])
        docs.append((100 + i, " of ".join([docs[i][1], "\n".join(t).upper(), docs[i][1]])))
    docs += [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "!!"), (1004, "one"), (1005, "All rights, reserved cc-by"), (1006, "z " * 20_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for piece in (licenses.PIECE, 16):
        monkeypatch.setattr(licenses, "PIECE", piece)
        got = {r[0]: tuple(r[1:]) for r in licenses.scan(df, templates, 0.8).collect()}
        assert got == _license_rows(docs, templates, 0.8)
    assert sum(bool(r[5]) for r in got.values()) > 40 and got[1003][0] == got[1001][0] == got[1000][0] == got[1002][0] == 0


def test_licenses_filters(spark):
    """They drop some candidates, and none that is the first common word of a contained template."""
    order = ["a", "b", "c", "d", "e", "f"]
    rows = [("b", "x b d e f".split(), 1, ["b", "d", "e", "f"], 4, 5), ("b", "a a c b x".split(), 3, ["b", "d", "e", "f"], 4, 5), ("d", "a b c d e".split(), 3, ["d", "e", "f"], 3, 5)]
    got = licenses.survivors(spark.createDataFrame(rows, "w string, near array<string>, at int, own array<string>, need int, size int"), order).collect()
    assert [r.near for r in got] == [rows[0][1]]


def test_media_round_trip():
    for t in (None, "", "a", "é" * 32, "x" * 64, LONG):
        r = media.row(t)
        p = (t or "").encode()
        p = p.ljust(max(64, -(-len(p) // 64) * 64), b"\0")
        assert (r["payload_sha256"], r["tail_crc32"], media.read_wav(r["media"])) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), p)
    assert len(media.row(LONG)["fingerprint"]) > 0


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(6)]
    items = [(str(i), " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 13, 20])))) for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 80))) + " " + rng.choice(items)[1].upper()) for i in range(60)]
    b = spark.createDataFrame([(int(i), t) for i, t in items], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(decontam.brute_force(docs, items))
    assert sorted(map(tuple, decontam.digest(decontam.find(d, b)).collect())) == want
    assert sorted(map(tuple, decontam.digest(decontam.find(d, b, max_bytes=200)).collect())) == want  # in parts
    r = decontam.find(d, b).where(F.size("spans") > 0).first()
    assert len(decontam.cut(r["text"], r["spans"]).split()) == r["n_words"] - sum(s[1] - s[0] for s in r["spans"])


def test_pieces_round_trip_and_best_score():
    c = pieces.Codec(pieces.read_vocabulary(queries.PIECE_MODEL))
    for t in ("", " ", "a  b ", "▁x▁", "日本 ȸ\t\r\n\n", LONG[:5000], "\U0001f600", "x" * 500):
        assert c.decode(c.encode(t)) == t
    v = [("<unk>", 0.0, False), *[(f"<0x{b:02X}>", 0.0, False) for b in range(256)], ("▁", -3.0, True), ("a", -1.0, True), ("b", -1.0, True), ("ab", -1.5, True), ("ba", -1.2, True), ("▁a", -2.5, True), ("bab", -1.1, True)]
    c, score = pieces.Codec(v), {p: s for p, s, ok in v if ok}

    def best(t):
        return 0.0 if not t else max([score[t[:k]] + best(t[k:]) for k in range(1, len(t) + 1) if t[:k] in score], default=-1e9)

    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
        assert abs(sum(v[i][1] for i in c.encode(t)) - best("▁" + t)) < 1e-9


@pytest.mark.parametrize("name,label,modulus,out", [("op1_quality_classifier", "quality", 3, 1), ("op8_toxicity", "toxic", 5, 0)])
def test_classifiers_on_held_out_rows(spark, name, label, modulus, out):
    sf = "/root/testdata/sf0.01"
    got = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("doc_id", "predicted", F.col(label).alias("y")).collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % modulus == out for r in got)
    assert np.mean([r.predicted == r.y for r in got]) > 0.93


def test_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op9_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.95


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert 0 < docs.count() < n and docs.where("not round_trip").count() == 0


#: Columns whose names the stages use inside, or that other tables have.
CLASHES = ["key", "class", "node", "group", "label", "score", "kept", "spans", "items", "n_words", "quality", "item_id", "_key", "_D", "_k", "_gone", "_text", "a.b"]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_stages_on_edge_rows(spark, rows):
    """Nothing crashes, the columns stay as they are, and other columns' values stay with their rows."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in CLASHES)
    docs = spark.createDataFrame([(d, t, None, "s", *[100 * n + (d or 0) for n in range(len(CLASHES))]) for d, t in rows], schema)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF).collect()
        if not rows:
            assert not got, name
        if k < len(corpus_pipeline.STAGES) - 1:
            assert stage(spark, docs, SF).schema.simpleString() == docs.schema.simpleString(), name
            assert all(tuple(r)[4:] == tuple(100 * n + (r.doc_id or 0) for n in range(len(CLASHES))) for r in got), name
    kept = [r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, docs, SF).collect()]
    assert len(kept) == (len(EDGE) if rows else 0)  # repeated rows have the same id, and both are of least id
