"""Values, not only counts: the defined cases of every operator, brute-force versions, and what happens at scale."""

import hashlib
import math
import random
import re
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomcast.llm import _sampling, _tables, _text, decontam, langid, licenses, line_dedup, media, near_dup, pieces, pii, quality, queries, toxicity

LONG = "word " * 30_000
DOCS = [(1, None), (2, ""), (3, " \n\t "), (4, "!!"), (5, "one"), (6, LONG), (7, "same text here for all of us"), (7, "same text here for all of us"), (None, "no id"), (8, "日本 \U0001f600")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "x", 1, 2) for d, t in DOCS], "doc_id long, text string, lang string, key int, class int")


def _by_text(df, docs):
    """The values of every row without the id, in the order of DOCS; equal rows must have equal values."""
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    assert len(out[7]) == 2 and out[7][0] == out[7][1]
    return [out[d][0] for d, _ in DOCS]


def test_near_dup_values(docs):
    got = _by_text(near_dup.near_duplicates(docs), docs)
    assert got == [(0, 1, True), (0, 2, True), (0, 3, True), (1, 4, True), (1, 5, True), (1, 6, True), (4, 7, True), (4, 7, True), (1, None, False), (1, 8, True)]


def test_pii_values(docs):
    empty = hashlib.sha256(b"").hexdigest()
    assert _by_text(pii.digest(pii.spans(docs)), docs) == [(0, 0, 0, 0, empty, "", 0, 0, 0)] * len(DOCS)


def test_license_values(docs):
    assert _by_text(licenses.scan(docs), docs) == [(n, 0, None, None, "", "", 0.0) for n in (0, 0, 0, 0, 1, 30_000, 7, 7, 2, 2)]


def test_line_dedup_values(docs):
    # rows equal in id and text are one row; blank lines and short lines stay
    assert _by_text(line_dedup.report(docs), docs) == [(n, n, "") for n in (1, 1, 2, 1, 1, 1, 1, 1, 1, 1)]


def test_decontamination_values(spark, docs):
    items = [(1, "one"), (2, None), (3, "?!"), (4, "here for all"), (4, "here for all"), (None, "no id")]
    got = _by_text(decontam.digest(decontam.find(docs, spark.createDataFrame(items, "item_id long, text string"))), docs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    none = lambda n: (n, 0, 0, sha(""), False)
    assert got == [none(0), none(0), none(0), none(0), (1, 1, 1, sha("1"), True), none(30_000), (7, 3, 1, sha("4"), True), (7, 3, 1, sha("4"), True), (2, 2, 0, sha(""), True), none(2)]
    assert sorted(map(str, got)) == sorted(str(r[1:]) for r in decontam.brute_force(DOCS, items))


def test_score_values(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert _by_text(quality.score(docs, quality.fit(docs, labels, F.lit(True))), docs) == [(0.5,)] * len(DOCS)
    got = _by_text(toxicity.score(docs, toxicity.fit(docs, labels, F.lit(True))), docs)
    assert len(set(got)) == 1 and 0 <= got[0][0] < 0.5
    got = _by_text(langid.predict(docs, langid.fit(docs, F.lit(True))), docs)
    assert [g[0] for g in got] == ["und"] * 4 + ["x"] * 6 and {g[1] for g in got} == {0.0, 1.0}


def test_pieces_values(docs):
    got = _by_text(pieces.encode(docs, queries.PIECE_MODEL), docs)
    assert got[0] == (None, 0, None) and got[1] == ([], 0, True) and all(g[2] and g[1] == len(g[0]) > 0 for g in got[2:])


def test_media_values(docs):
    for (_, t), g in zip(DOCS, _by_text(media.media_columns(docs, keep_media=False), docs), strict=True):
        raw = (t or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert g[:4] == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) and g[4] == len(p) + 44
        assert g[6].startswith(f"{len(g[7])}:")


def test_media_feature_equals_plain_transform():
    """Peaks by the sum that defines the transform, frame by frame, and pairs by loops."""
    text = "A plain text, long enough for some frames: " + "".join(chr(40 + 7 * i % 80) for i in range(500))
    p = media.to_payload(text)
    window = [0.5 - 0.5 * math.cos(2 * math.pi * i / (media.FRAME - 1)) for i in range(media.FRAME)]
    peaks = []
    for at in range(0, len(p) - media.FRAME + 1, media.HOP):
        x = [b - 128 for b in p[at : at + media.FRAME]]
        mean = sum(x) / len(x)
        x = [(v - mean) * w for v, w in zip(x, window, strict=True)]
        power = [abs(sum(v * complex(math.cos(2 * math.pi * k * i / len(x)), -math.sin(2 * math.pi * k * i / len(x))) for i, v in enumerate(x))) for k in range(65)]
        peaks.append([max(range(a, b), key=lambda k: power[k]) for a, b in media.BANDS])
    want = sorted(t << 32 | peaks[t][band] << 20 | peaks[t + gap][band] << 8 | gap for gap in range(1, media.FAN + 1) for t in range(len(peaks) - gap) for band in range(len(media.BANDS)))
    assert media.fingerprint(p).tolist() == want
    assert media.row(text)["feature"] == f"{len(want)}:{hashlib.sha256(np.array(want, '<i8').tobytes()).hexdigest()}"


def test_quality_score_equals_plain_average():
    rng = np.random.default_rng(1)
    m = quality.QualityModel(rng.normal(size=2 * quality.BUCKETS + 2), 0.25)
    texts = ["a b b c", "ab", "", "   ", "Übung macht macht den", "x" * 300, "b b"]
    got = m.score(*_text.utf8(pa.array(texts)))
    for t, g in zip(texts, got, strict=True):
        raw = t.encode()
        w = [x for x in re.split(rb"[\x20\x09-\x0D]+", raw) if x]
        h = [int(_text.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in w]
        grams = [int(_text.byte_ngrams(np.frombuffer(raw[i : i + 3], np.uint8), 3)[0]) for i in range(len(raw) - 2)]
        kinds = [[x % quality.BUCKETS for x in h], [x % quality.BUCKETS + quality.BUCKETS for x in grams], [2 * quality.BUCKETS + (i > 0 and w[i] == w[i - 1]) for i in range(len(w))]]
        z = m.bias + sum(sum(m.logit[i] for i in ids) / len(ids) for ids in kinds if ids)
        assert abs(g - 1 / (1 + math.exp(-z))) < 1e-12, t


def test_language_vectors_equal_plain_counts():
    """TF-IDF and softmax, with n-grams cut out of each text alone by Python."""
    rng = np.random.default_rng(2)
    m = langid.LanguageModel(["a", "b"], rng.normal(size=(langid.BUCKETS, 2)), np.array([0.1, -0.1]), rng.uniform(1, 2, langid.BUCKETS), 0.7)
    texts = ["Ein Wort", "é à", "", "1 2", "x\U00020000y z"]
    names, scores = m.predict(*_text.utf8(pa.array(texts)))
    for t, name, s in zip(texts, names, scores, strict=True):
        alone, one = m.predict(*_text.utf8(pa.array([t])))
        assert (name, s) == (alone[0], one[0])
        plain = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t)
        grams = [plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1) if (plain[i] != " " or plain[i + n - 1] != " ") and (n < 3 or plain[i + 1] != " ")]
        v = np.zeros(langid.BUCKETS)
        for g in grams:
            code = ord(g[0])
            for c in g[1:]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
            h = (code * 0x9E3779B1 + len(g)) & 0xFFFFFFFF
            h ^= h >> 15
            v[(h * 0x85EBCA77 & 0xFFFFFFFF) >> 20] += 1
        if not any(c.isalpha() for c in t):
            assert (name, s) == ("und", 0.0)
            continue
        v *= m.idf
        z = (v / np.sqrt((v * v).sum()) @ m.weights + m.bias) / 0.7
        p = np.exp(z) / np.exp(z).sum()
        assert name == "ab"[int(p.argmax())] and abs(s - p.max()) < 1e-9


def test_pieces_equal_plain_search_on_the_production_vocabulary(spark):
    """Every segmentation's best score, by a table over all substrings, on real texts."""
    v = pieces.read_vocabulary(queries.PIECE_MODEL)
    score = {p: s for p, s, plain in v if plain}
    c, most = pieces.Codec(v), max(map(len, score))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 900").limit(60).collect()]
    for t in texts:
        x = "▁" + t.replace(" ", "▁")
        best = [0.0] + [-math.inf] * len(x)
        for z in range(1, len(x) + 1):
            best[z] = max((best[a] + score[x[a:z]] for a in range(max(0, z - most), z) if x[a:z] in score), default=-math.inf)
            if x[z - 1] not in score:
                best[z] = max(best[z], best[z - 1] + c.unknown)
        ids = c.encode(t)
        spelled = sum(v[i][1] for i in ids if v[i][2]) + c.unknown * sum(ch not in score for ch in x)
        assert c.decode(ids) == t and abs(spelled - best[-1]) <= 1e-9 * max(1.0, abs(best[-1]))


def test_equal_texts_have_equal_scores(spark):
    """Wherever they stand, whatever stands beside them, and however the table is partitioned."""
    rng = random.Random(3)
    words = "the of and der die und you idiot que los ä ö 12 a, b.".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    rows = [(i, rng.choice(texts)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gen = np.random.default_rng(0)
    models = [lambda d: quality.score(d, quality.QualityModel(gen_logit, 0.1)), lambda d: toxicity.score(d, toxicity.train([(t, i % 2) for i, t in enumerate(texts)], {0: 6, 1: 6})),
              lambda d: langid.predict(d, langid.LanguageModel(["a", "b", "c"], weights, np.zeros(3), np.ones(langid.BUCKETS), 0.3))]
    gen_logit, weights = gen.normal(size=2 * quality.BUCKETS + 2), gen.normal(size=(langid.BUCKETS, 3))
    for f in models:
        got = {(t, tuple(r)[1:]) for n in (1, 7) for r in f(df.repartition(n)).collect() for t in [rows[r.doc_id][1]]}
        assert len(got) == len({t for _, t in rows})


def test_span_hashes_depend_on_the_bytes_alone(monkeypatch):
    monkeypatch.setattr(_text, "_SEGMENT", 64)
    monkeypatch.setattr(_text, "_powers", {})
    rng = random.Random(4)
    words = [bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 3, 30, 63, 64, 65, 129, 200]))) for _ in range(60)]
    seen = {}
    for _ in range(20):
        some = [rng.choice(words) for _ in range(30)]
        raw = np.frombuffer(b" ".join(some), np.uint8)
        w = _text.words(_text.SPACED[raw], np.array([0, len(raw)]))
        for x, h in zip(some, _text.span_hashes(_text.SPACED[raw], w.start, w.end).tolist(), strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_small_batches_bound_rows_and_bytes():
    b = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * (1 << 18) if i % 50 == 0 else "y" for i in range(1000)])], names=["a", "t"])
    parts = list(_text.small([b], 1))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(1000))
    assert max(p.num_rows for p in parts) <= _text.CHUNK_ROWS and all(len(_text.utf8(p.column(1))[0]) <= _text.CHUNK_BYTES for p in parts)


def test_samples_take_long_texts_within_a_bound_of_bytes(spark):
    rows = [(i, ("long " * 20_000) if i == 3 else f"text {i}") for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    got, counts = _sampling.labelled_sample(d, labels, "y", F.lit(True))
    assert len(got) == 40 and max(len(t) for t, _ in got) == 100_000 and counts == {0: 20, 1: 20}
    got, _ = _sampling.labelled_sample(d, labels, "y", F.lit(True), total_bytes=400)
    assert sum(len(t) for t, _ in got) <= 400 and len(got) >= 30


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Dir:
        def isDefined(self):
            return False

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": lambda self: Dir()})()

    with pytest.raises(ValueError, match="checkpoint"):
        _tables.shared_folder(Spark())


def test_large_groups_send_each_text_few_times(spark, monkeypatch):
    """One hot group of near copies and some texts that are near to few of them: all links, and no copy of every text for every block."""
    for name, value in (("SMALL", 4), ("BLOCK", 10), ("DEPTH", 1), ("PIVOTS", 3)):
        monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for _ in range(90):
        t = list(words)
        t[rng.randrange(120)] = f"x{rng.randrange(1000)}"
        rows.append(t)
    far = list(words)
    for _ in range(6):  # a chain that goes away from the group, step by step
        for _ in range(3):
            far[rng.randrange(120)] = f"y{rng.randrange(1000)}"
        rows.append(list(far))
    docs = [(i, " ".join(t)) for i, t in enumerate(rows)]
    sent = []
    first = near_dup._first_tasks
    monkeypatch.setattr(near_dup, "_first_tasks", lambda *a: sent.append(first(*a).count()) or first(*a))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [{tuple(t[i : i + 4]) for i in range(len(t) - 3)} for t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert [got[i] for i in range(len(rows))] == label
    assert len(rows) <= sent[0] <= len(rows) + 3 * 12


def test_wav_files_can_be_read_by_others(tmp_path):
    (tmp_path / "x.wav").write_bytes(media.write_wav(media.to_payload("some text")))
    with wave.open(str(tmp_path / "x.wav")) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(w.getnframes())) == (1, 1, media.to_payload("some text"))


def test_toxicity_score_equals_plain_sum():
    """Weights of the terms and patterns of a text, found by loops over its words."""
    rng = np.random.default_rng(4)
    h = lambda w: int(toxicity._hash([w])[0])
    salt = dict(zip(toxicity.BEGINNINGS, (int(s) for s in toxicity._SALT[1:]), strict=True))
    listed = ["awful", "idiot", "you", "über"]
    terms = np.array([*map(h, listed), h("hate") ^ salt[4], h("stupi") ^ salt[5]], np.uint64)
    m = toxicity.ToxicityModel(terms, rng.normal(size=len(terms) + 4), -0.2)
    order = {int(x): k for k, x in enumerate(np.sort(terms))}
    texts = ["You IDIOT, you are awful", "hateful stupidity über alles", "", "a plain text", "idiot one two three four you", None, "you are not an idiot hated"]
    got = m.score(*_text.utf8(pa.array(texts)))
    for t, g in zip(texts, got, strict=True):
        w = [x for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))]
        seen = {h(x) for x in w} | {h(x.encode()[:k].decode("utf-8", "ignore")) ^ salt[k] for x in w for k in toxicity.BEGINNINGS if len(x.encode()) > k and len(x.encode()[:k].decode("utf-8", "ignore").encode()) == k}
        found = [order[x] for x in seen if x in order]
        insults, second = [i for i, x in enumerate(w) if x in toxicity.INSULTS], [i for i, x in enumerate(w) if x in toxicity.SECOND_PERSON]
        flags = [bool(insults), any(0 < abs(i - j) <= 3 for i in insults for j in second), len(found) >= 3, not found]
        z = m.bias + sum(m.weights[k] for k in found) + sum(m.weights[len(terms) + k] for k, f in enumerate(flags) if f)
        assert abs(g - 1 / (1 + math.exp(-z))) < 1e-9, t


def test_label_model_finds_accuracies_and_discounts_copies():
    """Posteriors of votes of known quality: better than the best voter, and a voter that is there five times counts less than five."""
    rng = np.random.default_rng(6)
    y = rng.random(3000) < 0.3
    good = [np.where(rng.random(3000) < 0.85, y, ~y).astype(np.int8) for _ in range(4)]
    poor = np.where(rng.random(3000) < 0.55, y, ~y).astype(np.int8)
    votes = np.stack([*good, *[poor] * 5], axis=1)
    q = toxicity.label_model(votes, 0.3)
    assert ((q > 0.5) == y).mean() > max((g == y).mean() for g in good) and ((votes.mean(axis=1) > 0.5) == y).mean() < ((q > 0.5) == y).mean()
