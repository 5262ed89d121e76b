"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi search.

The automaton holds all pieces. At each end position of the text it yields the pieces that end there (its node and the
output links), and each relaxes the best score of that position from the position where the piece began. Characters that no
piece covers become byte pieces. The scores come from the vocabulary file, whatever way its pieces were trained; the result
is the segmentation of the highest total score (ties: the longer last piece).

No piece has a space mark after another character, and none has a newline, so a text falls into parts that are searched one
by one, and parts met before come from a bounded memory; where a vocabulary does otherwise, texts are searched whole.

Defined cases: null gives null ids and text, empty text gives no ids; decode(encode(x)) is x for every x, also if x has the
space mark U+2581 itself (it becomes byte pieces); of segmentations with equal scores the one with the longer last piece wins; very long texts are
read whole, part by part; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomcast.llm import _text

MARK, REMEMBERED, _INFINITE = "▁", 60_000, float("inf")
_PARTS = re.compile(f"[\n{MARK}]")


def read_vocabulary(path: str) -> list[tuple[str, float, bool]]:
    """(piece, score, is a plain piece) in order of id. Byte and control pieces are not plain."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i), not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))) for i in range(p.get_piece_size())]


class Codec:
    def __init__(self, vocabulary: list[tuple[str, float, bool]]):
        self.automaton = ahocorasick.Automaton()
        self.byte = [0] * 256
        self.raw: list[bytes] = []
        plain = [(i, p, s) for i, (p, s, ok) in enumerate(vocabulary) if ok and p]
        for i, (p, _, ok) in enumerate(vocabulary):
            m = re.fullmatch("<0x([0-9A-F]{2})>", p)
            if m and not ok:
                self.byte[int(m[1], 16)] = i
                self.raw.append(bytes([int(m[1], 16)]))
            else:
                self.raw.append(p.replace(MARK, " ").encode() if ok else b"")
        for i, p, s in plain:
            self.automaton.add_word(p, (len(p), s, i))
        if plain:
            self.automaton.make_automaton()
        self.any = bool(plain)
        self.sizes = [len(p) for p, _, _ in vocabulary]
        self.single = {p for _, p, _ in plain if len(p) == 1}
        self.unknown = min((s for _, _, s in plain), default=0.0) - 10.0
        self.parted = not any(MARK in p.lstrip(MARK) or "\n" in p for _, p, _ in plain)
        self.memory: tuple[dict, dict] = ({}, {})

    def viterbi(self, text: str) -> list[int]:
        """Best segmentation of a text in which spaces are marks already."""
        if not self.single.issuperset(text):
            return self._viterbi_with_bytes(text)
        n = len(text)
        best, piece = [0.0] + [-_INFINITE] * n, [0] * (n + 1)
        for end, (size, score, i) in self.automaton.iter(text):
            # matches come by end position, so the score at the piece's start is final
            score += best[end + 1 - size]
            if score > best[end + 1]:
                best[end + 1], piece[end + 1] = score, i
        out, k, sizes = [], n, self.sizes
        while k:
            i = piece[k]
            out.append(i)
            k -= sizes[i]
        out.reverse()
        return out

    def _viterbi_with_bytes(self, text: str) -> list[int]:
        """The same where some characters may have to become byte pieces, at the cost of an unknown character each."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text) if self.any else ():
            ends[end].append(match)
        best, piece = [0.0] * (n + 1), [-1] * (n + 1)
        for end, matches in enumerate(ends):
            best[end + 1] = best[end] + self.unknown
            for size, score, i in matches:
                score += best[end + 1 - size]
                if score > best[end + 1]:
                    best[end + 1], piece[end + 1] = score, i
        out, k = [], n
        while k:
            out += [piece[k]] if piece[k] >= 0 else [self.byte[b] for b in reversed(text[k - 1].encode())]
            k -= self.sizes[piece[k]] if piece[k] >= 0 else 1
        return out[::-1]

    def _word(self, word: str, marked: bool) -> list[int]:
        memory = self.memory[marked]
        ids = memory.get(word)
        if ids is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            ids = self.viterbi(MARK + word if marked else word)
            if len(word) < 64:
                memory[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        if not self.parted:
            escaped = [p.replace(" ", MARK) for p in text.split(MARK)]
            for k, p in enumerate(escaped):
                out += [self.byte[b] for b in MARK.encode()] if k else []
                out += self.viterbi(p if k else MARK + p)
            return out
        breaks, at = _PARTS.findall(text), -1
        marked, plain = self.memory[1], self.memory[0]
        for line in _PARTS.split(text) if breaks else (text,):
            if at >= 0:
                out += [self.byte[b] for b in breaks[at].encode()]
            words = line.split(" ")
            if at < 0:  # the text's start is marked like a word's
                words.insert(0, "")
            at += 1
            first = words[0]
            if first:
                out += plain.get(first) or self._word(first, False)
            spaces = 0
            for w in words[1:]:
                if w:
                    out += (self.viterbi(MARK * spaces + MARK + w) if spaces else marked.get(w) or self._word(w, True))
                    spaces = 0
                else:
                    spaces += 1
            if spaces:
                out += self.viterbi(MARK * spaces)
        return out

    def decode(self, ids) -> str:
        raw = self.raw
        text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_codec: list = [None, None]


def codec_of(shared) -> Codec:
    """A worker's codec of a broadcast vocabulary: made once, not in every task."""
    if _codec[0] is not shared.value:
        _codec[:] = shared.value, Codec(shared.value)
    return _codec[1]


def encode(documents: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, ids, n_pieces, round_trip) of every row; round_trip: decoding the ids gives the text."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))  # some ten thousand pieces

    def run(batches):
        codec = codec_of(shared)
        for b in _text.small(batches, 1):
            flat, ends, missing, same = [], [0], [], []
            for t in b.column(1).to_pylist():
                ids = codec.encode(t or "")
                same.append(None if t is None else codec.decode(ids) == t)
                missing.append(t is None)
                flat.append(np.array(ids, np.int32))
                ends.append(ends[-1] + len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)), mask=pa.array(missing, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(np.where(missing, 0, np.diff(ends)), pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "ids", "n_pieces", "round_trip"])

    return documents.select("doc_id", "text").mapInArrow(_text.released(run), "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches):
        codec = codec_of(shared)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else codec.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(_text.released(run), "doc_id long, text string")
