"""SentencePiece encoding by Viterbi over an Aho-Corasick automaton of the pieces, and decoding.

The automaton reads a text once; at each position its output links give all pieces that end there, and each relaxes
the best score at its end by its own score in the model file. A character that no piece covers falls back to
its UTF-8 byte pieces. The result is the segmentation with the best sum of scores, ties going to the
longer last piece; for a model file of merge kind it may differ from what merging in order gives.

Blanks are written as U+2581, one is put before the text, and a U+2581 of the text itself goes to byte pieces,
so decoding gives the text back exactly. No piece has that sign after another character, so
words are segmented on their own, each distinct word of a batch once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shared import ddl, release, slices

SPACE = "▁"
#: Added to the least score of a piece for a character without one.
PENALTY = -10.0
#: Words whose ids a task keeps.
KEPT_WORDS = 200_000
_STATE: dict = {}


class Pieces:
    """The automaton and the Viterbi search of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts, self.bytes = [], [0] * 256
        automaton, scores = ahocorasick.Automaton(), []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.texts.append(piece)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if any(a != SPACE and b == SPACE for a, b in zip(piece, piece[1:])):
                    raise ValueError(f"piece {piece!r} goes across words")
                automaton.add_word(piece, (i, len(piece), model.get_score(i)))
                scores.append(model.get_score(i))
        automaton.make_automaton()
        self.automaton, self.unknown = automaton, min(scores) + PENALTY
        self.raw = [t.replace(SPACE, " ").encode() for t in self.texts]
        for b, i in enumerate(self.bytes):
            self.raw[i] = bytes([b])

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text in which blanks are U+2581 already."""
        n = len(text)
        score, back = [0.0] * (n + 1), [None] * (n + 1)
        at = 0
        for end, (piece, size, own) in self.automaton.iter(text):
            end += 1
            while at < end - 1:  # positions that no piece ends at
                at += 1
                if back[at] is None:
                    score[at], back[at] = score[at - 1] + self.unknown, (-1, 1)
            value = score[end - size] + own
            if back[end] is None or value > score[end] or (value == score[end] and size > back[end][1]):
                score[end], back[end] = value, (piece, size)
        while at < n:
            at += 1
            if back[at] is None:
                score[at], back[at] = score[at - 1] + self.unknown, (-1, 1)
        out, at = [], n
        while at:
            piece, size = back[at]
            if piece < 0:
                out += [self.bytes[b] for b in reversed(text[at - 1].encode())]
            else:
                out.append(piece)
            at -= size
        return out[::-1]

    def word(self, word: str) -> list[int]:
        """Ids of a word: blanks, one more than are written, then signs other than blanks."""
        blanks = len(word) - len(word.lstrip(" "))
        first, *rest = word[blanks:].split(SPACE)
        out = self.best(SPACE * (blanks + 1) + first)
        for part in rest:
            out += [self.bytes[b] for b in SPACE.encode()] + self.best(part)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


def pieces(path: str) -> Pieces:
    if _STATE.get("path") != path:
        _STATE.update(path=path, model=Pieces(path), words={})
    return _STATE["model"]


def encoded(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text."""
    model = pieces(path)
    if len(_STATE["words"]) > KEPT_WORDS:
        _STATE["words"] = {}
    known, out = _STATE["words"], []
    for text in texts:
        if not text:
            out.append(np.zeros(0, np.int32))
            continue
        # A run of blanks stays with the word after it; the first blank is not written.
        words, run = [], 1
        for word in text.split(" "):
            if word:
                words.append(word if run == 1 else " " * (run - 1) + word)
                run = 1
            else:
                run += 1
        if run > 1:
            words.append(" " * (run - 2))
        for word in set(words).difference(known):
            known[word] = np.array(model.word(word), np.int32).tobytes()
        out.append(np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32))
    return out


def sentence_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pieces, n_pieces, ids_crc32, round_trip) for every row: the ids, how many, the crc32 of them as
    little-endian 32-bit integers, and whether decoding gives the text back.

    A null or empty text has no pieces. Rows that repeat an id are returned each; other columns are ignored.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces(path)
        _STATE["words"] = {}  # those of the worker's last task
        for batch in slices(batches, "text", 4 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = encoded(path, texts)
            words = pieces(path)
            same = [words.decode(i.tolist()) == t for i, t in zip(ids, texts)]
            sizes = np.array([len(i) for i in ids], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            sums = [zlib.crc32(i.astype("<u4").tobytes()) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values), pa.array(sizes), pa.array(sums, pa.int64()), pa.array(same)],
                ["doc_id", "pieces", "n_pieces", "ids_crc32", "round_trip"],
            )
        _STATE["words"] = {}
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, ddl(f"doc_id {kind}, pieces array<int>, n_pieces bigint, ids_crc32 bigint, round_trip boolean"))
