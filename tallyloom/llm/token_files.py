"""Token ids of texts in files of shuffled bit planes, written in id order and read back by chunk.

A file holds blocks of BLOCK ids (the last one fewer). A block's ids are transposed into planes, plane b holding
bit b of every id, or byte b, as asked for; each plane is a zstandard frame, planes above the highest
used one are left out. The footer is the chunk index: for each block its place, ids, and the sizes of its planes;
then the documents (ids, token counts, and which have no id), compressed; then the footer's length and the magic bytes.
"""

from __future__ import annotations

import itertools
import json
import operator
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.llm.files import created, opened, read_range
from tallyloom.llm.shared import ddl, new_folder, slices

MAGIC = b"BITPLANE2"
BLOCK = 1 << 16
END = 1
LEVEL = 3
#: Words whose ids a task keeps between batches; the memory is started anew when it is full.
KEPT_WORDS = 500_000
#: Text bytes encoded at once; of a larger batch fewer words are distinct.
_BATCH = 8 << 20
#: New words to a call of the library.
_WORDS = 4096


# ---- the format -----------------------------------------------------------------------------------


def packed(ids: np.ndarray, planes: str) -> list[bytes]:
    """A block of uint32 ids as its uncompressed planes, lowest first."""
    top = int(ids.max()) if len(ids) else 0
    if planes == "byte":
        raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
        return [raw[:, b].tobytes() for b in range(max(1, -(-top.bit_length() // 8)))]
    ids = ids.astype(np.uint32)
    return [np.packbits((ids & np.uint32(1 << b)).astype(bool), bitorder="little").tobytes() for b in range(max(1, top.bit_length()))]


def unpacked(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        part = np.frombuffer(plane, np.uint8)
        part, shift = (part, 8 * b) if kind == "byte" else (np.unpackbits(part, count=n, bitorder="little"), b)
        out |= part.astype(np.uint32) << np.uint32(shift)
    return out


class Writer:
    """Appends documents to an open stream; holds one block of ids, and the document counts."""

    def __init__(self, out, planes: str = "bit"):
        import zstandard

        self.out, self.planes, self.at = out, planes, 0
        self.pack = zstandard.ZstdCompressor(level=LEVEL)
        self.held: list[np.ndarray] = []
        self.n_held, self.n_ids, self.blocks = 0, 0, []
        self.docs: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.absent: list[np.ndarray] = []

    def add(self, doc_ids: pa.Array, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(pc.fill_null(doc_ids, 0).to_numpy().astype("<i8"))
        self.counts.append(counts.astype("<i8"))
        self.absent.append(doc_ids.is_null().to_numpy(zero_copy_only=False))
        self.held.append(ids.astype(np.uint32))
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            flat = np.concatenate(self.held)
            full = len(flat) // BLOCK * BLOCK
            for start in range(0, full, BLOCK):
                self._block(flat[start : start + BLOCK])
            self.held, self.n_held = [flat[full:]], len(flat) - full

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.pack.compress(p) for p in packed(ids, self.planes)]
        self.blocks.append([self.at, len(ids), [len(f) for f in frames]])
        for frame in frames:
            self.out.write(frame)
            self.at += len(frame)
        self.n_ids += len(ids)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        docs = b"".join(x.tobytes() for part in (self.docs, self.counts, self.absent) for x in part)
        index = json.dumps({"planes": self.planes, "block": BLOCK, "blocks": self.blocks}).encode()
        footer = struct.pack("<q", len(index)) + index + self.pack.compress(docs)
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)


def documents(uri: str) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(document ids, counts, token ids) of a file, some whole documents at a time, a block read at a time."""
    import zstandard

    system, path = opened(uri)
    size, tail = system.get_file_info(path).size, 8 + len(MAGIC)
    (length,), magic = struct.unpack("<q", (end := read_range(system, path, size - tail, tail))[:8]), end[8:]
    if magic != MAGIC:
        raise ValueError(f"{uri}: not a file of bit planes")
    footer = read_range(system, path, size - tail - length, length)
    (n,) = struct.unpack("<q", footer[:8])
    index, unpack = json.loads(footer[8 : 8 + n]), zstandard.ZstdDecompressor()
    flat = unpack.decompress(footer[8 + n :])
    n_docs = len(flat) // 17
    docs, counts = np.frombuffer(flat, "<i8", 2 * n_docs).reshape(2, -1)
    docs = pa.array(docs, mask=np.frombuffer(flat, bool, n_docs, 16 * n_docs))
    ends, done, held, have = np.cumsum(counts), 0, [], 0
    with system.open_input_file(path) as source:
        for at, n_ids, sizes in index["blocks"]:
            source.seek(at)
            raw = source.read(sum(sizes))
            edges = np.concatenate([[0], np.cumsum(sizes)])
            planes = [unpack.decompress(raw[a:b]) for a, b in zip(edges[:-1], edges[1:])]
            held.append(unpacked(planes, n_ids, index["planes"]))
            have += n_ids
            before = int(ends[done - 1]) if done else 0
            until = int(np.searchsorted(ends, before + have, "right"))
            if until > done:
                ids = np.concatenate(held)
                used = int(ends[until - 1]) - before
                yield docs[done:until], counts[done:until], ids[:used]
                held, have, done = [ids[used:]], have - used, until
    if done < len(docs):  # documents without ids after the last block
        yield docs[done:], counts[done:], np.zeros(0, np.uint32)


# ---- encoding -------------------------------------------------------------------------------------

#: Letters that are neither decomposed by the tokenizer nor lowered to more than a letter: Latin ones (A-Z are lowered
#: before) but the I with a dot, and Cyrillic ones.
_LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f\u0400-\u045f"
#: ASCII signs but the apostrophe.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_STATE: dict = {}


class Words:
    """The ids of the words that a worker has seen: a code for each word, and per code its run of ids."""

    def __init__(self):
        self.codes: dict[str, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, words: list[str], sizes: np.ndarray, flat: np.ndarray) -> None:
        self.codes.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.begins = np.concatenate([self.begins, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])

    def find(self, words: list[str]) -> np.ndarray:
        """The codes of words, -1 for unknown ones."""
        return np.fromiter(map(self.codes.get, words, itertools.repeat(-1)), np.int64, len(words))

    def runs(self, codes: np.ndarray) -> np.ndarray:
        """The ids of words one after the other."""
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[codes] - (ends - sizes), sizes)]


def _tokenizer(path: str):
    if _STATE.get("path") != path:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _STATE.update(path=path, tokenizer=Tokenizer.from_file(path), words=Words())
        added = _STATE["tokenizer"].get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: added tokens that are not literal")
        _STATE["added"] = {t.content: i for i, t in added.items()}
        vocabulary = _STATE["tokenizer"].get_vocab()
        _STATE["closes"] = np.zeros(max(vocabulary.values()) + 1, bool)
        _STATE["closes"][[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        # Texts are cut at added tokens before; what is like one only once it is lowered is ordinary text.
        _STATE["tokenizer"].encode_special_tokens = True
    return _STATE["tokenizer"]


def _listed(words: pa.Array) -> list[str]:
    """Strings without nulls as a list, some times faster than to_pylist."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _encode_new(path: str, words: list[str], into: Words) -> None:
    """Adds words without white space, encoded by the library, many to a call.

    A word of _LETTERS is one pre-token, whose last token closes a word; of others the offsets tell where they end.
    """
    tokenizer, closes = _tokenizer(path), _STATE["closes"]
    words = pa.array(words, pa.string())
    is_plain = pc.match_substring_regex(words, f"^[{_LETTERS}]+$")
    plain = _listed(words.filter(is_plain))
    for at in range(0, len(plain), _WORDS):
        part = plain[at : at + _WORDS]
        (encoded,) = tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        ends = np.flatnonzero(closes[ids])
        if len(ends) != len(part):
            raise ValueError(f"{path}: {len(part)} words with {len(ends)} ends")
        into.append(part, np.diff(ends, prepend=-1), ids)
    others = _listed(words.filter(pc.invert(is_plain)))
    for at in range(0, len(others), _WORDS):
        part = others[at : at + _WORDS]
        encoded = tokenizer.encode(" ".join(part), add_special_tokens=False)
        starts = np.cumsum([0, *map(len, part)]) + np.arange(len(part) + 1)
        first = np.fromiter(map(operator.itemgetter(0), encoded.offsets), np.int64)
        into.append(part, np.diff(np.searchsorted(first, starts)), np.array(encoded.ids, np.uint32))


def word_codes(path: str, words: pa.Array) -> tuple[Words, np.ndarray]:
    """What is known of distinct words, and the code of each. The tokenizer splits at white space and between a letter and
    the ASCII signs after it (but the apostrophe), so a word's ids are those of its stem and of its tail."""
    _tokenizer(path)
    if len(_STATE["words"].codes) + len(words) > KEPT_WORDS:
        _STATE["words"] = Words()
    known = _STATE["words"]
    codes = known.find(_listed(words))
    absent = np.flatnonzero(codes < 0)
    if len(absent):
        new = words.take(pa.array(absent))
        stems = pc.ascii_rtrim(new, _SIGNS)
        cut = pc.and_(pc.match_substring_regex(stems, f"[{_LETTERS}]$"), pc.not_equal(pc.binary_length(stems), pc.binary_length(new)))
        both, stems, whole = (_listed(part) for part in (new.filter(cut), stems.filter(cut), new.filter(pc.invert(cut))))
        tails = [word[len(stem) :] for word, stem in zip(both, stems)]
        _encode_new(path, [w for w in {*whole, *stems, *tails} if w not in known.codes], known)
        cut = cut.to_numpy(zero_copy_only=False)
        codes[absent[~cut]] = known.find(whole)
        if both:
            codes[absent[cut]] = np.arange(len(both)) + len(known.sizes)
            parts = np.stack([known.find(stems), known.find(tails)], axis=1)
            known.append(both, known.sizes[parts].sum(axis=1), known.runs(parts.ravel()))
    return known, codes


def encoded(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) of a string column, END after each text; added tokens are not looked for (see `tokenized`).
    Every distinct word of a batch is looked up once.

    The tokenizer lower-cases, composes and drops white space, and none of that crosses a blank or a line
    feed, so a text's ids are its words' ids one after the other; A-Z are lowered before, for fewer words.
    """
    plain = pc.replace_substring(pc.ascii_lower(pc.fill_null(texts, "")), "\n", " ")
    lists = pc.split_pattern(plain, " ")
    per_text = lists.value_lengths().to_numpy()
    coded = lists.flatten().dictionary_encode()
    known, codes = word_codes(path, coded.dictionary)
    codes = codes[coded.indices.to_numpy()]
    ends = np.cumsum(per_text)
    sums = np.concatenate([[0], np.cumsum(known.sizes[codes])])
    counts = sums[ends] - sums[ends - per_text] + 1
    out = np.empty(counts.sum(), np.uint32)
    is_end = np.zeros(len(out), bool)
    is_end[np.cumsum(counts) - 1] = True
    out[is_end], out[~is_end] = END, known.runs(codes)
    return counts, out


def tokenized(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ids) as the tokenizer's plain call gives them, END after each text.

    The call finds added tokens, such as <|endoftext|>, in the text as it is and encodes what is between them by itself.
    """
    _tokenizer(path)
    added = _STATE["added"]
    holds = np.zeros(len(texts), bool)
    for content in added:
        holds |= pc.fill_null(pc.match_substring(texts, content), False).to_numpy(zero_copy_only=False)
    if not holds.any():
        return encoded(path, texts)
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    pieces, closing, n_pieces = [], [], []
    for text in texts.to_pylist():
        parts = split.split(text or "")
        pieces += parts[::2]
        closing += [*(added[t] for t in parts[1::2]), END]
        n_pieces.append(len(parts[::2]))
    counts, ids = encoded(path, pa.array(pieces, texts.type))
    # Each piece is closed by the token that follows it in place of the end.
    ids[np.cumsum(counts) - 1] = closing
    return np.add.reduceat(counts, np.cumsum([0, *n_pieces[:-1]])), ids


# ---- jobs -----------------------------------------------------------------------------------------


def write_files(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text", planes: str = "bit") -> DataFrame:
    """Writes the token files and returns their list (part, file, n_docs, n_ids), parts in order of the ids.

    Rows are dealt by ranges of id, then of the hash of the text, and sorted; rows without an id come first.
    `path` is the tokenizer's file.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n_docs, writer = TaskContext.get().partitionId(), 0, None
        _tokenizer(path)
        _STATE["words"] = Words()  # those of the worker's last task
        with created(folder, f"part-{part:06d}.planes") as out:
            writer = Writer(out, planes)
            for batch in slices(batches, "text", _BATCH):
                counts, ids = tokenized(path, batch.column("text"))
                writer.add(batch.column("id"), counts, ids)
                n_docs += batch.num_rows
            writer.close()
        _STATE["words"] = Words()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.array([f"{folder}/part-{part:06d}.planes"]), pa.array([n_docs]), pa.array([writer.n_ids])],
            ["part", "file", "n_docs", "n_ids"],
        )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("h"))
    dealt = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h", "text")
    listed = dealt.select("id", "text").mapInArrow(write, ddl("part bigint, file string, n_docs bigint, n_ids bigint"))
    spark = docs.sparkSession
    listed.write.parquet(f"{folder}/list")
    return spark.read.schema(listed.schema).parquet(f"{folder}/list")


def read_files(listed: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files; a task reads whole files, by block.

    The window that adds up the ids before each file is over the list of files alone.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Whole files of one size each are the unit of reading, so they are dealt evenly.
    placed = listed.where("n_docs > 0").withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, listed.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                for docs, counts, ids in documents(file):
                    ends = np.cumsum(counts)
                    raw = ids.astype("<u4").tobytes()
                    sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    start += int(ends[-1])

    return placed.select("file", "before").repartitionByRange(n, "file").mapInArrow(
        read, ddl("doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    )


def token_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, planes: str = "bit") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from files written for `docs`.

    A null text is an empty one, of the end id alone. Rows that repeat an id follow each other; a null id comes
    first, then negative ones. Other columns are ignored. Equal inputs give equal files, whatever their order.
    """
    return read_files(write_files(docs, path, folder or new_folder(docs.sparkSession, "tokens"), id_col, text_col, planes))
