"""Token counts of texts by rank-synchronous merging of pre-tokens held as ragged numpy arrays.

For a sentencepiece model of merge kind. A pre-token is a run of blanks (U+2581 to the model) with the signs after
it, cut once more wherever no piece holds the two signs side by side: no merge crosses such a place. The distinct
pre-tokens of a batch lie one after the other in one array of symbols. In every round each pre-token's best pair
is merged, in all of them at once, until no pair is a piece; what is left are its tokens.

The library merges one pair at a time, the best score first, then the leftmost. Equal pairs of a pre-token are
merged in one round up to the first one that makes a better pair with a neighbour, which is the library's order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shared import ddl, slices

SPACE = "▁"
LIMIT = 4096
#: Text bytes counted at once. A longer text is counted in parts that end before a blank.
PART = 4 << 20
_NONE = np.iinfo(np.int32).max
_SYMBOLS: dict[str, Symbols] = {}


class Symbols:
    """The symbols of a model file: its pieces, and signs that occur in them; which pairs make which symbol."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {}
        for i in range(model.get_piece_size()):
            if model.is_unused(i):
                raise ValueError(f"{path}: unused pieces")
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                scores[model.id_to_piece(i)] = model.get_score(i)
        if any(a != SPACE and b == SPACE for p in scores for a, b in zip(p, p[1:])):
            raise ValueError(f"{path}: a piece goes across words")
        texts = [*scores, *sorted({c for p in scores for c in p}.difference(scores))]
        known = {t: i for i, t in enumerate(texts)}
        # Equal scores have equal ranks.
        places = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.array([places[scores[t]] if t in scores else _NONE for t in texts], np.int32)
        #: Tokens that a symbol is if it survives: one, or a byte each for a sign that is no piece.
        self.tokens = np.array([1 if t in scores else len(t.encode()) for t in texts], np.int64)
        pairs = sorted(
            (known[p[:cut]] << 32 | known[p[cut:]], known[p]) for p in scores for cut in range(1, len(p)) if p[:cut] in known and p[cut:] in known
        )
        self.pairs, self.made = np.array([k for k, _ in pairs], np.int64), np.array([m for _, m in pairs], np.int32)
        signs = sorted((ord(t), i) for t, i in known.items() if len(t) == 1)
        self.signs, self.sign_symbols = np.array([c for c, _ in signs], np.int64), np.array([i for _, i in signs], np.int32)
        beside = {ord(a) << 32 | ord(b) for p in scores for a, b in zip(p, p[1:])}
        self.beside = np.array(sorted(beside), np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that each pair makes, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.made[at], -1)

    def ranks(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols >= 0, self.rank[symbols], _NONE)

    def of_signs(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.signs, points), len(self.signs) - 1)
        return np.where(self.signs[at] == points, self.sign_symbols[at], -1)


def symbols(path: str) -> Symbols:
    """The model's tables, a few MB, read once by a worker."""
    if path not in _SYMBOLS:
        _SYMBOLS.clear()
        _SYMBOLS[path] = Symbols(path)
    return _SYMBOLS[path]


def _ends(owner: np.ndarray) -> np.ndarray:
    """Whether a symbol is the last one of its sequence."""
    out = np.ones(len(owner), bool)
    out[:-1] = owner[1:] != owner[:-1]
    return out


def surviving(model: Symbols, held: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The symbols of each of n sequences after all merges, as token counts.

    `held` has the symbols of the sequences (-1: a sign of no piece, which the caller counts), `owner` the sequence of each, ascending.
    """
    counts = np.zeros(n, np.int64)
    made = model.merged(held, np.append(held[1:], -1))
    made[_ends(owner)] = -1
    while len(held):
        rank = model.ranks(made)
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(begins, len(held)))
        best = np.minimum.reduceat(rank, begins)
        # Sequences without a pair are done.
        live = np.repeat(best < _NONE, sizes)
        if not live.all():
            done = np.flatnonzero(~live & (held >= 0))
            counts += np.bincount(owner[done], model.tokens[held[done]], n).astype(np.int64)
            held, owner, made, rank = held[live], owner[live], made[live], rank[live]
            sizes, best = sizes[best < _NONE], best[best < _NONE]
            if not len(held):
                break
        least = np.repeat(best, sizes)
        at = np.flatnonzero(rank == least)
        # Of pairs that overlap, the first, the third, ... of a run.
        run = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
        at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
        # A merge that makes a better pair goes before the equal ones to its right.
        new, ends = made[at], _ends(owner)
        left = np.where((at > 0) & ~ends[at - 1], held[at - 1], -1)
        touching = np.flatnonzero(at[1:] == at[:-1] + 2) + 1
        same = touching[owner[at[touching]] == owner[at[touching - 1]]]
        left[same] = new[same - 1]
        right = np.where(ends[at + 1], -1, held[np.minimum(at + 2, len(held) - 1)])
        ahead = np.minimum(model.ranks(model.merged(left, new)), model.ranks(model.merged(new, right))) < least[at]
        if ahead.any():
            first = np.full(n, len(held), np.int64)
            np.minimum.at(first, owner[at[ahead]], at[ahead])
            at = at[at <= first[owner[at]]]
        held[at] = made[at]
        keep = np.ones(len(held), bool)
        keep[at + 1] = False
        places = np.cumsum(keep) - 1
        at, held, owner, made = places[at], held[keep], owner[keep], made[keep]
        # Only pairs with a merged symbol are new.
        ends = _ends(owner)
        for which in (at, at[at > 0] - 1):
            made[which] = np.where(ends[which], -1, model.merged(held[which], held[np.minimum(which + 1, len(held) - 1)]))
    return counts


def word_counts(model: Symbols, words: pa.Array) -> np.ndarray:
    """Tokens of each word, which begins with its blanks as U+2581."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if not len(points):
        return np.zeros(len(words), np.int64)
    word = np.repeat(np.arange(len(words)), lengths)
    pairs = points[:-1] << 32 | points[1:]
    at = np.minimum(np.searchsorted(model.beside, pairs), len(model.beside) - 1)
    cut = np.append(True, (model.beside[at] != pairs) | (word[1:] != word[:-1]))
    sequence = np.cumsum(cut) - 1
    held = model.of_signs(points)
    counts = surviving(model, held.copy(), sequence, int(sequence[-1]) + 1)
    # Signs that no piece holds are a token for each byte, and always sequences of their own.
    strange = held < 0
    size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    counts[sequence[strange]] += size[strange]
    return np.bincount(word[cut], counts, len(words)).astype(np.int64)


def counted(model: Symbols, texts: pa.Array) -> np.ndarray:
    """Tokens of each text; every distinct word of the batch is merged once."""
    plain = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
    lists = pc.split_pattern(plain, " ")
    sizes = lists.value_lengths().to_numpy()
    parts = lists.flatten().dictionary_encode()
    codes, table = parts.indices.to_numpy(), parts.dictionary
    owner = np.repeat(np.arange(len(texts)), sizes)
    last = _ends(owner)
    empty = pc.equal(pc.binary_length(table), 0).to_numpy(zero_copy_only=False)[codes]
    # A blank stands before each part; an empty part's goes to the next one, unless its text ends there.
    blanks = np.ones(len(codes), np.int64)
    if empty.any():
        index = np.arange(len(codes))
        begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
        filled = np.maximum.accumulate(np.where(~empty, index, -1))
        before = np.append(-1, filled[:-1])
        blanks = index - np.maximum(before, begins - 1)
        kept = ~empty | last
        codes, owner, blanks = codes[kept], owner[kept], blanks[kept]
    width = int(blanks.max(initial=1)) + 1
    keys, codes = np.unique(codes.astype(np.int64) * width + blanks, return_inverse=True)
    runs = pc.binary_repeat(pa.array([SPACE] * len(keys), pa.large_string()), pa.array(keys % width))
    words = pc.binary_join_element_wise(runs, table.take(pa.array(keys // width)), pa.scalar("", pa.large_string()))
    out = np.bincount(owner, word_counts(model, words)[codes], len(texts)).astype(np.int64)
    out[pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)] = 0
    return out


def _parts(text: str, size: int = PART) -> Iterator[str]:
    """A long text in parts that are counted on their own; the blank between two of them is the second one's first."""
    start = 0
    while len(text) - start > size:
        at = start + size
        while (at := text.find(" ", at)) > 0 and text[at - 1] in (" ", SPACE):
            at += 1
        if at < 0:
            break
        yield text[start:at]
        start = at + 1
    yield text[start:]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes, tokens as the model file's library gives them
    without begin or end, and whether they are more than `limit`.

    A null or empty text has no tokens. Rows that repeat an id, or have none, are returned each; other columns are ignored.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = symbols(path)
        for batch in slices(batches, "text", PART):
            texts = batch.column("text")
            size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            if len(texts) == 1 and size[0].as_py() > PART:
                tokens = np.array([sum(int(counted(model, pa.array([part]))[0]) for part in _parts(texts[0].as_py()))])
            else:
                tokens = counted(model, texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, ddl(f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"))
