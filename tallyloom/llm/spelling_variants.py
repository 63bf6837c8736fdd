"""Spelling variants: words one edit apart, found by pivotal grams, and the form that each goes back to.

Bigrams are ordered by the number of words that hold them, rare ones first. The three first of a word, and all that are
equal to the third, are its prefix; its two pivots are the disjoint bigrams of the prefix that the fewest words hold in sum, by
dynamic programming over the positions. One edit spoils one pivot at most, so of two words one edit apart, the
one whose prefix ends no later has a pivot left that is in the other's prefix. The edit is either to the right of
it, and then the words are equal up to the pivot's end, or to the left, and then they are equal from its start on:
that fixes the pivot's position in the other word, and is the key of the index. Every candidate is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shared import ddl, slices, written

#: Of the runs of letters of a document, one in so many loses a sign, as the query's contract asks for.
SPOILED = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Edits times the gram's length, plus one.
PREFIX = 3
#: A form is at least so many times as frequent.
TIMES = 2
#: Distinct words that a task counts before it passes them on.
KEPT_WORDS = 200_000
_LETTERS = "a-zÀ-ÿ"
_RUNS = re.compile(f"[{_LETTERS}]{{{LEAST_LENGTH},}}")
_LONG = 8 << 20


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoiled: int | None = SPOILED) -> DataFrame:
    """(word, n): the runs of letters, A-Z lowered, of LEAST_LENGTH signs and LEAST_COUNT occurrences at least.

    With `spoiled`, a run of a document whose crc32 with the id it divides loses one sign first. Words are counted in
    the tasks, a bounded number at a time, before they are shuffled.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            ids = batch.column("id").to_pylist()
            for doc, text in zip(ids, pc.ascii_lower(pc.fill_null(batch.column("text"), "")).to_pylist()):
                found = _RUNS.findall(text) if len(text) < _LONG else (m.group() for m in _RUNS.finditer(text))
                own = Counter(found)
                if spoiled:
                    start = zlib.crc32(f"{doc}:".encode())
                    hit = [(w, h) for w in own if (h := zlib.crc32(w.encode(), start)) % spoiled == 0]
                    # All of a document's runs are looked at before one is put back without its sign.
                    hit = [(w, h, own.pop(w)) for w, h in hit]
                    for word, h, n in hit:
                        at = h % len(word)
                        if len(word) > LEAST_LENGTH:
                            own[word[:at] + word[at + 1 :]] += n
                counts.update(own)
                if len(counts) > KEPT_WORDS:
                    yield passed()
                    counts.clear()
        yield passed()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(count, ddl("word string, n bigint"))
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def gram_order(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Of every bigram its place, rare ones first, and how many words hold it (each place in a word counts).

    There are 90 letters, so at most 8,100 rows reach the driver.
    """
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))
    counted = words.select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()
    ordered = sorted(counted, key=lambda r: (r["n"], r["gram"]))
    return {r["gram"]: (place, r["n"]) for place, r in enumerate(ordered)}


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], list[int]]:
    """(place of the prefix's last bigram, positions of the prefix, positions of the two pivots)."""
    grams = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(place for place, _ in grams)[PREFIX - 1]
    prefix = [i for i, (place, _) in enumerate(grams) if place <= last]
    # Over the positions: the lightest bigram that ended before, and the lightest pair so far.
    single, pair, ready = None, None, 0
    for i in prefix:
        while prefix[ready] <= i - 2:
            own = (grams[prefix[ready]][1], prefix[ready])
            single = own if single is None else min(single, own)
            ready += 1
        if single is not None:
            both = (single[0] + grams[i][1], single[1], i)
            pair = both if pair is None else min(pair, both)
    return last, prefix, list(pair[1:])


def signed(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """(word, n, size, last, prefix, pivots) of every word; positions from 0."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [prefix_and_pivots(w, order) for w in batch.column("word").to_pylist()]
            last, prefix, pivots = zip(*found) if found else ((), (), ())
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("word"), batch.column("n"), pc.utf8_length(batch.column("word")),
                    pa.array(last, pa.int32()), pa.array(prefix, ints), pa.array(pivots, ints),
                ],
                ["word", "n", "size", "last", "prefix", "pivots"],
            )

    return words.mapInArrow(sign, ddl("word string, n bigint, size int, last int, prefix array<int>, pivots array<int>"))


def near_pairs(signs: DataFrame) -> DataFrame:
    """(word, n, near, near_n) for every two words one edit apart, both ways round."""

    def keyed(positions: str, sizes: list, names: dict[str, str]) -> DataFrame:
        rows = signs.select("*", F.explode(positions).alias("_at"))
        keys = []
        for size in sizes:
            keys.append(F.xxhash64(F.lit(0), F.substr("word", F.lit(1), F.col("_at") + 2), size))
            keys.append(F.xxhash64(F.lit(1), F.substr("word", F.col("_at") + 1), size))
        return rows.select(F.explode(F.array(*keys)).alias("key"), *[F.col(c).alias(name) for c, name in names.items()])

    # A pivot looks for words one sign shorter, as long, and one sign longer.
    pivots = keyed("pivots", [F.col("size") + d for d in (-1, 0, 1)], {"word": "a", "n": "a_n", "last": "a_last"})
    prefixes = keyed("prefix", [F.col("size")], {"word": "b", "n": "b_n", "last": "b_last"})
    met = pivots.join(prefixes, "key").where("a_last <= b_last AND a <> b")
    near = met.where(F.levenshtein("a", "b", 1) == 1)
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    # A pair may meet at several keys.
    return near.select(F.inline(both)).groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following (word, form) ends. A form is at least twice as frequent as its word, so there are
    no rings, and a chain of forms is no longer than the logarithm of the largest count; every round doubles the step."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = now.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        after = written(moved, "roots")
        now = after.drop("_moved")
        if after.where("_moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoiled: int | None = SPOILED) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `word_counts`: how many words are one edit away, the most frequent of
    them (ties: the first in code-point order) if it is at least twice as frequent, and the last of the chain of forms.

    A null or empty text has no words; a null id counts as the empty string. Rows that repeat an id are counted each. A word
    without near ones has none, no form, and is its own root. Without words there are no rows. Other columns are ignored.
    """
    words = written(word_counts(docs, id_col, text_col, spoiled), "words")
    signs = written(signed(words, gram_order(words)), "signs")
    best = F.min(F.struct(-F.col("near_n"), F.col("near")))
    nears = near_pairs(signs).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_best"))
    form_n = -F.col("_best.col1")
    form = F.when(form_n >= TIMES * F.col("n"), F.col("_best.near"))
    found = written(nears.select("word", "n_near", form.alias("form"), F.when(form.isNotNull(), form_n).alias("form_n")), "nears")
    ends = roots(found.where("form IS NOT NULL"))
    joined = words.join(found, "word", "left").join(ends, "word", "left")
    return joined.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n"
    )
