"""Cross-entropy difference of texts between a target and a background model of the same kind.

Both models are character n-gram models of order ORDER over one vocabulary, the Unicode code points, interpolated from the
uniform distribution upwards. A context that was seen c times gives its shorter context the weight of ceil(sqrt(c)) counts:
this smoothing is the module's own and not Witten-Bell's, which would count the context's distinct continuations.
The lowest order gives the uniform distribution the number of distinct characters. The background is counted over all texts, the target over the texts that are marked. The
n-grams themselves are counted, in Spark with partial sums, and their counts are written tables, one for each order,
that grow with the corpus. A text's score is the mean over its characters, its end included,
of loss under the target minus loss under the background, in bits: lower means more like the target.

The loss of a character follows from the n-gram of order ORDER that ends there. So texts are scored by blocks: the distinct
n-grams of a block are joined to the losses, each block's losses become a file, and the block's texts are read
along with it.
"""

from __future__ import annotations

import itertools
import operator
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.files import created, opened
from tallyloom.llm.shared import ddl, new_folder, slices, written

ORDER = 5
VOCABULARY = 0x110000
END = 0x10FFFF
#: An n-gram is two numbers, its last three points in `low` and those before in `high`, each point plus one in so many bits.
_BITS = 21
_POINT = (1 << _BITS) - 1
_BATCH = 1 << 21
#: Text bytes of a block, and rows of n-gram counts that a task holds.
_BLOCK, _HELD = 24 << 20, 1 << 20
_GRAM = ["high", "low"]


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points with END after each text, where each text begins) of a string column; nulls are empty. An END sign
    within a text, which is no character, counts as U+FFFD."""
    raw = [(t or "").replace(chr(END), "\ufffd").encode("utf-32-le") for t in column.to_pylist()]
    sizes = np.array([len(r) // 4 + 1 for r in raw], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    end = np.uint32(END).tobytes()
    return np.frombuffer(b"".join(x for r in raw for x in (r, end)), np.uint32), begins


def _mixed(key: np.ndarray, past: np.ndarray) -> np.ndarray:
    """The key of n-grams with one more point before them."""
    key = (key + past + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return key ^ (key >> np.uint64(32))


def cells(points: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """For each order, a 64-bit key of the n-gram that ends at each position; before a text there are END signs."""
    place = np.arange(len(points)) - np.repeat(begins[:-1], np.diff(begins))
    out, key = [], np.zeros(len(points), np.uint64)
    for back in range(ORDER):
        past = np.full(len(points), END, np.uint64)
        if back < len(points):
            past[back:] = points[: len(points) - back]
        past[place < back] = END
        key = _mixed(key, past)
        out.append(key.view(np.int64))
    return out


def _distinct(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the number of the n-gram of order ORDER at each position, the n-grams' keys, where each n-gram is)."""
    coded = pa.array(cells(points, begins)[-1]).dictionary_encode()
    numbers = coded.indices.to_numpy()
    at = np.empty(len(coded.dictionary), np.int64)
    at[numbers] = np.arange(len(numbers))
    return numbers, coded.dictionary.to_numpy(), at


def _grams(points: np.ndarray, begins: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """[high, low] of the n-grams of order ORDER that end at some positions."""
    first = begins[np.searchsorted(begins, at, "right") - 1]
    high, low = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for back in range(ORDER):
        past = np.where(at - back >= first, points[np.maximum(at - back, 0)], END).astype(np.int64) + 1
        if back < 3:
            low |= past << (_BITS * back)
        else:
            high |= past << (_BITS * (back - 3))
    return [high, low]


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The keys, as `cells` has them, of n-grams of order ORDER."""
    key = np.zeros(len(low), np.uint64)
    for back in range(ORDER):
        part, shift = (low, back) if back < 3 else (high, back - 3)
        key = _mixed(key, ((part >> (_BITS * shift)) & _POINT).astype(np.uint64) - np.uint64(1))
    return key.view(np.int64)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the n-grams of order ORDER in a task's texts: (high, low, target, background)."""
    names, held = [*_GRAM, "target", "background"], []

    def merged() -> pa.Table:
        found = pa.concat_tables(held).group_by(_GRAM).aggregate([("target", "sum"), ("background", "sum")])
        return found.select([*_GRAM, "target_sum", "background_sum"]).rename_columns(names)

    for batch in slices(batches, "text", _BATCH):
        points, begins = codes(batch.column("text"))
        wanted = np.repeat(batch.column("target").to_numpy(zero_copy_only=False).astype(bool), np.diff(begins))
        numbers, keys, at = _distinct(points, begins)
        counts = [np.bincount(numbers[wanted], minlength=len(keys)), np.bincount(numbers, minlength=len(keys))]
        held.append(pa.table([*_grams(points, begins, at), *counts], names))
        if sum(map(len, held)) > _HELD:
            held = [merged()]
            if len(held[0]) > _HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def _suffix(n: int) -> list:
    """[high, low] of the last n - 1 points of an n-gram."""
    high, low = F.col("high"), F.col("low")
    kept = _BITS * min(n - 1, 3)
    return [
        (high.bitwiseAND(F.lit(_POINT)) if n == 5 else F.lit(0).cast("bigint")),
        low if kept == 3 * _BITS else low.bitwiseAND(F.lit((1 << kept) - 1)),
    ]


def _prefix() -> list:
    """[high, low] of an n-gram without its last point."""
    high, low = F.col("high"), F.col("low")
    return [
        F.shiftright(high, _BITS),
        F.shiftright(low, _BITS).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(_POINT)), 2 * _BITS)),
    ]


def fit(rows: DataFrame) -> list[DataFrame]:
    """For each order the written table (high, low, target, background) of n-gram counts, from (text, target)."""
    sums = [F.sum(c).alias(c) for c in ("target", "background")]
    counted = rows.select("text", "target").mapInArrow(_counted, ddl("high bigint, low bigint, target bigint, background bigint"))
    out = [written(counted.groupBy(*_GRAM).agg(*sums), "ngrams")]
    for n in range(ORDER, 1, -1):
        # Each n-gram ends with one that is a point shorter, so the counts of those are sums.
        high, low = _suffix(n)
        shorter = out[0].select(high.alias("high"), low.alias("low"), "target", "background")
        out.insert(0, written(shorter.groupBy(*_GRAM).agg(*sums), "ngrams"))
    return out


def _beginning(n: int) -> tuple[int, int]:
    """(high, low) of n END signs: the context at the beginning of a text."""
    parts = [(END + 1) << (_BITS * back) for back in range(3)]
    return (END + 1 if n > 3 else 0), sum(parts[: min(n, 3)])


def _found(rows: DataFrame, table: DataFrame, on: list[str], columns: dict[str, str]) -> DataFrame:
    """`rows` with columns of the table's n-gram that is in the columns `on`; one plan for any size."""
    named = table.select(F.col("high").alias("_high"), F.col("low").alias("_low"), *[F.col(c).alias(to) for c, to in columns.items()])
    same = (F.col(on[0]) == F.col("_high")) & (F.col(on[1]) == F.col("_low"))
    return rows.join(named.hint("merge"), same, "left").drop("_high", "_low")


_MODELS = ("target", "background")


def _chances(grams: DataFrame, models: list[DataFrame]) -> DataFrame:
    """(high, low, target, background): the chance of the last point of n-grams of order ORDER, which are distinct."""
    sets = [grams]
    for n in range(ORDER, 1, -1):
        high, low = _suffix(n)
        sets.insert(0, sets[0].select(high.alias("high"), low.alias("low")).distinct())
    totals = models[0].agg(
        *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in _MODELS],
        *[F.count_if(F.col(m) > 0).alias(f"{m}_kinds") for m in _MODELS],
        *[F.coalesce(F.sum(F.when(F.col("low") == END + 1, F.col(m))), F.lit(0)).alias(f"{m}_texts") for m in _MODELS],
    ).first()
    chances = None
    for n, (own, model) in enumerate(zip(sets, models), 1):
        own = _found(own, model, _GRAM, {m: f"{m}_found" for m in _MODELS})
        if n > 1:
            (before_high, before_low), (after_high, after_low) = _prefix(), _suffix(n)
            own = own.withColumns({"_bh": before_high, "_bl": before_low, "_ah": after_high, "_al": after_low})
            own = _found(own, models[n - 2], ["_bh", "_bl"], {m: f"{m}_seen" for m in _MODELS})
            own = _found(own, chances, ["_ah", "_al"], {m: f"{m}_chance" for m in _MODELS})
        out = []
        for m in _MODELS:
            found = F.coalesce(F.col(f"{m}_found"), F.lit(0)).cast("double")
            if n > 1:
                # A context is followed by one character wherever it ends, but for the one at the beginning of a text: its
                # END signs end nowhere, and one character of each text follows them.
                high, low = _beginning(n - 1)
                seen = F.when((F.col("_bh") == high) & (F.col("_bl") == low), F.lit(totals[f"{m}_texts"])).otherwise(F.coalesce(F.col(f"{m}_seen"), F.lit(0)))
                seen, chance = seen.cast("double"), F.col(f"{m}_chance")
                new = F.ceil(F.sqrt(seen)).cast("double")
            else:
                seen, new, chance = F.lit(float(totals[m])), F.lit(float(totals[f"{m}_kinds"])), F.lit(1.0 / VOCABULARY)
            weight = seen + new
            out.append(F.when(weight > 0, (found + new * chance) / weight).otherwise(chance).alias(m))
        chances = own.select(*_GRAM, *out)
    return chances


def marked(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, target) of every row of `docs`; target rows are those whose id is in `chosen` (doc_id)."""
    ids = chosen.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_chosen")).distinct()
    # The chosen ids grow with the corpus: one plan for any size, which does not broadcast them.
    joined = docs.join(ids.hint("merge"), F.col(id_col) == F.col("_chosen"), "left")
    return joined.select(F.col(text_col).cast("string").alias("text"), F.col("_chosen").isNotNull().alias("target"))


def _blocked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the number of their block; a block is of one task and has about _BLOCK bytes of text."""
    block, used = TaskContext.get().partitionId() << 32, 0
    for batch in slices(batches, "text", _BATCH):
        size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        if used and used + size > _BLOCK:
            block, used = block + 1, 0
        used += size
        yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), *batch.columns], ["block", *batch.schema.names])


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each block's number with some of its rows; blocks follow each other."""
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        edges = np.flatnonzero(np.diff(blocks)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(blocks)]):
            if end > start:
                yield int(blocks[start]), batch.slice(start, end - start)


def _block_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, high, low): the distinct n-grams of order ORDER of each block."""
    for block, parts in itertools.groupby(_by_block(slices(batches, "text", _BATCH)), key=operator.itemgetter(0)):
        held = None
        for _, part in parts:
            points, begins = codes(part.column("text"))
            _, _, at = _distinct(points, begins)
            new = pa.table(_grams(points, begins, at), _GRAM)
            held = (pa.concat_tables([held, new]) if held else new).group_by(_GRAM).aggregate([])
        yield from held.append_column("block", pa.array(np.full(len(held), block))).select(["block", *_GRAM]).to_batches()


def _name(block: int) -> str:
    return f"block-{block:016x}.arrow"


def _stored(folder: str):
    """Writes each block's losses to a file, sorted by key; rows come by block."""

    def store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parts in itertools.groupby(_by_block(batches), key=operator.itemgetter(0)):
            rows = pa.Table.from_batches([part for _, part in parts])
            key = _keys(rows["high"].to_numpy(), rows["low"].to_numpy())
            order = np.argsort(key)
            columns = [key[order], *(-np.log2(rows[m].to_numpy()[order]) for m in _MODELS)]
            with created(folder, _name(block)) as out:
                table = pa.table(columns, ["key", *_MODELS])
                with pa.ipc.new_file(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as file:
                    file.write_table(table)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(key)])], ["block", "n"])

    return store


def _scored(folder: str):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, known, losses = None, None, None
        for block, part in _by_block(slices(batches, "text", _BATCH)):
            if block != loaded:
                system, path = opened(folder)
                with system.open_input_file(f"{path}/{_name(block)}") as source:
                    table = pa.ipc.open_file(source).read_all()
                loaded, known, losses = block, table["key"].to_numpy(), [table[m].to_numpy() for m in _MODELS]
            points, begins = codes(part.column("text"))
            numbers, keys, _ = _distinct(points, begins)
            place = np.searchsorted(known, keys)
            if not (known[place] == keys).all():
                raise ValueError(f"block {block}: n-grams without a loss")
            means = [np.add.reduceat(loss[place][numbers], begins[:-1]) / np.diff(begins) for loss in losses]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(begins)), pa.array(means[0]), pa.array(means[1]), pa.array(means[0] - means[1])],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"],
            )

    return score


def loss_difference(docs: DataFrame, models: list[DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference): mean losses in bits a token for every row.

    `models` is what `fit` returns for (text, target) rows, such as `marked` makes. A null text is an empty one,
    with its end as its only token. Rows that repeat are counted and scored each; other columns are ignored.
    With no target rows the target model is uniform. Texts need not be those of `fit`.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = written(rows.mapInArrow(_blocked, ddl(f"block bigint, doc_id {kind}, text string")), "texts")
    grams = written(texts.select("block", "text").mapInArrow(_block_grams, ddl("block bigint, high bigint, low bigint")), "grams")
    chances = _chances(grams.select(*_GRAM).distinct(), models)
    found = _found(grams, chances, _GRAM, {m: m for m in _MODELS})
    folder = new_folder(spark, "losses")
    # A block's n-grams are bounded by its text.
    dealt = found.repartition("block").sortWithinPartitions("block")
    written(dealt.mapInArrow(_stored(folder), ddl("block bigint, n bigint")), "blocks")
    return texts.mapInArrow(
        _scored(folder), ddl(f"doc_id {kind}, n_tokens bigint, target_loss double, background_loss double, difference double")
    )
