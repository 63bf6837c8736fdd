"""Near-duplicate texts: HyperMinHash registers, banding, corrected estimates, exact confirmation.

Every distinct shingle goes to each of a number of buckets under that bucket's own hash. A bucket keeps
its least hash value compressed: the count of leading zeros (6 bits) and the next bits, the mantissa. (With
one hash for all buckets, short texts would leave most of them empty.) Texts whose REGISTERS registers of
16 bits agree in all ROWS of a band are candidates. Texts with candidates get FINE more registers of 8 bits; a
candidate pair goes on if its Jaccard estimate from those, corrected for collisions of compressed values,
is at least ESTIMATE; it is a link if the full sets meet the threshold exactly.

At the threshold of 0.75 a pair shares no band with probability (1 - 0.75**3)**32 = 2e-8; its estimate
from 512 registers is under ESTIMATE with probability below 1e-6 (five standard errors of 0.02).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.blocks import block_pairs, by_unit, groups
from tallyloom.llm.components import components
from tallyloom.llm.shared import ddl, slices, utf8, written
from tallyloom.llm.words import mixed, shingles, word_hashes

BANDS, ROWS = 32, 3
REGISTERS = BANDS * ROWS
MANTISSA = 10
FINE, FINE_MANTISSA = 512, 2
ESTIMATE = 0.65
WIDTH = 5
#: Rows of a band bucket that one task holds; larger buckets are cut into pairs of blocks.
BLOCK = 2048
#: Text bytes whose shingles are hashed at once; the work arrays take about 20 times as much.
_BYTES = 1 << 20
#: The constant of the expected collisions of two compressed registers of sets of equal size.
COLLISION = 0.169919487159739093975315012348


def registers(values, begins, first: int = 0, count: int = REGISTERS, mantissa: int = MANTISSA):
    """HyperMinHash registers `first` .. `first + count` (texts x count) of non-empty runs of shingle hashes:
    uint16, or uint8 for a mantissa of two bits at most."""
    import numpy as np

    rng = np.random.default_rng(20)
    scale = rng.integers(1 << 62, 1 << 63, REGISTERS + FINE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, REGISTERS + FINE, dtype=np.uint64)
    kind = np.uint8 if mantissa <= 2 else np.uint16
    out = np.empty((len(begins), count), kind)
    for k in range(count):
        x = (values ^ salt[first + k]) * scale[first + k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        fraction, exponent = np.frexp((np.minimum.reduceat(x, begins) >> np.uint64(1)).astype(np.float64))
        zeros = np.minimum(64 - exponent, 63)
        cells = np.clip((fraction * 2 - 1) * (1 << mantissa), 0, (1 << mantissa) - 1)
        out[:, k] = (zeros.astype(kind) << kind(mantissa)) | cells.astype(kind)
    return out


def estimates(equal, left, right, mantissa: int = FINE_MANTISSA):
    """Jaccard estimates from the share of equal registers and the two set sizes."""
    import numpy as np

    left, right = np.maximum(left, 1).astype(float), np.maximum(right, 1).astype(float)
    ratio = np.maximum(left, right) / np.minimum(left, right)
    chance = COLLISION * 2.0**-mantissa * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def _sets(batch: pa.RecordBatch, column: str):
    """(distinct shingle hashes, where each row's begin), sorted within each row."""
    import numpy as np

    values, begins = shingles(*word_hashes(*utf8(batch.column(column))), WIDTH)
    parts = [np.unique(values[a:b]) for a, b in zip(begins[:-1], begins[1:])]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else values), np.concatenate([[0], np.cumsum(sizes)])


def _binary_rows(matrix) -> pa.Array:
    """The rows of a matrix as binary values."""
    import numpy as np

    data = np.ascontiguousarray(matrix)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.itemsize * data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _matrix(column, kind, width: int):
    import numpy as np

    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    import numpy as np

    for batch in slices(batches, "text", _BYTES):
        values, begins = _sets(batch, "text")
        sizes = np.diff(begins)
        full = np.flatnonzero(sizes > 0)
        data = values.tobytes()
        prints = [
            hashlib.blake2b(data[8 * begins[i] : 8 * begins[i + 1]], digest_size=16).digest() if sizes[i] else None
            for i in range(len(sizes))
        ]
        matrix = np.zeros((len(sizes), REGISTERS), np.uint16)
        if len(full):
            matrix[full] = registers(values, begins[:-1][full])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(sizes), pa.array(prints, pa.binary()), _binary_rows(matrix)],
            ["id", "n_shingles", "print", "registers"],
        )


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, print, registers); print is the digest of the whole set, null if it is empty."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_signed, ddl("id bigint, n_shingles bigint, print binary, registers binary"))


def _banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in slices(batches, "registers"):
        cells = _matrix(batch.column("registers"), np.uint16, REGISTERS).reshape(-1, BANDS, ROWS).astype(np.uint64)
        packed = (cells[:, :, 0] << np.uint64(32)) | (cells[:, :, 1] << np.uint64(16)) | cells[:, :, 2]
        keys = mixed(packed ^ (np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(49)))
        ids = np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)
        numbers = np.tile(np.arange(BANDS, dtype=np.int8), len(cells))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(keys.ravel().view(np.int64)), pa.array(numbers)], ["id", "band", "number"]
        )


def _estimated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both signatures, those with a high enough estimate."""
    import numpy as np

    for batch in slices(batches, "ra", _BYTES):
        left, right = (_matrix(batch.column(c), np.uint8, FINE) for c in ("ra", "rb"))
        sizes = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")]
        good = estimates((left == right).mean(axis=1), *sizes) >= ESTIMATE
        chosen = pa.array(np.flatnonzero(good))
        yield batch.select(["a", "b"]).take(chosen)


def _confirmed(percent: int):
    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links: pairs whose sorted sets share enough."""
        import numpy as np

        for batch in slices(batches, "sa"):
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"))):
                left, right = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return confirm


def _as_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets, their sizes and fine registers of texts that have at least one shingle."""
    import numpy as np

    for batch in slices(batches, "text", _BYTES):
        values, begins = _sets(batch, "text")
        sizes = np.diff(begins)
        full = np.flatnonzero(sizes > 0)
        if len(full):
            fine = registers(values, begins[:-1][full], REGISTERS, FINE, FINE_MANTISSA)
            data = values.tobytes()
            parts = [data[8 * begins[i] : 8 * begins[i + 1]] for i in full]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(full)), pa.array(parts, pa.binary()), pa.array(sizes[full]), _binary_rows(fine)],
                ["id", "words", "n_shingles", "fine"],
            )


def _rest_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs across components within a bucket, each in the first band that its texts share, but for those
    with a bucket's leader, which are tested already. One row for each text of a pair, the pairs packed in the
    row of their smaller id: the other ids (int64) and the estimates (float32)."""
    import numpy as np

    for unit in groups(slices(batches, "fine"), "_unit"):
        ids, number = unit["id"].to_numpy(), unit["number"][0].as_py()
        bands = _matrix(unit["registers"], np.uint16, REGISTERS).reshape(-1, BANDS, ROWS)
        fine, sizes = _matrix(unit["fine"], np.uint8, FINE), unit["n_shingles"].to_numpy()
        own, side, leader = (unit[c].to_numpy() for c in ("component", "_side", "leader"))
        met, mates_of, chances_of = np.zeros(len(ids), bool), {}, {}
        for i in range(len(ids)):
            mates = np.flatnonzero((own != own[i]) & (ids > ids[i]) & (leader != ids[i]))
            if side[i] != -1:
                mates = mates[side[mates] != side[i]]
            if len(mates):
                chance = estimates((fine[mates] == fine[i]).mean(axis=1), sizes[i], sizes[mates])
                good = chance >= ESTIMATE
                good &= ~(bands[mates, :number] == bands[i, :number]).all(axis=2).any(axis=1)
                if good.any():
                    mates_of[i], chances_of[i] = ids[mates[good]].tobytes(), chance[good].astype(np.float32).tobytes()
                    met[i] = met[mates[good]] = True
        rows = np.flatnonzero(met)
        if len(rows):
            yield pa.RecordBatch.from_arrays(
                [
                    unit["_unit"].combine_chunks().take(pa.array(rows)),
                    pa.array(ids[rows]),
                    pa.array(own[rows]),
                    pa.array([mates_of.get(i, b"") for i in rows.tolist()], pa.binary()),
                    pa.array([chances_of.get(i, b"") for i in rows.tolist()], pa.binary()),
                ],
                ["_unit", "id", "component", "mates", "chances"],
            )


def _rest_links(percent: int):
    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that connect the components of a unit: its pairs are tested exactly, the likeliest first, but not
        those whose components its links have connected already."""
        import numpy as np

        for unit in groups(slices(batches, "words"), "_unit"):
            ids, own = unit["id"].to_numpy(), unit["component"].to_numpy()
            place = {i: k for k, i in enumerate(ids.tolist())}
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in unit["words"]]
            pairs = []
            for k, (mates, chances) in enumerate(zip(unit["mates"].to_pylist(), unit["chances"].to_pylist())):
                pairs += [(-c, k, place[m]) for m, c in zip(np.frombuffer(mates, np.int64).tolist(), np.frombuffer(chances, np.float32).tolist())]
            root = {c: c for c in own.tolist()}

            def find(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            out = []
            for _, x, y in sorted(pairs):
                p, q = find(own[x]), find(own[y])
                if p != q:
                    left, right = sets[x], sets[y]
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    if 100 * both >= percent * (len(left) + len(right) - both):
                        root[max(p, q)] = min(p, q)
                        out.append((ids[x], ids[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out]), pa.array([b for _, b in out])], ["a", "b"])

    return confirm


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of texts linked by similar shingle sets.

    Texts with equal sets are one class, found by the digest of the set. Classes meet in bands: first
    every class is tested against the smallest id of its bucket. Then, in buckets that still hold
    several components, all pairs across components with a high enough estimate are tested where their bucket
    is, the sets being sent there once per text: no link between components is lost, however a group hangs
    together, no table of pairs is made, and within a component no further pair is tested.

    Null or empty texts, and those without words, have 0 shingles and are their own component. A null
    id is kept as a row of its own component (null) and linked with nothing. Rows that repeat an
    id are one node: links of any of them count, and each row is returned. Other columns are ignored.
    """
    signed = written(signatures(docs, id_col, text_col), "signatures")
    usable = signed.where("id IS NOT NULL AND print IS NOT NULL")
    classes = usable.groupBy("print").agg(F.min("id").alias("a"))
    member = usable.join(classes, "print").select("id", "a")
    heads = written(
        usable.join(classes.select("print", F.col("a").alias("id")), ["print", "id"])
        .groupBy("id", "print").agg(F.first("registers").alias("registers"))
        .select("id", "registers"),
        "heads",
    )
    bands = written(heads.select("id", "registers").mapInArrow(_banded, ddl("id bigint, band bigint, number tinyint")), "bands")
    leaders = bands.groupBy("band").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n"))
    shared = written(bands.join(leaders.where("n > 1").drop("n"), "band"), "shared")

    # Only classes that share a bucket need their sets.
    wanted = shared.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = texts.join(wanted, "id", "left_semi").mapInArrow(
        _as_sets, ddl("id bigint, words binary, n_shingles bigint, fine binary")
    )
    sets = written(sets.dropDuplicates(["id", "words"]), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("fine").alias("ra"), F.col("n_shingles").alias("na"))
        right = sets.select(F.col("id").alias("b"), F.col("fine").alias("rb"), F.col("n_shingles").alias("nb"))
        likely = written(
            pairs.distinct().join(left, "a").join(right, "b").mapInArrow(_estimated, ddl("a bigint, b bigint")), "likely"
        )
        first = sets.select(F.col("id").alias("a"), F.col("words").alias("sa"))
        second = sets.select(F.col("id").alias("b"), F.col("words").alias("sb"))
        joined = likely.join(first, "a").join(second, "b").select("a", "b", "sa", "sb")
        return written(joined.mapInArrow(_confirmed(percent), ddl("a bigint, b bigint")), "confirmed")

    found = links(shared.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")))
    placed = shared.join(components(found), "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    open_rows = written(placed.join(apart.select("band"), "band"), "open")
    dealt = block_pairs(open_rows, "band", "id", BLOCK).join(heads, "id").join(sets.drop("words"), "id")
    rest = written(
        by_unit(dealt).mapInArrow(_rest_pairs, ddl("_unit bigint, id bigint, component bigint, mates binary, chances binary")), "rest"
    )
    tested = by_unit(rest.join(sets.select("id", "words"), "id"))
    found = found.unionByName(written(tested.mapInArrow(_rest_links(percent), ddl("a bigint, b bigint")), "rest-links"))

    # Repeated ids of different texts join their classes.
    ends = found.unionByName(member.where("id <> a").select("a", F.col("id").alias("b")))
    named = components(ends)
    return (
        signed.join(named, "id", "left")
        .select(
            F.col("id").alias("doc_id"),
            "n_shingles",
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
