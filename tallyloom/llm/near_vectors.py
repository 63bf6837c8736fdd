"""Near-duplicate embeddings: Euclidean p-stable hashing in several tables, exact cosine checks.

A table's key of a unit vector x is floor((a_i . x + b_i) / WINDOW) for k Gaussian a_i and uniform
b_i. For unit vectors a cosine of c is a distance of sqrt(2 - 2 c), so cosine order is distance order.
The number of projections k follows from the number of vectors, so that a bucket holds about MATES
unrelated vectors at any size; the number of tables follows from k and the recall asked for, for a
pair just at the threshold (closer pairs meet more often).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.blocks import block_pairs, by_unit, forest, groups
from tallyloom.llm.components import components
from tallyloom.llm.shared import ddl, written
from tallyloom.llm.words import mixed

WINDOW = 2.0
#: Unrelated vectors that may share a bucket, and the distance they are taken to have at least.
MATES, UNRELATED = 64, 1.3
RECALL = 0.995
#: Rows of a bucket or component that one task holds; larger ones are cut into pairs of blocks.
BLOCK = 2048
_CHUNK = 512


def collision(distance: float, window: float = WINDOW) -> float:
    """Probability that one projection puts two points at this distance into the same cell."""
    if distance <= 0:
        return 1.0
    r = window / distance
    below = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections per table, tables) for n vectors."""
    k = max(6, math.ceil(math.log(max(n, 1) / MATES) / -math.log(collision(UNRELATED)))) if n > MATES else 6
    meet = collision(math.sqrt(2 - 2 * threshold)) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _unit_rows(column, kind: str):
    """Unit vectors in double precision, by dimension: (rows, matrix) pairs, from raw binary values."""
    import numpy as np

    raw = column.to_pylist()
    lengths = np.array([len(x) for x in raw])
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        matrix = np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64)
        # Scaling by the largest component first keeps huge and tiny values finite.
        matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
        yield rows, matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _raw(kind: str):
    def convert(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Valid vectors as binary; null for those that link with nothing."""
        import numpy as np

        for batch in batches:
            lists = batch.column("vector")
            values = lists.flatten()
            numbers = values.to_numpy(zero_copy_only=False).astype(kind)
            present = ~np.isnan(numbers) & np.isfinite(numbers)
            valid = lists.is_valid().to_numpy(zero_copy_only=False)
            lengths = np.where(valid, lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
            ends = np.cumsum(lengths)
            out = []
            for start, end in zip(ends - lengths, ends):
                good = end > start and present[start:end].all() and numbers[start:end].any()
                out.append(numbers[start:end].tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vector"])

    return convert


def _hashed(kind: str, k: int, tables: int):
    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            for rows, unit in _unit_rows(batch.column("vector"), kind):
                rng = np.random.default_rng([9, unit.shape[1]])
                lines, shift = rng.standard_normal((unit.shape[1], tables * k)), rng.random(tables * k) * WINDOW
                cells = np.floor((unit @ lines + shift) / WINDOW).astype(np.int64).view(np.uint64)
                cells = cells.reshape(len(rows), tables, k)
                key = np.broadcast_to(np.arange(tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 32), cells.shape[:2])
                for j in range(k):
                    key = mixed(key ^ cells[:, :, j]) + np.uint64(j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[rows], tables)), pa.array(key.ravel().view(np.int64))], ["id", "bucket"]
                )

    return keys


def _linked(unit: pa.Table, kind: str, threshold: float) -> Iterator[tuple]:
    """(ids, a, b) index arrays of the pairs of a unit that meet the threshold, a chunk at a time."""
    import numpy as np

    everyone, sides = unit["id"].to_numpy(), unit["_side"].to_numpy()
    for rows, matrix in _unit_rows(unit["vector"], kind):
        side = sides[rows]
        first, second = (np.flatnonzero(side != 1), np.flatnonzero(side != 0))
        for at in range(0, len(first), _CHUNK):
            left = first[at : at + _CHUNK]
            a, b = np.nonzero(matrix[left] @ matrix[second].T >= threshold)
            a, b = left[a], second[b]
            both = a < b if side[0] == -1 else slice(None)
            yield everyone, rows[a[both]], rows[b[both]]


def _forests(kind: str, threshold: float):
    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links that connect what all links of the bucket connect."""
        import numpy as np

        for unit in groups(batches, "_unit"):
            parts, ids = [], None
            for ids, a, b in _linked(unit, kind, threshold):
                if len(a):
                    parts.append(forest(len(ids), a, b))
            if parts:
                a, b = forest(len(ids), *(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

    return link


def _counts(kind: str, threshold: float):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row of a unit the vectors linked with it there, copies counted."""
        import numpy as np

        for unit in groups(batches, "_unit"):
            copies, total = unit["copies"].to_numpy(), np.zeros(unit.num_rows, np.int64)
            for _, a, b in _linked(unit, kind, threshold):
                np.add.at(total, a, copies[b])
                np.add.at(total, b, copies[a])
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit["id"].to_numpy()[some]), pa.array(total[some])], ["id", "linked"]
            )

    return count


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.9,
    recall: float = RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by cosine, computed in double precision.

    Equal vectors are one class and counted. Classes that share a bucket in some table are compared
    exactly where they meet, and each bucket gives on just the links that hold its members together.
    Links of a component are then counted by comparing its members exactly, once.

    Null, empty, zero or non-finite vectors, and those with a null component, have 0 links and their own
    component; vectors of different lengths are not linked. A null id is kept as a row without links.
    Rows that repeat an id are one node. Other columns are ignored.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    spark_kind = "float" if element == "float" else "double"
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(f"array<{spark_kind}>").alias("vector")
    )
    rows = written(rows.mapInArrow(_raw(kind), ddl("id bigint, vector binary")), "vectors")
    usable = rows.where("id IS NOT NULL AND vector IS NOT NULL")
    prints = usable.select("id", F.sha2("vector", 256).alias("print"))
    classes = prints.groupBy("print").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies"))
    member = written(prints.join(classes, "print").select("id", "head", "copies"), "members")
    counted = member.where("id = head").groupBy("id").agg(F.max("copies").alias("copies"))
    heads = written(usable.join(counted, "id").dropDuplicates(["id", "vector"]), "heads")

    k, tables = tables_for(heads.count(), threshold, recall)
    buckets = written(heads.select("id", "vector").mapInArrow(_hashed(kind, k, tables), ddl("id bigint, bucket bigint")), "buckets")
    meeting = block_pairs(buckets, "bucket", "id", BLOCK).select("id", "_unit", "_side")
    units = by_unit(meeting.join(heads.select("id", "vector"), "id"))
    links = written(units.mapInArrow(_forests(kind, threshold), ddl("a bigint, b bigint")).distinct(), "links")
    named = components(links)

    placed = block_pairs(named, "component", "id", BLOCK).select("id", "_unit", "_side")
    units = by_unit(placed.join(heads, "id"))
    linked = (
        units.mapInArrow(_counts(kind, threshold), ddl("id bigint, linked bigint"))
        .groupBy("id").agg(F.sum("linked").alias("linked"))
    )
    known = (
        member.dropDuplicates(["id", "head"])
        .join(linked.withColumnRenamed("id", "head"), "head", "left")
        .join(named.withColumnRenamed("id", "head"), "head", "left")
        .groupBy("id")
        .agg(
            F.sum(F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("n_links"),
            F.min(F.coalesce("component", "head")).alias("component"),
        )
    )
    return rows.select("id").join(known, "id", "left").select(
        F.col("id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
