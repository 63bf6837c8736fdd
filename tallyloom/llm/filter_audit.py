"""Audit of filters in every order: what each removes, repeats, and is worth, from min-plus removal ranks.

A document fails a set of filters, its mask. Documents are counted by part, mask and labels; there are 32 masks, so from there on
the work does not grow with the corpus. For masks as a matrix (0 where a filter fails, infinity elsewhere) and orders as
inverse permutations (the step at which each filter runs), the min-plus product gives the step at which an order
removes a mask. Counts scattered by that step are the removals; the rest follows by sums over masks.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shared import ddl, slices, written

FILTERS = "ABCDE"
MIN_WORDS = 100
#: Distinct words of 100 at least, capitals of 100 signs at most.
DISTINCT_OF_100, CAPITALS_OF_100 = 80, 10
SIGNS = re.compile(rb"[#$%&*|]")
_CAPITALS = bytes(range(65, 91))
NEVER = len(FILTERS) + 1
#: What is counted: all documents, those of good quality, toxic ones.
KINDS = ("n", "n_good", "n_toxic")

ORDERS = ["".join(order) for order in itertools.permutations(FILTERS)]
#: POSITIONS[order, filter]: the step, from 1, at which the filter runs.
POSITIONS = np.argsort([[FILTERS.index(f) for f in order] for order in ORDERS], axis=1) + 1
#: FAILS[mask, filter]; bit i of a mask is filter i.
FAILS = (np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS)) & 1).astype(bool)


def removal_steps(fails: np.ndarray = FAILS, positions: np.ndarray = POSITIONS) -> np.ndarray:
    """[mask, order]: the step that removes the mask; one more than there are where none does."""
    never = positions.shape[1] + 1
    return np.where(fails[:, None, :], positions[None, :, :], never).min(axis=2)


def audit(weights: np.ndarray) -> dict[str, np.ndarray]:
    """The audit of one part: weights[kind, mask] counts documents, of kinds all, good and toxic.

    Every column is [order, step]. All are sums of the counts over masks, scattered to the step of removal.
    """
    steps, n = removal_steps(), len(FILTERS)
    orders = np.arange(len(ORDERS))[None, :]
    gone = np.zeros((len(weights), len(ORDERS), NEVER), np.int64)
    for kind, counts in enumerate(weights):
        np.add.at(gone[kind], (orders, steps - 1), counts[:, None])
    removed = gone[:, :, :n]
    # by_filter[order, step]: the filter that runs there.
    by_filter = np.argsort(POSITIONS, axis=1)
    late = (FAILS[:, None, :] & (steps[:, :, None] < POSITIONS[None, :, :])).astype(np.int64)
    redundant = np.einsum("m,mof->of", weights[0], late)
    alone = weights[0][1 << np.arange(n)]
    of_filter = np.zeros(n, np.int64)
    np.add.at(of_filter, by_filter, removed[0])
    return {
        "kept": weights[0].sum() - np.cumsum(removed[0], axis=1),
        "removed": removed[0],
        "redundant": np.take_along_axis(redundant, by_filter, axis=1),
        "unique_fails": alone[by_filter],
        "good_lost": removed[1],
        "toxic_lost": removed[2],
        "shapley": of_filter[by_filter],
    }


def own_failures(raw: bytes) -> int:
    """The mask of the filters that look at the text alone."""
    words = raw.split()  # at blanks and \t to \r
    points = len(raw.decode())
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_OF_100 * len(words)) << 1
        | (100 * capitals > CAPITALS_OF_100 * points) << 2
        | (SIGNS.search(raw) is not None) << 3
    )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask) for every row. The last filter fails where a smaller id has the same text.

    Texts are compared by SHA-256, so that what is shuffled does not hold them. The least id of a text comes from partial
    minima; rows join it by their digest, and a digest of a third of all rows is split by the skew-join rule.
    """

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            masks = pa.array([own_failures(t) for t in raw], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], ["doc_id", "part", "own", "digest"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), part, F.col(text_col).cast("string").alias("text"))
    looked = written(rows.mapInArrow(look, ddl("doc_id bigint, part string, own int, digest binary")), "failures")
    # Written, so that both sides of the join are shuffled as they are and a popular digest can be split.
    first = looked.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = written(first, "firsts")
    found = looked.join(first, "digest", "left")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.col("first").isNotNull())
    return found.select("doc_id", "part", (F.col("own") + F.when(later, 16).otherwise(0)).alias("mask"))


def filter_audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang"
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part,
    each of the 120 orders and each step.

    A null text is empty, a null part the empty string. A null id is larger than all others, and equal to no label's. Rows that
    repeat an id are documents each. Of labels that repeat an id, one that says good (or toxic) is enough. Without
    documents there are no rows. Other columns are ignored.
    """
    failed = failures(docs, id_col, text_col, part_col)
    marks = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    marked = failed.join(written(marks.where("good OR toxic"), "marks"), "doc_id", "left")
    ones = [F.lit(1), F.col("good").cast("int"), F.col("toxic").cast("int")]
    sums = [F.coalesce(F.sum(one), F.lit(0)).cast("bigint").alias(kind) for kind, one in zip(KINDS, ones, strict=True)]
    counted = marked.groupBy("part", "mask").agg(*sums)
    # A part has 32 rows at most from here on.
    masks = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *KINDS)).alias("cells"))

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                weights = np.zeros((len(KINDS), len(FAILS)), np.int64)
                for cell in cells:
                    weights[:, cell["mask"]] += [cell[kind] for kind in KINDS]
                found = audit(weights)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(ORDERS) * len(FILTERS)),
                        pa.array(np.repeat(ORDERS, len(FILTERS)).tolist()),
                        pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))),
                        *[pa.array(column.ravel().astype(np.int64)) for column in found.values()],
                    ],
                    ["part", "filter_order", "step", *found],
                )

    columns = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint"
    return masks.mapInArrow(expand, ddl(f"{columns}, good_lost bigint, toxic_lost bigint, shapley bigint"))


ORACLE = """
WITH words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS found
    FROM documents
), firsts AS (
    SELECT body, min(doc_id) AS first_id FROM words GROUP BY body
), marks AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
    FROM labels GROUP BY doc_id
), failed AS (
    SELECT w.part,
           len(found) < 100 AS a,
           100 * len(list_distinct(found)) < 80 * len(found) AS b,
           100 * length(regexp_replace(w.body, '[^A-Z]', '', 'g')) > 10 * length(w.body) AS c,
           regexp_matches(w.body, '[#$%&*|]') AS d,
           coalesce(w.doc_id > f.first_id, f.first_id IS NOT NULL) AS e,
           coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic
    FROM words w JOIN firsts f ON w.body = f.body LEFT JOIN marks m ON w.doc_id = m.doc_id
), cells AS (
    SELECT part, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END,
                        CASE WHEN e THEN 'E' END) AS fails,
           count(*) AS n, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE toxic) AS n_toxic
    FROM failed GROUP BY part, a, b, c, d, e
), letters(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT p.x || q.x || r.x || s.x || t.x AS filter_order
    FROM letters p JOIN letters q ON q.x <> p.x JOIN letters r ON r.x NOT IN (p.x, q.x)
    JOIN letters s ON s.x NOT IN (p.x, q.x, r.x) JOIN letters t ON t.x NOT IN (p.x, q.x, r.x, s.x)
), placed AS (
    SELECT o.filter_order, c.*, CASE WHEN contains(fails, substr(filter_order, 1, 1)) THEN 1 WHEN contains(fails, substr(filter_order, 2, 1)) THEN 2
           WHEN contains(fails, substr(filter_order, 3, 1)) THEN 3 WHEN contains(fails, substr(filter_order, 4, 1)) THEN 4
           WHEN contains(fails, substr(filter_order, 5, 1)) THEN 5 ELSE 6 END AS gone
    FROM orders o CROSS JOIN cells c
), stepped AS (
    SELECT part, filter_order, k.step::INT AS step, substr(filter_order, k.step::INT, 1) AS f,
           sum(CASE WHEN gone > k.step THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN gone = k.step THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN gone < k.step AND contains(fails, substr(filter_order, k.step::INT, 1)) THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = substr(filter_order, k.step::INT, 1) THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN gone = k.step THEN n_good ELSE 0 END) AS good_lost,
           sum(CASE WHEN gone = k.step THEN n_toxic ELSE 0 END) AS toxic_lost
    FROM placed CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step) k
    GROUP BY part, filter_order, k.step
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM stepped
"""
