"""Language of texts: nearest of several centroids per language among TF-IDF vectors of byte n-grams.

A text's vector counts its n-grams of 1 to 4 UTF-8 bytes (lower case; ASCII other than letters is a space,
and n-grams with two spaces in a row do not count) in DIMENSIONS hashed cells, log-scaled, weighted by
inverse document frequency and normalised. Document frequencies are counted over all training rows.
Centroids are the means of CLUSTERS spherical clusters per language of a sample of training rows, at most
about SAMPLE rows over all languages (the bound on what reaches the driver), taken by the hash of the id.

A text is rejected if it has no letter or if its cosine to the nearest centroid is below that language's
limit for texts with as many different n-grams, so that repeating a text does not make it longer. A limit is the
QUANTILE of the cosines of all training rows that are nearest to their own language, and of beginnings of
them, which stand for short texts. A size of n such texts has its own limit by n^2 to LEAST^2 parts of that of the next
shorter size, so that few texts say little and no number of them switches the rule; before the first size there is a
share (REJECT) of the limit of all the language's texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyloom.llm.shared import ddl, ship, slices, utf8

DIMENSIONS = 1 << 13
ORDERS = (1, 2, 3, 4)
CLUSTERS = 4
SAMPLE = 2400
REJECT = 0.25
QUANTILE = 0.005
LEAST = 30
#: Lengths of beginnings in characters. Each row gives all that are shorter than its text, however many rows there are.
CUTS = tuple(round(16 * 2 ** (k / 2)) for k in range(12))
#: Sizes are half octaves of the number of different cells; cosines are counted in so many steps.
_SIZES, _STEPS = 27, 1000
UNKNOWN = "und"
_ROUNDS = 12
#: Text bytes and rows handled at once; a row takes DIMENSIONS numbers, however short its text.
_BATCH, _ROWS = 1 << 20, 512


def _counts(column: pa.Array):
    """(rows x DIMENSIONS) n-gram counts of a string column, float32; nulls count as empty."""
    import numpy as np

    data, offsets = _letters(column)
    out = np.zeros((len(offsets) - 1, DIMENSIONS), np.float32)
    piece = 1 << 18
    for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:])):
        for at in range(start, end, piece):
            # Pieces of very long texts overlap by what an n-gram needs.
            text = data[at : min(end, at + piece + ORDERS[-1] - 1)]
            for _, cells, good in _grams(text, piece):
                out[row] += np.bincount(cells[good], minlength=DIMENSIONS)
    return out


def _letters(column: pa.Array):
    """(bytes, offsets) of a string column in lower case, with spaces for ASCII other than letters."""
    import numpy as np
    import pyarrow.compute as pc

    data, offsets = utf8(pc.utf8_lower(column))
    letters = (data >= 128) | ((data >= 97) & (data <= 122))
    return np.where(letters, data, np.uint8(32)), offsets


def _grams(text, piece: int):
    """(n, cells, which of them count) for each n, of the n-grams that begin in the first `piece` bytes."""
    import numpy as np

    blank = text == 32
    twice = blank[1:] & blank[:-1]
    key = np.zeros(len(text), np.uint32)
    for n in ORDERS:
        size = min(piece, len(text) - n + 1)
        if size < 1:
            break
        key = key[: len(text) - n + 1] * np.uint32(0x01000193) + text[n - 1 :]
        good = ~blank[:size] if n == 1 else _none(twice, n - 1, size)
        hashed = (key[:size] * np.uint32(2654435769) + np.uint32(n)) * np.uint32(0x85EBCA6B)
        yield n, hashed >> np.uint32(19), good


def _beginnings(column: pa.Array):
    """(row, cells, counts) of each text longer than the least of CUTS: the cells that its beginnings have, ascending,
    and the (beginnings x cells) counts, float32. Each beginning adds to the one before, so n-grams are hashed once."""
    import numpy as np
    import pyarrow.compute as pc

    data, offsets = _letters(pc.utf8_slice_codeunits(column, 0, CUTS[-1] + 1))
    place = np.zeros(DIMENSIONS, np.int64)
    for row, (start, end) in enumerate(zip(offsets[:-1], offsets[1:])):
        characters = np.flatnonzero((data[start:end] & 0xC0) != 0x80)
        stops = characters[[c for c in CUTS if c < len(characters)]]
        if not len(stops):
            continue
        # The first beginning that holds a byte holds all n-grams that end there.
        first = np.repeat(np.arange(len(stops)), np.diff(stops, prepend=0))
        grams = [(cells[good], first[n - 1 :][good]) for n, cells, good in _grams(data[start : start + stops[-1]], stops[-1])]
        found, first = (np.concatenate(part) for part in zip(*grams))
        cells = np.flatnonzero(np.bincount(found, minlength=DIMENSIONS))
        place[cells] = np.arange(len(cells))
        added = np.bincount(first * len(cells) + place[found], minlength=len(stops) * len(cells))
        yield row, cells, added.reshape(len(stops), len(cells)).cumsum(axis=0, dtype=np.float32)


def _none(marks, width: int, size: int):
    """Which of the first `size` runs of `width` marks have none set."""
    found = marks[:size].copy()
    for j in range(1, width):
        found |= marks[j : j + size]
    return ~found


def _frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document counts of the cells, one table of DIMENSIONS rows for each task; cell -1 counts rows."""
    import numpy as np

    seen, rows = np.zeros(DIMENSIONS, np.int64), 0
    for batch in slices(batches, "text", _BATCH, _ROWS):
        seen += (_counts(batch.column("text")) > 0).sum(axis=0)
        rows += batch.num_rows
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(np.flatnonzero(seen), -1)), pa.array(np.append(seen[seen > 0], rows))], ["cell", "n"]
    )


def _sparse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in slices(batches, "text", _BATCH, _ROWS):
        counts = _counts(batch.column("text"))
        rows = [np.flatnonzero(r) for r in counts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("lang"),
                pa.array([r.astype(np.uint16).tobytes() for r in rows], pa.binary()),
                pa.array([counts[i][r].tobytes() for i, r in enumerate(rows)], pa.binary()),
            ],
            ["lang", "cells", "counts"],
        )


def _unit(counts, idf):
    import numpy as np

    vectors = np.log1p(counts) * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms > 0, norms, 1)


def _clusters(vectors, k: int):
    """Spherical k-means; starts from rows far from the ones before, so it needs no seed."""
    import numpy as np

    centroids = _norm(vectors.mean(axis=0, keepdims=True))
    while len(centroids) < min(k, len(vectors)):
        far = int(np.argmin((vectors @ centroids.T).max(axis=1)))
        centroids = np.vstack([centroids, vectors[far]])
    for _ in range(_ROUNDS):
        nearest = np.argmax(vectors @ centroids.T, axis=1)
        centroids = np.vstack(
            [_norm(vectors[nearest == c].mean(axis=0, keepdims=True)) if (nearest == c).any() else centroids[c : c + 1]
             for c in range(len(centroids))]
        )
    return centroids


def _norm(rows):
    import numpy as np

    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norms > 0, norms, 1)


def _sizes(counts):
    import numpy as np

    return (2 * np.log2(np.maximum(1, (counts > 0).sum(axis=1)))).astype(int)


def _own_cosines(model: dict):
    """(lang, size, step, n): how often texts of a task and their beginnings, nearest to their own language, have which cosine."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        langs, owner = np.array(model["langs"]), np.array(model["owner"], int)
        centroids = np.ascontiguousarray(model["centroids"].T)
        total = np.zeros((len(langs), _SIZES, _STEPS + 1), np.int64)

        def add(own, cosines, sizes):
            nearest = np.argmax(cosines, axis=1)
            best = cosines[np.arange(len(nearest)), nearest]
            good = (langs[owner[nearest]] == own) & (best > 0)
            steps = np.clip(best * _STEPS, 0, _STEPS).astype(int)
            np.add.at(total, (owner[nearest][good], sizes[good], steps[good]), 1)

        for batch in slices(batches, "text", _BATCH, _ROWS):
            own = np.array(batch.column("lang").to_pylist())
            counts = _counts(batch.column("text"))
            add(own, _unit(counts, model["idf"]) @ centroids, _sizes(counts))
            parts = [
                (row, _unit(counts, model["idf"][cells]) @ centroids[cells], _sizes(counts))
                for row, cells, counts in _beginnings(batch.column("text"))
            ]
            if parts:
                rows, cosines, sizes = zip(*parts)
                add(own[np.repeat(rows, [len(part) for part in sizes])], np.concatenate(cosines), np.concatenate(sizes))
        lang, size, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs[lang].tolist(), pa.string()), pa.array(size), pa.array(step), pa.array(total[lang, size, step])],
            ["lang", "size", "step", "n"],
        )

    return count


def _limits(rows: DataFrame, model: dict):
    """The limits by language and size, from all training rows and all their beginnings."""
    import numpy as np

    counted = rows.select("text", "lang").mapInArrow(_own_cosines(model), ddl("lang string, size bigint, step bigint, n bigint"))
    total = np.zeros((len(model["langs"]), _SIZES, _STEPS + 1), np.int64)
    place = {lang: i for i, lang in enumerate(model["langs"])}
    # At most languages x _SIZES x _STEPS rows.
    for r in counted.groupBy("lang", "size", "step").agg(F.sum("n").alias("n")).collect():
        total[place[r["lang"]], r["size"], r["step"]] = r["n"]

    def low(steps):
        return float(np.searchsorted(np.cumsum(steps), QUANTILE * steps.sum(), "right")) / _STEPS

    out = np.zeros((len(total), _SIZES))
    for lang, sizes in enumerate(total):
        last = REJECT * low(sizes.sum(axis=0)) if sizes.any() else 0
        for i, n in enumerate(sizes.sum(axis=1).astype(float).tolist()):
            own = n * n / (n * n + LEAST * LEAST)
            last = out[lang, i] = own * low(sizes[i]) + (1 - own) * last
    return out


def fit(training: DataFrame) -> dict:
    """The classifier from (key, text, lang): languages, centroids, limits, inverse frequencies."""
    import numpy as np

    spark = training.sparkSession
    rows = training.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {"langs": [], "owner": [], "centroids": np.zeros((0, DIMENSIONS), np.float32), "limits": [], "idf": np.ones(DIMENSIONS, np.float32)}
    frequency = {
        r["cell"]: r["n"]
        for r in rows.select("text").mapInArrow(_frequencies, ddl("cell bigint, n bigint"))
        .groupBy("cell").agg(F.sum("n").alias("n")).collect()
    }
    total = frequency.pop(-1)
    # Cells that no training text has weigh most, so texts unlike all of them are far from every centroid.
    idf = np.full(DIMENSIONS, np.log(1 + total), np.float32)
    idf[list(frequency)] = np.log(1 + total / np.array(list(frequency.values())))
    share = SAMPLE / len(sizes)
    parts = spark.createDataFrame([(k, float(min(1.0, share / n))) for k, n in sizes.items()], "lang string, part double")
    chance = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = rows.join(F.broadcast(parts), "lang").where(chance < F.col("part")).select("lang", "text")
    found: dict[str, list] = {}
    for row in picked.mapInArrow(_sparse, ddl("lang string, cells binary, counts binary")).collect():
        dense = np.zeros(DIMENSIONS, np.float32)  # SAMPLE rows of a few KB
        dense[np.frombuffer(row["cells"], np.uint16)] = np.frombuffer(row["counts"], np.float32)
        if dense.any():
            found.setdefault(row["lang"], []).append(dense)
    langs = sorted(found)
    centroids, owner = [], []
    for number, lang in enumerate(langs):
        vectors = _unit(np.stack(found[lang]), idf)
        own = _clusters(vectors, CLUSTERS)
        centroids.append(own)
        owner += [number] * len(own)
    stacked = np.vstack(centroids).astype(np.float32) if centroids else np.zeros((0, DIMENSIONS), np.float32)
    model = {"langs": langs, "owner": owner, "centroids": stacked, "limits": [], "idf": idf}
    if langs:
        model["limits"] = _limits(rows, model)
    return model


def _named(model: dict, texts: pa.Array):
    """(names, scores, which are rejected) of a string column."""
    import numpy as np

    if model["langs"]:
        counts = _counts(texts)
        cosines = _unit(counts, model["idf"]) @ model["centroids"].T
        nearest = np.argmax(cosines, axis=1)
        score = np.clip(cosines[np.arange(len(nearest)), nearest].astype(float), 0, 1)
        number = np.array(model["owner"], int)[nearest]
        known = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts.to_pylist()], bool)
        rejected = ~known | (score < model["limits"][number, _sizes(counts)])
    else:
        score, number = np.zeros(len(texts)), np.zeros(len(texts), int)
        known, rejected = np.zeros(len(texts), bool), np.ones(len(texts), bool)
    return [model["langs"][n] if k else UNKNOWN for n, k in zip(number, known)], np.where(known, score, 0.0), rejected


def _predicted(model: dict):
    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _BATCH, _ROWS):
            names, score, rejected = _named(model, batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "rejected"])

    return predict


def accepted(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model does not reject, with all their columns."""

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, _BATCH, _ROWS):
            yield batch.filter(pa.array(~_named(model, batch.column(text_col))[2]))

    ship(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected). Null text, text without a letter, or a model that has
    learned nothing: `und`, 0.0, rejected. Equal cosines: the first language in order of names."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_predicted(model), ddl(f"doc_id {kind}, lang_pred string, score double, rejected boolean"))


def training_rows(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(key, text, lang) of the rows where `held_out` is false; where it is null, nothing is learned."""
    return docs.where(~F.coalesce(held_out, F.lit(True))).select(
        F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).alias("lang")
    )


def languages(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows where `held_out` is false and predicts all rows, as `predict` returns them. Other columns
    are ignored, rows that repeat an id are predicted each."""
    return predict(docs, fit(training_rows(docs, held_out, id_col, text_col, lang_col)), id_col, text_col)


def fold(id_col: str = "doc_id"):
    """Whether a row is held out: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))
