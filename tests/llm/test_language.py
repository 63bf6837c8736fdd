import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language as L


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = L.languages(docs, L.fold())
    return found.join(docs.select("doc_id", "lang", "text"), "doc_id").withColumn("held_out", L.fold()).toPandas()


def test_held_out_accuracy(predicted):
    held = predicted[predicted.held_out & predicted.text.str.len().gt(100)]
    assert len(held) > 100
    assert (held.lang_pred == held.lang).mean() > 0.95


def test_scores_and_rejections(predicted):
    assert predicted.score.between(0, 1).all()
    assert predicted.rejected.mean() < 0.01


def test_nearest_centroid_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.fit(L.training_rows(docs, L.fold()))
    rows = L.predict(docs, model).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows[:40]:
        text = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in texts[r["doc_id"]].lower()).encode()
        counts = np.zeros(L.DIMENSIONS)
        for n in L.ORDERS:
            for i in range(len(text) - n + 1):
                gram = text[i : i + n]
                if gram == b" " or b"  " in gram:
                    continue
                key = 0
                for b in gram:
                    key = (key * 0x01000193 + b) & 0xFFFFFFFF
                counts[(((key * 2654435769 + n) & 0xFFFFFFFF) * 0x85EBCA6B & 0xFFFFFFFF) >> 19] += 1
        vector = np.log1p(counts) * model["idf"]
        cosines = model["centroids"] @ vector / np.linalg.norm(vector)
        assert abs(cosines.max() - r["score"]) < 1e-4
        assert model["langs"][model["owner"][int(cosines.argmax())]] == r["lang_pred"]


def test_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 -- 34", "en"), (4, "der Hund und die Katze", "de"), (5, "the dog and the cat", None), (None, "the dog", "en")]
    rows += [(10 + i, "the dog and the cat of that house", "en") for i in range(8)] + [(30 + i, "der Hund und die Katze", "de") for i in range(8)]
    rows += [(60, "the dog and the cat " * 20000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x")).withColumn("key", F.lit(1)).withColumn("part", F.lit(1))
    out = {r["doc_id"]: r for r in L.languages(docs, L.fold()).collect()}
    assert [out[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(out[i]["rejected"] and out[i]["score"] == 0 for i in (1, 2, 3))
    assert out[4]["lang_pred"] == "de" and out[5]["lang_pred"] == "en" and out[60]["lang_pred"] == "en"
    empty = docs.limit(0)
    assert L.languages(empty, L.fold()).collect() == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.languages(unlabelled, L.fold()).collect()} == {"und"}


def test_long_texts_count_like_short_ones():
    text = "der Hund und die Katze " * 30000
    one = L._counts(pa.array([text]))[0]
    assert one.sum() > 1_000_000
    half = L._counts(pa.array([text[: len(text) // 2]]))[0]
    assert np.allclose(one / one.sum(), half / half.sum(), atol=1e-5)


def test_far_texts_are_rejected(spark):
    rows = [(i, "the dog and the cat of that house were here " * 3, "en") for i in range(20)]
    docs = spark.createDataFrame(rows + [(99, "日本語の文章です。漢字とかな。", "en")], "doc_id long, text string, lang string")
    model = L.fit(L.training_rows(docs.where("doc_id < 50"), F.lit(False)))
    assert {r["doc_id"] for r in L.accepted(docs, model).collect()} == set(range(20))


UNLEARNED = {
    "nl": "De kinderen spelen vandaag in de tuin omdat het weer eindelijk weer mooi en warm is geworden.",
    "it": "I bambini giocano oggi nel giardino perché il tempo è finalmente tornato bello e caldo.",
    "pl": "Dzieci bawią się dzisiaj w ogrodzie, ponieważ pogoda wreszcie znowu jest ładna i ciepła.",
    "fi": "Lapset leikkivät tänään puutarhassa, koska sää on vihdoin taas kaunis ja lämmin.",
}


def test_unlearned_latin_languages_are_rejected_and_short_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(L.training_rows(docs, L.fold()))
    texts = [" ".join([t] * n) for t in UNLEARNED.values() for n in (1, 20)]
    _, score, rejected = L._named(model, pa.array(texts))
    assert rejected.all(), [(t[:20], s) for t, s, r in zip(texts, score, rejected) if not r]
    held = [r["text"] for r in docs.where(L.fold() & F.col("text").isNotNull()).select("text").collect()]
    for n in (3, 6, 12, 24):
        few = [" ".join(t.split()[:n]) for t in held]
        assert L._named(model, pa.array([t for t in few if any(map(str.isalpha, t))]))[2].mean() < 0.03


def test_beginnings_count_like_texts_of_their_own():
    texts = ["", None, "der Hund", "x" * 16, "x" * 17, "12 -- 34 !! 56 ?? 78", "İstanbul ÉTÉ 日本語 " * 9, "the dog and the cat " * 200, "字" * 724 + "a", "\U0001f600" * 800]
    found = {row: (cells, counts) for row, cells, counts in L._beginnings(pa.array(texts))}
    for row, text in enumerate(texts):
        own = [text[:c] for c in L.CUTS if c < len(text or "")]
        assert (row in found) == bool(own)
        if own:
            cells, counts = found[row]
            dense = np.zeros((len(own), L.DIMENSIONS), np.float32)
            dense[:, cells] = counts
            assert counts.dtype == np.float32 and np.array_equal(dense, L._counts(pa.array(own)))


def test_no_number_of_texts_switches_the_rule_of_limits(spark):
    class Counted:
        """Stands for rows of which 5,000 texts of a size have a cosine of 0.2, and n of the next size one of 0.6."""

        def __init__(self, n):
            self.n = n

        def same(self, *_):
            return self

        select = mapInArrow = groupBy = agg = same

        def collect(self):
            found = [("en", 12, 200, 5000), ("en", 13, 600, self.n)]
            return [dict(zip(("lang", "size", "step", "n"), r)) for r in found if r[3]]

    limits = np.array([L._limits(Counted(n), {"langs": ["en"]})[0] for n in range(400)])
    assert np.abs(np.diff(limits, axis=0)).max() < 0.02
    assert np.allclose(limits[:, 12], 0.2, atol=1e-3) and abs(limits[0, 13] - 0.2) < 1e-3 and abs(limits[-1, 13] - 0.6) < 5e-3
    assert np.array_equal(limits[:, 13], limits[:, -1])


def test_limits_do_not_depend_on_how_many_rows_other_languages_have(spark):
    words = "der die das Hund Katze Haus Garten Kinder spielen heute und wieder schön warm geworden".split()
    german = [(i, " ".join(words[(i * j + j) % len(words)] for j in range(1, 41)), "de") for i in range(33)]
    limits = []
    for n_english in (33, 20_000):
        rows = german + [(1000 + i, "the dog and the cat", "en") for i in range(n_english)]
        docs = spark.createDataFrame(rows + [(-1, UNLEARNED["nl"][:24], None)], "doc_id long, text string, lang string")
        model = L.fit(L.training_rows(docs, F.lit(False)))
        limits.append(model["limits"][model["langs"].index("de")])
        (dutch,) = L.predict(docs.where("doc_id = -1"), model).collect()
        assert dutch["lang_pred"] == "de" and dutch["rejected"]
    # Frequencies, and so cosines, depend on the other rows; which sizes have a limit of their own does not.
    assert np.abs(limits[0] - limits[1]).max() < 0.1
