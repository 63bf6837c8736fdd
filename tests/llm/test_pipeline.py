import importlib.util

import pytest
from oracle_check import connect, differences
from test_decontamination import expected as leaks
from test_near_duplicates import expected as copies

import corpus_pipeline as C
from tallyloom.llm import language, pii, sentence_pieces
from tallyloom.llm.queries import ORACLE, QUERIES, tokenizer


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


def test_entry_has_all_queries():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op")}
    assert "pipeline" in __spark_entry__.queries()


def test_pipeline_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(language.training_rows(docs, language.fold()))
    rejected = {r["doc_id"] for r in language.predict(docs, model).where("rejected").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in rejected]
    kept = copies(left)
    left = [(i, t) for i, t in left if kept[i][2]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {d for d, *_ in leaks(left, items)}
    left = spark.createDataFrame([x for x in left if x[0] not in bad], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redacted(left).collect()}
    ids = sentence_pieces.encoded(tokenizer("piece_bpe_32k.model"), list(clean.values()))
    got = {r["doc_id"]: r["pieces"] for r in C.run(spark, sf_dir).collect()}
    assert set(got) == set(clean)
    # The classifier of personal data learns from the stage's documents, the same here as there.
    assert got == {i: x.tolist() for i, x in zip(clean, ids)}


def rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    say = "the dog and the cat of that house were here today with us again"
    rows = [(i, f"{say} number {i} {'abcdefgh'[i % 8] * (i + 3)}", "en", "s", 9) for i in range(20)]
    return spark.createDataFrame(rows + [(20, None, None, None, None), (21, "", "en", "s", 0), (None, say, None, "s", 1), (3, rows[3][1], "en", "s", 9)], schema)


def test_stages_keep_columns_and_cope_with_edges(spark, sf_dir):
    from pyspark.sql import functions as F

    for docs in (rows(spark), rows(spark).limit(0)):
        docs = docs.withColumn("_id", F.lit(1)).withColumn("_n", F.lit(2)).withColumn("component", F.lit("x")).withColumn("key", F.lit(None).cast("int"))
        for _, stage in C.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.collect()
        C.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_language_stage_rejects_alike_among_few_and_many_rows(spark, sf_dir):
    words = "der die das Hund Katze Haus Garten Kinder spielen heute und wieder schön warm geworden".split()
    german = [(" ".join(words[(i * j + j) % len(words)] for j in range(1, 41)), "de") for i in range(44)]
    for n_english in (44, 40_000):
        texts = german + [("the dog and the cat", "en")] * n_english + [("De kinderen spelen vandaag in de tuin", None)]
        docs = spark.createDataFrame([(i, *t, "s", len(t[0])) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        kept = C.keep_known_language(spark, docs, sf_dir)
        assert {r["lang"] for r in kept.select("lang").distinct().collect()} == {"de", "en"}


def test_repeated_rows_of_one_id_leave_one(spark, sf_dir):
    out = C.keep_one_of_near_copies(spark, rows(spark), sf_dir).collect()
    ids = [r["doc_id"] for r in out]
    assert ids.count(3) <= 1 and ids.count(None) == 1 and 20 in ids and 21 in ids


def test_contaminated_documents_go_with_and_without_an_id(spark, sf_dir):
    item = next(r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect() if len(r["text"].split()) > 8)
    held = f"something before {item} and after"
    rows = [(None, held, 0), (1, held, 0), (None, "clean text of some words here", 0), (2, None, 0), (None, None, 0), (3, "clean too", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _contaminated int")
    out = C.drop_contaminated(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, ""), (0, "clean text of some words here"), (2, ""), (3, "clean too")]


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(importlib.util.find_spec("corpus_pipeline").origin).parent
    for path in [*root.glob("tallyloom/**/*.py"), *root.glob("workload/*.py"), root / "bench.py"]:
        if "llm" not in path.parts:
            assert "tallyloom.llm" not in path.read_text(), path
