"""A corpus from documents: language, near copies, benchmark passages, personal data, token pieces.

Each stage gets the documents that the one before kept, read from the table that it wrote. All but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import language
from tallyloom.llm.decontamination import contaminated
from tallyloom.llm.near_duplicates import near_duplicates
from tallyloom.llm.pii import redacted
from tallyloom.llm.queries import tokenizer
from tallyloom.llm.sentence_pieces import sentence_pieces
from tallyloom.llm.shared import table, written


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language classifier accepts; it learns from the stage's own documents, but those
    of the held-out fold. Without any label nothing is accepted."""
    return language.accepted(docs, language.fit(language.training_rows(docs, language.fold())))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies. Of rows that repeat an id with the same text
    one stays; rows with a null id stay all."""
    kept = written(near_duplicates(docs).where("kept").groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")), "kept")
    # The ids grow with the documents: one plan for any size, which does not broadcast them.
    joined = docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["_id"]))
    once = kept["_id"].isNull() | (kept["_n"] == 1)
    repeated = joined.where(~once).select(docs["*"]).dropDuplicates(["doc_id", "text"])
    return joined.where(once).select(docs["*"]).unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark. Rows are told apart by id, those without one by their text."""
    key = F.coalesce(F.concat(F.lit("id "), docs["doc_id"].cast("string")), F.sha2(docs["text"], 256))
    found = contaminated(docs.select(key.alias("doc_id"), docs["text"]), table(spark, sf_dir, "benchmark"))
    bad = written(found.select("doc_id").distinct(), "contaminated")
    return docs.join(bad, key == bad["doc_id"], "left_anti").select(*docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return redacted(docs).withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document's text."""
    return sentence_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("personal_data", redact_personal_data),
    ("sentence_pieces", encode_pieces),
]
#: Languages, registers and models are beyond SQL; the tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
