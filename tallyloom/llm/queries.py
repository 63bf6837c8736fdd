"""The operators applied to the given tables, with production parameters, and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.llm import decontamination, filter_audit, language, loss_difference
from tallyloom.llm.near_duplicates import near_duplicates
from tallyloom.llm.near_vectors import near_vectors
from tallyloom.llm.pii import personal_data
from tallyloom.llm.secret_scan import secrets
from tallyloom.llm.sentence_pieces import sentence_pieces
from tallyloom.llm.shared import table
from tallyloom.llm.spelling_variants import spelling_variants
from tallyloom.llm.token_counts import token_counts
from tallyloom.llm.token_files import token_table
from tallyloom.llm.warc import archived

#: The folder of the public tokenizers' files; the same on every machine.
TOKENIZERS = "TOKENIZERS_DIR"


def tokenizer(name: str) -> str:
    folder = os.environ.get(TOKENIZERS)
    if folder is None:
        import public_tokenizers

        return public_tokenizers.path(name)
    return os.path.join(folder, name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.languages(documents(spark, sf_dir), language.fold())
    return found.select("doc_id", language.fold().alias("held_out"), "lang_pred", "score", "rejected")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).drop("url", "payload")


def op8_loss_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as of good quality are the target."""
    docs = documents(spark, sf_dir)
    good = table(spark, sf_dir, "labels").where("quality = 1")
    return loss_difference.loss_difference(docs, loss_difference.fit(loss_difference.marked(docs, good)))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_decontamination, op3_language, op4_near_duplicates, op5_token_files, op6_sentence_pieces,
        op7_warc, op8_loss_difference, op9_near_vectors, op10_secrets, op11_filter_audit, op12_spelling_variants,
        op13_token_counts,
    )
}
#: For the exact operators that SQL can express.
ORACLE: dict[str, str] = {"op2_decontamination": decontamination.ORACLE, "op11_filter_audit": filter_audit.ORACLE}
