import random

import pyarrow as pa
import pytest

from tallyloom.llm import token_counts as T
from tallyloom.llm.queries import tokenizer

PATH = tokenizer("piece_bpe_32k.model")
TEXTS = [
    "", " ", "  ", "a ", "a  ", " a", "a  b   c ", "▁", "▁a", "a▁b", " ▁ ", "<s> x</s>", "<unk>", "\n\n", "\t x", "\x00", "ﬁ ｆ", "日本語 字", "😀😀 é",
    "membres", "12345 67", "<0x0A>", "==== ----", "x" * 500, "abc" * 400,
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_are_the_library_s(library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("abcdefghiéß  \n12,.▁日本😀aeerst") for _ in range(rng.randrange(300))) for _ in range(300)]
    texts += ["".join(rng.choice("esratinolmbr") for _ in range(rng.randrange(3000))) for _ in range(20)]
    texts += [rng.choice("abes日=-*") * rng.randrange(1, 2000) for _ in range(40)]
    got = T.counted(T.symbols(PATH), pa.array(texts))
    assert got.tolist() == [len(library.encode(t)) for t in texts]


def test_equal_pairs_stop_at_a_better_one():
    """In xyxy, x+y makes a piece that joins the next x better than x joins the second y."""
    model = T.Symbols.__new__(T.Symbols)
    texts, scores = ["x", "y", "xy", "xyx"], [-9.0, -9.0, -2.0, -1.0]
    import numpy as np

    order = sorted(set(scores), reverse=True)
    model.rank = np.array([order.index(s) for s in scores], np.int32)
    model.tokens = np.ones(4, np.int64)
    pairs = sorted((texts.index(t[:c]) << 32 | texts.index(t[c:]), texts.index(t)) for t in texts for c in range(1, len(t)) if t[:c] in texts and t[c:] in texts)
    model.pairs, model.made = np.array([p for p, _ in pairs]), np.array([m for _, m in pairs], np.int32)
    word = np.array([0, 1] * 3, np.int32)
    # xyx, y, xy: not xy, xy, xy
    assert T.surviving(model, word, np.zeros(6, np.int64), 1).tolist() == [3]
    assert T.surviving(model, np.array([0, 1, 0, 1] * 2, np.int32), np.repeat([0, 1], 4), 2).tolist() == [2, 2]


def test_long_texts_are_counted_in_parts(library):
    rng = random.Random(6)
    text = "".join(rng.choice(["the", " house", "  ", " ", "▁x", "é", "\n", " of"]) for _ in range(20000))
    parts = list(T._parts(text, 1000))
    assert len(parts) > 20
    assert sum(T.counted(T.symbols(PATH), pa.array(parts)).tolist()) == len(library.encode(text))
    assert list(T._parts("x" * 5000, 1000)) == ["x" * 5000]


def test_table(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    rows = T.token_counts(docs, PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]] or ""))
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 4096, len((texts[r["doc_id"]] or "").encode()))


def test_edges(spark, library):
    long = "longer words " * 400_000
    df = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (2, "", 0), (None, "x y", 0), (3, long, 0)], "doc_id long, text string, n_tokens int"
    )
    out = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in T.token_counts(df, PATH).collect())
    assert out == [(0, 3, len(library.encode("x y")), False), (1, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, len(long), len(library.encode(long)), True)]
    assert T.token_counts(df.limit(0), PATH).collect() == []
    assert [r["over_limit"] for r in T.token_counts(df.where("doc_id is null"), PATH, limit=1).collect()] == [True]
