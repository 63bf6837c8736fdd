import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from tallyloom.llm import token_files as T
from tallyloom.llm.queries import tokenizer

PATH = tokenizer("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("top", [0, 1, 255, 65535, 2**31 + 5])
def test_planes_round_trip(planes, top):
    ids = np.random.default_rng(0).integers(0, top + 1, 1001).astype(np.uint32)
    ids[5] = top
    made = T.packed(ids, planes)
    assert (T.unpacked(made, len(ids), planes) == ids).all()
    assert len(made) == (max(1, top.bit_length()) if planes == "bit" else max(1, -(-top.bit_length() // 8)))


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_file_round_trip_over_blocks(tmp_path, monkeypatch, planes):
    monkeypatch.setattr(T, "BLOCK", 64)
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 200, 50)
    ids = rng.integers(0, 50000, counts.sum()).astype(np.uint32)
    out = io.BytesIO()
    writer = T.Writer(out, planes)
    ends = np.cumsum(counts)
    for a, b in ((0, 1), (1, 30), (30, 50)):
        writer.add(pa.array([i - 3 if i != 7 else None for i in range(a, b)]), counts[a:b], ids[(ends[a - 1] if a else 0) : ends[b - 1]])
    writer.close()
    (tmp_path / "x").write_bytes(out.getvalue())
    got = list(T.documents(f"file://{tmp_path}/x"))
    assert len(got) > 5
    assert [i for g in got for i in g[0].to_pylist()] == [i - 3 if i != 7 else None for i in range(50)]
    assert (np.concatenate([g[2] for g in got]) == ids).all()


def test_negative_ids_and_rows_without_one(spark):
    df = spark.createDataFrame([(-1, "a b"), (None, "c"), (-(2**63), "d"), (0, None)], "doc_id long, text string")
    out = [(r["doc_id"], r["start"]) for r in T.token_table(df, PATH).orderBy("start").collect()]
    assert [i for i, _ in out] == [None, -(2**63), -1, 0] and [s for _, s in out] == [0, 2, 4, 7]


def test_empty_file(tmp_path):
    out = io.BytesIO()
    T.Writer(out).close()
    (tmp_path / "x").write_bytes(out.getvalue())
    assert list(T.documents(str(tmp_path / "x"))) == []
    (tmp_path / "y").write_bytes(out.getvalue()[:-1] + b"?")
    with pytest.raises(ValueError):
        list(T.documents(str(tmp_path / "y")))


def test_word_by_word_is_the_library_on_whole_texts():
    rng = random.Random(4)
    alphabet = list("aAbBzZ'stdmlvr.,;!?-#@$%^&*()[]{}|<>~`\"\\/ \n\t\r\f\v0123") + ["'s", "'ll", "é", "É", "é", "́", "ß", "İ", "K", " ", " ", "中", "😀", "<|endoftext|>", "\u0000", "ﬁ", "Å"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", None, " ", "\n", "it's, don't. IT'S! x'", "a" * 3000, "word " * 3000]
    counts, ids = T.encoded(PATH, pa.array(texts, pa.string()))
    want = [e.ids + [1] for e in library().encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ends = np.cumsum(counts)
    for text, n, end, ref in zip(texts, counts, ends, want):
        assert ids[end - n : end].tolist() == ref, repr(text)


def test_letters_beyond_ascii_share_their_stems(monkeypatch):
    sent = []
    own = T._encode_new
    monkeypatch.setattr(T, "_encode_new", lambda path, words, into: (sent.extend(words), own(path, words, into)))
    T._STATE.clear()
    T.encoded(PATH, pa.array(["café café, café. dog dog; (дом)"]))
    assert sorted(sent) == sorted(["café", ",", ".", "dog", ";", "(дом", ")"])


def test_every_letter_that_is_taken_for_plain_is_one():
    letters = [chr(c) for c in range(0x61, 0x460) if pa.compute.match_substring_regex(pa.array([chr(c)]), f"^[{T._LETTERS}]$")[0].as_py()]
    assert len(letters) > 250 and "İ" not in letters
    texts = [f"{c} a{c} {c}b {c}{c}, x{c}! {c}'s {c}1 1{c} -{c}- {c}\u0301. a\u0301{c}, {c.upper()}, {c}.a" for c in letters]
    counts, ids = T.encoded(PATH, pa.array(texts))
    want = [e.ids + [1] for e in library().encode_batch(texts, add_special_tokens=False)]
    for text, n, end, ref in zip(texts, counts, np.cumsum(counts), want):
        assert ids[end - n : end].tolist() == ref, text


def expected(rows):
    start, out, lib = 0, [], library()
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array(lib.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted(tuple(r) for r in T.token_table(docs.repartition(5), PATH).collect())
    assert got == expected(rows)


def test_edges(spark):
    rows = [(9, None), (3, ""), (3, ""), (None, "x y"), (5, "word " * 40000)]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, start string")
    got = [tuple(r) for r in T.token_table(df, PATH, planes="byte").collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows)
    assert T.token_table(df.limit(0), PATH).collect() == []


def test_added_tokens_are_those_of_the_plain_call(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    assert plain.encode("end of file <|endoftext|> next", add_special_tokens=False).ids == [806, 539, 4512, 49407, 1131]
    rng = random.Random(5)
    alphabet = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "endoftext", " ", "\n", "a", "B", "'s", "t", ".", "é", "\u0301", "İ", "中"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    texts += ["end of file <|endoftext|> next", "<|endoftext|><|endoftext|>", "plain", "", None]
    want, start = [], 0
    for i, text in enumerate(texts):
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = T.token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    assert sorted(map(tuple, got.collect())) == want
