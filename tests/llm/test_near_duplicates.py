"""Near-duplicate texts against plain sets and union-find."""

import random
import re

import numpy as np
import pytest

from tallyloom.llm import near_duplicates as N, words as W
from tallyloom.llm.blocks import forest

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if 0 < len(words) < 5:
        return {tuple(words)}
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    """Rows (id, text) with distinct ids -> {id: (n_shingles, component, kept)}."""
    sets, parent = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


def corpus(seed=3):
    """Texts with exact and near copies, chains of changes, shared passages, and edge cases."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    texts = []
    for _ in range(25):
        text = [word() for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(text))
        for _ in range(rng.randint(0, 3)):
            text = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 30))):
                text[rng.randrange(len(text))] = word()
            texts.append(" ".join(text))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(n)) for n in (1, 5, 15, 18, 25, 60)]
    texts += [None, "", " \t\n", "one", "ONE", "One ", "a b c d", "A\tB\nc  d", "a b c d e", "a b c e", "Ä b c d", "ä b c d"]
    texts += ["w " * 30000, "w " * 29999]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_agrees_with_plain_sets(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(N.near_duplicates(df)) == expected(rows)


def test_a_group_around_no_centre(spark, monkeypatch):
    """The least id of the group is like few of the others; blocks are small, so a group is many units."""
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = random.Random(5)
    centre = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(14):
        text = list(centre)
        text[(i * 7) % 60] = f"x{i}"
        rows.append((100 + i, " ".join(text)))
    first = list(centre)
    for j in range(0, 60, 25):
        first[j] = f"y{j}"
    rows += [(1, " ".join(first)), (2, " ".join(rng.sample(centre, 60)))]
    assert result(N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_empty_table_null_and_repeated_ids_clashing_names(spark):
    assert N.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(None, "a b c d e f", 1), (3, "a b c d e f", 2), (3, "a b c d e f", 2), (5, "A b c d e f", None), (7, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int").withColumn("a", df_null()).withColumn("band", df_null())
    out = sorted(map(tuple, N.near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (7, 0, 7, True)], key=str)


def df_null():
    from pyspark.sql import functions as F

    return F.lit(None).cast("string")


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = ("lorem " * 50 + "x" * 300 + "\tipsum é ").encode()
    data, offsets = np.frombuffer(text + b"next text", np.uint8), np.array([0, len(text), len(text) + 9])
    whole = W.word_hashes(data, offsets)
    monkeypatch.setattr(W, "PIECE", 64)
    for a, b in zip(whole, W.word_hashes(data, offsets)):
        assert (a == b).all()
    assert np.diff(whole[1]).tolist() == [53, 2]
    assert len(np.unique(whole[0])) == 6


def test_register_estimates_follow_jaccard():
    rng = np.random.default_rng(1)
    for shared in (0, 1600):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        left, right = pool[:2000], pool[2000 - shared : 4000 - shared]
        a, b = (N.registers(x, np.array([0]), N.REGISTERS, N.FINE, N.FINE_MANTISSA)[0] for x in (left, right))
        assert a.dtype == np.uint8
        # Registers that agree by chance alone count for nothing.
        assert abs(float(N.estimates((a == b).mean(), 2000, 2000)) - shared / (4000 - shared)) < 0.09
    coarse = N.registers(left, np.array([0]))[0]
    zeros, mantissa = coarse >> N.MANTISSA, coarse & ((1 << N.MANTISSA) - 1)
    assert coarse.dtype == np.uint16 and 8 < zeros.mean() < 14 and len(set(mantissa.tolist())) > 60


@pytest.mark.parametrize("seed", range(5))
def test_forest_connects_what_its_links_connect(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    ka, kb = forest(60, a, b)

    def parts(a, b):
        label = list(range(60))
        for _ in range(60):
            for x, y in zip(a.tolist(), b.tolist()):
                label[x] = label[y] = min(label[x], label[y])
        return label

    assert parts(ka, kb) == parts(a, b) and len(ka) < 60


@pytest.mark.parametrize("function", [N._signed, N._as_sets])
def test_memory_of_a_batch(function):
    """A batch of many texts is handled in parts: the work arrays grow with a part, not with the batch."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["id", "text"])
    tracemalloc.start()
    ids = [i for out in function([batch]) for i in out.column("id").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ids == list(range(len(texts))) and sum(map(len, texts)) > 5 << 20 and peak < 40 << 20, peak
