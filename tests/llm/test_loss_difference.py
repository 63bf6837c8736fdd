import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyloom.llm import loss_difference as D

TEXTS = [(1, "abab", True), (2, "abba é", False), (3, "", True), (4, None, False), (5, "abcabc", None), (5, "abcabc", None)]


def model(spark, rows):
    return D.fit(spark.createDataFrame(rows, "doc_id long, text string, target boolean").withColumn("target", F.coalesce("target", F.lit(False))))


def test_agrees_with_plain_counts(spark):
    """With so few n-grams no two share a cell, so counts by n-gram give the same."""
    models = model(spark, TEXTS)
    plain = []
    for wanted in (True, False):
        grams, contexts = ([Counter() for _ in range(D.ORDER + 1)] for _ in range(2))
        for _, text, target in TEXTS:
            if target or not wanted:
                padded = ["$"] * (D.ORDER - 1) + list(text or "") + ["$"]
                for i in range(D.ORDER - 1, len(padded)):
                    for n in range(1, D.ORDER + 1):
                        grams[n][tuple(padded[i - n + 1 : i + 1])] += 1
                        contexts[n][tuple(padded[i - n + 1 : i])] += 1
        plain.append((grams, contexts))

    def mean(counts, text):
        grams, contexts = counts
        padded, total = ["$"] * (D.ORDER - 1) + list(text or "") + ["$"], 0.0
        for i in range(D.ORDER - 1, len(padded)):
            p = 1 / D.VOCABULARY
            for n in range(1, D.ORDER + 1):
                gram = tuple(padded[i - n + 1 : i + 1])
                seen = contexts[n][gram[:-1]]
                new = math.ceil(math.sqrt(seen)) if n > 1 else len(grams[1])
                weight = seen + new
                p = (grams[n][gram] + new * p) / weight if weight else p
            total -= math.log2(p)
        return total / (len(text or "") + 1)

    rows = spark.createDataFrame([(i, t, "x") for i, t, _ in TEXTS], "doc_id long, text string, cell string")
    for r in D.loss_difference(rows, models).collect():
        text = next(t for i, t, _ in TEXTS if i == r["doc_id"])
        assert r["n_tokens"] == len(text or "") + 1
        assert abs(r["target_loss"] - mean(plain[0], text)) < 1e-4 and abs(r["background_loss"] - mean(plain[1], text)) < 1e-4
        assert r["difference"] == r["target_loss"] - r["background_loss"]


def test_target_texts_score_lower(spark):
    rng = np.random.default_rng(0)
    say = lambda words: " ".join(rng.choice(words, 30))
    left, right = "house water river stone".split(), "xq99 zz## ##%% 00!!".split()
    rows = [(i, say(left if i % 2 else right), bool(i % 2) and i < 150) for i in range(200)]
    models = model(spark, rows)
    out = {r["doc_id"]: r["difference"] for r in D.loss_difference(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), models).collect()}
    assert max(out[i] for i in range(151, 200, 2)) < min(out[i] for i in range(150, 200, 2))


def test_chances_over_the_vocabulary_sum_to_one(spark):
    """After every context of four signs, those at the beginning of a text included, under both models."""
    texts = [(i, t, i % 3 == 0) for i, t in enumerate(["abab", "abba é", "", "abcabc", "b", "a", "aa", "bc", "\U0010ffff a", "cab"] * 2)]
    models = model(spark, texts)
    letters = sorted({c for _, t, _ in texts for c in t.replace("\U0010ffff", "\ufffd")}) + ["$"]
    point = lambda c: (D.END if c == "$" else ord(c)) + 1
    grams = {}
    for context in ("$$$$", "$$$a", "$$ab", "$aba", "abab", "bba ", "zzzz", "$$$z", "$$$b"):
        for letter in [*letters, "z", "\u4e00"]:
            low = sum(point(c) << (21 * back) for back, c in enumerate(reversed(context[2:] + letter)))
            high = sum(point(c) << (21 * back) for back, c in enumerate(reversed(context[:2])))
            grams[high, low] = (context, letter)
    rows = D._chances(spark.createDataFrame(list(grams), "high long, low long"), models).collect()
    assert len(rows) == len(grams)
    for m in ("target", "background"):
        for context in {c for c, _ in grams.values()}:
            own = {grams[r["high"], r["low"]][1]: r[m] for r in rows if grams[r["high"], r["low"]][0] == context}
            unseen = own.pop("z")
            assert own.pop("\u4e00") == unseen
            whole = sum(own.values()) + (D.VOCABULARY - len(own)) * unseen
            assert abs(whole - 1) < 1e-9, (m, context, whole)


def test_four_equal_beginnings_cost_two_bits(spark):
    rows = [(i, "abcd"[i % 4], True) for i in range(20)]
    out = D.loss_difference(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), model(spark, rows)).collect()
    # The letter costs some two bits, its end next to nothing.
    assert all(1.8 < 2 * r["target_loss"] < 3 for r in out) and max(r["difference"] for r in out) == 0


def test_no_target_and_no_rows(spark):
    models = model(spark, [(1, "ab", False)])
    df = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    (row,) = D.loss_difference(df, models).collect()
    assert abs(row["target_loss"] - math.log2(D.VOCABULARY)) < 1e-3 and row["difference"] > 0
    assert D.loss_difference(df.limit(0), model(spark, [])).collect() == []


def test_marked_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")
    assert sorted(map(tuple, D.marked(docs, chosen).collect())) == [("a", True), ("b", False), ("c", False)]


def test_every_ngram_has_its_own_count(spark):
    """More distinct n-grams than any fixed table of 2**18 cells holds apart; texts need not be those of the fit."""
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x4E00 + 300, 40000))) for _ in range(10)]
    rows = [(i, t, i < 5) for i, t in enumerate(texts)]
    models = model(spark, rows)
    grams, contexts = ([[Counter() for _ in range(D.ORDER)] for _ in range(2)] for _ in range(2))
    for _, text, target in rows:
        padded = "$" * (D.ORDER - 1) + text + "$"
        for n in range(D.ORDER):
            own = Counter(padded[i - n : i + 1] for i in range(D.ORDER - 1, len(padded)))
            for which in (0, 1) if target else (1,):
                grams[which][n].update(own)
                contexts[which][n].update(padded[i - n : i] for i in range(D.ORDER - 1, len(padded)))
    assert models[-1].count() == len(grams[1][-1]) > 1 << 18
    probe = texts[0][100:400] + "new" + texts[7][5:300]
    want = []
    for counts, before in zip(grams, contexts):
        padded, total = "$" * (D.ORDER - 1) + probe + "$", 0.0
        for i in range(D.ORDER - 1, len(padded)):
            p = 1 / D.VOCABULARY
            for n in range(D.ORDER):
                gram = padded[i - n : i + 1]
                seen = before[n][gram[:-1]]
                new = math.ceil(math.sqrt(seen)) if n else len(counts[0])
                weight = seen + new
                p = (counts[n][gram] + new * p) / weight if weight else p
            total -= math.log2(p)
        want.append(total / (len(probe) + 1))
    (row,) = D.loss_difference(spark.createDataFrame([(1, probe)], "doc_id long, text string"), models).collect()
    assert abs(row["target_loss"] - want[0]) < 1e-6 and abs(row["background_loss"] - want[1]) < 1e-6
