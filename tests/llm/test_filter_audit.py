import itertools
import random
import re

import numpy as np
from oracle_check import connect, differences

from tallyloom.llm import filter_audit as A
from tallyloom.llm.queries import op11_filter_audit


def plain(docs, labels):
    """Every order run step by step over the documents."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        own = []
        for i, text, lang in docs:
            if (lang or "") != part:
                continue
            t = text or ""
            words = re.findall(r"[^\x20\x09-\x0D]+", t)
            first = least.get(t)
            fails = {
                "A": len(words) < 100,
                "B": 100 * len(set(words)) < 80 * len(words),
                "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": re.search(r"[#$%&*|]", t) is not None,
                "E": first is not None and (i is None or i > first),
            }
            own.append((i, fails))
        worth = dict.fromkeys("ABCDE", 0)
        rows = {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                redundant = sum(d[1][f] for d in own) - len(gone)
                left = [d for d in left if not d[1][f]]
                worth[f] += len(gone)
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in own)
                rows["".join(order), step] = [
                    f, len(left), len(gone), redundant, alone, sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone),
                ]
        out |= {(part, *key): (*row[1:], worth[row[0]]) for key, row in rows.items()}
    return out


def found(df):
    rows = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}
    return rows


def test_query_agrees_with_sql(spark, sf_dir):
    assert differences(op11_filter_audit(spark, sf_dir), connect(sf_dir), A.ORACLE) == []


def test_removal_steps_are_minima():
    steps = A.removal_steps()
    for mask, order in itertools.product(range(32), range(120)):
        at = [s for s, f in enumerate(A.ORDERS[order], 1) if mask >> "ABCDE".index(f) & 1]
        assert steps[mask, order] == min(at, default=6)


def test_own_failures_keep_to_the_definitions():
    long = " ".join(f"w{i}" for i in range(100))
    assert A.own_failures(long.encode()) == 0
    assert A.own_failures("\x85".join(["a"] * 200).encode()) == 1  # no white space here
    assert A.own_failures((long + " #").encode()) == 8
    assert A.own_failures(("\x0b".join("a" for _ in range(120))).encode()) == 2
    assert A.own_failures(("é" * 8 + "A").encode()) == 1 | 4  # code points, not bytes: one of nine
    assert A.own_failures(("é" * 9 + "A").encode()) == 1  # one of ten
    assert A.own_failures(b"") == 1


def test_random_documents_against_every_order(spark):
    rng = random.Random(8)
    texts = [None, "", "a b", "x # y"] + [
        " ".join(rng.choice(["Aa", "B", f"w{rng.randrange(150)}", f"v{rng.randrange(999)}", "ü", "$"][: rng.randrange(2, 7)]) for _ in range(rng.randrange(180)))
        for _ in range(40)
    ]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "en", "de", ""])) for _ in range(150)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 60, 2), 4, 8]] + [(None, 1, 1)]
    # Ids repeat; the brute force looks labels up by id.
    rows = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, lang string, mask int").repartition(5)
    marks = spark.createDataFrame([(*x, "q") for x in labels], "doc_id long, quality int, toxic int, part string")
    named = [(i, q, t) for i, q, t in labels if i is not None]
    assert found(A.filter_audit(rows, marks)) == plain(docs, named)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "same", "en"), (2, "same", "en"), (2, "same", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = found(A.filter_audit(docs, labels))
    assert len(out) == 600 and out["en", "EABCD", 1][:4] == (1, 2, 0, 0) and out["en", "ABCDE", 5][:3] == (0, 0, 2)
    assert A.filter_audit(docs.limit(0), labels).collect() == []


def test_audit_adds_up():
    rng = np.random.default_rng(1)
    weights = rng.integers(0, 50, (3, 32))
    out = A.audit(weights)
    assert (out["kept"][:, -1] == weights[0, 0]).all()
    assert (out["removed"].sum(axis=1) + out["kept"][:, -1] == weights[0].sum()).all()
    assert (out["shapley"].sum(axis=1) == 120 * (weights[0].sum() - weights[0, 0])).all()
