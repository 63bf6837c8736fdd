import random
import re
import zlib
from collections import Counter

from tallyloom.llm import spelling_variants as V

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def apart_by_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [v for v in words if apart_by_one(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_table_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    assert found(V.spelling_variants(docs)) == plain([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_words_of_few_letters_against_all_pairs(spark):
    """Repeated bigrams, overlapping pivots, chains of forms, ties."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abÀé"[: rng.randrange(1, 5)]) for _ in range(rng.randrange(4, 9))) for _ in range(500)})
    docs = []
    for i in range(40):
        text = [rng.choice(words[: rng.choice([20, 100, 500])]) for _ in range(400)]
        docs.append((i if i % 7 else None, rng.choice([" ", ", ", "×1 "]).join(rng.choice([w, w.upper()]) for w in text)))
    rows = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, word string").repartition(7)
    assert found(V.spelling_variants(rows)) == plain(docs)


def test_one_pivot_is_left():
    """For words one edit apart, the one whose prefix ends no later has a pivot in the other's prefix, at the place that the key gives."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(5, 10))) for _ in range(400)]
    pairs = [(a, b) for a in words for b in words if apart_by_one(a, b)]
    assert len(pairs) > 100
    counts = Counter(w[i : i + 2] for w in set(words) for i in range(len(w) - 1))
    order = {g: (place, n) for place, (g, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}
    for a, b in pairs:
        (last_a, _, pivots), (last_b, prefix, _) = V.prefix_and_pivots(a, order), V.prefix_and_pivots(b, order)
        assert abs(pivots[0] - pivots[1]) >= 2
        if last_a <= last_b:
            left = any(p == q and a[: p + 2] == b[: q + 2] for p in pivots for q in prefix)
            assert left or any(a[p:] == b[q:] for p in pivots for q in prefix)


def test_pivots_are_the_lightest_pair():
    order = {"ab": (0, 1), "bc": (1, 2), "cd": (2, 3), "de": (3, 9), "ef": (4, 9)}
    # ab and bc overlap
    assert V.prefix_and_pivots("abcdef", order) == (2, [0, 1, 2], [0, 2])


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i:02}", f"w{i + 1:02}") for i in range(37)] + [("x", "y")], "word string, form string")
    assert {tuple(r) for r in V.roots(forms).collect()} == {(f"w{i:02}", "w37") for i in range(37)} | {("x", "y")}


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, 0), (2, "", 0), (3, "lonely " * 3, 0), (3, "lonely " * 3, 0), (None, "rareword 1234 #", 0), (5, "q" * 300_000 + " ", 0)],
        "doc_id long, text string, n int",
    )
    assert found(V.spelling_variants(docs, spoiled=None)) == {("lonely", None, "lonely", 6, 0, None)}
    assert V.spelling_variants(docs.limit(0)).collect() == []
    assert V.spelling_variants(docs.where("doc_id < 3")).collect() == []
