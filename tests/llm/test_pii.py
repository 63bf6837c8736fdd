import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import pii as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(d):
        return sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits(m.group())) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]


CASES = [
    "", "a@b", "a@b.c", "x@a.b@c.d", "@a.b@c.d", "a.b+c@d-e.f.g, <q@r.s>", "a@@b.c", "..@-.-", "a@b..c", "a@b.c.", "a" * 200 + "@b.c" + "@d.e",
    "1.2.3.4 1.2.3.256 1.2.3.4.5.6.7.8 0001.002.3.04 99999999999999999999.1.1.1", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111 1111 1111 1112",
    "4111111111111111 4111  1111 1111 1111", "é+49 (30) 123-4567 é", "+1", "+12 3", "++12345678901234567", "+44 20 7946 0958 and more 1", "00 12",
]


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(0)
    texts = CASES + ["".join(rng.choice(list("a@.-+ 0123(é_%"), 80)) for _ in range(3000)]
    for text in texts:
        assert [(P.KINDS[k], a, b) for k, a, b in P.base_spans(text)] == plain(text), text


def test_windows_and_long_texts_get_one_tag_each():
    model = P._start(np.random.default_rng(3))
    text = "".join(np.random.default_rng(4).choice(list("ab1@. é"), 3000))
    tags = P.tag_texts(model, [text, "", "a", text[:256], text[:300]])
    assert [len(t) for t in tags] == [3000, 0, 1, 256, 300]


def test_emissions_are_those_of_one_direction_at_a_time():
    model = P._start(np.random.default_rng(5))
    rng = np.random.default_rng(6)
    lengths = np.array([7, 12, 1, 12])
    chars = rng.integers(0, P.SYMBOLS, (12, 4)).astype(np.uint8)
    got = P.emissions(model, chars, lengths)
    for row, n in enumerate(lengths):
        own = chars[:n, row : row + 1]
        mask = np.ones(own.shape, np.float32)
        states = np.concatenate([P._run(model, "f", own, mask)[0], P._run(model, "b", own, mask)[0]], axis=2)[:, 0]
        assert np.allclose(got[:n, row], states @ model["out"] + model["bias"], atol=1e-5)


def test_emissions_of_many_windows_do_not_hold_all_states():
    import tracemalloc

    model = P._start(np.random.default_rng(5))
    rng = np.random.default_rng(6)
    lengths = np.sort(np.append(rng.integers(1, P.WINDOW, 23), np.full(P._ROWS - 23, P.WINDOW)))
    chars = rng.integers(0, P.SYMBOLS, (P.WINDOW, P._ROWS)).astype(np.uint8)
    tracemalloc.start()
    got = P.emissions(model, chars, lengths)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20, peak
    for row in (0, 1, 7, 22, 23, P._ROWS - 1):
        n = lengths[row]
        own = chars[:n, row : row + 1]
        mask = np.ones(own.shape, np.float32)
        states = np.concatenate([P._run(model, "f", own, mask)[0], P._run(model, "b", own, mask)[0]], axis=2)[:, 0]
        assert np.allclose(got[:n, row], states @ model["out"] + model["bias"], atol=1e-4)


@pytest.mark.parametrize("block", [4, 16, 2048])
@pytest.mark.parametrize("scale", [0.3, 1.5, 6])
def test_one_best_path_through_each_text(monkeypatch, block, scale):
    """Against a plain search, whatever is skipped and however long stretches are cut."""
    monkeypatch.setattr(P, "_BLOCK", block)
    rng = np.random.default_rng(7)
    lengths = [0, 1, 2, 60, 300, 37, 0, 128, 5]
    begins = np.concatenate([[0], np.cumsum(lengths)])
    emit = (rng.standard_normal((begins[-1], P.TAGS)) * scale).astype(np.float32)
    emit[:, 0] += scale
    move = rng.standard_normal((P.TAGS, P.TAGS)).astype(np.float32)
    move[0, 0] += 2
    got = P.best_path(np.ascontiguousarray(emit.T), begins, move).astype(int)
    for a, b in zip(begins[:-1], begins[1:]):
        if a == b:
            continue
        best = emit[a].astype(float)
        for t in range(a + 1, b):
            best = (best[:, None] + move).max(axis=0) + emit[t]
        tags = got[a:b]
        own = emit[np.arange(a, b), tags].sum() + move[tags[:-1], tags[1:]].sum()
        assert abs(own - best.max()) < 1e-3 * max(1, abs(best.max()))


def test_a_million_digits_take_seconds():
    import time

    model, start = P._start(np.random.default_rng(3)), time.process_time()
    text = "7" * 1_000_000
    assert P.spans_of(model, [text]) == [([], [])]
    P.base_spans("1." * 500_000 + "1")
    assert time.process_time() - start < 60


def test_gradients():
    rng = np.random.default_rng(8)
    emit, move = rng.standard_normal((5, 3, P.TAGS)), rng.standard_normal((P.TAGS, P.TAGS))
    tags = rng.integers(0, P.TAGS, (5, 3))
    loss, d_emit, d_move = P._crf(emit, move, tags)
    for array, grad, at in ((emit, d_emit, (2, 1, 3)), (move, d_move, (1, 2))):
        array[at] += 1e-5
        assert abs((P._crf(emit, move, tags)[0] - loss) / 1e-5 - grad[at]) < 1e-3
        array[at] -= 1e-5


def made_texts(n, seed):
    rng = np.random.default_rng(seed)
    words = "the and of reading house water tree that with from here stone river open".split()
    texts = []
    for _ in range(n):
        say = lambda: " ".join(rng.choice(words, int(rng.integers(3, 14))))
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        card = next(c for c in (digits + str(d) for d in range(10)) if P.luhn(c))
        found = [f"{rng.choice(words)}.{rng.choice(words)}@{rng.choice(words)}.example", ".".join(map(str, rng.integers(0, 256, 4))), card,
                 "+" + " ".join("".join(map(str, rng.integers(1, 10, n))) for n in (2, 3, 3, 3)), ""][int(rng.integers(5))]
        texts.append(f"{say()} {found} {say()}" if found else say() + say())
    return texts


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(list(enumerate(made_texts(900, 1))), "doc_id long, text string")
    return P.fit(docs)


def test_trained_model_tags_held_out_spans(model):
    texts = made_texts(150, 2)
    hits = total = wrong = 0
    for text, tags in zip(texts, P.tag_texts(model, texts)):
        truth = np.zeros(len(text), int)
        for k, a, b in P.base_spans(text):
            truth[a:b] = k + 1
        hits += ((tags > 0) & (truth > 0)).sum()
        total += (truth > 0).sum()
        wrong += ((tags > 0) & (truth == 0)).sum()
    assert hits / total > 0.85 and wrong < 0.1 * total


def test_rewritten_forms_of_every_kind_are_found(model):
    """Held-out spans in forms that the base rules miss: nine of ten of each kind."""
    rng = np.random.default_rng(5)
    found, total = [0] * 4, [0] * 4
    cases = []
    for text in made_texts(500, 3):
        for kind, a, b in P.base_spans(text):
            made = P._rewritten(kind, text[a:b], rng)
            if not any(k == kind and y - x >= len(made) - 1 for k, x, y in P.base_spans(made)):
                cases.append((kind, a, a + len(made), text[:a] + made + text[b:]))
    for (kind, a, b, _), (base, more) in zip(cases, P.spans_of(model, [c[3] for c in cases])):
        total[kind] += 1
        found[kind] += any(k == kind and x <= a + 2 and y >= b - 2 for k, x, y in more)
    assert min(total) > 40 and all(f >= 0.9 * n for f, n in zip(found, total)), (found, total)
    assert P.spans_of(model, ["the water of that tree and the stone house with nothing in it"]) == [([], [])]


def test_few_spans_in_many_texts_train_the_model(spark):
    """One text in 2,000 has a span: all of them are in the sample, whatever the partitions."""
    texts = [(i, f"nothing in number {i % 90} of these" if i % 2000 else f"write to a.b{i}@house.example now") for i in range(20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    seen = []
    train = P.train
    try:
        P.train = lambda windows: seen.append(windows) or {}
        P.fit(docs, sample=20)
        P.fit(docs.repartition(7), sample=20)
    finally:
        P.train = train
    first, second = seen
    assert sum(t.any() for _, t in first) == 20 and len(first) == 60
    assert [(c.tobytes(), t.tobytes()) for c, t in first] == [(c.tobytes(), t.tobytes()) for c, t in second]


def test_query_columns_and_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "é a@b.c 1.2.3.4", 0), (3, "é a@b.c 1.2.3.4", 0), (None, "+44 20 7946 0958", 1), (4, "x " * 50000 + "a@b.c", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_email int")
    out = {r["doc_id"]: r for r in P.personal_data(df).collect()}
    assert out[1]["base_sha256"] == hashlib.sha256(b"").hexdigest() and out[1]["spans"] == ""
    assert out[3]["spans"] == "email:2:7,ip:8:15" and (out[3]["n_email"], out[3]["n_ip"]) == (1, 1)
    assert out[3]["base_sha256"] == hashlib.sha256(b"email:2:7,ip:8:15").hexdigest()
    assert out[None]["n_phone"] == 1 and out[4]["spans"].endswith("email:100000:100005")
    assert P.personal_data(df.limit(0)).collect() == []
    texts = {r["doc_id"]: r["text"] for r in P.redacted(df.withColumn("more", F.lit(None).cast("string"))).collect()}
    assert texts[3] == "é [EMAIL] [IP]" and texts[1] is None and texts[2] == ""


def test_overlaps_are_replaced_once():
    assert P.without("abcdefgh", [(2, 1, 5), (3, 3, 7)]) == "a[CARD]h"
    assert P.without("abcdefgh", []) == "abcdefgh"


def test_agrees_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in P.personal_data(docs).collect():
        base = plain(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r["spans"].split(",")) | {""}
