import numpy as np

from tallyloom.llm import near_vectors as V


def expected(rows, threshold=0.9):
    valid = {}
    for i, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            scaled = np.array(v, float) / max(map(abs, v))
            valid[i] = scaled / np.linalg.norm(scaled)
    links = {i: {j for j in valid if j != i and len(valid[i]) == len(valid[j]) and valid[i] @ valid[j] >= threshold} if i in valid else set() for i, _ in rows}
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def rows_of(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 25))):
            rows.append((centre + rng.standard_normal(16) * 0.12 * (c % 3)).tolist())
    step = rng.standard_normal((2, 16))
    rows += [(np.cos(t) * step[0] + np.sin(t) * step[1]).tolist() for t in np.arange(0, 2, 0.3)]
    rows += [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.1], [1e200] * 16, [1e-200] * 16]
    rows += [rows[0], rows[0]]
    return [(int(i), v) for i, v in zip(rng.permutation(len(rows)) * 3, rows)]


def result(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in df.collect()}


def test_agrees_with_all_pairs(spark, monkeypatch):
    rows = rows_of()
    for block in (2048, 5):
        monkeypatch.setattr(V, "BLOCK", block)
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        assert result(V.near_vectors(df, recall=0.99999)) == expected(rows)


def test_recall_on_the_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    want, got = expected(rows), result(V.near_vectors(df))
    assert sum(n for n, _, _ in got.values()) >= 0.99 * sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_tables_give_the_recall_asked_for():
    for n in (1000, 10**6, 10**9):
        k, tables = V.tables_for(n, 0.9)
        assert 1 - (1 - V.collision((2 - 1.8) ** 0.5) ** k) ** tables >= V.RECALL
    rng = np.random.default_rng(0)
    cells = np.floor((rng.standard_normal((20000, 1)) * 0.447 + rng.random((20000, 1)) * V.WINDOW) / V.WINDOW)
    assert abs(float((cells == 0).mean()) - V.collision(0.447)) < 0.02


def test_empty_repeated_and_extra(spark):
    assert V.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = [(4, [1.0, 0.0], "x"), (4, [1.0, 0.0], "x"), (None, [1.0, 0.0], "y"), (9, [2.0, 0.0], None)]
    out = V.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, bucket string"))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [(4, 2, 4, True), (4, 2, 4, True), (None, 0, None, True), (9, 2, 4, False)]))
