import numpy as np

from salescast.llm import descent as D
from salescast.llm.queries import op13_near_vectors


def brute(rows, least=0.9):
    """(key, n_links, component, kept) of each row, from all cosines."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    by_size = {}
    for i in good:
        by_size.setdefault(len(rows[i][1]), []).append(i)
    for some in by_size.values():
        x = np.array([rows[i][1] for i in some], float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        for p, q in zip(*np.nonzero(x @ x.T >= least)):
            if p != q:
                near[some[p]].append(some[q])
    out, seen = [], {}
    for i in near:
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                todo = [q for p in todo for q in near[p] if q not in group and not group.add(q)]
            keys = [rows[p][0] for p in group if rows[p][0] is not None]
            seen.update(dict.fromkeys(group, min(keys) if keys else None))
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def planted(seed, n, groups, spread=0.03, dims=24):
    """Random vectors, and groups of near ones and of copies of the given sizes."""
    draw = np.random.default_rng(seed)
    x = [draw.standard_normal((n, dims))]
    for size in groups:
        base = draw.standard_normal(dims)
        x.append(base + spread * np.linalg.norm(base) / dims**0.5 * draw.standard_normal((size, dims)) * draw.uniform(0, 4))
        x.append(np.repeat(base[None] * 3, size // 3, axis=0))
    x = np.concatenate(x)
    return [(int(i), v.tolist()) for i, v in zip(draw.permutation(len(x)), x)]


def test_groups_of_near_vectors_and_of_copies(spark, join_way):
    rows = planted(1, 700, [2, 2, 3, 5, 30, 150])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert found(D.near_vectors(frame)) == brute(rows)


def test_hubs_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "CLIENTS", 5)
    rows = planted(2, 200, [2, 40])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(D.near_vectors(frame)) == brute(rows)


def test_recall_counts_the_missing_links(spark):
    rows = planted(3, 100, [20], spread=0.01)
    nodes = spark.createDataFrame([(i, v) for i, v in rows[:120]], "node long, vector array<double>")
    graph = D.neighbour_graph(nodes, 0.9)
    assert D.recall(nodes, graph, 0.9, 1000) == 1.0
    assert abs(D.recall(nodes, graph.filter("greatest(a, b) % 2 = 0"), 0.9, 1000) - 1.0) > 0.1
    assert D.recall(nodes, graph.limit(0), 0.9, 1000) == 0.0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0, 2.0, 3.01]), (None, None), (4, []), (5, [0.0, 0.0, -0.0]),
        (6, [1.0, None, 3.0]), (7, [1.0, nan, 3.0]), (8, [inf, 1.0, 3.0]), (9, [1e-200, 2e-200, 3e-200]), (10, [1e200, 2e200, 3e200]),
        (11, [1.0, 2.0]), (12, [-1.0, -2.0, -3.0]), (13, [1.0, 2.0, 3.0, 0.0]), (None, [5.0, -1.0, 0.0]), (None, [5.0, -1.0, 0.0]), (16, [2.0, 4.1]),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = [
        (1, 4, 1, True), (1, 4, 1, True), (None, 4, 1, False), (None, 0, None, True), (4, 0, 4, True), (5, 0, 5, True),
        (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 4, 1, False), (10, 4, 1, False), (11, 1, 11, True),
        (12, 0, 12, True), (13, 0, 13, True), (None, 1, None, True), (None, 1, None, True), (16, 1, 11, False),
    ]
    assert found(D.near_vectors(frame)) == sorted(want, key=repr)
    from pyspark.sql import functions as F

    more = frame.withColumns({n: F.lit(n) for n in ("key", "vector", "node", "a", "b", "sim", "k", "row", "root", "sound", "n_links")})
    assert found(D.near_vectors(more)) == sorted(want, key=repr)
    assert D.near_vectors(frame.limit(0)).count() == 0
    assert found(D.near_vectors(frame.limit(1))) == [(1, 0, 1, True)]


def test_query_over_all_embeddings(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert found(op13_near_vectors(spark, folder)) == brute(rows)
