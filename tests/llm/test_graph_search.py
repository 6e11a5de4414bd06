"""Graph search: recall against brute force, exact scores, ties, copies and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenlend.llm import graphann


def brute(rows, is_query, k):
    """``query id: [(score, id)]`` over all rows that take part, best pair per id."""
    rows = [(i, np.trim_zeros(np.array(v, float), "b")) for i, v in rows if i is not None and v is not None and None not in v]
    rows = [(i, v) for i, v in rows if len(v) and np.isfinite(v).all()]
    dims = max((len(v) for _, v in rows), default=0)
    x = np.array([np.pad(v, (0, dims - len(v))) for _, v in rows])
    ids = [i for i, _ in rows]
    out = {}
    for q, v in zip(ids, x):
        if is_query(q):
            best = out.setdefault(q, {})
            for i, s in zip(ids, graphann.cosines(np.broadcast_to(v, x.shape), x)):
                if i != q:
                    best[i] = max(best.get(i, -2.0), s)
    return {q: sorted(((-s, i) for i, s in best.items()))[:k] for q, best in out.items()}


def found(frame):
    out = {}
    for r in frame.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def table(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return frame.withColumns({"v": F.lit(1), "shard": F.lit("s"), "__hi": F.lit(0), "score": F.lit(2.0)})


@pytest.mark.parametrize("shard_rows", [300, 5000])
def test_recall_over_all_shards(spark, shard_rows):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    params = graphann.GraphParams(shard_rows=shard_rows)
    got = found(graphann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, 5, params))
    want = brute(rows, lambda i: i % 50 == 0, 5)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    exact = {q: dict((i, s) for s, i in brute(rows, lambda j: j == q, 3000)[q]) for q in list(want)[:5]}
    for q, scores in exact.items():
        assert all(abs(scores[i] - s) < 1e-12 for s, i in got[q])


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100, 130)]
    rows += [(i, [1.0, 2.0, 0.0, -0.0]) for i in range(0, 90)]  # a hot vector, also as query
    rows += [(200, [1.0, 2.0]), (201, [2.0, 4.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0])]
    rows += [(300, None), (301, []), (302, [0.0, 0.0]), (303, [float("nan"), 1.0]), (304, [float("inf"), 1.0]), (305, [None, 1.0]), (None, [1.0, 2.0])]
    rows += [(10, [0.0, 1.0, 1.0]), (400, [3e38, 3e38, 3e38]), (410, [1e-38, 1e-38, 1e-38])]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = found(graphann.nearest(table(spark, rows), F.col("vec_id") % 10 == 0, 5, graphann.GraphParams(shard_rows=40)))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert set(got) == set(want)
    for q, best in want.items():
        assert [i for _, i in got[q]] == [i for _, i in best], q
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in best], rtol=0, atol=1e-12)


def test_few_rows(spark):
    empty = table(spark, [(1, None)])
    assert graphann.nearest(empty, F.lit(True)).count() == 0
    assert graphann.nearest(empty.limit(0), F.lit(True)).columns == ["query_id", "rank", "vec_id", "score"]
    assert graphann.nearest(table(spark, [(0, [1.0])]), F.lit(True)).count() == 0
    two = found(graphann.nearest(table(spark, [(0, [1.0]), (1, [-2.0])]), F.lit(True)))
    assert two == {0: [(1.0, 1)], 1: [(1.0, 0)]}


def test_pruning_keeps_diverse_edges():
    x = graphann.unit(np.random.default_rng(1).normal(size=(400, 8)))
    params = graphann.GraphParams(degree=8, build_beam=24, alpha=1.2)
    graph = graphann.build(x, params)
    assert graph.edges.shape == (400, 8) and (graph.edges >= 0).any(axis=1).all()
    reached, todo = {graph.entry}, [graph.entry]
    while todo:
        for j in graph.edges[todo.pop()]:
            if j >= 0 and j not in reached:
                reached.add(int(j))
                todo.append(int(j))
    assert len(reached) >= 396
    near = np.argsort(((x - x[3]) ** 2).sum(axis=1), kind="stable")[1:60]
    dist = ((x[near] - x[3]) ** 2).sum(axis=1).astype(np.float32)
    kept = graph.prune(near[None, :], dist[None, :], 1.2)[0]
    plain = []
    for j, d in zip(near, dist):
        if len(plain) < 8 and all(1.44 * ((x[j] - x[p]) ** 2).sum() > d for p in plain):
            plain.append(j)
    assert [j for j in kept if j >= 0] == plain


def test_shared_table_recall(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = found(graphann.nearest(frame, F.col("vec_id") % 50 == 0))
    want = brute([(r["vec_id"], r["embedding"]) for r in frame.collect()], lambda i: i % 50 == 0, 5)
    assert set(got) == set(want)
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
