import math

import numpy as np
import pytest

from nearfield import api
from nearfield.functions import quantizers as Q
from nearfield.functions.metrics import metric
from nearfield.functions.predicates import Predicate as P
from nearfield.operators import measure
from nearfield.operators.coded import coded_knn
from nearfield.operators.graph import build_shard
from nearfield.operators.search import knn, knn_columns
from nearfield.plans import queries as plans
from nearfield.sources.workdir import fresh


def cloud(n, dim, seed=0, centres=0):
    r = np.random.default_rng(seed)
    if not centres:
        return r.random((n, dim)).astype(np.float32)
    c = np.random.default_rng(99).uniform(-1, 1, (centres, dim))
    return (c[np.arange(n) % centres] + r.normal(0, 0.12, (n, dim))).astype(np.float32)


def truth(x, q, k, by="l2", keep=None):
    d = metric(by).exact(q.astype(float)[:, None], x.astype(float)[None])
    ids = np.arange(len(x)) if keep is None else np.flatnonzero(keep)
    return [[(int(i), float(row[i])) for i in ids[np.lexsort((ids, row[ids]))][:k]] for row in d]


def found(df, n):
    out = [[] for _ in range(n)]
    for r in df.orderBy("q_id", "rank").collect():
        out[r.q_id].append((r.vec_id, r.dist))
    return out


@pytest.fixture(scope="module")
def sample(spark):
    x, q = cloud(400, 16), cloud(9, 16, 5)
    return x, q, api.vectors(spark, x, [[i % 3, i] for i in range(400)]).repartition(5).cache(), api.queries(spark, q).cache()


@pytest.mark.parametrize("by", ["l2", "euclidean", "cosine", "dot"])
def test_exact_search(sample, by):
    x, q, rows, asked = sample
    assert found(knn(rows, asked, 7, by), 9) == truth(x, q, 7, by)
    assert found(knn_columns(rows, asked, 7, by), 9) == truth(x, q, 7, by)


def test_non_finite_vectors(spark):
    x = cloud(60, 4)
    x[3, 1], x[7, 0], x[9, 2], x[11] = np.nan, np.inf, -np.inf, np.inf
    q = np.array([x[0], x[7], x[3]])
    rows, asked = api.vectors(spark, x.tolist()), api.queries(spark, q.tolist())
    for by in ("l2", "euclidean", "dot"):
        with np.errstate(invalid="ignore"):
            d = metric(by).exact(q.astype(float)[:, None], x.astype(float)[None])
        want = [[(int(i), float(r[i])) for i in np.lexsort((np.arange(60), r)) if not np.isnan(r[i])] for r in d]
        for k in (5, 100):
            assert found(knn(rows, asked, k, by), 3) == [w[:k] for w in want]
        assert found(knn_columns(rows, asked, 5, by), 3) == [w[:5] for w in want]
    assert len(want[0]) < 60 and want[2] == []
    with pytest.raises(Exception, match="null"):
        knn(spark.createDataFrame([(0, None)], "vec_id long, embedding array<float>"), asked.limit(1), 1).collect()


def test_edges_of_k_and_blocks(sample, spark):
    x, q, rows, asked = sample
    assert found(knn(rows, asked, 7, block_bytes=300), 9) == truth(x, q, 7)
    assert knn(rows, asked, 0).collect() == [] and len(found(knn(rows, asked, 1000), 9)[0]) == 400
    one = api.vectors(spark, [[1.0] * 16] * 6)
    assert [i for i, _ in found(knn(one, asked.limit(1), 3), 9)[0]] == [0, 1, 2]
    with pytest.raises(ValueError):
        knn(rows, asked, 3, "chebyshev")
    with pytest.raises(Exception, match="dimensions"):
        knn(rows, api.queries(spark, [[1.0, 2.0]]), 3).collect()
    assert found(knn(api.vectors(spark, [[0.0] * 16]), asked.limit(1), 1, "cosine"), 9)[0] == [(0, 1.0)]


@pytest.mark.parametrize(("predicate", "keep"), [(P.eq(0, 1), lambda a, b: a == 1), (P.and_([P.in_(0, [0, 2]), P.range(1, 10, 90)]), lambda a, b: a in (0, 2) and 10 <= b <= 90), (P.or_([P.lt(1, 3), P.gt(1, 395)]), lambda a, b: b < 3 or b > 395), (P.none(), lambda a, b: True), (P.eq(0, 999), lambda a, b: False), (P.gt(5, 0), lambda a, b: False)])
def test_filters(sample, predicate, keep):
    x, q, rows, asked = sample
    mask = np.array([keep(i % 3, i) for i in range(400)])
    assert found(knn(rows, asked, 5, predicate=predicate), 9) == truth(x, q, 5, keep=mask)
    assert [predicate.matches([i % 3, i]) for i in range(400)] == mask.tolist()
    assert not P.eq(0, 1).matches([]) and P.none().matches([])


@pytest.mark.parametrize(("kind", "floor"), [("f16", 0.95), ("int8", 0.8), ("pq", 0.1), ("sign", 0.2)])
def test_quantizers(spark, kind, floor):
    x, q = cloud(300, 64, 1), cloud(8, 64, 2)
    rows, asked = api.vectors(spark, x).cache(), api.queries(spark, q)
    options = {"parts": 8, "centres": 32, "rounds": 4} if kind == "pq" else {}
    model = Q.train(kind, rows, **options)
    again = Q.loads(Q.dumps(model))
    codes = model.encode(x.astype(float))
    assert (again.encode(x.astype(float)) == codes).all() and codes.shape == (300, model.code_size())
    plain = coded_knn(Q.encoded(rows, model), asked, 10, model)
    ranked = coded_knn(Q.encoded(rows, model), asked, 10, model, rerank=100, vectors=rows)
    share = lambda df: np.mean([len({i for i, _ in a} & {i for i, _ in b}) / 10 for a, b in zip(found(df, 8), truth(x, q, 10))])
    assert share(plain) >= floor and share(ranked) >= share(plain)
    exact = [dict(t) for t in truth(x, q, 300)]
    assert all(d == pytest.approx(exact[i][v], abs=1e-9) for i, r in enumerate(found(ranked, 8)) for v, d in r)
    y = q.astype(float)
    assert (model.distances(y, codes) == model.distances(y, codes, model.prepare(y))).all()
    if kind == "pq":
        assert np.allclose(model.distances(y, codes), model.direct(y, codes)) and (model.distances(y, codes) == model.direct(y, codes)).mean() > 0.99
    path = fresh(spark, "model") + ".json"
    Q.save(spark, model, path)
    assert (Q.load(spark, path).encode(x.astype(float)) == codes).all()
    with pytest.raises(Exception, match="exist"):
        Q.save(spark, model, path)


def test_quantizer_arguments(spark):
    rows = api.vectors(spark, cloud(20, 12))
    for bad in ({"parts": 5}, {"parts": 4, "centres": 257}):
        with pytest.raises(ValueError):
            Q.train("pq", rows, **bad)
    with pytest.raises(ValueError):
        Q.train("zip", rows)
    with pytest.raises(ValueError):
        Q.train("int8", rows.limit(0))


def test_sign_bits():
    x = np.random.default_rng(3).uniform(-1, 1, (500, 100))
    m = Q.SignBit(x.mean(axis=0))
    assert np.allclose(np.linalg.norm(m.rotate(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(m.unrotate(m.rotate(x)), x)
    d, e = m.estimates(x[:20], m.encode(x))
    true = metric("l2").exact(x[:20, None], x[None])
    assert (np.abs(d - true) < 0.35 * true + 0.02 * true.mean()).mean() > 0.95 and (d - e <= true).mean() > 0.93


def test_half_precision_expression(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=500) * 10.0 ** np.random.default_rng(1).integers(-7, 4, 500), [0.0, 1.0, -2.5, 65504.0, 6e-8]])
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "x double").select(Q.Half.rounded(F.col("x"))).collect()]
    assert got == x.astype(np.float16).astype(float).tolist()


def test_measures(spark, sample):
    x, q, rows, asked = sample
    assert np.allclose(measure.centroid(rows).first().centroid, x.astype(float).mean(axis=0))
    near = metric("l2").exact(x.astype(float).mean(axis=0)[None], x.astype(float))
    assert measure.medoid(rows).first().vec_id == near.argmin()
    full, part = knn(rows, asked, 10), knn(rows.where("vec_id % 2 = 0"), asked, 10)
    want = [len({i for i, _ in a} & {i for i, _ in b}) / 10 for a, b in zip(truth(x, q, 10), truth(x, q, 10, keep=np.arange(400) % 2 == 0))]
    assert [r.recall for r in measure.recall(part, full, 10).orderBy("q_id").collect()] == pytest.approx(want)
    assert all(r.recall >= w for r, w in zip(measure.radius_recall(part, full, 10).orderBy("q_id").collect(), want))
    assert "numpy" in api.engine_info() and math.isfinite(near[0])


def test_copies_of_a_node_do_not_fill_its_list():
    x = np.concatenate([np.zeros((20, 2)), np.random.default_rng(0).normal(size=(30, 2))])
    near, _ = build_shard(x, metric("l2"), 8, 40, 1.2)
    assert all((near[i] >= 20).any() for i in range(20)) and max(map(len, near)) <= 8


def test_every_node_is_reached():
    x = np.concatenate([np.random.default_rng(i).normal(100 * i, 0.01, (40, 3)) for i in range(6)])
    near, medoid = build_shard(x, metric("l2"), 4, 6, 1.2)
    seen, todo = {medoid}, [medoid]
    while todo:
        for j in near[todo.pop()]:
            if int(j) not in seen:
                seen.add(int(j))
                todo.append(int(j))
    assert len(seen) == 240 and max(map(len, near)) <= 4


def test_graph(spark):
    x, q = cloud(600, 32, 4), cloud(12, 32, 6)
    index = api.GraphIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x, [[i % 5] for i in range(600)]), max_degree=24, build_beam_width=64, shard_rows=250)
    got = api.search_batch(index, q.tolist(), 10, beam_width=64)
    assert np.mean([len({i for i, _ in a} & {i for i, _ in b}) / 10 for a, b in zip(got, truth(x, q, 10))]) >= 0.9
    assert all(len(r) == 10 and [d for _, d in r] == sorted(d for _, d in r) for r in got)
    again = api.GraphIndex.open(spark, index.store.path)
    assert api.search(again, q[0].tolist(), 10, beam_width=64) == got[0] and again.num_vectors == 600 and again.max_degree == 24
    from pyspark.sql import functions as F

    assert again.graph().agg(F.max(F.size("neighbors"))).first()[0] <= 24
    assert again.get_labels(7) == [2] and again.count_matching(P.eq(0, 2)) == 120 and again.has_labels and again.num_fields == 1 and again.dim == 32
    assert again.get_vector(7) == x[7].tolist() and again.search_filtered(api.queries(spark, q), P.eq(0, 3), 5).count() == 60
    moved = api.GraphIndex.from_bytes(spark, again.to_bytes(), fresh(spark, "t"))
    assert api.search_batch(moved, q.tolist(), 10, beam_width=64) == got
    keep = np.arange(600) % 5 == 3
    assert api.search_batch(index, q.tolist(), 5, predicate=P.eq(0, 3)) == truth(x, q, 5, keep=keep)
    with pytest.raises(IndexError):
        again.get_vector(600)
    with pytest.raises(ValueError):
        api.GraphIndex.open(spark, index.store.path, "cosine")
    with pytest.raises(ValueError):
        api.GraphIndex.build(spark, fresh(spark, "t"), api.vectors(spark, []))
    with pytest.raises(ValueError):
        api.search(index, [1.0, 2.0])


@pytest.mark.parametrize("name", ["ivf_build", "graph_build"])
def test_recall_verdicts_rest_on_rows_of_the_whole_table(spark, sf, name, monkeypatch):
    asked, recall = set(), plans.measure.recall

    def spied(found, truth, k):
        asked.update(r.q_id for r in truth.select("q_id").distinct().collect())
        return recall(found, truth, k)

    monkeypatch.setattr(plans.measure, "recall", spied)
    (row,) = plans.QUERIES[name](spark, sf).collect()
    assert row.recall_ok and asked == {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
