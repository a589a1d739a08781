"""Results at the sizes and on the rows where shortcuts would show: rare directions, copies, many centroids, tiny numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import api
from nearfield.functions import quantizers as Q
from nearfield.functions.metrics import metric
from nearfield.operators.coded import bounded_knn
from nearfield.operators.postings import Centroids
from nearfield.plans import queries as plans
from nearfield.sources.workdir import fresh
from tests.test_search import truth


@pytest.fixture(scope="module")
def copies(spark, sf, tmp_path_factory):
    """A folder whose embeddings hold each of 150 vectors four times, by shifted keys."""
    at = f"file://{tmp_path_factory.mktemp('copies')}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 150")
    rows.withColumn("vec_id", F.explode(F.array(*(F.col("vec_id") + 150 * i for i in range(4))))).orderBy("vec_id").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.fixture(scope="module")
def gapped(spark, sf, tmp_path_factory):
    """A folder whose embeddings hold each of 150 vectors twice, by keys shifted farther than the rows reach."""
    at = f"file://{tmp_path_factory.mktemp('gapped')}"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 150")
    rows.withColumn("vec_id", F.explode(F.array(F.col("vec_id"), F.col("vec_id") + 5000))).orderBy("vec_id").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


def matrix_of(spark, at):
    return np.array([r.embedding for r in spark.read.parquet(f"{at}/embeddings.parquet").orderBy("vec_id").collect()])


def nearest_ids(x, c, ids):
    return [int(ids[np.lexsort((ids, metric("l2").exact(row[None], c)))[0]]) for row in x]


def misleading():
    """Rows and a query whose nearest row has a code that looks far: the query lies across the signs of its residual. The mean is 0."""
    own, rng = Q.SignBit(np.zeros(64)), np.random.default_rng(1)
    x = rng.normal(size=64)
    x /= np.linalg.norm(x)
    b = np.sign(own.rotate(x[None])[0]) / 8
    b = own.unrotate(b[None])[0]
    q = x - b * (x @ b)
    q /= np.linalg.norm(q)
    side = rng.normal(size=(20, 64))
    side -= np.outer(side @ q, q)
    side /= np.linalg.norm(side, axis=1)[:, None]
    others = 0.45 * q + math.sqrt(1 - 0.45**2) * side
    rows = np.concatenate([x[None], others]).astype(np.float32)
    return np.concatenate([rows, -rows]).astype(np.float64), q


def test_sign_search_loses_no_row_whose_code_misleads(spark):
    x, q = misleading()
    rows = api.vectors(spark, x.tolist())
    found = bounded_knn(Q.encoded(rows.select("vec_id", "embedding"), Q.SignBit(np.zeros(64))), api.queries(spark, [q.tolist()]), 1, Q.SignBit(np.zeros(64)), rows, metric("l2"))
    assert [(r.vec_id, r.dist) for r in found.collect()] == truth(x, q[None], 1)[0] and truth(x, q[None], 1)[0][0][0] == 0


def test_bound_search_loses_no_row_whose_code_misleads(spark):
    x, q = misleading()
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x.tolist()), max_posting_size=1 << 20, centroids=Centroids(np.array([0]), np.zeros((1, 64))), quantizer="sign")
    assert api.search(index, q.tolist(), 1, n_probe=1) == truth(x, q[None], 1)[0]


@pytest.mark.parametrize(("shift", "scale"), [(0, 1), (1e6, 1), (0, 1e-12), (0, 1e8)])
def test_floors_hold(shift, scale):
    rng = np.random.default_rng(0)
    c, x, q = (rng.normal(size=(n, 40)) * scale + shift for n in (5, 600, 20))
    of = np.arange(600) % 5
    x[:20], x[20:25] = q, c
    own = Q.SignBit(np.zeros(40))
    codes = np.concatenate([own.encode(x[i : i + 1], c[of[i]]) for i in range(600)])
    assert (own.floors(q, codes, c, of) <= metric("l2").exact(q[:, None], x[None])).all()


def test_bound_search_of_copies_takes_the_first_centroid(spark, copies):
    x, ids = matrix_of(spark, copies), np.arange(0, 600, 25)
    own, want = np.array(nearest_ids(x, x[ids], ids)), set()
    for i in range(0, 600, 50):
        probed = ids[np.lexsort((ids, metric("l2").exact(x[i][None], x[ids])))[:4]]
        rows = np.flatnonzero(np.isin(own, probed))
        d = metric("l2").exact(x[i][None], x[rows])
        want |= {(i, n + 1, int(rows[j]), float(d[j])) for n, j in enumerate(np.lexsort((rows, d))[:10])}
    assert {(r.q_id, r.rank, r.vec_id, r.dist) for r in plans.ivf_bound_search(spark, copies).collect()} == want
    index = plans._fixed_index(spark, copies)
    assert api.PostingIndex.open(spark, index.store.path).centroids().ids.tolist() == ids.tolist()  # those without rows take probes too


def test_build_verdicts_on_copies(spark, copies):
    (row,) = plans.ivf_build(spark, copies).collect()
    assert row.asDict() == {"live": 600, "bounded": True, "in_nearest": True, "recall_ok": True}


def test_build_verdicts_count_rows_where_ids_have_gaps(spark, gapped):
    (row,) = plans.ivf_build(spark, gapped).collect()
    assert row.asDict() == {"live": 300, "bounded": True, "in_nearest": True, "recall_ok": True}


def test_rows_of_a_build_sit_in_their_nearest_postings(spark):
    x = np.random.default_rng(2).normal(size=(1500, 64))
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x.tolist()), max_posting_size=24)
    assert index.in_nearest() == 1 and index.stats()["max_posting"] < 24


def test_posting_stats_of_copies_and_of_many_centroids(spark, copies):
    x, ids = matrix_of(spark, copies), np.arange(0, 600, 25)
    want = dict(zip(*np.unique(nearest_ids(x, x[ids], ids), return_counts=True), strict=True))
    assert {r.posting_id: r.n for r in plans.ivf_posting_stats(spark, copies).collect()} == want
    rng = np.random.default_rng(3)
    c, y = rng.normal(size=(5000, 64)), rng.normal(size=(100, 64))
    assert Centroids(np.arange(5000), c).owners(y, np.arange(100)).tolist() == nearest_ids(y, c, np.arange(5000))


def test_posting_stats_count_a_repeated_row_once(spark, copies, tmp_path):
    rows = spark.read.parquet(f"{copies}/embeddings.parquet")
    rows.union(rows.where("vec_id % 2 = 0")).coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    assert sorted(plans.ivf_posting_stats(spark, f"file://{tmp_path}").collect()) == sorted(plans.ivf_posting_stats(spark, copies).collect())


def test_reassigned_rows_of_copies(spark, copies):
    x, ids = matrix_of(spark, copies), np.arange(0, 600, 25)
    want = list(enumerate(nearest_ids(np.concatenate([x, -x[::3]]), x[ids], ids)))
    assert sorted((r.vec_id, r.posting_id) for r in plans.ivf_reassign(spark, copies).collect()) == want


def test_reassigned_rows_where_ids_have_gaps(spark, gapped):
    x, own = matrix_of(spark, gapped), np.concatenate([np.arange(150), 5000 + np.arange(150)])
    ids, third = own[own % 25 == 0], np.flatnonzero(own % 3 == 0)
    near = nearest_ids(np.concatenate([x, -x[third]]), x[own % 25 == 0], ids)
    want = sorted(zip([*own.tolist(), *range(300, 300 + len(third))], near, strict=True))
    assert sorted((r.vec_id, r.posting_id) for r in plans.ivf_reassign(spark, gapped).collect()) == want


def test_halves_that_round_to_zero_keep_their_sign(spark):
    x = [-1e-9, 1e-9, -2.0**-25, -2.9e-8, -0.0, -3.1e-8, -1.00048828125]
    (row,) = spark.createDataFrame([(x,)], "x array<double>").select(F.transform("x", Q.Half.rounded).alias("x")).collect()
    want = np.array(x, np.float32).astype(np.float16).astype(float)
    assert row.x == want.tolist() and [math.copysign(1, v) for v in row.x] == np.copysign(1, want).tolist()
