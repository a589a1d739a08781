import math

import numpy as np
import pytest

from nearfield.llm import op9_multiindex as op


def brute(rows, least=0.98):
    fit = [(i, tuple(v), l) for i, v, l in rows if i is not None and v and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    fit = list(dict.fromkeys(fit))
    links = {}
    for i, v, l in fit:
        for j, w, m in fit:
            if i != j and l == m and len(v) == len(w) and op.cosines(np.array([v]), np.array([w]))[0] >= least:
                links.setdefault(i, set()).add(j)
    parent = {r[0]: r[0] for r in rows}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            for j in js:
                m = min(parent[i], parent[j])
                changed |= parent[i] != m or parent[j] != m
                parent[i] = parent[j] = m
    return {i: (len(links.get(i, ())), parent[i]) for i in parent if i is not None}


@pytest.mark.parametrize("block", [4, 512])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    r = np.random.default_rng(4)
    centres = r.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + r.normal(size=16) * r.choice([0.02, 0.12, 0.5])).tolist(), i % 3) for i in range(400)]
    rows += [(400 + i, rows[i % 2][1], i % 2) for i in range(8)] + [(500, rows[0][1], 0), (500, rows[0][1], 0)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] * 16, 1), (604, [None] + [1.0] * 15, 1), (605, rows[0][1], None), (None, rows[0][1], 0), (606, rows[0][1][:8], 0), (607, [float("inf")] + [1.0] * 15, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({c: __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1) for c in ("cell", "home", "key", "times", "component")})
    got, want = op.near_duplicates(df.repartition(4)).collect(), brute(rows)
    assert len(got) == len(rows)
    for x in got:
        if x.vec_id is None:
            assert x.component_id is None and x.n_links == 0 and x.kept is None
        else:
            assert (x.n_links, x.component_id, x.kept) == (*want[x.vec_id], x.vec_id == want[x.vec_id][1])


def test_a_crowd_makes_no_pairs(spark, monkeypatch):
    """Rows that the blocks give grow with the vectors of a crowd, not with its pairs; vectors of many lengths are no error."""
    r, made = np.random.default_rng(2), []
    inner = op._links

    def spied(*args):
        made.append(inner(*args))
        return made[-1]

    monkeypatch.setattr(op, "_links", spied)
    crowd = [(i, (np.ones(8) + r.normal(size=8) * 0.01).tolist(), 1) for i in range(300)]
    rows = crowd + [(1000 + k, [1.0] * (k + 1), 1) for k in range(66) if k != 7]
    got = {x.vec_id: x for x in op.near_duplicates(spark.createDataFrame(crowd, "vec_id long, embedding array<double>, label int")).collect()}
    assert all(got[i].n_links == 299 and got[i].component_id == 0 for i in range(300))
    assert made[0].count() < 300 * 40
    monkeypatch.setattr(op, "_links", inner)
    few = op.near_duplicates(spark.createDataFrame(rows[:20] + rows[-6:], "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(x.n_links for x in few) == [0] * 6 + [19] * 20


def test_forest():
    r = np.random.default_rng(3)
    for _ in range(50):
        n = int(r.integers(1, 30))
        a, b = r.integers(0, n, size=(2, int(r.integers(0, 40))))
        one, two = op.forest(a, b, n)
        label = np.arange(n)
        for _ in range(n):
            for i, j in zip(a, b):
                label[[i, j]] = min(label[i], label[j])
        assert len(one) == n - len(set(label.tolist())) and all(label[i] == label[j] == i for i, j in zip(one, two))


def test_reach_is_set_against_all_rows(spark, monkeypatch):
    """Links to rows beyond the sample set the reach, and the share asked for is found."""
    monkeypatch.setattr(op, "SAMPLE", 60)
    monkeypatch.setattr(op, "IN_CELL", 1)
    r = np.random.default_rng(7)
    centres = r.normal(size=(200, 12))
    rows = [(i, (centres[i % 200] + r.normal(size=12) * 0.08).tolist(), 0) for i in range(600)]
    got = {x.vec_id: x.n_links for x in op.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want = brute(rows)
    assert sum(got.values()) >= 0.9 * sum(n for n, _ in want.values()) > 300


def test_no_rows(spark):
    assert op.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_traversal_is_in_order():
    r = np.random.default_rng(1)
    one, two = r.random(9), r.random(7)
    sums = [one[c // 7] + two[c % 7] for c in op.visits(one, two, 0.6)]
    every = sorted((a + b for a in one for b in two))
    assert sums == sorted(sums) and len(sums) == sum(x <= every[0] + 0.6 for x in every)
