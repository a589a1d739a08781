import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row

from nearfield.llm import components as cc
from nearfield.llm import op8_jaccard as op
from nearfield.llm.components import components
from nearfield.llm.scratch import Scratch


def brute(rows, n, num):
    """doc_id -> (size, component)"""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(seed, base, copies, edits):
    r = random.Random(seed)
    words = [f"w{r.randint(0, 400)}" for _ in range(base)]
    out = [" ".join(words)]
    for _ in range(copies):
        own = list(words)
        for _ in range(r.randint(0, edits)):
            k = r.choice("dis")
            at = r.randrange(len(own))
            if k == "d":
                del own[at]
            elif k == "i":
                own.insert(at, f"n{r.randint(0, 99)}")
            else:
                own[at] = f"n{r.randint(0, 99)}"
        out.append(" ".join(own))
    return out


def held(rows):
    """The bucket reader with HOLD lowered, also where it runs."""

    def read(batches, num, den):
        op.HOLD = rows
        return inner(batches, num, den)

    inner = op._shared
    return read


@pytest.mark.parametrize(("n", "num", "block", "hold"), [(3, 90, 2048, 1 << 16), (5, 80, 2, 5)])
def test_groups_equal_brute_force(spark, n, num, block, hold, monkeypatch):
    monkeypatch.setattr(op, "GROUP", 3)
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "BROADCAST_IDS", 1_000_000 if block > 2 else 0)
    monkeypatch.setattr(op, "_shared", held(hold))
    texts = family(1, 30, 40, 3) + family(2, 120, 60, 6) + family(3, 9, 20, 1) + family(4, 300, 30, 12) + ["a b", "a  B", "c", "", None, "x y z"] + family(5, 4, 8, 1)
    rows = list(enumerate(texts))
    random.Random(0).shuffle(rows)
    got = op.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), words=n, num=num).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, n, num)


def test_awkward_rows(spark, awkward, nothing):
    got = op.jaccard_groups(awkward).collect()
    want = brute({(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None}, 3, 90)
    assert len(got) == awkward.count()
    assert all(want[r.doc_id] == (r.n_shingles, r.component_id) for r in got if r.doc_id is not None)
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert op.jaccard_groups(nothing).collect() == []


def test_no_pair_escapes_the_buckets():
    """Two sets that link share a signature, whatever their sizes and differences."""
    r = np.random.default_rng(6)
    for num in (90, 80):
        band = op.Banding(num, 100, r.integers(0, 9, size=1 << op.TALLY).astype(np.uint8))
        for _ in range(400):
            size = int(r.integers(1, 400))
            x = np.unique(r.integers(0, 2**63, size=size).astype(np.uint64))
            drop = int(r.integers(0, max(1, len(x) // 8 + 1)))
            y = np.unique(np.concatenate([x[r.permutation(len(x))[: len(x) - drop]], r.integers(0, 2**63, size=int(r.integers(0, max(1, size // 8 + 1)))).astype(np.uint64)]))
            if len(y) and op.links(x, y, num, 100):
                with np.errstate(over="ignore"):
                    (a, near_a), (b, near_b) = band.signatures(x), band.signatures(y)
                    near = near_a if len(x) < len(y) else near_b
                    common = set(a) & set(b)
                    assert common and (len(x) == len(y) or common & set((a if len(x) < len(y) else b)[near]))
                    rows = sorted((sig, k, 2 * len(s) + m) for k, (s, sigs, ms) in enumerate(((x, a, near_a), (y, b, near_b))) for sig, m in zip(sigs.view(np.int64).tolist(), ms.tolist()))
                    made = list(op._shared(iter([pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["sig", "set_id", "size"])]), num, 100))
                    assert {i for m in made for i in m.column(1).to_pylist()} == {0, 1}


@pytest.mark.parametrize("hold", [1, 3, 100])
def test_shared_buckets(hold, monkeypatch):
    """Whatever the batches, all buckets of two sets at least come back, equal ones as one with their number."""
    monkeypatch.setattr(op, "HOLD", hold)
    r = random.Random(hold)
    size = {i: r.choice([8, 9, 10, 11, 14]) for i in range(12)}
    near = {(s, i): r.random() < 0.6 for s in range(60) for i in range(12)}
    rows = sorted((s, i, 2 * size[i] + near[s, i]) for s in range(60) for i in r.sample(range(12), r.choice([1, 1, 2, 3, 9])) for _ in range(r.choice([1, 1, 2])))
    want = {}
    for s in range(60):
        members = {i for t, i, _ in rows if t == s}
        fits = lambda a, b: a != b and size[a] <= size[b] and size[a] * 100 >= 80 * size[b] and near[s, a]  # noqa: E731, B023
        members = frozenset(i for i in members if any(fits(i, j) or fits(j, i) for j in members))
        if members:
            want[members] = want.get(members, 0) + 1
    for rows_at_once in (1, 4, 1000):
        parts = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[i : i + rows_at_once]], pa.int64()) for k in range(3)], names=["sig", "set_id", "size"]) for i in range(0, len(rows), rows_at_once)]
        found, weights = {}, {}
        for b in op._shared(iter(parts), 80, 100):
            for x in b.to_pylist():
                found.setdefault(x["sig"], set()).add(x["set_id"])
                weights[x["sig"]] = x["weight"]
        if hold == 100:
            assert {frozenset(v) for v in found.values()} == set(want)
        else:  # a bucket that is too large to hold keeps all its rows
            assert all(any(w <= v for v in found.values()) for w in want)
        if hold == 100 and rows_at_once == 1000:
            assert {frozenset(found[k]): w for k, w in weights.items()} == want


def test_bound_holds():
    r = np.random.default_rng(8)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 300, size=int(r.integers(1, 200))).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "xy")
        a, b = op.folded([op.bitmap(x), op.bitmap(y)])
        assert op.overlap(a, len(x), b[None], np.array([len(y)]))[0] >= len(np.intersect1d(x, y))


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (5, 5), (None, 3), (400, 401), (401, 400)]
    df = spark.createDataFrame([Row(a=a, b=b) for a, b in edges], "a long, b long")
    got = {r.node: r.component for r in components(df, Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 1), 100: 100, 200: 100, 300: 100, 400: 400, 401: 400}
    assert components(df.limit(0), Scratch(spark, "test")).collect() == []


def test_small_graphs_are_joined_in_one_task_and_alike_in_rounds(spark, monkeypatch):
    r = random.Random(7)
    edges = [(r.randint(-300, 300), r.randint(-300, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3), (9000, 9000)]
    df, scratch = spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")
    at_once = {r.node: r.component for r in components(df, scratch).collect()}
    assert not scratch.kept  # no rounds of tables
    monkeypatch.setattr(cc, "TOGETHER", 0)
    assert at_once == {r.node: r.component for r in components(df, scratch).collect()}
    assert at_once[1040] == 1000 and 9000 not in at_once
