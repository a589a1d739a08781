import importlib.util

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield import api
from nearfield.functions.predicates import Predicate as P
from nearfield.operators import postings
from nearfield.operators.layered import DELTA
from nearfield.sources import hdf5, vecs
from nearfield.sources.store import Store
from nearfield.sources.workdir import fresh
from nearfield.streaming.feed import feed
from tests.test_search import cloud, truth


def ids(spark, values):
    return spark.createDataFrame([(int(v),) for v in values], "vec_id long")


def test_layers(spark):
    x, more, q = cloud(120, 8), cloud(30, 8, 1), cloud(4, 8, 2)
    index = api.LayeredIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x, [[i % 4] for i in range(120)]), delta_threshold=50)
    assert index.add(api.vectors(spark, more, [[9]] * 30)) == (DELTA, DELTA + 30)
    both = np.concatenate([x, more])
    name = lambda i: i if i < 120 else DELTA + i - 120
    want = [[(name(i), d) for i, d in r] for r in truth(both, q, 6)]
    assert api.search_batch(index, q.tolist(), 6) == want
    gone = [want[0][0][0], want[1][0][0], 10**9]
    index.delete(ids(spark, gone))
    index.delete(ids(spark, gone))
    keep = np.array([name(i) not in gone for i in range(150)])
    assert api.search_batch(index, q.tolist(), 6) == [[(name(i), d) for i, d in r] for r in truth(both, q, 6, keep=keep)]
    assert index.stats() == {"base": 120, "delta": 30, "tombstones": 3, "live": 147, "dim": 8}
    assert index.is_deleted(gone[0]) and index.get_vector(gone[0]) is not None and index.get_vector(999_999) is None
    assert not index.should_compact()
    assert {i for r in api.search_batch(index, q.tolist(), 5, predicate=P.eq(0, 9)) for i, _ in r} <= {DELTA + i for i in range(30)}
    again = api.LayeredIndex.from_bytes(spark, index.to_bytes(), fresh(spark, "t"))
    assert again.has_labels and not again.has_quantizer and again.base().count() == 120
    assert again.search_filtered(api.queries(spark, q.tolist()), P.eq(0, 9), 3).count() == 12
    assert api.search_batch(again, q.tolist(), 6) == api.search_batch(index, q.tolist(), 6)
    small = again.compact(fresh(spark, "t"))
    live = np.flatnonzero(keep)
    assert api.search_batch(small, q.tolist(), 6) == truth(both[live], q, 6) and small.stats()["tombstones"] == 0
    assert [r.labels for r in small.rows().orderBy("vec_id").collect()] == [[9] if i >= 120 else [i % 4] for i in live]
    for bad in (api.vectors(spark, [[1.0]]), api.vectors(spark, cloud(1, 8), [[1, 2]])):
        with pytest.raises(ValueError):
            index.add(bad)
    small.delete(ids(spark, range(len(live))))
    assert api.search(small, q[0].tolist()) == [] and small.should_compact()
    with pytest.raises(ValueError):
        small.compact(fresh(spark, "t"))


def test_layers_with_a_quantizer(spark):
    x, q = cloud(100, 8), cloud(3, 8, 2)
    index = api.LayeredIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x), quantizer="int8", rerank_size=100)
    index.add(api.vectors(spark, cloud(5, 8, 7)))
    assert api.search_batch(index, q.tolist(), 5) == [[(i if i < 100 else DELTA + i - 100, d) for i, d in r] for r in truth(np.concatenate([x, cloud(5, 8, 7)]), q, 5)]
    empty = api.LayeredIndex.new_empty(spark, fresh(spark, "t"), 8)
    assert api.search(empty, q[0].tolist()) == []
    empty.add(api.vectors(spark, x[:3], [[1], [2], [3]]))
    assert [i for i, _ in api.search(empty, q[0].tolist(), predicate=P.eq(0, 2))] == [DELTA + 1]


def test_postings(spark):
    x, q = cloud(700, 16, 3, centres=25), cloud(10, 16, 4, centres=25)
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x), max_posting_size=48)
    assert api.search_batch(index, q.tolist(), 10, n_probe=10_000) == truth(x, q, 10)
    share = lambda n: np.mean([len({i for i, _ in a} & {i for i, _ in b}) / 10 for a, b in zip(api.search_batch(index, q.tolist(), 10, n_probe=n), truth(x, q, 10))])
    assert share(4) >= 0.8 and share(16) >= 0.95
    s = index.stats()
    assert s["live"] == 700 and s["max_posting"] < 48 and index.in_nearest() == 1
    more = cloud(90, 16, 8, centres=25)
    assert index.insert(api.vectors(spark, more)) == (700, 790)
    both = np.concatenate([x, more])
    assert api.search_batch(index, q.tolist(), 5, n_probe=10_000) == truth(both, q, 5) and index.stats()["max_posting"] < 48
    dead = list(range(0, 790, 3))
    index.delete(ids(spark, [*dead, 10**9]))
    keep = ~np.isin(np.arange(790), dead)
    for _ in range(2):
        assert api.search_batch(index, q.tolist(), 5, n_probe=10_000) == truth(both, q, 5, keep=keep)
        index.gc()
    assert index.stats()["deleted"] == len(dead) and index.get_vector(0) is None and index.is_deleted(0) and index.get_vector(1) is not None
    index.compact()
    target = fresh(spark, "t")
    assert {x.split("/")[0] for x in index.snapshot(target)} == {"postings", "centroids", "deleted"} and index.snapshot(target) == []
    back = api.PostingIndex.restore(spark, target, fresh(spark, "t"))
    assert api.search_batch(back, q.tolist(), 5, n_probe=4) == api.search_batch(index, q.tolist(), 5, n_probe=4)
    with pytest.raises(ValueError):
        api.PostingIndex.open(spark, target, "dot")
    with pytest.raises(ValueError):
        index.insert(api.vectors(spark, [[1.0]]))


def test_inserts_are_local(spark, monkeypatch):
    """An insert reads and writes the parts that its rows and splits touch; rows sit in their nearest postings as before."""
    monkeypatch.setattr(postings, "PART_ROWS", 40)
    x, q = cloud(900, 8, 3, centres=40), cloud(6, 8, 4, centres=40)
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x), max_posting_size=32, quantizer="sign")
    before = dict(index.store.tables["postings"])
    more = np.repeat(x[:1], 3, axis=0) + 0.001
    assert len(before) > 10 and index.insert(api.vectors(spark, more.tolist())) == (900, 903)
    after = index.store.tables["postings"]
    assert 1 <= sum(after[p] != before.get(p) for p in after) < len(before) / 2
    crowd = (x[5] + np.random.default_rng(0).normal(0, 0.01, (100, 8))).astype(np.float32)
    index.insert(api.vectors(spark, crowd.tolist()))
    both = np.concatenate([x, more.astype(np.float32), crowd])
    assert index.stats() == {"live": 1003, "deleted": 0, "postings": index.stats()["postings"], "max_posting": index.stats()["max_posting"], "dim": 8}
    assert index.stats()["max_posting"] < 32 and index.in_nearest() > 0.95
    assert api.search_batch(index, q.tolist(), 10, n_probe=10_000) == truth(both, q, 10)
    index.reassign_neighbors()
    assert index.in_nearest() == 1 and index.reassign_neighbors() == 0
    again = api.PostingIndex.open(spark, index.store.path)
    assert api.search_batch(again, q.tolist(), 10, n_probe=10_000) == truth(both, q, 10)
    assert {r.posting_id: r.n for r in again.store.read("centroids").collect()} == {r.posting_id: r["count"] for r in again.store.read("postings").groupBy("posting_id").count().collect()}
    saved = fresh(spark, "t")
    index.save(saved)
    assert api.search_batch(api.PostingIndex.open(spark, saved), q.tolist(), 10, n_probe=4) == api.search_batch(index, q.tolist(), 10, n_probe=4)


def test_no_seed_is_drawn_for_too_many_centroids(spark, monkeypatch):
    monkeypatch.setattr(postings, "CENTROID_BYTES", 1000)
    with pytest.raises(ValueError, match="max_posting_size"):
        api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, cloud(300, 8)), max_posting_size=8)


@pytest.mark.parametrize("by", ["l2", "euclidean", "cosine"])
def test_sign_codes_of_residuals(spark, by):
    x, q = cloud(500, 32, 3, centres=25), cloud(8, 32, 4, centres=25)
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x), by=by, max_posting_size=64, quantizer="sign")
    got = api.search_batch(index, q.tolist(), 10, n_probe=10_000, **({"rerank": 400} if by == "cosine" else {}))
    want = truth(x, q, 10, by)
    assert np.mean([len({i for i, _ in a} & {i for i, _ in b}) / 10 for a, b in zip(got, want)]) >= 0.95
    exact = [dict(r) for r in truth(x, q, 500, by)]
    assert all(d == exact[i][v] for i, r in enumerate(got) for v, d in r)


@pytest.mark.parametrize(("kind", "floor"), [("f16", 0.95), ("int8", 0.9), ("sign", 0.9), ("pq", 0.5)])
def test_coded_postings(spark, kind, floor):
    x, q = cloud(500, 32, 3, centres=25), cloud(8, 32, 4, centres=25)
    options = {"parts": 8, "centres": 32} if kind == "pq" else {}
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x), max_posting_size=64, quantizer=kind, rerank_size=64, **options)
    got, want = api.search_batch(index, q.tolist(), 10, n_probe=16), [dict(r) for r in truth(x, q, 500)]
    assert np.mean([len({i for i, _ in a} & set(list(b)[:10])) / 10 for a, b in zip(got, want)]) >= floor
    assert all(d == want[i][v] for i, r in enumerate(got) for v, d in r)


def test_equal_vectors_stay_below_the_limit(spark):
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, [[1.0, 2.0]] * 90), max_posting_size=32)
    assert index.stats()["max_posting"] < 32 and [i for i, _ in api.search(index, [1.0, 2.0], 3, n_probe=100)] == [0, 1, 2]


def test_compressed(spark):
    x, q = cloud(150, 16), cloud(3, 16, 2)
    index = api.CompressedIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x, [[i % 2] for i in range(150)]), quantizer="f16")
    again = api.CompressedIndex.open(spark, index.store.path)
    assert api.search_batch(index, q.tolist(), 5) == api.search_batch(again, q.tolist(), 5)
    assert api.search_batch(again, q.tolist(), 5, rerank=150, predicate=P.eq(0, 1)) == truth(x, q, 5, keep=np.arange(150) % 2 == 1)


def test_stores(spark):
    path = fresh(spark, "t")
    one, two = Store(spark, path), Store(spark, path)
    one.write("a", spark.range(3))
    two.write("a", spark.range(4))
    one.publish(x=1)
    with pytest.raises(Exception, match="exist"):
        two.publish(x=2)
    blob = Store(spark, path).open().pack()
    back = Store.unpack(spark, blob, fresh(spark, "t"))
    assert back.meta == {"x": 1} and back.read("a").count() == 3
    back.write("a", spark.range(5))
    back.write_parts("b", spark.range(10), F.col("id") % 3)
    back.publish()
    assert back.read("b", {1}).count() == 3 and back.read("b").count() == 10 and back.read("b").columns == ["id"]
    back.write_parts("b", spark.range(100, 102), F.lit(1), {1})
    back.append("b", spark.range(200, 201))
    assert sorted(r.id for r in back.read("b").collect()) == [0, 2, 3, 5, 6, 8, 9, 100, 101, 200]
    target = fresh(spark, "t")
    back.publish()
    assert back.snapshot(target) == ["a", "b/part=0", "b/part=1", "b/part=2", "b/part=3"]
    back.write_parts("b", spark.range(300, 301), F.lit(2), {2})
    assert back.snapshot(target) == ["b/part=2"] and Store(spark, target).open().read("b").count() == back.read("b").count() == 8
    back.publish()
    assert "a/v=1" in back.vacuum() and Store(spark, back.path).open().read("b").count() == 8 and back.vacuum() == []
    blob = back.pack()
    assert sorted(Store.unpack(spark, blob, fresh(spark, "t")).read("b").collect()) == sorted(back.read("b").collect())
    back.discard("a")
    with pytest.raises(ValueError):
        Store(spark, back.path).open()
    for bad in (b"", b"garbage", blob[: len(blob) // 2]):
        with pytest.raises((ValueError, FileNotFoundError)):
            Store.unpack(spark, bad, fresh(spark, "t"))
    with pytest.raises(FileNotFoundError):
        Store(spark, fresh(spark, "t")).open()


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs"])
def test_vector_files(spark, kind):
    rows = [[1, 2, 3], [], [4], [255, 0]]
    assert [v.tolist() for v in vecs.parse(vecs.dump(rows, kind), kind)] == rows and vecs.parse(b"", kind) == []
    for cut in (1, 5):
        with pytest.raises(ValueError):
            vecs.parse(vecs.dump(rows, kind)[:-cut] if kind == "bvecs" or cut > 1 else vecs.dump(rows, kind)[:-cut], kind)
    path = fresh(spark, "t")
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    vecs.write(df, path, kind, files=2)
    back = vecs.read(spark, path, kind).orderBy("vec_id").collect()
    assert [(r.vec_id, list(r.embedding)) for r in back] == list(enumerate(rows))
    assert vecs.read(spark, path, kind, first=1).count() <= 2
    with pytest.raises(FileExistsError):
        vecs.write(df, path, kind)


@pytest.mark.parametrize("prefix", [16 << 20, 0])
def test_vector_files_in_blocks(spark, monkeypatch, prefix):
    monkeypatch.setattr(vecs, "PREFIX", prefix)
    x, path = cloud(50, 6), fresh(spark, "t")
    vecs.write(api.vectors(spark, x), path, "fvecs", files=3)
    got = vecs.read_blocks(spark, path, "fvecs", 6).orderBy("vec_id").collect()
    assert [r.vec_id for r in got] == list(range(50)) and (np.array([r.embedding for r in got], dtype=np.float32) == x).all()
    assert sorted(r.vec_id for r in vecs.read_blocks(spark, path, "fvecs", 6, first=23).collect()) == list(range(23))
    with pytest.raises(ValueError):
        vecs.read_blocks(spark, path, "fvecs", 7)
    with pytest.raises(Exception, match="dimensions"):
        vecs.read_blocks(spark, path, "bvecs", 24).collect()


def test_hdf5(spark, tmp_path, monkeypatch):
    """Ranges of rows reach the tasks; without the library the error says so."""
    if importlib.util.find_spec("h5py") is None:
        with pytest.raises(ImportError, match="h5py"):
            hdf5.read(spark, f"file://{tmp_path}/x.hdf5")
    (tmp_path / "h5py.py").write_text(
        "import io, numpy as np\n"
        "class File(dict):\n"
        "    def __init__(self, raw, mode):\n"
        "        super().__init__(np.load(io.BytesIO(raw.read())))\n"
        "    def __enter__(self): return self\n"
        "    def __exit__(self, *x): pass\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    x = cloud(25, 3)
    with open(tmp_path / "x.hdf5", "wb") as f:
        np.savez(f, train=x, flat=x[0])
    monkeypatch.setattr(hdf5, "ROWS", 10)
    got = {}
    for lo in range(3):  # as a task does
        for b in hdf5._rows(iter([pa.RecordBatch.from_arrays([pa.array([lo])], names=["id"])]), f"file://{tmp_path}/x.hdf5", "train", 25, pa.float32()):
            got |= {r["vec_id"]: r["embedding"] for r in b.to_pylist()}
    assert sorted(got) == list(range(25)) and all(np.array(got[i], dtype=np.float32).tolist() == x[i].tolist() for i in got)
    for bad in ("test", "flat"):
        with pytest.raises(ValueError):
            hdf5.read(spark, f"file://{tmp_path}/x.hdf5", bad)


def test_stream(spark, tmp_path):
    x = cloud(20, 4)
    index = api.LayeredIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x))
    schema = "op string, vec_id long, embedding array<float>"
    spark.createDataFrame([("add", None, [1.0] * 4), ("delete", 3, None), ("add", None, [2.0] * 4)], schema).write.parquet(str(tmp_path / "in"))
    feed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), index, str(tmp_path / "ck")).awaitTermination()
    assert index.stats() == {"base": 20, "delta": 2, "tombstones": 1, "live": 21, "dim": 4} and index.store.meta["batch"] == 0
    assert index.store.number == 2  # one version for the build, one for the batch
    feed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), index, str(tmp_path / "ck2")).awaitTermination()
    assert index.stats()["delta"] == 2


def test_sign_codes_of_all_postings_list_no_pairs(spark, monkeypatch):
    """Neither postings by query nor candidates by query are listed where every query probes every posting."""
    x, q = cloud(300, 16, 3), cloud(40, 16, 4)
    index = api.PostingIndex.build(spark, fresh(spark, "t"), api.vectors(spark, x), max_posting_size=32, quantizer="sign")

    def none(*_, **__):
        raise AssertionError("pairs are listed")

    monkeypatch.setattr(postings.PostingIndex, "probes", none)
    monkeypatch.setattr(postings, "rescored", none)
    assert api.search_batch(index, q.tolist(), 10, n_probe=10_000) == truth(x, q, 10)
