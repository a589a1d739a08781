import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from nearfield.llm import op2_pii as op2
from nearfield.llm import op10_language as op10
from nearfield.llm.op6_mix import fill
from nearfield.llm.queries import ORACLES, QUERIES
from tests.llm.test_documents import plain_finds
from tests.llm.test_jaccard import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "personal_data", "mix"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns and 0.7 * before < out.count() <= before, name
        docs, before = out, out.count()
    assert corpus_pipeline.run(spark, sf).columns == [*columns, "size", "source_size", "target", "taken"]


def test_run_equals_plain_stages(spark, sf):
    """The rows of run() from each stage's brute-force version, on whole documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    with np.errstate(over="ignore"):
        names, score, _ = op10.train(docs).predict(pa.array([r["text"] for r in rows]))
    rows = [r for r, n, x in zip(rows, names, score, strict=True) if n != "und" and x >= 0.5]
    groups = brute([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    assert any(c != i for i, (_, c) in groups.items())
    rows = [r for r in rows if groups[r["doc_id"]][1] == r["doc_id"]]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if r.text is not None]
    dirty = {i for i, _ in plain_finds([(r["doc_id"], r["text"]) for r in rows], bench)}
    rows, field = [r for r in rows if r["doc_id"] not in dirty], op2.trained()
    assert dirty
    for r in rows:
        base, added = op2.find(r["text"], field)
        assert base == op2.base_spans(r["text"])
        out, end = "", 0
        for kind, a, b in sorted(base + added, key=lambda x: (x[1], -x[2])):
            if a >= end:
                out += r["text"][end:a] + f"<{kind}>"
            end = max(end, b)
        r["text"] = out + r["text"][end:]
        r["n_chars"] = len(r["text"])
        r["size"] = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    sources = sorted({r["source"] for r in rows}, key=lambda x: (x is None, x or ""))
    sizes = {k: sum(r["size"] for r in rows if r["source"] == k) for k in sources}
    targets, want = dict(zip(sources, fill([sizes[k] for k in sources], 1.5, 2.0, (5, 2, 1)), strict=True)), []
    for k in sources:
        turns, start = int(targets[k] // sizes[k]), 0
        for r in sorted((r for r in rows if r["source"] == k), key=lambda r: (hashlib.md5(f"mix:{r['doc_id']}".encode()).hexdigest(), r["doc_id"])):
            taken = turns * r["size"] + max(0, min(r["size"], int(targets[k]) - turns * sizes[k] - start))
            start += r["size"]
            if taken:
                want.append((*r.values(), sizes[k], targets[k], taken))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(want)


def test_stages_bear_awkward_rows(spark, awkward, sf):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        assert docs.count() > 0
        if name != "mix":
            assert docs.columns == awkward.columns, name
    assert docs.columns == [*(c for c in awkward.columns if c != "size"), "size", "source_size", "target", "taken"]
    assert docs.where("doc_id is null").count() and dict(docs.dtypes)["size"] == "bigint"
    assert all(r.size == len(r.text.split()) for r in docs.collect())


def test_stages_bear_empty_tables(spark, nothing, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, sf).collect() == []


def test_mix_counts_rows_without_an_id(spark):
    rows = [(None, f"w{i} a b", "x") for i in range(40)] + [(7, f"v{i} c", "x") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.mix(spark, docs, None).collect()
    assert sum(r.taken for r in got) == 300 and len(got) == 80 and {r.source_size for r in got} == {200}


def test_texts_that_share_an_id_are_told_apart(spark, sf):
    text = lambda x: " ".join(f"{x}{i}" for i in range(60))
    near = lambda x: text(x) + " end"
    rows = [(1, text("a")), (2, near("a")), (2, text("b")), (3, near("b")), (4, text("c")), (4, text("d")), (4, text("c")), (5, text("e")), (5, near("e")), (6, ""), (6, None), (6, None), (7, text("f")), (None, text("a")), (None, text("a"))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    fives = [x.text for x in got if x.doc_id == 5]
    assert len(fives) == 1 and fives[0] in (text("e"), near("e"))
    want = [(1, text("a")), (2, text("b")), (4, text("c")), (4, text("d")), (6, ""), (6, None), (7, text("f")), (None, text("a")), (None, text("a"))]
    assert sorted(((x.doc_id, x.text) for x in got if x.doc_id != 5), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0
    assert name.startswith("op") and (name not in ORACLES or ORACLES[name].strip())
