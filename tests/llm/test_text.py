import random
import re

import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import textkit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(x):
    return re.sub("[A-Z]", lambda m: m.group().lower(), x)


@pytest.fixture(autouse=True)
def quiet():
    with np.errstate(over="ignore"):
        yield


def texts(n=400, seed=4):
    r = random.Random(seed)
    pieces = ["a", "B", "Cd", " ", "  ", "\n", "\t", "é", "日", ".", "the ", "The ", "x" * 30]
    return [None, "", " "] + ["".join(r.choices(pieces, k=r.randint(0, 60))) for _ in range(n)]


def test_words_are_counted():
    t = texts()
    assert textkit.count_words(pa.array(t)).tolist() == [len(WORD.findall(x or "")) for x in t]


@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_hashes_are_equal_just_where_words_are(limit, monkeypatch):
    t = texts()
    data, offsets = textkit.utf8(pa.array(t))
    seen = {}
    for lo, hi in textkit.chunks(offsets, limit):
        h, bounds = textkit.word_hashes(data, offsets, lo, hi)
        for i in range(hi - lo):
            words = WORD.findall(lower(t[lo + i] or ""))
            own = h[bounds[i] : bounds[i + 1]].tolist()
            assert len(own) == len(words)
            for w, x in zip(words, own):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_shingle_sets(n):
    t = texts()
    seen = {}
    for i, x in textkit.shingle_sets(pa.array(t), n):
        words = WORD.findall(lower(t[i] or ""))
        want = {tuple(words[j : j + n]) for j in range(max(1, len(words) - n + 1))} if words else set()
        assert len(x) == len(want) and (np.diff(x.astype(object)) > 0).all()
        seen.setdefault(frozenset(want), set()).add(tuple(x.tolist()))
    assert all(len(v) == 1 for v in seen.values())


def test_sliced_and_chunked_columns():
    t = pa.array(["a b", "c", None, "d e f"])
    assert textkit.count_words(t.slice(1, 3)).tolist() == [1, 0, 3]
    assert textkit.count_words(pa.chunked_array([t, t.slice(3)])).tolist() == [2, 1, 0, 3, 3]
    assert textkit.count_words(pa.array([], pa.string())).tolist() == []
