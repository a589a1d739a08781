"""Benchmark decontamination: a BM25 inverted index of test items with block-max WAND, then question and answer overlap.

The test items are indexed: for each term the list of its items with their BM25 impacts, items in the order of their scores against
themselves, and over each list a shorter one of blocks of BLOCK neighbouring items with the largest impact in each. Every passage of
every text is a query, and all items at or above their threshold, a share of the item's score against itself, are retrieved. A
passage's terms are put in the order of their largest impacts; those before the pivot, where the sum of the impacts reaches the
smallest threshold, can't lift an item to it by themselves, so their lists (the longest) aren't walked. The block lists of the others are
walked, for many passages at once: blocks whose bound, the sum of block maxima and of the impacts before the pivot, stays below
what their easiest item needs are skipped, and only in the blocks left all terms' lists are entered, by binary search, and their items scored exactly.

Retrieved items are verified: word 3-grams of the item's question and of its answer have to be in the passage (a part of one or
two words is looked for as it is, and an item of less than SHORT words with such a part has to be there whole). Passages are 2 * stride words,
a stride apart, where a stride is no shorter than the longest item, so an item's copy always lies whole in one.

Counts of items and of a term's items, the mean and the longest item are those of the whole benchmark. An index beyond POSTINGS
entries is met in parts, each broadcast and met by a scan of its own; scores, and so results, don't depend on the parts. Texts aren't shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textkit import chunks, shingle_hashes, utf8, word_hashes

#: Entries of one index (some 40 bytes each; an item of more is one of its own); items of a block; words of the shortest stride.
POSTINGS, BLOCK, STRIDE = 1 << 21, 8, 64
#: Cells of passages by blocks, and entries of lists, that are held at once.
CELLS, ENTRIES = 1 << 22, 1 << 20
K1, B = 1.2, 0.75
#: What rounding may take from a score.
SLACK = 1e-9
#: Share of an item's own score from which it is verified; overlaps asked for; words below which an item must be there whole.
SHARE, QUESTION, ANSWER, SHORT = 0.55, 0.5, 0.5, 8
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence, or the last quarter of the words where that leaves either less than three."""
    parts = [x for x in _SENTENCE.split(text.strip()) if re.search(r"\w", x)]
    if len(parts) > 1 and len(parts[-1].split()) >= 3 and len(" ".join(parts[:-1]).split()) >= 3:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    cut = len(words) - max(min(3, len(words)), len(words) // 4)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _hashes(text: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _words_of(text)


def _words_of(text: str) -> np.ndarray:
    data, offsets = utf8(pa.array([text]))
    return word_hashes(data, offsets, 0, 1, letters=True)[0]


def grams(words: np.ndarray, n: int = 3) -> np.ndarray:
    """Distinct n-grams, or the whole sequence of fewer words."""
    return np.unique(shingle_hashes(words, np.array([0, len(words)]), n)[0])


class Statistics(NamedTuple):
    """Of the items with a word: how many, words of the mean and of the longest, and the items of each term in more than one (sorted hashes)."""

    count: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray

    def items_of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.ones(len(terms), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.df[at], 1)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, items, words, longest) of batches of texts: a row for each term, and one without a term for the batch."""
    with np.errstate(over="ignore"):
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in chunks(offsets):
                words, bounds = word_hashes(data, offsets, lo, hi, letters=True)
                sizes = np.diff(bounds)
                each = [np.unique(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                terms, df = np.unique(np.concatenate(each), return_counts=True)
                none = pa.nulls(len(terms), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df, pa.int64()), none, none], names=["term", "items", "words", "longest"])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ([None], [int((sizes > 0).sum())], [len(words)], [int(sizes.max())])], names=["term", "items", "words", "longest"])


def statistics(rows: DataFrame) -> Statistics:
    """Of all rows (item_id, text), counted where they are; the driver gets 16 bytes for each term of more than one item."""
    counted = rows.select("text").mapInArrow(_counted, "term long, items long, words long, longest long")
    counted = counted.groupBy("term").agg(F.sum("items").alias("items"), F.sum("words").alias("words"), F.max("longest").alias("longest"))
    found = counted.where("term is null or items > 1").toArrow()
    whole = pc.is_null(found["term"])
    (total,) = found.filter(whole).to_pylist() or [{"items": 0, "words": 0, "longest": 0}]
    shared = found.filter(pc.invert(whole))
    terms, df = shared["term"].to_numpy().view(np.uint64), shared["items"].to_numpy()
    order = np.argsort(terms)
    return Statistics(total["items"], total["words"] / max(1, total["items"]), total["longest"], terms[order], df[order])


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... of each range in turn."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def _cuts(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Where parts of about ENTRIES begin and end."""
    first = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // ENTRIES, prepend=-1)).tolist() if len(sizes) else []
    return list(zip(first, [*first[1:], len(sizes)], strict=False))


class Index:
    """The lists of some items; without statistics of the whole they are the whole."""

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        with np.errstate(over="ignore"):
            coded = [(k, _hashes(text), *(_hashes(x) for x in split_item(text))) for k, text in items]
        coded = [x for x in coded if len(x[1])]
        lengths = np.array([len(x[1]) for x in coded], dtype=np.float64)
        bags = [np.unique(x[1], return_counts=True) for x in coded]
        self.terms, df = np.unique(np.concatenate([x[0] for x in bags] or [np.empty(0, np.uint64)]), return_counts=True)
        whole = whole or Statistics(len(coded), float(lengths.mean()) if len(coded) else 1.0, int(lengths.max(initial=0)), self.terms, df)
        df = whole.items_of(self.terms)
        idf = np.log(1 + (whole.count - df + 0.5) / (df + 0.5))
        term = [np.searchsorted(self.terms, own) for own, _ in bags]
        impact = [idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / whole.mean)) for at, (_, tf), n in zip(term, bags, lengths, strict=True)]
        own = [math.fsum(x) for x in impact]
        order = sorted(range(len(coded)), key=lambda i: (own[i], coded[i][0]))
        self.ids = [coded[i][0] for i in order]
        self.own = np.array([own[i] for i in order])
        self.parts = [(self._parts(*coded[i][1:]), len(coded[i][1])) for i in order]
        self.stride = max(STRIDE, whole.longest)
        # entries in the order of term, then item
        flat = np.concatenate([term[i] for i in order] or [np.empty(0, np.int64)]) * len(order) + np.repeat(np.arange(len(order)), [len(term[i]) for i in order])
        by_list = np.argsort(flat, kind="stable")
        self.entry, self.impact = flat[by_list], np.concatenate([impact[i] for i in order] or [np.empty(0)])[by_list]
        # and over them the blocks with their largest impacts
        self.blocks = -(-len(order) // BLOCK)
        list_of, item = self.entry // max(1, len(order)), self.entry % max(1, len(order))
        block = list_of * self.blocks + item // BLOCK
        first = np.flatnonzero(np.diff(block, prepend=-1))
        self.block, self.block_most = block[first] % max(1, self.blocks), np.maximum.reduceat(self.impact, first) if len(first) else np.empty(0)
        self.list_at = np.searchsorted(block[first], np.arange(len(self.terms) + 1) * self.blocks)
        self.most = np.maximum.reduceat(self.block_most, self.list_at[:-1]) if len(self.terms) else np.empty(0)
        self.need = SHARE * self.own[::BLOCK] - SLACK

    @staticmethod
    def _parts(words: np.ndarray, question: np.ndarray, answer: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """(grams, their words) of the question and the answer, and of the whole of a short item with a part of one or two words."""
        parts = [(grams(x), min(3, len(x))) for x in (question, answer)]
        if len(words) < SHORT and any(0 < n < 3 for _, n in parts):
            parts.append((grams(words), min(3, len(words))))
        return parts

    def search(self, column: pa.Array) -> Iterator[tuple[int, int, float, float, float, float]]:
        """(row, item, score, share of the item's own, question overlap, answer overlap) of each contaminated text and item, from its best passage."""
        if not self.ids:
            return
        data, offsets = utf8(column)
        for lo, hi in chunks(offsets):
            words, bounds = word_hashes(data, offsets, lo, hi, letters=True)
            if len(words):
                yield from self._search(words, bounds, lo)

    def _search(self, words: np.ndarray, bounds: np.ndarray, lo_text: int) -> Iterator[tuple[int, int, float, float, float, float]]:
        sizes = np.diff(bounds)
        cells = -(-sizes // self.stride)
        first = np.concatenate([[0], np.cumsum(cells)])  # a text's first cell
        term = np.searchsorted(self.terms, words)
        term[term == len(self.terms)] = 0
        hit = np.flatnonzero(self.terms[term] == words)
        text = np.searchsorted(bounds, hit, side="right") - 1
        place = (hit - bounds[text]) // self.stride
        cell = first[text] + place
        # passage j of a text is its cells j and j + 1; numbered by the first cell, the last cell alone is no passage unless it is the only one
        one = np.where((place < cells[text] - 1) | (cells[text] == 1), cell, -1)
        two = np.where(place > 0, cell - 1, -1)
        n = len(self.terms)
        keys = np.concatenate([(one * n + term[hit])[one >= 0], (two * n + term[hit])[two >= 0]])
        keys = np.unique(keys)
        if not len(keys):
            return
        passage, t = keys // n, keys % n
        starts = np.flatnonzero(np.diff(passage, prepend=-1))
        ends = np.append(starts[1:], len(keys))
        best: dict[tuple[int, int], tuple[float, float, float, float]] = {}
        step = max(1, CELLS // self.blocks)
        for s in range(0, len(starts), step):
            lo, hi = starts[s], ends[min(s + step, len(starts)) - 1]
            row = np.repeat(np.arange(min(step, len(starts) - s)), ends[s : s + step] - starts[s : s + step])
            for r, block in self._blocks(row, t[lo:hi]):
                a, b = starts[s + r], ends[s + r]
                for i, item, score in self._scores(a, b, block, t):
                    self._verify(words, bounds, first, int(passage[a[i]]), int(item), float(score), best)
        for (row, item), found in sorted(best.items()):
            yield lo_text + row, self.ids[item], *found

    def _blocks(self, row: np.ndarray, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(passages, blocks) that may hold an item, for passages 0, 1, ... (row) of terms t, in parts."""
        passages, upper = int(row[-1]) + 1, self.most[t]
        order = np.lexsort((upper, row))
        sums = np.cumsum(upper[order])
        begin = np.flatnonzero(np.diff(row, prepend=-1))
        sums -= np.repeat(np.concatenate([[0], sums[begin[1:] - 1]]), np.diff(np.append(begin, len(row))))
        walked = np.empty(len(row), dtype=bool)
        walked[order] = sums >= self.need[0]  # from the pivot on
        low = np.bincount(row, np.where(walked, 0, upper), minlength=passages)  # what the others may add
        row_of, row, t = row, row[walked], t[walked]
        count = self.list_at[t + 1] - self.list_at[t]
        bound = np.zeros(passages * self.blocks)
        for a, b in _cuts(count):
            at = _ranges(self.list_at[t[a:b]], count[a:b])
            cell = np.repeat(row[a:b], count[a:b]) * self.blocks + self.block[at]
            from_, to = int(cell[0]) // self.blocks * self.blocks, (int(row[b - 1]) + 1) * self.blocks
            bound[from_:to] += np.bincount(cell - from_, self.block_most[at], minlength=to - from_)
        bound = bound.reshape(passages, self.blocks)
        r, block = np.nonzero((bound + low[:, None] >= self.need) & (bound > 0))
        size = np.bincount(row_of, minlength=passages)[r]
        for a, b in _cuts(size):
            yield r[a:b], block[a:b]

    def _scores(self, a: np.ndarray, b: np.ndarray, block: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(which, item, score) of the items that reach their threshold in block[i] for the terms t[a[i]:b[i]]. Impacts add up in the order of the terms."""
        which, term = np.repeat(np.arange(len(a)), b - a), t[_ranges(a, b - a)]
        low = term * len(self.ids) + block[which] * BLOCK
        start = np.searchsorted(self.entry, low)
        count = np.searchsorted(self.entry, np.minimum(low + BLOCK, (term + 1) * len(self.ids))) - start
        at = _ranges(start, count)
        cell = np.repeat(which, count) * BLOCK + self.entry[at] % len(self.ids) % BLOCK
        score = np.bincount(cell, self.impact[at], minlength=len(a) * BLOCK)
        item = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
        there = np.flatnonzero((item < len(self.ids)) & (score > 0))
        there = there[score[there] >= SHARE * self.own[item[there]] - SLACK]
        return zip(there // BLOCK, item[there], score[there], strict=True)

    def _verify(self, words: np.ndarray, bounds: np.ndarray, first: np.ndarray, passage: int, item: int, score: float, best: dict) -> None:
        row = int(np.searchsorted(first, passage, side="right")) - 1
        start = bounds[row] + (passage - first[row]) * self.stride
        span = words[start : min(start + 2 * self.stride, bounds[row + 1])]
        parts, size = self.parts[item]
        there = {n: grams(span, n) for n in {n for _, n in parts if n}}
        q, a, *whole = (float(np.isin(x, there[n]).mean()) if n else 1.0 for x, n in parts)
        good = q == 1 == a and whole in ([], [1]) if size < SHORT else q >= QUESTION and a >= ANSWER
        if good:
            found = (score, score / float(self.own[item]), q, a)
            best[row, item] = max(found, best.get((row, item), found), key=lambda x: (x[2] + x[3], x[0]))


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The index in parts of at most POSTINGS entries; the driver holds one part's texts at a time."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    whole = statistics(rows)
    held, room = [], POSTINGS
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        size = len(_hashes(r.text))
        if held and size > room:
            yield Index(held, whole)
            held, room = [], POSTINGS
        held.append((r.item_id, r.text))
        room -= size
    if held:
        yield Index(held, whole)


def _find(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        for batch in batches:
            found = list(index.value.search(batch.column(1)))
            if found:
                rows, items, *figures = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(items, pa.int64()), *(pa.array(x, pa.float64()) for x in figures)], names=["doc_id", "item_id", "score", "share", "question_overlap", "answer_overlap"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, share, question_overlap, answer_overlap) for every row of docs and every test item in it.

    Overlaps are shares of the question's and the answer's word 3-grams found in the best passage (of a part of one or two words,
    1 if it is there and else 0); of passages that tie in both overlaps the one of the larger score counts. Whole texts are read, however long. Rows of docs without a
    find, null and empty texts among them, aren't returned; null ids and repeated rows of docs are kept as they are. Items
    with a null id or no word are found nowhere; repeated items give equal rows. An empty table on either side gives an empty one.
    Other columns are passed over.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema, out = "doc_id long, item_id long, score double, share double, question_overlap double, answer_overlap double", None
    for index in indexes(benchmark):
        found = rows.mapInArrow(partial(_find, index=spark.sparkContext.broadcast(index)), schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs in which no test item is found, with all their columns and repeats, null and empty texts among them."""

    def keep(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                dirty = {x[0] for x in index.value.search(batch.column(batch.schema.get_field_index(text_col)))}
                yield batch.filter(pa.array([i not in dirty for i in range(len(batch))], pa.bool_()))

    small_batches(docs.sparkSession)
    for index in indexes(benchmark):
        docs = docs.mapInArrow(partial(keep, index=docs.sparkSession.sparkContext.broadcast(index)), docs.schema)
    return docs
