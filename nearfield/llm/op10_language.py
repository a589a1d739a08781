"""Language identification by prediction by partial matching.

Each language has a byte context tree of variable order, up to ORDER. A symbol that a context has seen costs its share
of the context's counts; any other costs the escape (method C: distinct symbols over total plus distinct) and then its share
in the context that is shorter by a symbol, where the symbols already seen are excluded and the shares of the others, escapes of that
context included, are brought to sum 1 again. Statistics are frozen after training, so every
node's full distribution is worked out once, as whole numbers of 1/4096 bit, and a text's code length under a language is
an exact sum of table entries. The language of the shortest code wins.

Symbols are bytes: ASCII letters in lower case, any other ASCII byte as a space, Latin capitals of two bytes in lower case,
bytes that training never saw as one more symbol. All trees share one alphabet; each is kept over its own language's symbols and one
that stands for any of the others, which are equally likely there, so a tree's size depends on its own language alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textkit import capitals, chunks, utf8

#: Longest context, in symbols.
ORDER = 3
#: Training sample of each language: documents, bytes of all, and bytes of one, from its start.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_ONE = 600, 1 << 20, 1 << 16
#: Parts of a bit in which costs are kept.
PARTS = 4096
UNKNOWN = "und"

_ASCII = np.full(256, 32, dtype=np.uint8)
_ASCII[97:123] = np.arange(97, 123)
_ASCII[65:91] = np.arange(97, 123)
_ASCII[128:] = np.arange(128, 256)
_LETTER = (_ASCII > 96) & (_ASCII < 123)


def folded(b: np.ndarray) -> np.ndarray:
    """Bytes with letters in lower case and other ASCII as spaces."""
    out = _ASCII[b]
    if len(b) > 1:
        out[1:][capitals(out)] += 0x20
    return out


class Model:
    """Context trees of all languages over one alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        coded = {k: [folded(np.frombuffer(x.encode(), np.uint8)) for x in v] for k, v in texts.items()}
        seen = np.zeros(256, dtype=bool)
        seen[32] = True
        for v in coded.values():
            for x in v:
                seen[x] = True
        self.alphabet = int(seen.sum()) + 1
        self.trees = [self._tree(coded[k]) for k in self.languages]

    def _tree(self, texts: list[np.ndarray]) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """(symbol of each byte, symbols, node of each run of ORDER symbols, cost of each symbol after each node). Symbol 0 is the space, the last any other."""
        own = np.zeros(256, dtype=bool)
        own[32] = True
        for t in texts:
            own[t] = True
        order = [32, *(c for c in np.flatnonzero(own).tolist() if c != 32)]
        s = len(order) + 1
        symbol = np.full(256, s - 1, dtype=np.int32)
        symbol[order] = np.arange(s - 1)
        times = np.ones(s)  # symbols of the alphabet that each stands for
        times[-1] = self.alphabet - (s - 1)
        texts = [symbol[t] for t in texts]
        pad = np.zeros(ORDER, dtype=np.int64)
        x = np.concatenate([y for t in texts for y in (pad, t)] or [pad]).astype(np.int64)
        code = np.zeros(max(0, len(x) - ORDER), dtype=np.int64)
        for j in range(ORDER + 1):
            code = code * s + x[j : j + len(code)]
        inside = np.concatenate([y for t in texts for y in (np.zeros(ORDER, dtype=bool), np.ones(len(t), dtype=bool))] or [np.zeros(ORDER, dtype=bool)])
        grams, counts = np.unique(code[inside[ORDER:]], return_counts=True)  # the spaces before a text are contexts, not symbols
        chance, at = np.full((1, s), 1 / self.alphabet), np.zeros(1, dtype=np.int64)  # the level below order 0 is uniform
        rows, node, base = [], np.zeros(1, dtype=np.int32), 0
        for k in range(ORDER + 1):
            context, last = (grams % s ** (k + 1)) // s, grams % s
            known, back = np.unique(context, return_inverse=True)
            if not k:
                known, back = np.zeros(1, dtype=np.int64), np.zeros(len(grams), dtype=np.int64)
            n = np.zeros((len(known), s))
            np.add.at(n, (back, last), counts)
            parent = chance[at[known % s ** (k - 1)]] if k else np.repeat(chance, len(known), axis=0)
            total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
            rest = np.where(n > 0, 0, parent)
            left = (rest * times).sum(axis=1, keepdims=True)  # the last symbol is never seen, so something is
            here = n / np.maximum(total + kinds, 1) + np.where(kinds == 0, 1.0, kinds / np.maximum(total + kinds, 1)) * rest / left
            chance = here if not k else np.concatenate([chance, here])
            wide = np.tile(node, s) if k else node  # a context not known stands for its longest known ending
            ids = np.arange(base, base + len(known))
            wide = wide.copy()
            wide[known] = ids
            node, base = wide.astype(np.int32), base + len(known)
            at = node.astype(np.int64)
            rows.append(here)
        cost = np.rint(-np.log2(np.concatenate(rows)) * PARTS).astype(np.int32)
        return symbol, s, node, cost.ravel()

    def lengths(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Code lengths of texts lo to hi (rows) under the languages (columns), in 1/PARTS bit."""
        sizes = np.diff(offsets[lo : hi + 1])
        out = np.zeros((hi - lo, len(self.trees)), dtype=np.int64)
        if not sizes.sum():
            return out
        # ORDER spaces go before each text, so that contexts are plain shifts; places are those of the symbols after them
        start = np.cumsum(sizes) - sizes + ORDER * np.arange(hi - lo)
        b = np.full(int(sizes.sum()) + ORDER * (hi - lo), 32, dtype=np.uint8)
        b[np.arange(sizes.sum()) + np.repeat(ORDER * np.arange(1, hi - lo + 1), sizes)] = folded(data[offsets[lo] : offsets[hi]])
        ends = np.stack([start, start + sizes], axis=1).ravel()
        for k, (symbol, s, node, cost) in enumerate(self.trees):
            x = symbol[b]
            index = x[:-ORDER].copy()
            for j in range(1, ORDER):
                index *= s
                index += x[j : j - ORDER]
            index = node[index]
            index *= s
            index += x[ORDER:]
            out[:, k] = np.add.reduceat(np.append(cost[index], 0), ends, dtype=np.int64)[::2] * (sizes > 0)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, share of it among equally likely languages, bits a byte) of each text; UNKNOWN without a letter or a text."""
        data, offsets = utf8(column)
        total = len(offsets) - 1
        names, score, rate = [UNKNOWN] * total, np.zeros(total), np.zeros(total)
        if not self.languages:
            return names, score, rate
        for lo, hi in chunks(offsets):
            lengths = self.lengths(data, offsets, lo, hi)
            best = lengths.argmin(axis=1)
            least = lengths.min(axis=1)
            share = 1 / np.exp2(-np.minimum(lengths - least[:, None], 1 << 22) / PARTS).sum(axis=1)
            letters = np.append(0, np.cumsum(_LETTER[data[offsets[lo] : offsets[hi]]]))
            inner = offsets[lo : hi + 1] - offsets[lo]
            has = letters[inner[1:]] > letters[inner[:-1]]
            for i in range(hi - lo):
                if has[i] or any(map(str.isalpha, data[offsets[lo + i] : offsets[lo + i + 1]].tobytes().decode())):
                    names[lo + i], score[lo + i], rate[lo + i] = self.languages[best[i]], share[i], least[i] / PARTS / (offsets[lo + i + 1] - offsets[lo + i])
        return names, score, rate


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Context trees of every language from a bounded sample, by a hash of the id, of the rows that are not held out."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Model({})
    share = docs.sparkSession.createDataFrame([(r.lang, min(1 << 30, int(2 * TRAIN_DOCS / r["count"] * (1 << 30)) + 1)) for r in counts], "lang string, share long")
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))).join(F.broadcast(share), "lang").where("draw < share")
    sample: dict[str, dict[str, int]] = {r.lang: {} for r in counts}
    for r in rows.select("lang", "draw", F.substring("text", 1, TRAIN_ONE).alias("text")).toLocalIterator():
        text = r.text.encode()[:TRAIN_ONE].decode(errors="ignore")
        sample[r.lang][text] = min(r.draw, sample[r.lang].get(text, r.draw))
    texts: dict[str, list[str]] = {}
    for lang, found in sample.items():
        room = TRAIN_BYTES
        for text, _ in sorted(found.items(), key=lambda kv: (kv[1], kv[0]))[:TRAIN_DOCS]:
            room -= len(text.encode())
            if room < 0 and texts.get(lang):
                break
            texts.setdefault(lang, []).append(text)
    return Model(texts)


def held_out(id_col: str):
    """Whether a row is kept from training: crc32 of the id as text has the remainder 2 by 4. A null id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    """Adds lang_pred, score and rate to batches whose last column is the text, which goes."""
    for batch in batches:
        names, score, rate = model.value.predict(batch.column(batch.num_columns - 1))
        kept = batch.columns[:-1]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(names), pa.array(score), pa.array(rate)], names=[*batch.schema.names[:-1], "lang_pred", "score", "rate"])


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rate) for every row of docs, from its whole text alone.

    lang_pred is UNKNOWN and score 0 for a null or empty text and one without a letter (or if nothing was learned); rate is the
    winner's bits a byte. Very long texts are read whole. Ties go to the first language by code point. Null ids and repeated rows are kept as they are;
    an empty table gives an empty one. Other columns are passed over.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_predict, model=docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, lang_pred string, score double, rate double")


def with_language(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is known with a score of at least `least`, with all their columns and repeats; those go whose text is null, empty or without a letter."""
    small_batches(docs.sparkSession)

    def choose(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, _ = model.value.predict(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in zip(names, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(partial(choose, model=docs.sparkSession.sparkContext.broadcast(model)), docs.schema)
