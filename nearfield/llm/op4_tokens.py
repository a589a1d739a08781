"""Token counts by a map-side lookup of two tiers; pre-tokens are neither shuffled nor collected.

Byte-level BPE with the usual pattern of letters, digits, punctuation and white space never lets a pre-token cross from
a run of ASCII white space into a word, but for one space before it. So a text's count is the sum over its words, each
with the single space before it if there is one, and over the rest of the white space. Words are hashed with numpy and
looked up in a direct-mapped table: tier one, the words of the tokenizer's own vocabulary (its merges are those of frequent words), alone and with a
mark after them, is made once by the tokenizer and broadcast as hashes and lengths (12 bytes an entry, at most FREQUENT); tier two is the worker's own
copy of the table (SLOTS entries), which learns the misses. Misses are
encoded by the tokenizer itself, each distinct one of a batch once. Texts in which the rule above doesn't hold (a special
token's string, white space beyond ASCII) are encoded whole, and so is every text if the file's tokenizer isn't of that kind.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textkit import SPACE, U, chunks, mix, utf8, word_hashes, word_starts

#: Entries of the broadcast tier, and marks with which its words are taken too.
FREQUENT, AFTER = 1 << 18, ("", ",", ".")
#: Slots of a worker's table.
SLOTS = 1 << 22
_SPACED = U(0xA24BAED4963EE407)
_BEYOND = regex.compile(r"(?V1)[\p{White_Space}--[\x20\x09-\x0D]]|[\x1C-\x1F]")
_ONE_WORD = regex.compile(r" ?[^\s\x1C-\x1F\uFFFD]+")
_workers: dict[str, "Counter"] = {}


class Counter:
    """Token counts of Arrow text columns for one tokenizer file."""

    def __init__(self, path: str, frequent: tuple[np.ndarray, np.ndarray] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.keys, self.lengths = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint32)
        if frequent:
            self._learn(*frequent)
        self.blank: dict[str, int] = {}
        self.splits = splits_at_words(json.loads(self.tokenizer.to_str()))

    def _learn(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        at = (keys >> U(8) & U(SLOTS - 1)).astype(np.int64)
        self.keys[at], self.lengths[at] = keys, lengths

    def encode(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _white(self, run: str) -> int:
        if run not in self.blank:
            if len(self.blank) > 10_000:
                self.blank.clear()
            self.blank[run] = self.encode([run])[0]
        return self.blank[run]

    def count(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, tokens) of each text."""
        data, offsets = utf8(column)
        tokens = np.zeros(len(offsets) - 1, dtype=np.int64)
        for lo, hi in chunks(offsets):
            if not self.splits:
                tokens[lo:hi] = self.encode([data[i:j].tobytes().decode() for i, j in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)])
                continue
            b, starts, bounds = word_starts(data, offsets, lo, hi)
            inner = offsets[lo : hi + 1] - offsets[lo]
            if len(starts):
                tokens[lo:hi] = self._words(data, offsets, lo, hi, b, starts, bounds, inner)
            tokens[lo:hi] += self._spaces(b, inner)
            for i in self._odd(b, inner):
                tokens[lo + i] = self.encode([b[inner[i] : inner[i + 1]].tobytes().decode()])[0]
        return np.diff(offsets), tokens

    def _odd(self, b: np.ndarray, inner: np.ndarray) -> list[int]:
        """Texts to be encoded whole."""
        if not len(b):
            return []
        text = b.tobytes()
        low = (b >= 0x1C) & (b <= 0x1F)
        high = (b == 0xC2) | (b == 0xE1) | (b == 0xE2) | (b == 0xE3)  # first bytes of white space beyond ASCII
        if not (low.any() or high.any() or any(x.encode() in text for x in self.specials)):
            return []
        found = []
        for i in range(len(inner) - 1):
            part = text[inner[i] : inner[i + 1]].decode()
            if any(x in part for x in self.specials) or _BEYOND.search(part):
                found.append(i)
        return found

    def _words(self, data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, b: np.ndarray, starts: np.ndarray, bounds: np.ndarray, inner: np.ndarray) -> np.ndarray:
        hashes, _ = word_hashes(data, offsets, lo, hi, fold=False)
        spaced = np.zeros(len(starts), dtype=bool)
        spaced[starts > 0] = b[starts[starts > 0] - 1] == 32
        first = bounds[:-1][bounds[:-1] < bounds[1:]]
        spaced[first] &= ~np.isin(starts[first], inner)  # the byte before belongs to another text
        hashes = mix(hashes ^ np.where(spaced, _SPACED, U(0))) | U(1)
        at = (hashes >> U(8) & U(SLOTS - 1)).astype(np.int64)
        miss = np.flatnonzero(self.keys[at] != hashes)
        lengths = self.lengths[at].astype(np.int64)
        if len(miss):
            new, where, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            text = b.tobytes()
            ends = np.append(starts[1:], len(b))
            where = miss[where]
            ends = np.minimum(ends[where], inner[np.searchsorted(inner, starts[where], side="right")])
            words = [text[i:j].rstrip(b" \t\n\v\f\r").decode() for i, j in zip((starts[where] - spaced[where]).tolist(), ends.tolist(), strict=True)]
            counted = np.array(self.encode(words), dtype=np.int64)
            lengths[miss] = counted[back]
            self._learn(new, counted)
        return np.add.reduceat(np.append(lengths, 0), np.minimum(bounds[:-1], len(lengths))) * (bounds[1:] > bounds[:-1])

    def _spaces(self, b: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Tokens of white space that isn't the single space before a word."""
        out = np.zeros(len(inner) - 1, dtype=np.int64)
        if not len(b):
            return out
        blank = SPACE[b]
        begin, end = blank.copy(), blank.copy()
        begin[1:] &= ~blank[:-1]
        end[:-1] &= ~blank[1:]
        edges = inner[(inner > 0) & (inner < len(b))]
        begin[edges] = blank[edges]
        end[edges - 1] = blank[edges - 1]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        last = np.isin(ends, inner)  # a run at the end of its text is one pre-token
        size = ends - starts
        plain = ~last & (size == 1)
        simple = plain & (b[starts] != 32)
        owner = np.searchsorted(inner, starts, side="right") - 1
        if simple.any():
            table = np.zeros(256, dtype=np.int64)
            for c in np.unique(b[starts[simple]]):
                table[c] = self._white(chr(c))
            out += np.bincount(owner[simple], weights=table[b[starts[simple]]], minlength=len(out)).astype(np.int64)
        for i in np.flatnonzero(~plain):
            run = b[starts[i] : ends[i]].tobytes().decode()
            if last[i]:
                out[owner[i]] += self._white(run)
            else:
                out[owner[i]] += self._white(run[:-1]) + (0 if run[-1] == " " else self._white(run[-1]))
        return out


def splits_at_words(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those under which words can be counted one by one: byte-level BPE with the usual pattern, nothing before it."""
    before = settings.get("pre_tokenizer") or {}
    usual = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    plain = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in settings.get("added_tokens") or ())
    return bool(usual and plain and settings.get("normalizer") is None and settings.get("model", {}).get("type") == "BPE")


def keys_of(words: list[str]) -> np.ndarray:
    """Keys in the table of words without white space but a space before them."""
    data, offsets = utf8(pa.array(words, pa.string()))
    found, spaced = [np.empty(0, np.uint64)], np.array([w[:1] == " " for w in words], dtype=bool)
    with np.errstate(over="ignore"):
        for lo, hi in chunks(offsets):
            hashes, _ = word_hashes(data, offsets, lo, hi, fold=False)
            found.append(mix(hashes ^ np.where(spaced[lo:hi], _SPACED, U(0))) | U(1))
    return np.concatenate(found)


def frequent_words(counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(keys, lengths) of the vocabulary's words, the first of its merges first, and of those with a mark."""
    if not counter.splits:
        return np.empty(0, np.uint64), np.empty(0, np.uint32)
    vocabulary = range(counter.tokenizer.get_vocab_size(with_added_tokens=False))
    words = [w for w in counter.tokenizer.decode_batch([[i] for i in vocabulary], skip_special_tokens=False) if _ONE_WORD.fullmatch(w)]
    words = [w + mark for w in words[: FREQUENT // len(AFTER)] for mark in AFTER]
    return keys_of(words), np.array(counter.encode(words), dtype=np.uint32)


def _count(batches: Iterator[pa.RecordBatch], path: str, frequent, limit: int) -> Iterator[pa.RecordBatch]:
    with np.errstate(over="ignore"):
        counter = _workers.get(path)
        if counter is None:
            counter = _workers[path] = Counter(path, frequent.value)
        for batch in batches:
            n_bytes, n_tokens = counter.count(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs, counted as the byte-level BPE of the file at `path` does.

    No special tokens are added; their strings inside a text count as the library takes them by default. A null or empty
    text has 0 bytes and 0 tokens; very long ones are counted whole. Null ids and repeated rows are kept as they are, each with its own count, so
    nothing ties; an empty table gives an empty one. Other columns are passed over.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_words(Counter(path)))
    return texts.mapInArrow(partial(_count, path=path, frequent=frequent, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
