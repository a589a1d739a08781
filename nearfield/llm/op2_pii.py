"""Personal data: patterns for the plain cases, and a semi-Markov conditional random field for what they don't describe.

The field scores candidate segments as wholes: shape of the characters, digits and letters, check digits, the word before,
what stands on either side. A dynamic program over segments of at most SEGMENT tokens chooses boundaries and types
together, with a weight for each pair of neighbouring labels. It is trained here, weights and pairs, by conditional likelihood, on sentences made
from a seeded generator (no corpus text), and reads only the surroundings of digits, ``@`` and ``[at]`` that no pattern has covered: elsewhere it
has no candidates, and the surroundings hold every candidate whole with the words before it that count, so
leaving the rest out changes nothing. Its spans are added; those of the patterns stay.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches
from .textkit import chunks, utf8

#: Kinds in the order in which spans are listed; the first four are the patterns'.
BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "ssn", "iban", "mail", "tel")
KINDS = BASE + ADDED
#: Most tokens and characters of a segment, characters before it in which a telling word is sought, and characters read around a place of interest.
SEGMENT, SPAN, CUE = 16, 80, 24
AROUND = SPAN + CUE + 2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start: leftmost matches that don't overlap others of their kind and pass its test.

    An address is sought from each ``@`` outwards and an IP only from the first digit of a run, which finds the same
    matches as trying each place in turn, in linear time.
    """
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.groups()):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _DIGITS.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W_]+|[^\s]")
_INTEREST = re.compile(r"[0-9@]|[\[({]\s?(?:at|AT)\s?[\])}]")
_SHAPE = re.compile(r"[0-9]+|[a-z]+|[A-Z]+")
#: Words before a segment that matter; all others count as one.
_CUES = frozenset("token key secret password passwd apikey bearer ssn social security iban account acct call phone tel mobile fax cell mail email contact order invoice version page room id no ref isbn date".split())


_AT, _WORD, _PREFIX = re.compile(r"[\[({] ?at ?[\])}]"), re.compile(r"(?<![^\s])[A-Za-z]{1,}(?![^\s])"), re.compile(r"AKIA|ASIA|sk-|ghp_|gho_|xox")


def _shape(span: str) -> str:
    def part(m: re.Match) -> str:
        x = m.group()
        if x[0].isdigit():
            return f"9{len(x)}" if len(x) <= 4 else "9x"
        return "a" if x[0].islower() else "A"

    return _SHAPE.sub(part, span)


def _iban(span: str) -> bool:
    x = span.replace(" ", "")
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", x):
        return False
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def _features(span: str, cue: str, before: str, after: str) -> tuple[str, ...]:
    digits, letters = sum(c in "0123456789" for c in span), sum(c.isascii() and c.isalpha() for c in span)
    low = span.lower()
    one = span.isalnum()
    mixed = one and digits and letters
    bits = 0.0
    if mixed and len(span) >= 12:
        bits = -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(low).values())
    out = [
        "1", f"shape={_shape(span)}" if len(span) <= 32 else "shape=long", f"digits={min(digits, 12)}", f"letters={min(letters, 8)}", f"cue={cue}", f"before={before}", f"after={after}",
        f"cue={cue},one={one},long={len(span) >= 16}", f"mixed={bool(mixed)},bits={int(min(bits, 5))},len={min(len(span) // 8, 5)}", f"at={'@' in span or bool(_AT.search(low))},dot={bool(re.search(r'[\[({] ?dot ?[\])}]', low))},end={low[-3:].isalpha()}", f"iban={_iban(span)},pieces={len(span.split()) > 1}", f"words={min(len(_WORD.findall(span)), 4)},at={bool(_AT.search(low))}", f"prefix={_PREFIX.match(span).group() if _PREFIX.match(span) else '-'},one={one}", f"first={'+' if span[0] == '+' else '(' if span[0] == '(' else '9' if span[0].isdigit() else 'a'}",
    ]
    return tuple(out)


class Field:
    """The model: a weight for each feature and kind, and for each pair of neighbouring labels (0: none)."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.weight = np.zeros((0, len(ADDED)))
        self.step = np.zeros((len(ADDED) + 1, len(ADDED) + 1))

    @staticmethod
    def candidates(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, tuple[str, str, str, str]]]:
        """(first token, token after the last, (span, cue, before, after)) of all segments that may be an entity.

        A segment begins with a letter, a digit, + or ( and ends with a letter or digit, and holds a digit or an at sign, plain or in brackets. One
        of several words begins and ends with words that hold digits, unless it has an at sign.
        """
        words = [text[a:b] for a, b in tokens]
        digit = [w.isascii() and any(c in "0123456789" for c in w) for w in words]
        at = [w == "@" or w in "])}" and i > 1 and words[i - 1] in ("at", "AT") and words[i - 2] in "[({" for i, w in enumerate(words)]
        for i, (start, _) in enumerate(tokens):
            c = text[start]
            if not (c in "+(" or c.isascii() and c.isalnum()):
                continue
            cue, before, spaced, numbers, ats = None, "", False, False, False
            for j in range(i, min(len(tokens), i + SEGMENT)):
                a, b = tokens[j]
                gap = a - tokens[j - 1][1] if j > i else 0
                if gap > (text[a - 1] == " ") or b - start > SPAN:
                    break
                spaced, numbers, ats = spaced or gap > 0, numbers or digit[j], ats or at[j]
                if not (numbers or ats) or b - start < 9 or not (text[b - 1].isascii() and text[b - 1].isalnum()):
                    continue
                if spaced and not ats and not (digit[j] and (digit[i] or c in "+(")):
                    continue
                if cue is None:
                    near = re.findall(r"[A-Za-z]+", text[max(0, start - CUE) : start].lower())
                    cue = next((w for w in reversed(near[-3:]) if w in _CUES), "-")
                    before = text[start - 1 : start]
                    before = before if before in " \n=\"':.(" else "a" if before.isalnum() else "?"
                after = text[b : b + 1]
                yield i, j + 1, (text[start:b], cue, before, after if after in " \n\"'.,:;)" else "a" if after.isalnum() else "?")

    def score(self, what: tuple[str, str, str, str]) -> np.ndarray:
        found = [self.index[f] for f in _features(*what) if f in self.index]
        return self.weight[found].sum(axis=0) if found else np.zeros(len(ADDED))

    def decode(self, text: str) -> list[tuple[str, int, int]]:
        """The best segmentation's entities."""
        tokens = [m.span() for m in _TOKEN.finditer(text)]
        into: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, j, what in self.candidates(text, tokens):
            into.setdefault(j, []).append((i, self.score(what)))
        if not into:
            return []
        n, k = len(tokens), len(ADDED) + 1
        best, back = np.full((n + 1, k), -np.inf), {}
        best[0, 0] = 0
        for t in range(1, n + 1):
            prior = best[t - 1] + self.step[:, 0]
            best[t, 0], back[t, 0] = prior.max(), (t - 1, int(prior.argmax()))
            for i, s in into.get(t, ()):
                enter = best[i][:, None] + self.step[:, 1:]
                value = enter.max(axis=0) + s
                for c in np.flatnonzero(value > best[t, 1:]):
                    best[t, c + 1], back[t, int(c) + 1] = value[c], (i, int(enter[:, c].argmax()))
        out, t, c = [], n, int(best[n].argmax())
        while t:
            i, was = back[t, c]
            if c:
                out.append((ADDED[c - 1], tokens[i][0], tokens[t - 1][1]))
            t, c = i, was
        return out[::-1]

    def fit(self, sentences: list[tuple[str, list[tuple[str, int, int]]]], turns: int = 8, rate: float = 0.4, decay: float = 1e-4) -> "Field":
        """Stochastic gradient ascent of the conditional likelihood of the marked segmentations, in the features' weights and in `step`; both are averaged over the turns."""
        made = []
        for text, spans in sentences:
            tokens = [m.span() for m in _TOKEN.finditer(text)]
            found = []
            for i, j, what in self.candidates(text, tokens):
                ids = [self.index.setdefault(f, len(self.index)) for f in _features(*what)]
                found.append((i, j, np.array(ids)))
            starts, ends = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
            made.append((len(tokens), found, {(starts[a], ends[b]): ADDED.index(kind) for kind, a, b in spans}))
        k = len(ADDED) + 1
        self.weight = np.zeros((len(self.index), k - 1))
        total, steps, order = np.zeros_like(self.weight), np.zeros_like(self.step), random.Random(3)
        for turn in range(turns):
            order.shuffle(made)
            speed = rate / (1 + turn)
            for n, found, gold in made:
                by_end, by_start = {}, {}
                for c, (i, j, ids) in enumerate(found):
                    seg = (i, j, self.weight[ids].sum(axis=0), c)
                    by_end.setdefault(j, []).append(seg)
                    by_start.setdefault(i, []).append(seg)
                ahead, behind = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
                ahead[0, 0], behind[n] = 0, 0
                for t in range(1, n + 1):
                    ahead[t, 0] = np.logaddexp.reduce(ahead[t - 1] + self.step[:, 0])
                    for i, _, s, _ in by_end.get(t, ()):
                        ahead[t, 1:] = np.logaddexp(ahead[t, 1:], np.logaddexp.reduce(ahead[i][:, None] + self.step[:, 1:], axis=0) + s)
                for t in range(n - 1, -1, -1):
                    value = self.step[:, 0] + behind[t + 1, 0]
                    for _, j, s, _ in by_start.get(t, ()):
                        value = np.logaddexp(value, np.logaddexp.reduce(self.step[:, 1:] + (s + behind[j, 1:])[None], axis=1))
                    behind[t] = value
                log_z = np.logaddexp.reduce(ahead[n])
                expected = np.zeros_like(self.step)
                expected[:, 0] = np.exp(ahead[:-1] + self.step[:, 0] + behind[1:, :1] - log_z).sum(axis=0)
                shares = []
                for i, j, s, c in (seg for segs in by_end.values() for seg in segs):
                    entering = np.exp(ahead[i][:, None] + self.step[:, 1:] + s + behind[j, 1:] - log_z)
                    expected[:, 1:] += entering
                    shares.append((i, j, c, entering.sum(axis=0)))
                for i, j, c, share in shares:
                    if (i, j) in gold:
                        share[gold[i, j]] -= 1
                    np.subtract.at(self.weight, found[c][2], speed * share)
                self.step += speed * (self._steps(n, gold) - expected)
            self.weight *= 1 - decay
            self.step *= 1 - decay
            total += self.weight
            steps += self.step
        self.weight, self.step = total / turns, steps / turns
        return self

    def _steps(self, n: int, gold: dict[tuple[int, int], int]) -> np.ndarray:
        """How often each label follows each in the segmentation of n tokens with these entities."""
        out, ends, t, label = np.zeros_like(self.step), {i: (j, c + 1) for (i, j), c in gold.items()}, 0, 0
        while t < n:
            to, now = ends.get(t, (t + 1, 0))
            out[label, now] += 1
            t, label = to, now
        return out


@lru_cache(1)
def trained() -> Field:
    """The field, trained on generated sentences."""
    return Field().fit(sentences(600))


def sentences(count: int, seed: int = 17) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with their entities marked, and about as many numbers and names that are none."""
    r = random.Random(seed)
    syllables = "an er th re on in ed nd ha at en es of or nt ea ti to it st le ou ar ne de la que el ich sch ver".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 3)))
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    alnum = lambda n, of: "".join(r.choices(of, k=n))
    hexa, caps, both = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

    def secret() -> str:
        return r.choice([lambda: alnum(r.choice([16, 18, 20, 24, 32, 40, 48, 64]), hexa), lambda: alnum(r.choice([18, 32, 40]), hexa), lambda: "AKIA" + alnum(16, caps), lambda: "sk-" + alnum(r.randint(24, 40), both), lambda: "ghp_" + alnum(36, both), lambda: alnum(r.randint(20, 40), both)])()

    def iban() -> str:
        body, country = digits(18), r.choice(["DE", "FR", "ES", "GB", "NL"])
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97
        x = f"{country}{check:02d}{body}"
        return x if r.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    def mail() -> str:
        a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" [at] ", "."), ("(at)", ".")])
        return f"{word()}{r.choice(['', '.' + word(), digits(2)])}{a}{word()}{d}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def tel() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}){b}-{c}"])

    ssn = lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"
    kinds = {"secret": (secret, ['token = "{}"', 'key: {}', 'password={}', 'api_key={}', '{}', 'secret="{}"', "bearer {}", "{}", "password {}"]), "ssn": (ssn, ["ssn {}", "SSN: {}", "social security no {}", "{}"]), "iban": (iban, ["iban {}", "account {}", "{}"]), "mail": (mail, ["contact {}", "mail {}", "{}"]), "tel": (tel, ["call {}", "phone: {}", "tel {}", "{}"])}
    plain = [lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: digits(r.randint(5, 20)), lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"version {digits(1)}.{digits(2)}.{digits(3)}", lambda: f"page {digits(3)}-{digits(3)}", lambda: f"order {digits(8)}", lambda: f"{word()}{digits(2)}{word()}", lambda: f"{word()}_{digits(4)}_{word()}", lambda: f"ISBN 978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", lambda: f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", lambda: f"CC BY {digits(1)}.{digits(1)}", lambda: f"{digits(1)} + {digits(2)} = {digits(3)}", lambda: f"@{word()}{digits(3)}", lambda: f"{word()} {digits(4)} {word()} {digits(3)}", lambda: f"http {word()} {digits(6)} {word()}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}", lambda: f"{word()}{digits(1)}{word()}{digits(1)}{word()}{word()}"]
    out = []
    for i in range(count):
        text, spans = " ".join(word() for _ in range(r.randint(0, 5))), []
        if i % 2:
            for turn in range(1 + (i % 10 == 1)):  # some hold two, next to each other or a few words apart
                kind = r.choice(list(kinds))
                make, frames = kinds[kind]
                x, frame = make(), r.choice(frames)
                text += r.choice([" ", ", ", f" {word()} {word()} "]) if turn else " " if text else ""
                text += frame.split("{}")[0]
                spans.append((kind, len(text), len(text) + len(x)))
                text += x + frame.split("{}")[1]
        else:
            text += (" " if text else "") + r.choice(plain)()
        text += r.choice([" ", ", ", ". ", "\n"]) + " ".join(word() for _ in range(r.randint(0, 4)))
        out.append((text, spans))
    return out


def find(text: str, field: Field) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(the patterns' spans, the field's spans that touch none of them)."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    merged: list[list[int]] = []
    for a, b in taken:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    parts: list[list[int]] = []
    pieces = zip([0, *(b for _, b in merged)], [*(a for a, _ in merged), len(text)], strict=True)
    for a, b in pieces:  # between the patterns' spans
        for m in _INTEREST.finditer(text, a, b):
            lo, hi = _edge(text, max(a, m.start() - AROUND), a, -1), _edge(text, min(b, m.end() + AROUND), b, 1)
            if parts and lo <= parts[-1][1] and parts[-1][2] == a:
                parts[-1][1] = hi
            else:
                parts.append([lo, hi, a])
    added = [(kind, lo + x, lo + y) for lo, hi, _ in parts for kind, x, y in field.decode(text[lo:hi])]
    return base, added


def _edge(text: str, at: int, end: int, way: int) -> int:
    """at, moved away so far as it cuts a word, at most to end; back to where it was in a word that is too long for any segment."""
    to = at
    while to != end and text[to - 1].isalnum() and text[to].isalnum():
        to += way
        if abs(to - at) > SPAN:
            return at
    return to


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end, by kind as listed, then start."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_OF_INTEREST = np.zeros(256, dtype=bool)
_OF_INTEREST[[*range(48, 58), 64, 91, 40, 123]] = True  # digits, @ and opening brackets


def _worth_reading(column: pa.Array) -> np.ndarray:
    """Which texts hold a byte that any span needs."""
    data, offsets = utf8(column)
    out = np.zeros(len(offsets) - 1, dtype=bool)
    for lo, hi in chunks(offsets, 1 << 24):
        seen = np.flatnonzero(_OF_INTEREST[data[offsets[lo] : offsets[hi]]]) + offsets[lo]
        out[lo:hi] = np.diff(np.searchsorted(seen, offsets[lo : hi + 1])) > 0
    return out


def _spans(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    field, nothing = model.value, hashlib.sha256(b"").hexdigest()
    for batch in batches:
        texts, n = batch.column(1), len(batch)
        counts, shas, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
        for i in np.flatnonzero(_worth_reading(texts)).tolist():
            base, added = find(texts[i].as_py(), field)
            for k, _, _ in base:
                counts[BASE.index(k), i] += 1
            shas[i], spans[i] = hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + added)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(shas), pa.array(spans)], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of docs.

    The counts and the digest are of the patterns' spans, `spans` lists the field's too; places are code points, ends
    exclusive. Whole texts are read, however long. A null or empty text has no spans. Segmentations that tie give the one with the earlier kind.
    Null ids and repeated rows are kept; an empty table gives an empty one. Other columns are passed over.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(partial(_spans, model=docs.sparkSession.sparkContext.broadcast(trained())), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of docs with each span replaced by its kind in angle brackets (overlapping spans by the first's), all columns kept; chars_col is counted anew where it exists."""

    def clean(text: str, field: Field) -> str:
        out, end = [], 0
        for kind, a, b in sorted((s for part in find(text, field) for s in part), key=lambda s: (s[1], -s[2])):
            if a >= end:
                out += [text[end:a], f"<{kind}>"]
            end = max(b, end)
        return "".join(out) + text[end:]

    def rewrite(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            worth = _worth_reading(batch.column(at))
            texts = [clean(t.as_py(), field) if w else t.as_py() for t, w in zip(batch.column(at), worth.tolist(), strict=True)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            n = batch.schema.get_field_index(chars_col) if chars_col else -1
            if n >= 0:
                columns[n] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(partial(rewrite, model=docs.sparkSession.sparkContext.broadcast(trained())), docs.schema)
