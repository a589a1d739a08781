"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines, one for each block element's run of text. Elements that never hold an article (scripts,
menus, headers, footers, sidebars, forms, notices, adverts, reader comments; known by tag, role, class or id) are left out, and
each leaves a gap of empty lines behind. The edge of each box (``<div>``, ``<section>``, ``<center>``) is an empty line.

The characters outside links are summed over sliding windows of WINDOW lines. Where the window that ends at a line
rises to the page's level is a surge, where the window that begins at a line falls below it a dive; the lines between are a
stretch. The level is DENSE of the page's largest window, but no more than SURGE characters. Lines that are mostly links never
belong to a stretch.

In a page that marks its article (``<article>``, ``<main>``) the windows run over the lines inside it. The marks say where the article is, so
what lies between a dive and the next surge stays too, short paragraphs among it, but for windows full of links (menus, lists of other
pages). In a page that marks none the distribution decides alone: kept are the longest stretch, those at
least SHARE of it, and of the other runs of lines those that belong to the article: between two kept stretches, in the same box as
a kept one, or headings right before one. A notice as dense and long as the article, in a
box of its own with no telling name, can't be told from it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import small_batches

#: Lines of a window; a stretch's text, of the longest one's, from which it is kept too; text in links above which it isn't.
WINDOW, SHARE, LINKS = 3, 0.3, 0.5
#: Window sum of a surge: of the page's largest window, and characters that always suffice.
DENSE, SURGE = 0.3, 90

# HTML element names by role.
_RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
_NEVER = frozenset("head nav footer aside form button select menu dialog header fieldset option datalist".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption legend".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ROOT = frozenset(["article", "main"])
_BOX = frozenset(["div", "section", "center"])
_HEADING = frozenset(["h1", "h2", "h3"])
# Words of class, id and role that mark what isn't the article; those that do so beside one unknown word; words that say nothing; words of an article's own parts.
_MARKS = frozenset("ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay sidebar side rail widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments discussion disqus respond reply replies related recommended share sharing social newsletter subscribe subscription signup login search pagination pager skip copyright complementary contentinfo".split())
_STRONG = frozenset("advert advertisement sponsor sponsored cookie cookies sidebar newsletter breadcrumb breadcrumbs navbar comment comments disqus".split())
_PLAIN = frozenset("area bar block bottom box btn button buttons column container form global group icons id inner item items left links list module outer page panel primary right row secondary section site slot top unit wrap wrapper".split())
_KEEP = frozenset("article content post entry story main body text".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_WORDS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def _attributes(text: str) -> dict[str, str]:
    """A tag's attributes, each name as a whole, the first of a name."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _marked(token: str, whole: bool) -> bool:
    """Whether a class or id names a part that isn't the article. With `whole` (ids, which often repeat a title) no word of it may be unknown; else
    most have to be known, or half beside a strong one. Words of an article's parts save all but strong ones (entry-header, but not post-comments)."""
    words = [w for w in _WORDS.split(_CAMEL.sub("-", token).lower()) if w]
    marks, strong = sum(w in _MARKS for w in words), any(w in _STRONG for w in words)
    if not marks or not strong and any(w in _KEEP for w in words):
        return False
    unknown = sum(w not in _MARKS and w not in _PLAIN and w not in _KEEP for w in words)
    return not unknown or not whole and (2 * unknown < len(words) or strong and 2 * unknown == len(words))


def _unwanted(name: str, found: dict[str, str]) -> bool:
    if name in _NEVER:
        return True
    if not found or name in ("html", "body"):
        return False
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDES.search(found.get("style", "")):
        return True
    roles = found.get("role", "").lower().split()
    if "main" in roles or "article" in roles:
        return False
    return any(r in _MARKS for r in roles) or any(_marked(x, False) for x in found.get("class", "").split()) or any(_marked(x, True) for x in found.get("id", "").split())


def lines_of(page: str) -> list[tuple[str, int, bool, int, bool]]:
    """(text, characters in links, inside an article, number of the box, is a heading) of each block in page order.

    An empty text is the edge of a box; WINDOW of them are a gap.
    """
    out: list[tuple[str, int, bool, int, bool]] = []
    boxes: list[tuple[str, int]] = [("", 0)]
    count = 0
    heading = False
    held: list[str] = []
    linked = at = inside = 0
    link = False
    skip: str | None = None
    deep = 0

    def gap(lines: int = WINDOW) -> list[tuple[str, int, bool, int, bool]]:
        return [("", 0, inside > 0, 0, False)] * lines

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.append((text, min(linked, len(text)), inside > 0, boxes[-1][1], heading))
        held.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if piece:
            held.append(piece)
            linked += len(piece) * link

    pos = 0
    while m := _TAG.search(page, pos):
        if skip is None:
            take(page[at : m.start()])
        pos = at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, rest = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and name in _RAW and not rest.endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, pos)
            pos = at = end.end() if end else len(page)
            if skip is None:
                held.append(" ")
            continue
        if skip is not None:
            if name == skip:
                deep += -1 if closing else 1
            opened = not closing and name in _ROOT and not _unwanted(name, _attributes(rest))
            if deep and not (opened and skip not in ("aside",) and name != skip) and not (closing and name in ("body", "html")):
                if not (skip == "head" and name == "body"):
                    continue
            skip = None
            out += gap()
            if closing or not opened:
                continue
        found = {} if closing else _attributes(rest)
        if not closing and name not in _VOID and not rest.endswith("/") and _unwanted(name, found):
            if name == "header" and inside:  # an article's own heading
                flush()
                continue
            flush()
            out += gap()
            skip, deep = name, 1
            continue
        if name == "a":
            link = not closing
        elif name in _ROOT or name in _BLOCK:
            flush()
            link = False
            heading = not closing and name in _HEADING
            if name in _BOX and not rest.endswith("/"):
                out += gap(1)
                if not closing:
                    count += 1
                    boxes.append((name, count))
                elif any(x == name for x, _ in boxes):
                    while boxes.pop()[0] != name:
                        pass
            if name in _ROOT:
                inside = max(0, inside - 1) if closing else inside + 1
                if inside == (0 if closing else 1):
                    out += gap()
        elif name in ("br", "td", "th"):
            held.append(" ")
    if skip is None:
        take(page[at:])
    flush()
    return out


Line = tuple[str, int, bool, int, bool]


def _runs(lines: list[Line]) -> list[tuple[bool, bool, list[Line]]]:
    """(between a surge and its dive, mostly links, lines) of each run of lines in page order; lines beyond a dive part where the box changes."""
    plain = np.array([len(x[0]) - x[1] for x in lines])
    before = np.convolve(plain, np.ones(WINDOW, dtype=np.int64), "full")[: len(lines)]  # the window that ends at each line
    after = np.convolve(plain, np.ones(WINDOW, dtype=np.int64), "full")[WINDOW - 1 :]  # and the one that begins there
    level = max(1, min(DENSE * before.max(), SURGE))
    runs: list[tuple[bool, bool, list[Line]]] = []
    broken = True
    for line, a, b in zip(lines, before, after, strict=True):
        if not line[0]:
            broken = broken or a == 0
            continue
        linked = line[1] > LINKS * len(line[0])
        alive = bool(a >= level and b >= level) and not linked
        if broken or runs[-1][:2] != (alive, linked) or not alive and runs[-1][2][-1][3] != line[3]:
            runs.append((alive, linked, []))
        runs[-1][2].append(line)
        broken = False
    return runs


def main_text(page: str) -> str:
    """The article's blocks, joined by newlines; empty if there is none."""
    lines = lines_of(page)
    marked = [x for x in lines if x[2]]
    if any(x[0] for x in marked):
        return "\n".join(x[0] for _, linked, part in _runs(marked) if not linked or len(part) < WINDOW for x in part)
    if not any(x[0] for x in lines):
        return ""
    runs = _runs(lines)
    sizes = [sum(len(x[0]) - x[1] for x in part) for _, _, part in runs]
    most = max((n for n, (alive, _, _) in zip(sizes, runs, strict=True) if alive), default=0)
    take = [alive and n >= SHARE * most for n, (alive, _, _) in zip(sizes, runs, strict=True)]
    chosen = [i for i, x in enumerate(take) if x]
    if not chosen:
        return ""
    places = {x[3] for i in chosen for x in runs[i][2]}
    for i in range(len(runs) - 1, -1, -1):
        _, linked, part = runs[i]
        titles = i + 1 < len(runs) and take[i + 1] and all(x[4] for x in part)
        between = chosen[0] < i < chosen[-1]
        take[i] = take[i] or not linked and (between or part[0][3] in places or titles) or linked and len(part) < WINDOW and (between or titles)
    return "\n".join(x[0] for ok, (_, _, part) in zip(take, runs, strict=True) if ok for x in part)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x or "") for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages, from the whole html.

    A null or empty page, or one without an article, has an empty text. Very long pages are read whole, in time linear in their length. Null ids
    and urls and repeated rows are kept as they are, each with its own text, so nothing ties; an empty table gives an empty one. Other columns are passed over.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
