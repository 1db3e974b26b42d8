"""Main-text extraction by differencing each page with its nearest neighbour by URL.

Pages of a host are ordered by URL path.  Of the pages before and behind it, a page's neighbour is the
one whose path shares the longer beginning with its own (the one before, if both do).  Pages are read
into text lines (blocks), the two pages' lines are aligned by their longest common subsequence, and lines
in both are what the host's template prints: they go.  What the page itself says bounds that.  What the
markup names as menu, header, footer, sidebar, notice, advert, form, script, style or comment goes whether
the neighbour has it or not.  In the page's article element a shared line goes unless it is a heading, ends
as a sentence or has over ``NOTICE_WORDS`` words, and none goes if over half of the article is shared: then
the two pages are copies.  A page without an article is judged by its neighbour and by link density alone.

A name (class, id, role) isn't always what it says: ``has-sidebar`` or ``no-sidebar`` names nothing, a wrapper that
holds over half of the page's prose is a layout, and a paragraph of prose in an article isn't a share button because its
class says ``share-price``.  Only names of comments, consents, subscriptions and adverts hold whatever they frame.

A host may hold a third of all pages, so pages are dealt into ranges of (host, path, page_id), cut at keys
of a sample.  The first and the last page of each range are also sent to the ranges before and behind it, as
line hashes, so that each page meets its true neighbours and results don't depend on the cuts.  Pages are
read before they are dealt: what is shuffled is their lines, and a task holds three pages at a time.

Defined cases: a null or empty html gives an empty text; a null url is the host '' and path ''; equal
URLs are neighbours in order of page_id, and repeated page_ids in order of a hash of their html; a host's
only page loses no shared lines; broken markup is read as far as it goes: an element left open ends with its
parent; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import os
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, partitions

#: Elements whose text is never shown as text of the page.
SKIPPED = frozenset("script style noscript template svg math head iframe object canvas select option button textarea audio video".split())
#: Elements that frame a page or ask for input.
FRAMES = frozenset("nav header footer aside form menu dialog fieldset label figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
MAIN = frozenset(("article", "main"))
#: Words in class, id and role that name what is no main text.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|footer|sidebar|aside|widget|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscri\w+|comments?|disqus|replies|respond|related|share|social|search|login|pagination|pager|skip)(?:$|[\s_-])",
    re.I,
)
#: Before such a word, these say that the page has it, or hasn't.
_PREFIXED = re.compile(r"(?:^|(?<=[\s_-]))(?:has|have|no|non|not|with|without|hide|show)[_-][^\s]*", re.I)
#: Names that hold even where they frame most of the page.
FIRM = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscri\w+|comments?|disqus|replies|respond)(?:$|[\s_-])", re.I)
#: Names that prose in an article may have for its subject.
LOOSE = frozenset(("share", "social", "related", "search", "notice", "alert", "login", "skip", "widget", "aside"))
#: The same outside an article, whose own header is part of it.
HEADS = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:$|[\s=/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")
LINK_SHARE = 0.6
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A line of an article with more words is no notice.
NOTICE_WORDS = 8
_SENTENCE = re.compile(r"[.!?\u2026\u3002]['\"\u2019\u201d\u00bb)\]]*$")
#: Keys sampled for each range of pages.
SAMPLE = 20
#: Cells (bits) of the alignment of two runs of lines that are held at once.
CELLS = 1 << 26


class Line:
    """A block of text: in_main tells whether it stands in the article, framed whether markup names it as none."""

    __slots__ = ("framed", "heading", "in_main", "linked", "names", "text")

    def __init__(self, text: str, in_main: bool, framed: bool, linked: float, heading: bool, names: tuple[int, ...] = ()):
        self.text, self.in_main, self.framed, self.linked, self.heading, self.names = text, in_main, framed, linked, heading, names

    def prose(self) -> bool:
        return not self.heading and self.linked < LINK_SHARE and (bool(_SENTENCE.search(self.text)) or self.text.count(" ") >= NOTICE_WORDS)

    def marks(self) -> int:
        """1: in the article, 2: framed, 4: mostly links, 8: a heading or prose."""
        own = self.heading or bool(_SENTENCE.search(self.text)) or self.text.count(" ") >= NOTICE_WORDS
        return self.in_main + 2 * self.framed + 4 * (self.linked >= LINK_SHARE) + 8 * own


#: How a name frames: whatever it holds; unless that is most of the page; and also unless that is prose of an article.
_FIRM, _PLAIN, _LOOSE = 0, 1, 2


def _named(own: str, in_main: bool) -> int | None:
    """How an element's names frame it, if they do."""
    own = _PREFIXED.sub(" ", own)
    if FIRM.search(own):
        return _FIRM
    found = NAMED.search(own)
    if found:
        word = found[0].strip(" \t\n\r\f_-").lower()
        return _LOOSE if in_main and word in LOOSE else _PLAIN
    return _PLAIN if not in_main and HEADS.search(own) else None


def _frame(lines: list[Line], kinds: list[int]) -> list[Line]:
    """Lines with the frames of names that hold; kinds are those of the names met, in the order of Line.names."""
    held, total = [0] * len(kinds), 0
    for x in lines:
        if x.prose() and not x.framed and all(kinds[k] != _FIRM for k in x.names):
            total += len(x.text)
            for k in x.names:
                held[k] += len(x.text)
    layout = [kind != _FIRM and 2 * n > total for kind, n in zip(kinds, held)]
    for x in lines:
        x.framed = x.framed or any(not layout[k] and not (kinds[k] == _LOOSE and x.prose()) for k in x.names)
    return lines


def read_lines(html: str | None) -> list[Line]:
    """The blocks of a page in page order, white space inside made single spaces."""
    lines: list[Line] = []
    stack: list[tuple[str, bool, bool, bool, bool, tuple[int, ...]]] = []  # name, in_main, framed, linked, heading, names
    parts: list[str] = []
    kinds: list[int] = []
    linked = [0]
    state = nothing = ("", False, False, False, False, ())

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                lines.append(Line(text, state[1], state[2], min(1.0, linked[0] / max(1, len(text))), state[4], state[5]))
            parts.clear()
        linked[0] = 0

    html = html or ""
    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else n]
        if text:
            parts.append(text)
            if state[3]:
                linked[0] += len(text.strip())
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if any(e[0] == name for e in stack):
                if name not in INLINE:
                    flush()
                while stack and stack.pop()[0] != name:
                    pass
                state = stack[-1] if stack else nothing
            elif name in ("p", "br"):
                flush()
            continue
        if name in SKIPPED:  # to its end tag, or the page's end
            if name not in INLINE and name != "button":
                flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            if name == "head" and not end:
                continue
            at = end.end() if end else n
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] in (name, "b", "i", "em", "strong", "span", "a"):
            # an element of this kind ends the last one, and what inline elements it left open
            depth = len(stack)
            while depth and stack[depth - 1][0] in INLINE:
                depth -= 1
            if depth and stack[depth - 1][0] == name:
                del stack[depth - 1 :]
                state = stack[-1] if stack else nothing
        own = " ".join(x.strip("\"'") for x in _NAMES.findall(m[3])) if m[3] else ""
        in_main = state[1] or name in MAIN
        # a header inside an article is the article's own
        framed = state[2] or name in FRAMES and not (state[1] and name in ("header", "label", "figcaption"))
        names = state[5]
        if own and name not in ("html", "body", "article", "main") and (kind := _named(own, state[1])) is not None:
            kinds.append(kind)
            names = (*names, len(kinds) - 1)
        framed = framed or bool(m[3] and _HIDDEN.search(m[3]))
        entry = (name, in_main, framed, state[3] or name == "a", state[4] or name in HEADINGS, names)
        if not m[3].rstrip().endswith("/") or name in INLINE:
            stack.append(entry)
            state = entry
    flush()
    return _frame(lines, kinds)


def line_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def _rows(a: list[int], places: dict[int, int], width: int) -> Iterator[int]:
    """For each beginning of a: bits over b's places, 0 where the common subsequence grows by a line of b."""
    full = (1 << width) - 1
    row = full
    for x in a:
        u = row & places.get(x, 0)
        row = (row + u | row - u) & full
        yield row


def _places(b: list[int]) -> dict[int, int]:
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    return places


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """The length of a longest common subsequence of a and each beginning of b."""
    row = (1 << len(b)) - 1
    for row in _rows(a, _places(b), len(b)):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes((len(b) + 7) // 8, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits, dtype=np.int64)))


def _align(a: list[int], b: list[int]) -> list[int]:
    """Places of a, read off the stored rows of all of a's beginnings."""
    size = (len(b) + 7) // 8
    rows = [r.to_bytes(size, "little") for r in _rows(a, _places(b), len(b))]
    grows = lambda i, j: not rows[i][j >> 3] >> (j & 7) & 1
    found, i, j = [], len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if not grows(i, j):
            j -= 1
        elif i and grows(i - 1, j):
            i -= 1
        else:
            found.append(i)
            i, j = i - 1, j - 1
    return found


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """Which places of a stand in a longest common subsequence of a and b.

    Rows of the alignment are bits of one integer.  Runs of over ``CELLS`` pairs are halved first (Hirschberg),
    so memory is bounded.
    """
    both = set(a) & set(b)
    at, a, b = [i for i, x in enumerate(a) if x in both], [x for x in a if x in both], [x for x in b if x in both]
    found: set[int] = set()
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.add(at[i])
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            found.add(at[j - 1])
            j, m = j - 1, m - 1
        if i == j or k == m:
            continue
        if (j - i) * (m - k) <= CELLS or j - i == 1:
            found.update(at[i + x] for x in _align(a[i:j], b[k:m]))
            continue
        mid = (i + j) // 2
        cut = int(np.argmax(_lengths(a[i:mid], b[k:m]) + _lengths(a[mid:j][::-1], b[k:m][::-1])[::-1]))
        todo += [(i, mid, k, k + cut), (mid, j, k + cut, m)]
    return found


def _kept(marks: list[int], sizes: list[int], shared: set[int]) -> list[int]:
    """The places of the lines that stay."""
    main = [i for i, m in enumerate(marks) if m & 3 == 1]
    if main:  # comments and cards may be articles too: those are framed
        copies = 2 * sum(sizes[i] for i in main if i in shared) > sum(sizes[i] for i in main)
        return [i for i in main if copies or marks[i] & 8 or i not in shared]
    return [i for i, m in enumerate(marks) if not m & 6 and i not in shared]


def main_text(lines: list[Line], neighbour: list[int] | None) -> str:
    """The lines that stay, joined by one space; neighbour has the neighbouring page's line hashes."""
    shared = common_lines([line_hash(x.text) for x in lines], neighbour) if neighbour else set()
    return " ".join(lines[i].text for i in _kept([x.marks() for x in lines], [len(x.text) for x in lines], shared))


def _key(host: str, path: str, page: int | None) -> tuple:
    return host, path, page is not None, page or 0


def _edges(shared):
    """The first and last key of each range among a task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, first, last = shared.value, {}, {}
        for batch in batches:
            for key in map(_key, *(batch.column(i).to_pylist() for i in range(3))):
                part = bisect_right(cuts, key)
                if part not in first or key < first[part]:
                    first[part] = key
                if part not in last or key > last[part]:
                    last[part] = key
        rows = [(p, *k[:2], k[3] if k[2] else None, e) for e, own in ((0, first), (1, last)) for p, k in own.items()]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["part", "host", "path", "page_id", "edge"])

    return run


_READ = "part int, host string, path string, page_id long, tie long, sent boolean, url string, marks array<tinyint>, hashes array<long>, sizes array<int>, lines array<string>"
_READ_ARROW = pa.schema(
    [("part", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("page_id", pa.int64()), ("tie", pa.int64()), ("sent", pa.bool_()), ("url", pa.string())]
    + [(n, pa.list_(k)) for n, k in (("marks", pa.int8()), ("hashes", pa.int64()), ("sizes", pa.int32()), ("lines", pa.string()))]
)


def _read(shared):
    """Pages as lines with their range; the text of lines that markup names as none stays behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, sent = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for host, path, page, url, html in zip(*(batch.column(i) for i in range(5))):
                host, path, page, html = host.as_py(), path.as_py(), page.as_py(), html.as_py()
                lines, key = read_lines(html), _key(host, path, page)
                marks, hashes = [x.marks() for x in lines], [line_hash(x.text) - (1 << 63) for x in lines]
                own = (host, path, page, xxhash.xxh64_intdigest(html or "") - (1 << 63))
                sizes = [len(x.text) for x in lines]
                rows.append((bisect_right(cuts, key), *own, False, url.as_py(), marks, hashes, sizes, ["" if m & 2 else x.text for x, m in zip(lines, marks)]))
                rows += [(part, *own, True, None, None, hashes, None, None) for part in sent.get(key, ())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_READ_ARROW), _READ_ARROW)], schema=_READ_ARROW)

    return run


_RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])


def _nearest(before: tuple | None, page: tuple, behind: tuple | None) -> list[int] | None:
    """The line hashes of the neighbour; pages are (host, path, hashes, ...)."""
    sides = [len(os.path.commonprefix([x[1], page[1]])) if x and x[0] == page[0] else -1 for x in (before, behind)]
    return None if max(sides) < 0 else (before if sides[0] >= sides[1] else behind)[2]


def _differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the lines of pages sorted by range, host, path and page_id."""
    before = page = None  # of the same range

    def text(behind: tuple | None) -> tuple:
        near = _nearest(before, page, behind)
        shared = common_lines(page[2], near) if near else set()
        marks, sizes, lines = page[6:]
        return page[4], page[5], " ".join(lines[i] for i in _kept(marks, sizes, shared))

    at = None
    for batch in batches:
        out: list[tuple] = []
        for part, host, path, page_id, sent, url, marks, hashes, sizes, lines in zip(*(batch.column(i) for i in range(10))):
            behind = (host.as_py(), path.as_py(), hashes.as_py(), sent.as_py(), page_id.as_py(), url.as_py(), marks.as_py(), sizes.as_py(), lines.as_py())
            same = part.as_py() == at
            if page and not page[3]:
                out.append(text(behind if same else None))
            before, page, at = page if same else None, behind, part.as_py()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, _RESULT)], schema=_RESULT)
    if page and not page[3]:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(text(None), _RESULT)], schema=_RESULT)


def extract(pages: DataFrame, ranges: int | None = None) -> DataFrame:
    """page_id, url and the page's main text."""
    spark = bounded_batches(pages).sparkSession
    url = F.coalesce("url", F.lit(""))
    keyed = pages.select(
        F.lower(F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        "html",
    )
    keys = keyed.select("host", "path", "page_id")
    ranges = ranges or 2 * partitions(spark)  # pages differ in length
    # about SAMPLE keys a range come to the driver, and two keys of each range; the cuts decide nothing but the load
    sample = sorted({_key(*r) for r in keys.sample(min(1.0, SAMPLE * ranges / max(1, pages.count())), 1).collect()})
    cuts = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []
    edges = keys.mapInArrow(_edges(spark.sparkContext.broadcast(cuts)), "part int, host string, path string, page_id long, edge int")
    key = F.struct("host", "path", F.col("page_id").isNotNull().alias("known"), "page_id")
    listed = sorted(tuple(r) for r in edges.groupBy("part").agg(F.min(F.when(F.col("edge") == 0, key)), F.max(F.when(F.col("edge") == 1, key))).collect())
    sent: dict[tuple, list[int]] = {}
    for (one, _, last), (two, first, _) in zip(listed, listed[1:]):
        if last["host"] == first["host"]:
            sent.setdefault(_key(last["host"], last["path"], last["page_id"]), []).append(two)
            sent.setdefault(_key(first["host"], first["path"], first["page_id"]), []).append(one)
    read = keyed.mapInArrow(_read(spark.sparkContext.broadcast((cuts, sent))), _READ)
    order = ["part", "host", "path", "page_id", "tie"]
    dealt = read.repartitionById(ranges, "part").sortWithinPartitions(*order)
    return dealt.select("part", "host", "path", "page_id", "sent", "url", "marks", "hashes", "sizes", "lines").mapInArrow(_differ, "page_id long, url string, text string")


def op5(pages: DataFrame) -> DataFrame:
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
