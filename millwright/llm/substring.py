"""Substring dedup: repeated word windows, found with suffix automata of reference shards.

Every run of ``window`` words that starts at two or more places of the corpus goes, wherever it stands.
All documents are the reference, so the reference is cut into shards that are closed under repetition:

1. Each window picks an anchor, the least hash among its ``GRAM``-word grams (winnowing).  Equal windows
   pick equal anchors at equal offsets, so windows that repeat meet under one anchor; consecutive windows
   with one anchor form a segment.  Anchors, places and content hashes are written as arrays per document.
2. Anchors are counted with map-side combine.  Those seen twice or more are set in a bit table of bounded
   size that is broadcast; a false positive costs work, never results.
3. Segments of such anchors are counted by content.  A content seen twice or more goes whole.  Under an
   anchor with several contents one place of each content is chosen (again a bit table) and its words are
   sent to the anchor's shard: a suffix automaton with occurrence counts is built over the shard's contents
   and each content seen once is streamed through it for matching statistics (the longest suffix at each
   word that occurs twice or more); where these reach ``window`` words, the span goes.
4. An anchor with over ``HOT`` contents would make a large shard.  Windows of its contents are told apart
   by 128-bit hashes instead, counted with map-side combine; those in a bit table of the repeated ones are
   joined back.  They are at most as many as the words of these contents.  Anchors of very many contents, and
   contents and windows of very many places, are salted where they meet their counts.
5. Spans come back to their documents, which drop the words under them.

Documents are worked in pieces of ``PIECE`` words that overlap by a window, so that long ones need
bounded memory.  Defined cases: a null text has no words; texts under ``window`` words lose nothing;
repeated rows repeat each other and lose all windows; an empty table gives an empty table; further
columns pass through ``dedup_substrings`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keeps_columns, materialise, partitions, sole
from .suffix import SuffixAutomaton

WINDOW = 35
GRAM = 8
HOT = 500
#: A key with more than one in so many rows is dealt into parts of that size.
SHARES = 4096
PIECE = 200_000
MIN_BITS, MAX_BITS = 20, 29
CACHE_WORDS = 300_000
_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    """A bounded cache of 64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
                _POWERS[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))))
    return _POWERS[0][:n], _POWERS[1][:n]


def _rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k values."""
    up, down = _powers(len(h))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up)))
    return _mix((sums[k:] - sums[:-k]) * down[: len(h) - k + 1])


@dataclass
class Segments:
    """Of a piece of a document: its first word, the words' hashes, and for each segment its anchor, its
    content's hash, its first and last window (counted from the piece's first word) and a hash of its place."""

    at: int
    hashes: np.ndarray
    anchors: np.ndarray
    contents: np.ndarray
    first: np.ndarray
    last: np.ndarray
    places: np.ndarray


def segments(words: list[bytes], window: int, seed: int = 0) -> Iterator[Segments]:
    gram = min(GRAM, window)
    reach = window - gram + 1  # grams in a window
    for at in range(0, max(0, len(words) - window + 1), PIECE):
        own = words[at : at + PIECE + window - 1]
        h = np.fromiter(map(_HASHES.__getitem__, own), np.uint64, len(own))
        up, down = _powers(len(h) + 1)
        sums = np.concatenate(([np.uint64(0)], np.cumsum(h * up[:-1])))
        grams = _mix((sums[gram:] - sums[:-gram]) * down[: len(h) - gram + 1])
        # the least hash of each window, the leftmost of equals: high bits of the hash, then the place
        least = (grams & ~np.uint64(0xFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: width - reach], least[reach - width :])
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1))
        last = np.concatenate((first[1:], [len(place)])) - 1
        anchors = grams[place[first]]
        contents = _mix((sums[last + window] - sums[first]) * down[first] + (last - first).astype(np.uint64))
        places = _mix(anchors ^ contents * np.uint64(3) + np.uint64(5 * seed % (1 << 64)) + (first + at).astype(np.uint64) * np.uint64(_BASE))
        yield Segments(at, h, anchors, contents, first, last, places)


class Bits:
    """A set of hashes as a bit table; it may hold more than was put in."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bit_table(hashes: DataFrame) -> Bits:
    """Of a frame's column h. The table is at most 2^MAX_BITS bits (64 MB), whatever the input."""
    n = hashes.count()
    bits = max(MIN_BITS, min(MAX_BITS, (16 * n).bit_length()))
    at = F.shiftrightunsigned("h", 64 - bits)
    cells = hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 AS INT))").alias("b"))
    found = cells.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.int64)
    words[found["w"].to_numpy()] = found["b"].to_numpy()
    return Bits(words.view(np.uint64), bits)


def _seed(doc: int | None, t: int) -> int:
    """Of a document's places: copies of a text have their own, so that one place of a content is in one document."""
    return t ^ (doc or 0) * _BASE


_PLACED = "doc_id long, t long, h array<bigint>, c array<bigint>, p array<bigint>, start array<int>, end array<int>"
_ROW = "h long, c long, p long, doc_id long, t long, start int, end int"


def _place(window: int):
    """Segments of each document, as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(_HASHES)
        for batch in batches:
            bounds, found = [0], [[] for _ in range(5)]
            for doc, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n = 0
                for s in segments(split_words(text.as_py()), window, _seed(doc, t)):
                    n += len(s.first)
                    for k, x in enumerate((s.anchors.view(np.int64), s.contents.view(np.int64), s.places.view(np.int64), s.first + s.at, s.last + s.at + window)):
                        found[k].append(x)
                bounds.append(bounds[-1] + n)
            offsets = pa.array(bounds, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else [], kind)) for x, kind in zip(found, [pa.int64()] * 3 + [pa.int32()] * 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "t", "h", "c", "p", "start", "end"])

    return run


def _repeated_rows(shared):
    """Rows of the segments whose anchor is in a bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
            flat = [batch.column(i).flatten() for i in range(2, 7)]
            keep = pa.array(np.flatnonzero(shared.value.has(flat[0].to_numpy().view(np.uint64))))
            h, c, p, start, end = (x.take(keep) for x in flat)
            of = pa.array(doc[keep.to_numpy()])
            yield pa.RecordBatch.from_arrays([h, c, p, batch.column(0).take(of), batch.column(1).take(of), start, end], names=["h", "c", "p", "doc_id", "t", "start", "end"])

    return run


def _known(table):
    """Rows whose first column, a hash, is in a bit table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(table.value.has(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    return run


def _flagged(flood):
    """Rows of contents with whether their anchor is in the bit table of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = flood.value.has(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hot)], names=[*batch.schema.names, "hot"])

    return run


_CONTENT = "hot boolean, h long, c long, n long, other long, doc_id long, t long, start int, end int, words binary"
_CONTENT_ARROW = pa.schema(
    [("hot", pa.bool_()), ("h", pa.int64()), ("c", pa.int64()), ("n", pa.int64()), ("other", pa.int64()), ("doc_id", pa.int64()), ("t", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("words", pa.binary())]
)


def _contents(chosen, flood, texts, window: int, hot: bool):
    """The words of chosen segments under anchors that aren't hot; or of those under hot ones each window with a 128-bit hash.

    Only documents whose text hash is in the bit table texts hold any; the others aren't read.  The table chosen also
    picks a share of all places, so a task sends a content once: of one at several places only the words matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick, often, sent = chosen.value, flood.value, set()
        sole(_HASHES)
        for batch in batches:
            batch = batch.filter(pa.array(texts.value.has(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))))
            rows: list[tuple] = []
            for doc, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = split_words(text.as_py())
                for s in segments(words, window, _seed(doc, t)):
                    keep = np.flatnonzero(pick.has(s.places))
                    keep = keep[often.has(s.anchors[keep]) == hot]
                    if not len(keep):
                        continue
                    anchors, contents = s.anchors.view(np.int64), s.contents.view(np.int64)
                    if hot:
                        one, two = (_rolling(x, window).view(np.int64) for x in (s.hashes, _mix(s.hashes + np.uint64(1))))
                    for i in keep.tolist():
                        if contents[i] in sent:
                            continue
                        if len(sent) >= CACHE_WORDS:
                            sent.clear()
                        sent.add(int(contents[i]))
                        a, b = int(s.first[i]), int(s.last[i])
                        if hot:
                            rows += [(True, int(one[k]), int(contents[i]), None, int(two[k]), doc, t, s.at + k, s.at + k + window, None) for k in range(a, b + 1)]
                        else:
                            cut = slice(s.at + a, s.at + b + window)
                            rows.append((False, int(anchors[i]), int(contents[i]), None, None, doc, t, cut.start, cut.stop, b" ".join(words[cut])))
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTENT_ARROW)], schema=_CONTENT_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTENT_ARROW)], schema=_CONTENT_ARROW)

    return run


class CountedAutomaton(SuffixAutomaton):
    """A suffix automaton of weighted sequences; times[v] counts the places where v's words end."""

    def __init__(self, sequences: list[tuple[list[int], int]]):
        super().__init__()
        self.times = [0]
        for word, weight in sequences:
            last = 0
            for c in word:
                last = self.extend(last, c)
                self.times[last] += weight
        for v in self.by_length(longest_first=True):
            self.times[self.link[v]] += self.times[v]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.times.append(0)
        return super()._state(length, link, moves)

    def repeated(self, word: list[int], window: int) -> list[tuple[int, int]]:
        """The maximal spans of word that are covered by runs of window values that end at two or more places."""
        v, spans = 0, []
        n = 0
        for e, c in enumerate(word, 1):
            v = self.next[v][c] if c in self.next[v] else 0
            n += 1
            while v and self.times[v] < 2:
                v = self.link[v]
                n = self.length[v]
            if n >= window:
                if spans and spans[-1][1] >= e - window:
                    spans[-1] = (spans[-1][0], e)
                else:
                    spans.append((e - window, e))
        return spans


def _match(window: int):
    """Spans [start, end) to remove, from a stream of contents sorted by anchor: rows with n, rows with words."""

    def shard(times: dict[int, int], texts: dict[int, tuple]) -> Iterator[tuple]:
        known = {c: r for c, r in texts.items() if c in times}
        if len(known) < 2:
            return
        codes: dict[bytes, int] = {}
        coded = {c: [codes.setdefault(w, len(codes)) for w in r[3].split(b" ")] for c, r in known.items()}
        automaton = CountedAutomaton([(coded[c], times[c]) for c in coded])
        for c, (doc, t, start, _) in known.items():
            if times[c] == 1:  # others went whole
                for a, b in automaton.repeated(coded[c], window):
                    yield doc, t, start + a, start + b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[int, int] = {}
        texts: dict[int, tuple] = {}
        at = None
        for batch in batches:
            out: list[tuple] = []
            for h, c, n, doc, t, start, words in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if h != at:
                    out += shard(times, texts)
                    times, texts, at = {}, {}, h
                if words is None:
                    times[c] = n
                else:
                    texts[c] = (doc, t, start, words)
            yield _spans(out)
        yield _spans(list(shard(times, texts)))

    return run


def _spans(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "t", "start", "end"])


def _meet(rows: DataFrame, keys: DataFrame, on: list[str], by: tuple[str, ...] = ("doc_id", "t", "start"), carry: tuple[str, ...] = ()) -> DataFrame:
    """rows joined to keys (and their columns carry), which have the number n of their rows.

    A key's rows are dealt by the columns by into parts of about 1/SHARES of all rows.  At most 2 x SHARES keys have
    several parts, so their list is small enough to be broadcast, and there are as few parts of them to join to.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    parts = F.ceil(F.col("n") / max(1, total // SHARES)).cast("int")
    dealt = keys.select(*on, *carry, F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    large = F.broadcast(keys.select(*on, parts.alias("parts")).filter("parts > 1"))
    salt = F.coalesce(F.pmod(F.hash(*by), F.col("parts")), F.lit(0))
    return rows.join(large, on, "left").withColumn("salt", salt).join(dealt, [*on, "salt"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, t (hash of the text), start, end: spans of words under repeated windows; they may overlap."""
    spark, share = docs.sparkSession, docs.sparkSession.sparkContext.broadcast
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    placed = materialise(keyed.mapInArrow(_place(window), _PLACED), "anchors")
    seen = placed.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    rows = placed.mapInArrow(_repeated_rows(share(_bit_table(materialise(seen, "repeated")))), _ROW)
    contents = materialise(rows.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("p", "t")).alias("at")).select("h", "c", "n", "at.p", "at.t"), "contents")
    several = materialise(contents.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").withColumn("k", F.col("n")), "several")
    mixed = materialise(_meet(contents, several, ["h"], by=("c",), carry=("k",)).select("h", "c", "n", "p", "t", "k"), "mixed")
    chosen = share(_bit_table(mixed.select(F.col("p").alias("h"))))
    flood = share(_bit_table(mixed.filter(F.col("k") > hot).select("h").distinct()))

    # an anchor is hot here if the bit table says so, falsely or not: all passes must agree
    mixed = mixed.select("h", "c", "n", "t").mapInArrow(_flagged(flood), "h long, c long, n long, t long, hot boolean")
    of_hot, of_others = (share(_bit_table(mixed.filter(own).select(F.col("t").alias("h")).distinct())) for own in ("hot", "not hot"))

    whole = _meet(rows, contents.filter("n > 1").select("h", "c", "n"), ["h", "c"]).select("doc_id", "t", "start", "end")

    texts = keyed.mapInArrow(_contents(chosen, flood, of_others, window, False), _CONTENT).select("h", "c", "n", "doc_id", "t", "start", "words")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("doc_id", "long"), ("t", "long"), ("start", "int"), ("words", "binary"))]
    dealt = texts.union(mixed.filter("not hot").select("h", "c", "n", *none))
    spans = dealt.repartition(partitions(spark), "h").sortWithinPartitions("h").mapInArrow(_match(window), "doc_id long, t long, start int, end int")

    windows = materialise(keyed.mapInArrow(_contents(chosen, flood, of_hot, window, True), _CONTENT).select("h", "other", "c", "doc_id", "t", "start", "end"), "windows")
    place = F.struct("c", "start")
    counted = windows.groupBy("h", "other").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("n"))
    twice = materialise(counted.filter("a <> b").select("h", "other", "n"), "twice")
    again = windows.mapInArrow(_known(share(_bit_table(twice.select("h")))), windows.schema)
    return whole.union(spans).union(_meet(again, twice, ["h", "other"]).select("doc_id", "t", "start", "end"))


def _cut(text_at: int, spans_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(text_at), batch.column(spans_at)):
                words, spans = split_words(text.as_py()), spans.as_py()
                keep, last, removed = [], 0, 0
                for s in spans or ():
                    if s["end"] > last:
                        a = max(s["start"], last)
                        keep += words[last:a]
                        removed += s["end"] - a
                        last = s["end"]
                keep += words[last:]
                rows.append((len(words), removed, b" ".join(keep).decode()))
            n, removed, kept = map(list, zip(*rows)) if rows else ([], [], [])
            own = [c for i, c in enumerate(batch.columns) if i != spans_at]
            names = [c for i, c in enumerate(batch.schema.names) if i != spans_at]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "__n_words", "__n_removed", "__kept"])

    return run


def scan(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """docs with __n_words, __n_removed and __kept (the kept words joined by one space)."""
    spans = repeated_spans(docs, window, hot)
    listed = spans.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("__spans"))
    listed = listed.select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), "__spans")
    on = docs["doc_id"].cast("long").eqNullSafe(listed["__id"]) & (F.xxhash64(docs["text"]) == listed["__t"])
    joined = docs.join(listed, on, "left").select(*[docs[f"`{c}`"] for c in docs.columns], "__spans")
    schema = T.StructType(docs.schema.fields + [T.StructField("__n_words", T.LongType()), T.StructField("__n_removed", T.LongType()), T.StructField("__kept", T.StringType())])
    return joined.mapInArrow(_cut(docs.columns.index("text"), len(docs.columns)), schema)


@keeps_columns
def dedup_substrings(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """docs without repeated windows; a document that loses words has its others joined by one space."""
    cut = scan(docs, window, hot)
    text = F.when(F.col("__n_removed") > 0, F.col("__kept")).otherwise(F.col("text"))
    return cut.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2(F.col("__kept").cast("binary"), 256).alias("kept_sha256")
    )


SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
ws AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
marked AS (SELECT ws.doc_id, ws.i, ws.word, max(CASE WHEN r.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY ws.doc_id ORDER BY ws.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM ws LEFT JOIN r ON ws.doc_id = r.doc_id AND ws.i = r.i),
kept AS (SELECT doc_id, sum(gone)::BIGINT AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(kept.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by counting all windows, for tests."""
    seen: dict[tuple, int] = {}
    split = [(d, split_words(t)) for d, t in rows]
    for _, words in split:
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            seen[w] = seen.get(w, 0) + 1
    out = []
    for d, words in split:
        gone = {k for i in range(len(words) - window + 1) if seen[tuple(words[i : i + window])] > 1 for k in range(i, i + window)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
