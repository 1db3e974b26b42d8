"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and split into words.  A generalised suffix automaton of the
items' words is broadcast; each document's words are streamed through it, which yields the longest match
that ends at each word.  Where it is at least ``window`` long (or covers an item shorter than that), the
words under it are hit.  Hit spans are removed; a document is dropped if its hit share is over a limit.

Items are cut into pieces of at most ``PIECE`` words that overlap by a window less one word, and pieces are
dealt into shards of at most ``SHARD_WORDS`` words.  One shard's pieces at a time are collected and broadcast,
and workers build its automaton from them.  With several shards the documents are scanned for one after the
other, hits are written, and spans are united per document; both ways give the same rows.  A document's words
that occur in no item reset the automaton, so only runs of known words that are long enough are streamed at
all; that skips no possible match.

Defined cases: a null or empty text has no words and no hits; items without words match nothing; an item_id
counts once however many rows and texts it has, and ids are compared as strings; what an item without an id
says is hit, but it is in no list of ids; repeated documents are scanned each; empty tables give no hits or no
rows; further columns of docs pass through the removing forms untouched.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import UPPER, bounded_batches, keeps_columns, materialise, sole
from .suffix import SuffixAutomaton

WINDOW = 10
MAX_COVERAGE = 0.5
SHARD_WORDS = 100_000
PIECE = 10_000
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def norm_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton(SuffixAutomaton):
    """A suffix automaton of items' word sequences; an item may have several."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        super().__init__()
        self.window, self.ids, self.vocab = window, [], {}
        numbers: dict[str | None, int] = {}
        paths = []
        for item, words in items:
            if words:
                path, last = [self.vocab.setdefault(w, len(self.vocab)) for w in words], 0
                for c in path:
                    last = self.extend(last, c)
                paths.append((numbers.setdefault(item, len(numbers)), path))
        self.ids = list(numbers)
        self._index(paths)

    def _index(self, paths: list[tuple[int, list[int]]]) -> None:
        """What is found in a state: the items of its window, and the short items that end there."""
        n, w = len(self.length), self.window
        self.holds: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for i, word in paths:
            v = 0
            for c in word:
                v = self.next[v][c]
                u = v
                while self.length[u] >= w:
                    if self.length[self.link[u]] < w:
                        self.holds.setdefault(u, set()).add(i)
                    u = self.link[u]
            if len(word) < w:
                self.short.setdefault(v, []).append((len(word), i))
        self.base = list(range(n))  # the ancestor that stands for the last `window` words
        self.near = [-1] * n  # the nearest ancestor, itself included, where short items end
        for v in self.by_length():
            up = self.link[v]
            if self.length[up] >= w:
                self.base[v] = self.base[up]
            self.near[v] = v if v in self.short else self.near[up]
        self.least = min([w, *(k for ends in self.short.values() for k, _ in ends)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Maximal hit spans [start, end) over words, the items found, and the longest match."""
        get = self.vocab.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int32, count=len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([0], (codes >= 0).view(np.int8), [0]))))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        starts, ends = known[::2], known[1::2]
        for i in np.flatnonzero(ends - starts >= self.least):
            longest = max(longest, self._run(codes[starts[i] : ends[i]].tolist(), int(starts[i]), spans, found))
        return spans, found, longest

    def _run(self, codes: list[int], at: int, spans: list[tuple[int, int]], found: set[int]) -> int:
        v = n = longest = 0
        moves, link, length, w = self.next, self.link, self.length, self.window
        for e, c in enumerate(codes, at + 1):
            while v and c not in moves[v]:
                v = link[v]
                n = length[v]
            if c in moves[v]:
                v = moves[v][c]
                n += 1
            hit = w if n >= w else 0
            if hit:
                found |= self.holds[self.base[v]]
            u = self.near[v]
            while u > 0:
                for k, item in self.short[u]:
                    if u != v or n >= k:
                        found.add(item)
                        hit = max(hit, k)
                u = self.near[link[u]]
            if hit:
                start = e - hit
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, e))
            longest = max(longest, n)
        return longest


def _pieces(items: DataFrame, window: int) -> tuple[DataFrame, int]:
    """(s, i, w): the pieces of items with their shards, written once; and the number of shards."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower())
    own = items.select(F.col("item_id").cast("string").alias("i"), F.filter(F.split(low, _BREAK), lambda w: w != "").alias("w")).filter("size(w) > 0")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window), F.lit(PIECE)))
    cut = own.select("i", "w", starts.alias("at")).select("i", F.slice("w", F.col("at") + 1, PIECE + window - 1).alias("w")).distinct()
    cut = materialise(cut, "decontam-items")
    words = cut.agg(F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-words // SHARD_WORDS))
    while True:  # a few more shards than that, until none is over the bound or no two pieces are together
        dealt = cut.withColumn("s", F.pmod(F.xxhash64("i", "w"), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("s").agg(F.sum(F.size("w")).alias("n"), F.count("*").alias("k")).filter((F.col("n") > SHARD_WORDS) & (F.col("k") > 1))
        if n == 1 and words <= SHARD_WORDS or sizes.isEmpty():
            return dealt, n
        n += -(-n // 2)


_BREAK = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_FOUND = [("__n_words", T.LongType()), ("__spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))), ("__items", T.ArrayType(T.StringType())), ("__longest", T.IntegerType())]
_BUILT: dict[str, Automaton] = {}


def _automaton(token: str, pieces: list[tuple[str | None, list[str]]], window: int) -> Automaton:
    """A shard's automaton, built once in a worker process."""
    sole(_BUILT)
    if token not in _BUILT:
        _BUILT.clear()
        _BUILT[token] = Automaton(((i, [w.encode() for w in words]) for i, words in pieces), window)
    return _BUILT[token]


def _scanner(shared, token: str, window: int, text_at: int, cut: bool = False):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(token, shared.value, window)
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows, texts = [], []
            for text in batch.column(text_at):
                text = text.as_py()
                words = norm_words(text)
                spans, items, longest = automaton.scan(words)
                ids = sorted(i for i in (automaton.ids[k] for k in items) if i is not None)
                rows.append((len(words), [{"start": a, "end": b} for a, b in spans], ids, longest))
                if cut:
                    texts.append(_without(text, spans))
            n, spans, items, longest = map(list, zip(*rows)) if rows else ([], [], [], [])
            own = list(batch.columns)
            if cut:
                own[text_at] = pa.array(texts, own[text_at].type)
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(n, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32())],
                names=[*batch.schema.names, *(c for c, _ in _FOUND)],
            )

    return scan


def _shard(dealt: DataFrame, s: int):
    """A broadcast of a shard's pieces: at most SHARD_WORDS words."""
    return dealt.sparkSession.sparkContext.broadcast(sorted(((r["i"], r["w"]) for r in dealt.filter(F.col("s") == s).collect()), key=str))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, cut: bool = False) -> DataFrame:
    """docs with __n_words, __spans (hit words, end excluded), __items (ids as sorted strings), __longest; if cut, without the hit words in the text."""
    bounded_batches(docs)
    found = [T.StructField(c, k) for c, k in _FOUND]
    schema = T.StructType(docs.schema.fields + found)
    dealt, n = _pieces(items, window)
    at = docs.columns.index("text")
    if n == 1:
        return docs.mapInArrow(_scanner(_shard(dealt, 0), uuid.uuid4().hex, window, at, cut), schema)
    keyed = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam")
    narrow = keyed.select("__row", "text")
    out = T.StructType(narrow.schema.fields + found)
    parts = None
    for s in range(n):
        shared = _shard(dealt, s)
        part = narrow.mapInArrow(_scanner(shared, uuid.uuid4().hex, window, 1), out).drop("text")
        part = materialise(part if s == 0 else part.filter("__longest > 0"), "decontam-shard")  # the first has a row for each document
        shared.unpersist()
        parts = part if parts is None else parts.union(part)
    merged = parts.groupBy("__row").agg(
        F.max("__n_words").alias("__n_words"),
        F.sort_array(F.flatten(F.collect_list("__spans"))).alias("s"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"),
        F.max("__longest").alias("__longest"),
    )
    union = F.aggregate(
        "s",
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]),
            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(a, F.array(x))),
    )
    united = merged.select("__row", "__n_words", union.alias("__spans"), "__items", "__longest")
    scanned = keyed.join(united, "__row").select(*[F.col(f"`{c}`") for c in docs.columns], "__n_words", "__spans", "__items", "__longest")
    return scanned.mapInArrow(_cutter(at, len(docs.columns) + 1), schema) if cut else scanned


def _hit():
    return F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


@keeps_columns
def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs without hit spans; documents with a hit share over max_coverage are dropped. The columns stay.

    A span reaches from its first word's first character to its last word's last; n_chars follows the text.
    """
    clean = scan(docs, items, window, cut=True).filter(_hit() <= max_coverage * F.col("__n_words"))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.size("__spans") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def _cutter(text_at: int, spans_at: int):
    """The text without its spans, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(batch.columns)
            spans = ([(s["start"], s["end"]) for s in x] for x in own[spans_at].to_pylist())
            own[text_at] = pa.array([_without(t.as_py(), s) for t, s in zip(own[text_at], spans)], own[text_at].type)
            yield pa.RecordBatch.from_arrays(own, names=batch.schema.names)

    return run


def _without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    if not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    parts, last = [], 0
    for start, end in spans:
        parts.append(raw[last : at[start][0]])
        last = at[end - 1][1]
    return b"".join([*parts, raw[last:]]).decode()


def op1(docs: DataFrame, items: DataFrame) -> DataFrame:
    found = scan(docs.select("doc_id", "text"), items)
    n_hit = _hit()
    return found.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


SQL = """
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM low),
it AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
ks AS (SELECT DISTINCT least(10, len(w)) AS k FROM it WHERE len(w) > 0),
ig AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT dg.doc_id, dg.k, dg.i, ig.item FROM dg JOIN ig ON dg.g = ig.g AND dg.k = ig.k),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(found.ids, '')) AS items_sha256,
  coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same by comparing windows directly, for tests."""
    grams: dict[tuple, set[str]] = {}
    for item, text in items:
        words = norm_words(text)
        k = min(window, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            grams.setdefault(tuple(words[i : i + k]), set()).update([] if item is None else [str(item)])
    out = []
    for doc, text in docs:
        words, hit, found = norm_words(text), set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(words) - k + 1):
                if (ids := grams.get(tuple(words[i : i + k]))) is not None:
                    found |= ids
                    hit |= set(range(i, i + k))
        out.append((doc, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out
