"""Token-ID output: bit-plane shuffled blocks with a chunk index.

Documents are range-partitioned by doc_id and sorted; each partition becomes one shard, a stream of
unsigned 32-bit ids with the end id after each document.  The stream is cut into blocks of ``block_ids``
ids (a shard's last one is shorter).  A block is transposed into byte planes (plane k holds byte k of
every id) or bit planes, each plane is compressed with zstandard by itself, and planes that are all zero
are stored empty.  A block is one row of a Parquet table in the shared folder, beside its index: shard,
chunk, first position in the shard, number of ids, and which documents' pieces it holds.  Writing through
Spark's committer means a lost executor's tasks are simply run again.

Words are encoded once each: the tokenizer drops white space and never joins across it, so a text's ids
are those of its space-separated pieces in turn, and a bounded cache of pieces spares most of the work.

Defined cases: a null or empty text is the end id alone; repeated rows are written each, in order of
doc_id, then of a hash of the text; null doc_ids come first; an empty table gives an empty store; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, fresh_path, partitions, sole

BLOCK_IDS = 1 << 16
END_ID = 1
LEVEL = 3
CACHE_PIECES = 450_000
CACHE_PIECE_CHARS = 64
SCHEMA = (
    "shard int, chunk int, first long, n_ids int, planes array<binary>, first_row long,"
    " doc_ids array<long>, lengths array<int>"
)


def to_planes(ids: bytes, kind: str = "byte") -> list[bytes]:
    """Little-endian 32-bit ids as 4 byte planes or 32 bit planes."""
    view = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [np.ascontiguousarray(view[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(view, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> bytes:
    """The reverse; an empty plane is all zero."""
    if len(planes) == 4:
        out = np.zeros((n, 4), dtype=np.uint8)
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, dtype=np.uint8)
        return out.tobytes()
    bits = np.zeros((n, 32), dtype=np.uint8)
    for k, p in enumerate(planes):
        if p:
            bits[:, k] = np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").tobytes()


_LATIN = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_BINARY = re.compile("[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 as is, the rest from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Pieces(dict):
    """A bounded cache from pieces between white space to their ids as little-endian bytes.

    A piece of Latin letters with ASCII punctuation behind it, the usual word, is two pre-tokens: its
    letters, in lower case, and the rest; both are looked up or given to the model by themselves.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        super().__init__()
        self.limit = limit
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # pieces are cached here already
        self.letters = _byte_letters()
        # the short way holds for tokenizers that lower-case, drop white space and work on bytes in words
        probe = ["Ab,", "ÉÖß?!", "don't", "x"]
        self.old: dict[str, bytes] = {}
        self.short = True
        self.short = all(self._letters_way(*m.groups()) == self._whole(p) for p in probe if (m := _LATIN.fullmatch(p)))

    def _whole(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _lower(self, low: str) -> bytes:
        written = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode()))
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _letters_way(self, letters: str, rest: str) -> bytes:
        return self[letters.lower()] + self[rest] if rest else self[letters.lower()]

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            if not self.short or len(piece) > CACHE_PIECE_CHARS:
                ids = self._whole(piece)
                if len(piece) > CACHE_PIECE_CHARS:
                    return ids
            elif piece.isascii() and piece.isalpha() and piece.islower():
                ids = self._lower(piece)
            elif m := _LATIN.fullmatch(piece):
                letters, rest = m.groups()
                low = letters.lower()
                if low == piece:
                    ids = self._lower(low)
                else:
                    fresh = low not in self
                    ids = self._letters_way(letters, rest)
                    if fresh:  # the word alone is kept the first time, with its case and punctuation the next
                        return ids
            else:
                ids = self._whole(piece)
        if len(self) >= self.limit:  # the last generation is kept beside the new one
            self.old = dict(self)
            super().clear()
        self[piece] = ids
        return ids

    short = False

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        # str.split() also breaks at four control characters that are no white space to the tokenizer
        return b"".join(map(self.__getitem__, text.split(" ") if _BINARY.search(text) else text.split()))


_PIECES: dict[str, Pieces] = {}


def pieces(path: str, limit: int) -> Pieces:
    """One per worker process; worker processes serve many tasks."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(path, limit)
    _PIECES[path].limit = limit
    return _PIECES[path]


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())),
        ("first_row", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
    ]
)


def _writer(path: str, end_id: int, block_ids: int, kind: str, level: int, cache: int) -> Callable:
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shard, press = sole(pieces(path, cache)), TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=level)
        pending: list[bytes] = []
        docs: deque[list] = deque()  # doc_id, row in the shard, ids that no block has yet
        size = row = chunk = first = 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal pending, size, chunk, first
            data = b"".join(pending)
            pending, size = [data[4 * n :]], len(data) - 4 * n
            planes = [press.compress(p) if p.strip(b"\0") else b"" for p in to_planes(data[: 4 * n], kind)]
            out = {"shard": shard, "chunk": chunk, "first": first, "n_ids": n, "planes": planes, "first_row": docs[0][1], "doc_ids": [], "lengths": []}
            chunk, first = chunk + 1, first + n
            while n:
                take = min(n, docs[0][2])
                out["doc_ids"].append(docs[0][0])
                out["lengths"].append(take)
                docs[0][2] -= take
                n -= take
                if not docs[0][2]:
                    docs.popleft()
            return pa.RecordBatch.from_pylist([out], schema=_ARROW)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = known.encode(text.as_py()) + end
                pending.append(ids)
                size += len(ids)
                docs.append([doc, row, len(ids) // 4])
                row += 1
                while size >= 4 * block_ids:
                    yield block(block_ids)
        if size:
            yield block(size // 4)

    return write


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, kind: str = "byte", level: int = LEVEL,
    cache_pieces: int = CACHE_PIECES,
) -> None:
    """Writes docs (doc_id, text) as a token store at path; a worker caches twice cache_pieces pieces at most."""
    # ids are written as array('I'), which is 32 bits wide and little-endian wherever Spark runs
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    ordered = bounded_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions(docs.sparkSession), "doc_id")
    ordered = ordered.withColumn("h", F.xxhash64("text")).sortWithinPartitions("doc_id", "h").drop("h")
    ordered.mapInArrow(_writer(tokenizer, end_id, block_ids, kind, level, cache_pieces), SCHEMA).write.option("compression", "none").parquet(path)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    expand = zstandard.ZstdDecompressor()
    for batch in batches:
        for i in range(batch.num_rows):
            block = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield block, from_planes([expand.decompress(p) if p else b"" for p in block["planes"]], block["n_ids"])


def _pieces_of(block: dict, ids: bytes) -> Iterator[tuple]:
    at = 0
    for k, (doc, n) in enumerate(zip(block["doc_ids"], block["lengths"])):
        yield block["shard"], block["first_row"] + k, doc, block["first"] + at, n, ids[4 * at : 4 * (at + n)]
        at += n


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, ids in _blocks(batches):
        shard, row, doc, first, n, data = zip(*_pieces_of(block, ids))
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array(shard, pa.int32()), "row": pa.array(row, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "first": pa.array(first, pa.int64()), "n": pa.array(n, pa.int64()), "crc": pa.array([zlib.crc32(d) for d in data], pa.int64())}
        )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, ids in _blocks(batches):
        shard, row, doc, first, n, data = zip(*_pieces_of(block, ids))
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array(shard, pa.int32()), "row": pa.array(row, pa.int64()), "doc_id": pa.array(doc, pa.int64()), "first": pa.array(first, pa.int64()), "n": pa.array(n, pa.int64()), "ids": pa.array(data, pa.binary())}
        )


def _with_start(pieces_: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Adds the ids in all shards before a piece's own; there is a row for each shard, so for each write task."""
    counts = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    base, run = [], 0
    for c in counts:
        base.append((c["shard"], run))
        run += c["n"]
    return pieces_.join(F.broadcast(spark.createDataFrame(base, "shard int, base long")), "shard")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit)."""
    found = spark.read.schema(SCHEMA).parquet(path).mapInArrow(_contents, "shard int, row long, doc_id long, first long, n long, ids binary")
    whole = found.groupBy("shard", "row", "doc_id").agg(F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("first", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return _with_start(whole, spark, path).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", joined.alias("ids"))


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, without moving ids: pieces' sums are combined."""
    found = spark.read.schema(SCHEMA).parquet(path).mapInArrow(_digests, "shard int, row long, doc_id long, first long, n long, crc long")
    whole = found.groupBy("shard", "row", "doc_id").agg(F.min("first").alias("first"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("first", "n", "crc"))).alias("p"))
    crc = F.when(F.size("p") == 1, F.col("p")[0]["crc"]).otherwise(_combined("p"))
    return _with_start(whole, spark, path).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", crc.alias("ids_crc32"))


@F.udf(T.LongType(), useArrow=True)
def _combined(parts):
    crc = 0
    for p in parts:
        crc = crc_combine(crc, p["crc"], 4 * p["n"])
    return crc


def crc_combine(a: int, b: int, n: int) -> int:
    """crc32 of A + B from crc32 of A, crc32 of B and B's n bytes: A's is multiplied by x^(8n) mod the polynomial."""

    def times(x: int, y: int) -> int:
        out = 0
        for k in range(31, -1, -1):  # bit 31 is x^0
            if y >> k & 1:
                out ^= x
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        return out

    power, square, k = 1 << 31, 1 << 23, n  # x^0, x^8
    while k:
        if k & 1:
            power = times(power, square)
        square = times(square, square)
        k >>= 1
    return times(a, power) ^ b


def op10(docs: DataFrame, **options) -> DataFrame:
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, **options)
    return digest_tokens(docs.sparkSession, path)
