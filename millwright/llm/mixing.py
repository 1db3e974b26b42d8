"""Mixing sources to target weights by soft membership.

A classifier fitted to the labels table gives each document posteriors over domains (``DOMAINS``: good
clean text, toxic text, poor text).  Rates r, between 0 and ``max_rate``, minimise the squared gaps
between expected domain totals, the sums of r x tokens x posterior, and target totals; of all rates that do,
those nearest to 1 are taken.  By duality a rate is 1 plus the posteriors' product with one weight a domain,
clipped, so only these few weights are solved for: by Newton steps, each one pass over a narrow written table
that returns sums for the step and shorter ones, until every domain's gradient is below ``TOLERANCE`` of its
own goal, be its share of the tokens ever so small.  The pull towards 1 is lowered step by step to ``PULL`` of
the rarest domain's share.  Rates are computed again wherever they are needed, so that no state
is kept on executors.  A rate becomes copies: its whole part, and one more with its fraction as the
probability, decided by a hash of doc_id.

The classifier is a softmax regression over shape features and hashed words, fitted to at most
``SAMPLE_ROWS`` labelled rows (least hashes of doc_id); tokens, posteriors and totals cover all rows.

Defined cases: a null or empty text has no tokens and the posterior of no evidence; several labels of one
doc_id: the worst counts; without labels of two domains all posteriors are equal; targets that can't be
reached are approached as the least squares say; repeated rows share rate and copies; an empty table
gives an empty table; further columns pass through ``resample`` untouched.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, keeps_columns, materialise, sole

DOMAINS = ("clean", "toxic", "poor")
#: Target totals as multiples of what a domain has.
TARGETS = {"clean": 1.2, "toxic": 0.05, "poor": 0.25}
MAX_RATE = 4.0
SAMPLE_ROWS = 10_000
BUCKETS = 1 << 12
SHAPES = 12
PASSES = 200  # a bound for safety, told when met; 10 to 25 are usual
TOLERANCE = 1e-3
PULL = 1e-4
#: Lengths tried of each Newton step.
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01)
CACHE_WORDS = 60_000


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = b = xxhash.xxh64_intdigest(word.strip(".,;:!?\"'()").lower()) % BUCKETS
        return b


_BUCKET = _Buckets()


def features(text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
    """Tokens, shape features, and the distinct buckets of the words."""
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256) / max(1, len(raw))
    lines = text.split("\n")
    shape = np.array(
        [
            np.log1p(len(words)) / 8, len(raw) / n / 16, counts[65:91].sum() * 4, counts[48:58].sum() * 8, counts[33] * 16, counts[124] * 16,
            counts[[35, 36, 37, 38, 42, 60, 62]].sum() * 8, counts[[44, 46]].sum() * 16, counts[128:].sum(), 1 - len(set(lines)) / len(lines),
            1 - len(set(words)) / n if words else 0.0, float(len(words) < 20),
        ]
    )
    return len(words), shape, np.unique(np.fromiter(map(_BUCKET.__getitem__, words), np.int64, len(words)))


@dataclass
class Classifier:
    shape: np.ndarray  # (SHAPES + 1) x domains, the last row the intercept
    words: np.ndarray  # BUCKETS x domains

    def posterior(self, shape: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        z = shape @ self.shape[:-1] + self.shape[-1]
        if len(buckets):
            z = z + self.words[buckets].sum(axis=0) / np.sqrt(len(buckets))
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_classifier(shapes: np.ndarray, buckets: list[np.ndarray], y: np.ndarray, steps: int = 150) -> Classifier:
    """Penalised softmax regression by Adam over the whole bounded sample."""
    k, n = len(DOMAINS), len(y)
    model = Classifier(np.zeros((SHAPES + 1, k)), np.zeros((BUCKETS, k)))
    if n == 0 or len(set(y.tolist())) < 2:
        return model
    x = np.hstack([shapes, np.ones((n, 1))])
    sizes = np.array([len(b) for b in buckets])
    index = np.concatenate(buckets).astype(np.int64)
    row = np.repeat(np.arange(n), sizes)
    weight = np.repeat(1 / np.sqrt(np.maximum(sizes, 1)), sizes)
    truth = np.eye(k)[y]
    params = [model.shape, model.words]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        z = x @ model.shape
        for c in range(k):
            z[:, c] += np.bincount(row, weights=model.words[index, c] * weight, minlength=n)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        gap = (p / p.sum(axis=1, keepdims=True) - truth) / n
        slopes = [x.T @ gap + 1e-4 * model.shape, np.stack([np.bincount(index, weights=gap[row, c] * weight, minlength=BUCKETS) for c in range(k)], axis=1) + 2e-4 * model.words]
        for p_, g, m in zip(params, slopes, moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.999 * m[1] + 0.001 * g * g
            p_ -= 0.1 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)
    return model


def domain(quality: Column, toxic: Column) -> Column:
    """The number of a labelled row's domain."""
    return F.when(quality == 0, 2).when(toxic == 1, 1).otherwise(0)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sole(_BUCKET)
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([s.tolist() for _, s, _ in found], pa.list_(pa.float64())), pa.array([b.tolist() for _, _, b in found], pa.list_(pa.int32()))], names=["y", "shape", "buckets"]
        )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Classifier:
    own = labels.filter("doc_id is not null and (quality is not null or toxic is not null)")
    own = own.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).select("doc_id", domain(F.col("q"), F.col("x")).alias("y"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    joined = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(own), "doc_id")
    labelled = joined.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("text").alias("text")).drop("doc_id")  # at most sample rows
    rows = labelled.mapInArrow(_featurise, "y int, shape array<double>, buckets array<int>").toArrow().combine_chunks()
    shapes = rows["shape"].combine_chunks().flatten().to_numpy().reshape(-1, SHAPES)
    lists = rows["buckets"].combine_chunks()
    cuts = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1] if len(lists) else []
    buckets = np.split(lists.flatten().to_numpy(), cuts) if len(lists) else []
    return fit_classifier(shapes, buckets, rows["y"].to_numpy().astype(np.int64))


def _posteriors(shared, text_at: int, plan=None):
    """Adds tokens and posteriors, and with a plan the rate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sole(_BUCKET)
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column(text_at)]
            p = np.array([shared.value.posterior(s, b) for _, s, b in found]).reshape(-1, len(DOMAINS))
            extra = [pa.array([n for n, _, _ in found], pa.int64()), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))]
            rate = [pa.array(plan.value.rates(p))] if plan else []
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra, *rate], names=[*batch.schema.names, *_POSTERIOR, *["__rate"] * len(rate)])

    return run


_POSTERIOR = ["__tokens", *(f"__p_{d}" for d in DOMAINS)]


def with_posteriors(docs: DataFrame, model: Classifier, plan: Plan | None = None) -> DataFrame:
    """docs with __tokens and the posteriors __p_<domain>, and with a plan __rate."""
    share = docs.sparkSession.sparkContext.broadcast
    added = [T.StructField(c, T.LongType() if c == "__tokens" else T.DoubleType()) for c in _POSTERIOR + ["__rate"] * bool(plan)]
    run = _posteriors(share(model), docs.columns.index("text"), share(plan) if plan else None)
    return bounded_batches(docs).mapInArrow(run, T.StructType(docs.schema.fields + added))


@dataclass
class Plan:
    """A weight for each domain; from them any document's rate follows."""

    weights: np.ndarray
    max_rate: float

    def rates(self, p: np.ndarray) -> np.ndarray:
        """Of documents with posteriors p."""
        return np.clip(1 + p @ self.weights, 0.0, self.max_rate)


def _totals(tried: list[Plan]):
    """Of each plan: the dual's value without its linear part, domain totals, and curvature (_SUMS, in this order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tried), len(_SUMS)))
        for batch in batches:
            tokens, *p = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(1 + len(DOMAINS)))
            p = np.stack(p, axis=1)
            for own, plan in zip(sums, tried):
                z, rate = p @ plan.weights, plan.rates(p)
                free = (1 + z > 0) & (1 + z < plan.max_rate)
                own[0] += (tokens * (rate * z - (rate - 1) ** 2 / 2)).sum()
                own[1 : 1 + len(DOMAINS)] += (rate * tokens) @ p
                own[1 + len(DOMAINS) :] += ((p[free] * tokens[free, None]).T @ p[free]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(tried)), pa.int32()), *(pa.array(c) for c in sums.T)], names=["plan", *_SUMS])

    return run


_SUMS = ["value", *(f"total_{d}" for d in DOMAINS), *(f"curve_{d}_{e}" for d in DOMAINS for e in DOMAINS)]


def solve(rows: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE, passes: int = PASSES) -> Plan:
    """The plan whose rates bring rows (the columns of with_posteriors) to the targets, multiples of what domains have."""
    narrow = rows.select(*_POSTERIOR)
    size = len(DOMAINS)
    has = narrow.agg(F.sum("__tokens").alias("all"), *[F.sum(F.col("__tokens") * F.col(f"__p_{d}")).alias(d) for d in DOMAINS]).first()
    whole = float(has["all"] or 0)
    tried = [Plan(np.zeros(size), max_rate)]
    if not whole:
        return tried[0]
    own = np.array([has[d] for d in DOMAINS]) / whole
    goal = np.array([targets.get(d, 1.0) for d in DOMAINS]) * own
    small = TOLERANCE * np.maximum(goal, TOLERANCE * own)
    last = PULL * own[own > 0].min()
    pull = 1.0
    for _ in range(passes):
        schema = ", ".join(["plan int", *(f"{c} double" for c in _SUMS)])
        found = {r["plan"]: np.array(r[1:]) / whole for r in narrow.mapInArrow(_totals(tried), schema).groupBy("plan").agg(*[F.sum(c).alias(c) for c in _SUMS]).collect()}
        weights = [x.weights for x in tried]
        slopes = [found[i][1 : 1 + size] - goal + pull * w for i, w in enumerate(weights)]
        values = [found[i][0] - goal @ w + pull / 2 * w @ w for i, w in enumerate(weights)]
        best = int(np.argmin(values))
        if best == 0 and len(tried) > 1:  # values differ by rounding alone: the slopes decide
            best = int(np.argmin([np.abs(g / np.maximum(small, 1e-300)).max() for g in slopes]))
        stalled = best == 0 and len(tried) > 1
        plan, slope = tried[best], slopes[best]
        while stalled or (np.abs(slope) <= small).all():
            if pull <= last:
                if (np.abs(slope) > small).any():
                    warnings.warn(f"mixing: stopped by rounding at relative gradients {np.abs(slope) / np.maximum(small, 1e-300) * TOLERANCE}")
                return plan
            stalled = False
            slope = slope - pull * plan.weights
            pull = max(last, pull / 10)
            slope = slope + pull * plan.weights
        step = np.linalg.solve(found[best][1 + size :].reshape(size, size) + pull * np.eye(size), -slope)
        tried = [plan, *(Plan(plan.weights + length * step, max_rate) for length in LENGTHS)]
    warnings.warn(f"mixing: not solved within {passes} passes, relative gradients {np.abs(slope) / np.maximum(small, 1e-300) * TOLERANCE}")
    return tried[0]


def _rated(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(DOMAINS)
        for batch in batches:
            p = np.stack([batch.column(batch.num_columns - k + i).to_numpy(zero_copy_only=False) for i in range(k)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.rates(p))], names=[*batch.schema.names, "__rate"])

    return run


def with_rates(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (with posteriors as their last columns) with __rate."""
    schema = T.StructType(rows.schema.fields + [T.StructField("__rate", T.DoubleType())])
    return rows.mapInArrow(_rated(rows.sparkSession.sparkContext.broadcast(plan)), schema)


def with_copies(rated: DataFrame) -> DataFrame:
    """rated with __copies: the rate's whole part, and one more if a hash of doc_id falls under its fraction."""
    draw = F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 53)) / F.lit(float(1 << 53))
    whole = F.floor("__rate")
    return rated.withColumn("__copies", (whole + (draw < F.col("__rate") - whole).cast("long")).cast("int"))


def _weighed(docs: DataFrame, labels: DataFrame, targets: dict[str, float], max_rate: float) -> tuple[DataFrame, Classifier, Plan]:
    model = fit(docs, labels)
    narrow = materialise(with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "mixing")
    return narrow, model, solve(narrow, targets, max_rate)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """doc_id, tokens, posteriors, rate and copies, one row per row of docs."""
    narrow, _, plan = _weighed(docs, labels, targets, max_rate)
    return with_copies(with_rates(narrow, plan)).select("doc_id", *[F.col(c).alias(c[2:]) for c in (*_POSTERIOR, "__rate", "__copies")])


@keeps_columns
def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, max_rate: float = MAX_RATE) -> DataFrame:
    """docs, each row as often as its copies say; the columns stay."""
    _, model, plan = _weighed(docs, labels, targets, max_rate)
    rated = with_copies(with_posteriors(docs, model, plan)).filter("__copies > 0")
    return rated.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return mix(docs, labels)
