"""Toxicity as a weighted finite-state grammar over clauses, fitted to labelled rows.

A lexicon reads words as classes: insult (with a weight), threat, target, negation, negative pronoun, report
verb, intensifier, quotation mark, or nothing.  A clause's classes run through one cascade of weighted
transducers, composed into two tables.  Left to right: the insult transducer turns insults into plain marks
(an intensifier before one raises its weight), the negation transducer negates marks and threats for the next
``SCOPE`` words (a negative pronoun to the clause's end), the report transducer turns what follows a report
verb, or the quotation behind it, into reported marks, and the target transducer aims marks behind a target
and gives out a menace where a threat and a target meet.  Right to left over that output: marks before a
target are aimed, and a quotation that a report verb follows is reported.  Lines, full stops and their like
end a clause, as do colons unless they announce what someone said.  A document's score is the logistic of the
weighted sums of its matched clauses; each insult word counts once a document and way of use.

What is learned, from labelled rows only: the insults.  Words and word beginnings (stems) are counted by
label, features are picked greedily by how many toxic rows they explain that no earlier pick does, words
under a picked stem get weights shrunk to the stem's, and the coefficients of the five outputs start from
fixed priors and are fitted by penalised logistic regression that allows for ``NOISE`` wrong labels.  Rows
are bounded to ``SAMPLE_ROWS`` (least hashes of doc_id, one row a doc_id), one for each group of near copies
with a label, so repeated texts don't vote; what reaches the driver is bounded by that sample.

Defined cases: a null or empty text scores the model's floor; null doc_ids are scored and never learned
from; several labels of one doc_id: toxic if any is; several texts of one doc_id: the least is learned from;
without usable labels the fixed seed words and prior coefficients hold; repeated rows score alike; further
columns pass through ``drop_toxic`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, keeps_columns, materialise, sole

SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6, 7, 8)
FAMILIES = 3
LIMIT = 0.7
SCOPE = 3
CACHE_TOKENS = 80_000

# The grammar's closed classes.
TARGETS = "you your yours yourself he she they them their tu toi vous votre ton du dich dir euch ihr sie usted ustedes ti vos".split()
NEGATIONS = "not never no none isn't aren't wasn't don't without nicht kein keine nie niemals ohne pas jamais aucun sans nunca jamás ningún sin".split()
NOBODIES = "nobody nothing niemand nichts personne rien nadie nada".split()
REPORTS = "said says wrote called claimed quoted reported alleged sagte schrieb behauptete zitierte dit écrit déclaré affirmé dijo escribió afirmó".split()
THREATS = "kill hurt stab shoot strangle murder töten umbringen verprügeln tuer frapper étrangler matar golpear".split()
BOOSTS = "such total complete utter absolute real totaler totale kompletter vrai vraie total verdadero".split()
SEEDS = "idiot moron scum loser stupid worthless pathetic".split()
SEED_WEIGHT = 4.0
#: Log odds above which a feature can mark toxic rows.
ODDS = 2.5

OTHER, TARGET, NEGATION, NOBODY, REPORT, THREAT, BOOST, QUOTE, INSULT, PLAIN, AIMED, NEGATED, REPORTED, MENACE = range(14)
#: Outputs: insults plain, aimed at a target, negated, reported; menaces.
MARKS = (PLAIN, AIMED, NEGATED, REPORTED, MENACE)
OUTPUTS = len(MARKS)
BOOSTED = 1.25
#: Words between a quotation's end and the verb that reports it.
BEHIND = 3
#: Prior coefficients of the intercept and the outputs, and how firmly each is held.
PRIOR = np.array([-3.0, 1.0, 1.2, 0.3, 0.4, 3.0])
FIRMNESS = np.array([50.0, 0.5, 0.5, 0.5, 0.5, 0.5])
#: The share of labels taken to be wrong.
NOISE = 0.01


#: arcs[state][symbol] is (next state, symbol given out, weight); a symbol without an arc keeps the state and passes.
Transducer = list[dict[int, tuple[int, int, float]]]


def compose(one: Transducer, two: Transducer) -> Transducer:
    """The transducer that reads what one gives out with two, as far as it can be reached; weights multiply."""
    number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
    for a, b in todo:
        row = {}
        for symbol in range(14):
            to_a, middle, u = one[a].get(symbol, (a, symbol, 1.0))
            to_b, out, v = two[b].get(middle, (b, middle, 1.0))
            if (to_a, to_b) not in number:
                number[to_a, to_b] = len(number)
                todo.append((to_a, to_b))
            row[symbol] = (number[to_a, to_b], out, u * v)
        arcs.append(row)
    return arcs


def _insults() -> Transducer:
    back = {c: (0, c, 1.0) for c in range(14) if c not in (BOOST, INSULT)}
    return [{INSULT: (0, PLAIN, 1.0), BOOST: (1, BOOST, 1.0)}, back | {INSULT: (0, PLAIN, BOOSTED)}]


def _negation(scope: int) -> Transducer:
    """States 0 to scope: so many words are still negated; the last: all are."""
    whole = scope + 1
    arcs: Transducer = []
    for s in range(whole + 1):
        left = s if s == whole else max(0, s - 1)
        row = {c: (left, c, 1.0) for c in range(14) if c != QUOTE} | {NEGATION: (max(s, scope), NEGATION, 1.0), NOBODY: (whole, NOBODY, 1.0)}
        arcs.append(row | ({PLAIN: (left, NEGATED, 1.0), THREAT: (left, OTHER, 1.0)} if s else {}))
    return arcs


def _reports() -> Transducer:
    """What follows a report verb: all of it, or if a quotation opens, that."""
    told = {c: REPORTED for c in (PLAIN, NEGATED)} | {THREAT: OTHER}
    return [{REPORT: (1, REPORT, 1.0)}, *[{c: (s, out, 1.0) for c, out in told.items()} | {QUOTE: (to, QUOTE, 1.0)} for s, to in ((1, 2), (2, 0))]]


def _targets() -> Transducer:
    """States: nothing, a target, a threat, both."""
    return [
        {TARGET: (1, TARGET, 1.0), THREAT: (2, THREAT, 1.0)},
        {PLAIN: (1, AIMED, 1.0), THREAT: (3, MENACE, 1.0)},
        {TARGET: (3, MENACE, 1.0)},
        {PLAIN: (3, AIMED, 1.0)},
    ]


def _targets_behind() -> Transducer:
    """From right to left; a menace stands for its target."""
    return [{TARGET: (1, TARGET, 1.0), MENACE: (1, MENACE, 1.0)}, {PLAIN: (1, AIMED, 1.0)}]


def _reports_behind(reach: int) -> Transducer:
    """From right to left: a quotation that ends up to so many words before a report verb. The last state is within it."""
    inside = reach + 2
    arcs: Transducer = [{REPORT: (1, REPORT, 1.0)}]
    for s in range(1, reach + 2):
        arcs.append({c: ((s + 1) % (reach + 2), c, 1.0) for c in range(14) if c not in (REPORT, QUOTE)} | {REPORT: (1, REPORT, 1.0), QUOTE: (inside, QUOTE, 1.0)})
    return [*arcs, {c: (inside, REPORTED, 1.0) for c in (PLAIN, AIMED, NEGATED)} | {MENACE: (inside, OTHER, 1.0), REPORT: (inside, REPORT, 1.0), QUOTE: (0, QUOTE, 1.0)}]


FORWARD = compose(compose(compose(_insults(), _negation(SCOPE)), _reports()), _targets())
BACKWARD = compose(_targets_behind(), _reports_behind(BEHIND))

_PARTS = regex.compile(r"[\p{L}\p{M}']+|[\"\u201c\u201d\u201e\u00ab\u00bb]")
_QUOTES = frozenset("\"\u201c\u201d\u201e\u00ab\u00bb")
#: A clause's end; an end inside a quotation, which ends no clause that goes on with a report; an announcement.
_ENDS = regex.compile(r"[.!?;]")
_ENDS_QUOTE = regex.compile(r"[.!?][\"\u201c\u201d\u00ab\u00bb],?$")
STOP, QUOTED_STOP, COLON = 1, 2, 3


@dataclass
class Model:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    coefficients: np.ndarray = field(default_factory=lambda: PRIOR.copy())

    def insult(self, word: str) -> float:
        """The weight of a word: its own, or that of its longest stem."""
        if (own := self.words.get(word)) is not None:
            return own
        for k in reversed(STEMS):
            if len(word) > k and (w := self.stems.get(word[:k])) is not None:
                return w
        return 0.0


_FIXED = {w: c for c, own in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (NOBODY, NOBODIES), (REPORT, REPORTS), (THREAT, THREATS), (BOOST, BOOSTS)) for w in own}


class Reader(dict):
    """Tokens (space-separated) to (class, weight, word) for each word, how they end a clause, and whether they matter."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def read(self, token: str) -> tuple | None:
        words = []
        for word in _PARTS.findall(token.lower()):
            if word in _QUOTES:
                words.append((QUOTE, 0.0, word))
            else:
                weight = self.model.insult(word)
                words.append((INSULT if weight else _FIXED.get(word, OTHER), weight, word))
        ends = QUOTED_STOP if _ENDS_QUOTE.search(token) else STOP if _ENDS.search(token) else COLON if token.endswith(":") else 0
        matters = any(c in (INSULT, THREAT) for c, _, _ in words)
        return (words, ends, matters) if matters or ends or any(c for c, _, _ in words) else None

    def __missing__(self, token: str) -> tuple | None:
        found = self.read(token)
        if len(token) <= 64:
            if len(self) >= CACHE_TOKENS:
                self.clear()
            self[token] = found
        return found

    @staticmethod
    def _reports(read: list) -> bool:
        return any(r and any(c == REPORT for c, _, _ in r[0]) for r in read)

    def _over(self, read: list, i: int, lo: int) -> bool:
        """Whether a clause that began at lo ends behind token i."""
        ends = read[i][1] if read[i] else 0
        if ends == COLON:
            return not self._reports(read[lo : i + 1])
        return ends == STOP or ends == QUOTED_STOP and not self._reports(read[i + 1 : i + 2 + BEHIND])

    def outputs(self, text: str | None) -> list[float]:
        """The sums of the grammar's five outputs over a whole text."""
        sums = [0.0] * OUTPUTS
        used: set[tuple[int, str]] = set()
        for line in (text or "").split("\n"):
            read = list(map(self.__getitem__, line.split()))
            at = [i for i, r in enumerate(read) if r and r[2]]
            lo = done = 0
            for i in at:
                if i < done:
                    continue
                while done <= i:
                    lo = done
                    while done < len(read) and not self._over(read, done, lo):
                        done += 1
                    done += 1
                self._clause(read[lo:done], sums, used)
        return sums

    @staticmethod
    def _clause(read: list, sums: list[float], used: set[tuple[int, str]]) -> None:
        state, given = 0, []
        for r in read:
            for c, weight, word in r[0] if r and r[0] else ((OTHER, 0.0, ""),):
                state, out, factor = FORWARD[state][c]
                given.append((out, weight * factor, word))
        state = 0
        for c, weight, word in reversed(given):
            state, out, factor = BACKWARD[state][c]
            if out == MENACE:
                sums[4] += 1.0
            elif out >= PLAIN and (out, word) not in used:
                used.add((out, word))
                sums[out - PLAIN] += weight * factor


def _featurise(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = sole(Reader(shared.value))
        for batch in batches:
            x = [reader.outputs(t.as_py()) for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(x, pa.list_(pa.float64()))], names=[*batch.schema.names, "__x"])

    return run


def _scorer(shared, text_at: int):
    featurise = _featurise(shared, text_at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beta = shared.value.coefficients
        for batch in featurise(batches):
            x = np.array(batch.column(batch.num_columns - 1).flatten()).reshape(-1, OUTPUTS)
            z = np.clip(beta[0] + x @ beta[1:], -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], names=[*batch.schema.names[:-1], "__score"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(toxic, text): the bounded sample of labelled rows that may be learned from."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    own = own.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").filter("text is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return rows.select(F.col("toxic").cast("int").alias("toxic"), "text")


def _stems(words: Column, k: int) -> Column:
    return F.transform(F.filter(words, lambda w: F.char_length(w) > k), lambda w: F.substring(w, 1, k))


def _least(hashes: Column, seed: int) -> Column:
    return F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(seed))))


def _counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their words, one for each group of near copies and label, and (feature, toxic rows, rows)."""
    rows = rows.select("toxic", F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{M}']+"), lambda w: w != "").alias("w"))
    shingles = F.when(
        F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    ).otherwise(F.array(F.xxhash64("w")))
    rows = rows.select("toxic", F.array_distinct("w").alias("words"), shingles.alias("s"))
    rows = rows.select("toxic", "words", *[_least(F.col("s"), k).alias(f"m{k}") for k in range(FAMILIES)])
    rows = rows.withColumn("id", F.xxhash64("words"))
    own = F.struct("id", *[f"m{k}" for k in range(FAMILIES)], "words")
    for k in range(FAMILIES):  # rows that share a min-hash of shingles are near copies: the one of least hash stays, however they lie
        rows = rows.groupBy(f"m{k}", "toxic").agg(F.min(own).alias("first")).select("toxic", "first.*")
    rows = materialise(rows.select("toxic", "words"), "toxicity-rows")
    stems = [_stems(F.col("words"), k) for k in STEMS]
    features = F.concat(F.transform("words", lambda w: F.concat(F.lit("="), w)), F.array_distinct(F.flatten(F.array(*stems))))
    counts = rows.select("toxic", F.explode(features).alias("f")).groupBy("f").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    return rows, materialise(counts, "toxicity-counts")


def _matches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            found = []
            for words in batch.column(1):
                own = {number.get("=" + w) for w in words.as_py()} | {number.get(w[:k]) for w in words.as_py() for k in STEMS if len(w) > k}
                found.append(sorted(own - {None}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "found"])

    return run


def pick(names: list[str], a: np.ndarray, b: np.ndarray, sizes: tuple[int, int], pairs: tuple[np.ndarray, np.ndarray], gain: float = 7.0, evidence: float = 11.0) -> list[int]:
    """The features that mark toxic rows: those with strong evidence of their own, then greedily what explains the rest.

    Evidence is the log likelihood ratio of a feature's labels against the base rate.  A stem whose rows are
    those of one of its words is left to the word.  pairs are (toxic row, feature), sizes the numbers of toxic
    and clean rows.
    """
    n_toxic, n_clean = sizes
    rows, features = pairs
    share = n_toxic / (n_toxic + n_clean)
    strong = np.ones(len(names), dtype=bool)
    most: dict[str, int] = {}
    for i, name in enumerate(names):
        if name[0] == "=":
            for k in STEMS:
                most[name[1 : k + 1]] = max(most.get(name[1 : k + 1], 0), int(a[i]))
    for i, n in enumerate(names):
        if n[0] != "=" and a[i] < 1.2 * most.get(n, 0) + 1:
            strong[i] = False
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = a * np.log(a / ((a + b) * share)) + np.where(b > 0, b * np.log(b / ((a + b) * (1 - share))), 0.0)
    taken = strong & (ratio >= evidence)
    chosen = np.flatnonzero(taken).tolist()
    left = np.ones(n_toxic, dtype=bool)
    left[rows[taken[features]]] = False
    while left.any() and strong.any():
        u = np.bincount(features[left[rows]], minlength=len(names))
        gains = np.where(strong & (u >= 2), u * (np.log((u + 1) / (left.sum() + 2)) - np.log((b + 1) / (n_clean + 2))), 0.0)
        i = int(gains.argmax())
        if gains[i] < gain:
            break
        chosen.append(i)
        left[rows[features == i]] = False
    return chosen


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    spark, context = docs.sparkSession, docs.sparkSession.sparkContext
    sampled = materialise(training_rows(bounded_batches(docs), labels, sample), "toxicity-sample")
    rows, counts = _counts(sampled)
    size = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("a"), F.count("*").alias("n")).first()
    n_toxic, n_clean = int(size["a"]), int(size["n"]) - int(size["a"])
    model = Model()
    if n_toxic and n_clean:
        odds = F.log((F.col("a") + 0.5) / (n_toxic + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (n_clean + 1))
        best = counts.filter("a >= 2").filter(odds > ODDS).orderBy("f").collect()  # words of the bounded sample
        names = [r["f"] for r in best]
        shared = context.broadcast({f: i for i, f in enumerate(names)})
        lists = rows.filter("toxic = 1").mapInArrow(_matches(shared), "toxic int, found array<int>").toArrow()["found"].combine_chunks()
        pairs = (np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        a, b = (np.array([r[k] for r in best], dtype=np.int64).reshape(-1) for k in ("a", "n"))
        chosen = pick(names, a, b - a, (n_toxic, n_clean), pairs)
        share = n_toxic / n_clean
        for i in chosen:
            w = float(np.log((a[i] + 0.5) / (n_toxic + 1)) - np.log((b[i] - a[i] + 0.5) / (n_clean + 1)))
            (model.words if names[i][0] == "=" else model.stems)[names[i].lstrip("=")] = w
        if model.stems:
            stems = F.broadcast(spark.createDataFrame(list(model.stems.items()), "stem string, w double"))  # chosen from the sample's words
            words = counts.filter("f like '=%'").select(F.substring("f", 2, 1 << 30).alias("word"), "a", "n")
            stem = F.explode(F.array(*[F.when(F.char_length("word") > k, F.substring("word", 1, k)) for k in STEMS])).alias("stem")
            own = words.select("word", "a", "n", stem).join(stems, "stem").groupBy("word").agg(F.max("a").alias("a"), F.max("n").alias("n"), F.max_by("stem", F.char_length("stem")).alias("stem"))
            for r in own.orderBy("word").collect():
                q = 1 / (1 + np.exp(-model.stems[r["stem"]]))
                odds_w = (r["a"] + 2 * q) / ((r["n"] - r["a"]) * share + 2 * (1 - q))
                model.words[r["word"]] = float(np.log(odds_w))
    for w in SEEDS:
        model.words.setdefault(w, SEED_WEIGHT)
    x = sampled.mapInArrow(_featurise(context.broadcast(model), 1), "toxic int, text string, __x array<double>").select("toxic", "__x").toArrow()
    if n_toxic and n_clean:
        outputs = x["__x"].combine_chunks().flatten().to_numpy().reshape(-1, OUTPUTS)
        toxic = x["toxic"].to_numpy().astype(float)
        order = np.lexsort((toxic, *outputs.T))  # sums of floats are the same however the rows lie
        model.coefficients = _logistic(np.hstack([np.ones((len(outputs), 1)), outputs])[order], toxic[order])
    return model


def _logistic(x: np.ndarray, y: np.ndarray, noise: float = NOISE) -> np.ndarray:
    """Scoring steps towards the penalised optimum around PRIOR; signs of evidence stay as in the prior."""
    beta = PRIOR.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        seen, bend = noise + (1 - 2 * noise) * p, (1 - 2 * noise) * p * (1 - p)
        spread = seen * (1 - seen)
        slope = x.T @ ((y - seen) * bend / spread) - FIRMNESS * (beta - PRIOR)
        step = np.linalg.solve((x * (bend * bend / spread)[:, None]).T @ x + np.diag(FIRMNESS), slope)
        step *= min(1.0, 1.0 / max(1e-12, np.abs(step).max()))
        beta = beta + step
        beta[1:] = np.maximum(beta[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __score, the probability that a text is toxic."""
    schema = T.StructType(docs.schema.fields + [T.StructField("__score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return bounded_batches(docs).mapInArrow(_scorer(shared, docs.columns.index("text")), schema)


@keeps_columns
def drop_toxic(docs: DataFrame, model: Model, limit: float = LIMIT) -> DataFrame:
    """docs whose score is under limit."""
    return score(docs, model).filter(F.col("__score") < limit).drop("__score")


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= LIMIT).cast("int").alias("predicted")
    )
