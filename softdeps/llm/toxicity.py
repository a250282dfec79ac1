"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other) with weights learned from labels.  Small weighted transducers read the symbols of a
clause: one softens what a negation governs, one what reported speech introduces, one strengthens an insult or threat that meets a target.  Their
composition scores clauses, not isolated words; a document's score is the calibrated sum over its clauses.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from softdeps.llm.common import arrow, map_batches, stage

# Seed words of each symbol in the languages of the texts.  Insults and threats seen in training get learned weights.
SEEDS = {
    "I": "idiot idiots moron morons stupid dumb loser losers pathetic scum trash worthless clown disgusting imbecile idiota imbécil estúpido inútil "
    "abruti connard débile crétin trottel arschloch dummkopf",
    "T": "kill murder strangle stab shoot töten umbringen tuer matar matarte",
    "U": "you your yourself u ya dich dir dein deine euch toi tes vous votre usted ustedes tú eres",
    "N": "not no never isn't aren't don't without nicht kein keine niemals pas jamais aucun nunca jamás tampoco",
    "R": "said says wrote writes called calls quoted reported allegedly sagte schrieb nannte zitierte écrit appelé cité dijo escribió llamó citó",
}
SEED_WEIGHT = {"I": 3.0, "T": 2.0}
CLAUSE_END = frozenset(".;:!?\n,()")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.;:!?\n,()]")

# Bounds of learning: labelled rows per class, shortest and longest word beginnings, evidence (log odds) and number of learned patterns.
SAMPLE, SHORTEST, LONGEST, EVIDENCE, PATTERNS = 4000, 4, 8, 3.5, 2000
THRESHOLD = 0.3

Rule = tuple[int, str, float]
Transducer = dict[tuple[int, str], Rule]
SYMBOLS = "ITUNRO"


def transducer(n_states: int, rules: dict[tuple[int, str], Rule]) -> Transducer:
    """A complete machine: a missing rule keeps state and symbol at no weight."""
    return {(q, s): rules.get((q, s), (q, s, 0.0)) for q in range(n_states) for s in SYMBOLS}


def negation(scope: int = 3, weight: float = -2.5) -> Transducer:
    """An insult or threat within ``scope`` words after a negation weighs less; states count what is left of the scope."""
    rules = {(q, s): (max(0, q - 1), s, weight if q and s in "IT" else 0.0) for q in range(scope + 1) for s in SYMBOLS}
    return transducer(scope + 1, rules | {(q, "N"): (scope, "N", 0.0) for q in range(scope + 1)})


def reported(weight: float = -1.5) -> Transducer:
    """After a word of saying, the clause's insults and threats are someone else's."""
    return transducer(2, {(0, "R"): (1, "R", 0.0), (1, "I"): (1, "I", weight), (1, "T"): (1, "T", weight)})


def targeted(weight: float = 1.0) -> Transducer:
    """An insult or threat and a target in one clause, in either order, weigh more, once.  States: nothing, target, attack, both."""
    attack = {(0, s): (2, s, 0.0) for s in "IT"} | {(1, s): (3, s, weight) for s in "IT"}
    return transducer(4, attack | {(0, "U"): (1, "U", 0.0), (2, "U"): (3, "U", weight)})


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The machine that feeds the first one's output to the second; weights add.  States are pairs, numbered from the start."""
    number, out, work = {(0, 0): 0}, {}, [(0, 0)]
    while work:
        p, q = work.pop()
        for s in SYMBOLS:
            p2, middle, w1 = first[p, s]
            q2, last, w2 = second[q, middle]
            if (p2, q2) not in number:
                number[p2, q2] = len(number)
                work.append((p2, q2))
            out[number[p, q], s] = (number[p2, q2], last, w1 + w2)
    return out


GRAMMAR = compose(compose(negation(), reported()), targeted())


class Lexicon:
    """Symbols and weights of words: whole words and word beginnings."""

    def __init__(self, words: dict[str, tuple[str, float]], begins: dict[str, float]):
        self.words, self.begins = words, begins
        self.lengths = sorted({len(b) for b in begins})
        self.memo: dict[str, tuple[str, float] | None] = {}

    def of(self, word: str) -> tuple[str, float] | None:
        if (found := self.words.get(word)) is None:
            for n in self.lengths:
                if (weight := self.begins.get(word[:n])) is not None:
                    found = ("I", weight)
                    break
        if len(self.memo) >= 300_000:
            self.memo.clear()
        self.memo[word] = found
        return found

    def score(self, text: str) -> float:
        """Sum over clauses of what the grammar makes of their words; a clause never counts below zero."""
        tokens, memo, missing = TOKEN.findall(text.lower()), self.memo, object()
        marks = []
        for at, token in enumerate(tokens):
            found = memo.get(token, missing)
            if found is missing:
                found = self.of(token)
            if found is not None:
                marks.append((at, found))
        if not any(symbol in "IT" for _, (symbol, _) in marks):
            return 0.0
        known, total = dict(marks), 0.0
        state, clause = 0, 0.0
        for at, token in enumerate(tokens):
            if token in CLAUSE_END:
                total += max(0.0, clause)
                state, clause = 0, 0.0
            else:
                symbol, weight = known.get(at, ("O", 0.0))
                state, _, more = GRAMMAR[state, symbol]
                clause += weight + more if symbol in "IT" else more
        return total + max(0.0, clause)


def held_out(doc_id="doc_id"):
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` labelled rows of each class outside the held-out fold, chosen by a hash, with their texts; and the classes' sizes."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    picked = F.broadcast(picks[0].unionAll(picks[1]).dropDuplicates(["doc_id"]))  # at most 2 * per_class rows of two numbers
    return stage(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select("text", "toxic"), "sample"), sizes


def learn(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[Lexicon, float, float]:
    """A lexicon and the calibration ``(slope, intercept)``.  Without labelled rows the seeds and a fixed calibration hold."""
    sample, sizes = training_sample(docs, labels, per_class)
    seeds = {w: s for s, words in SEEDS.items() for w in words.split()}
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    words = {w: (s, SEED_WEIGHT.get(s, 0.0)) for w, s in seeds.items()}
    if not n0 or not n1:
        return Lexicon(words, {}), 1.0, -2.0

    def beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, toxic = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = set()
                for word in set(TOKEN.findall(text.lower())):
                    found.update(word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1))
                    if word in seeds:
                        found.add(word + "$")
                features += found
                toxic += [label] * len(found)
            yield arrow({"feature": (features, pa.string()), "toxic": (toxic, pa.int32())})

    counts = map_batches(sample, beginnings, "feature string, toxic int").groupBy("feature").agg(F.sum("toxic").alias("f1"), F.count(F.lit(1)).alias("f"))
    odds = F.log(((F.col("f1") + 0.5) / (n1 + 1)) / ((F.col("f") - F.col("f1") + 0.5) / (n0 + 1))).alias("odds")
    seed, support = F.col("feature").endswith("$"), max(3, n1 // 400)
    strong = counts.select("feature", "f1", odds).where(seed | ((F.col("f1") >= support) & (F.col("odds") >= EVIDENCE)))
    rows = strong.orderBy(seed.desc(), (F.col("f1") * F.col("odds")).desc(), "feature").limit(PATTERNS).collect()  # bounded by PATTERNS
    begins: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["feature"]), r["feature"])):
        word = r["feature"]
        if word.endswith("$"):
            symbol = seeds[word[:-1]]
            if symbol in "IT":
                words[word[:-1]] = (symbol, max(0.0, r["odds"]))
        elif not any(word[:k] in begins for k in range(SHORTEST, len(word))):
            begins[word] = r["odds"]
    lexicon = Lexicon(words, begins)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield arrow({"raw": ([lexicon.score(t) for t in batch.column(0).to_pylist()], pa.float64()), "toxic": (batch.column(1), pa.int32())})

    fit = map_batches(sample, scored, "raw double, toxic int").collect()  # at most 2 * per_class rows
    x, y = np.array([math.log1p(r["raw"]) for r in fit]), np.array([r["toxic"] for r in fit], float)
    weight = np.where(y == 1, sizes[1] / n1, sizes[0] / n0)
    return lexicon, *calibrated(x, y, weight / weight.mean())


def calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Weighted logistic regression of one feature by Newton steps; the ridge keeps separable classes finite."""
    design, beta = np.stack([x, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - np.array([ridge, 1e-3]) * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([ridge, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).  Scores depend on the text alone.

    Null and empty texts get the score of a text without any pattern.  A null ``doc_id`` is not held out.  Repeated rows score alike; further columns
    pass through; columns of the new names are replaced.
    """
    docs = docs.drop("held_out", "score", "predicted")
    lexicon, slope, intercept = learn(docs, labels, per_class)
    lexicon.memo.clear()
    names, at = list(docs.columns), docs.columns.index("text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.array([lexicon.score(t) if t else 0.0 for t in batch.column(at).to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(slope * np.log1p(raw) + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    scored = map_batches(docs, task, ", ".join([*(f"`{n}` {t}" for n, t in docs.dtypes), "score double"]))
    return scored.select(*docs.columns, held_out().alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
