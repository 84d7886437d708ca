"""Operator 2, quality classifier: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Their votes enter the label model as counts per vote pattern (at most 3 to the
number of labellers rows), so expectation-maximisation estimates every labeller's
accuracies from all documents at a size that doesn't grow with them. Each
pattern's posterior is the soft label of its documents. A logistic scorer over
hashed features (words, word shapes and binned measures of the text) is trained on a
bounded sample of SAMPLE documents, chosen by the hash of their key, and scores
every document by its whole text.

Nulls and texts without a word score 0 and aren't kept. Repeated rows count each.
Empty tables give no rows. A table whose documents all have one class is fitted with
smoothed accuracies and keeps the score's meaning. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import Recent, load, slices
from sqlweave.session import ship_package

SAMPLE = 8_000  # documents that train the scorer
BITS = 18  # hashed features: 2 ** BITS
ROUNDS = 60
KEEP = 0.5
GOOD, BAD, NONE = "+", "-", "."
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def measures(text: str) -> dict[str, float]:
    """What the labellers look at; each is a share between 0 and 1, but for n_words."""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    rows = [x for x in text.split("\n") if x and not x.isspace()]
    letters = len(_NOT_LETTERS.sub("", text))
    return {"n_words": n, "symbols": sum(map(text.count, "#*$%&|<>")) / chars,
            "upper": sum(map(text.count, UPPER)) / max(1, letters), "letters": letters / chars,
            "shouts": min(1.0, text.count("!") / max(1, n)),
            "lines": 1 - len(set(rows)) / max(1, len(rows)),
            "pairs": 1 - len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 0.0,
            "words": 1 - len(set(words)) / max(1, n),
            "ends": min(1.0, sum(map(text.count, ".?!")) / max(1, n))}


def _bad(name: str, limit: float, least: int = 5):
    """Vote bad from a value of a measure on, else nothing."""
    return lambda m: BAD if m["n_words"] >= least and m[name] >= limit else NONE


#: The labellers. Those that look for one kind of damage vote bad or nothing; those
#: that look for prose vote good or nothing, or take either side.
LABELLERS = {
    "symbols": _bad("symbols", 0.05),
    "letters": lambda m: NONE if m["n_words"] < 5 else BAD if m["letters"] < 0.7 else GOOD if m["letters"] >= 0.77 else NONE,
    "upper": _bad("upper", 0.35),
    "shouts": _bad("shouts", 0.2),
    "lines": _bad("lines", 0.5),
    "pairs": _bad("pairs", 0.45, 20),
    "words": _bad("words", 0.75, 40),
    "sentences": lambda m: NONE if m["n_words"] < 20 else GOOD if 0.01 <= m["ends"] <= 0.3 else BAD,
    "plain": lambda m: GOOD if m["symbols"] <= 0.02 and m["upper"] <= 0.2 and m["shouts"] <= 0.05 else NONE,
    "fresh": lambda m: GOOD if m["pairs"] <= 0.3 and m["lines"] <= 0.35 and m["symbols"] <= 0.02 else NONE,
}


def votes(text: str | None) -> str:
    m = measures(text or "")
    return "".join(f(m) for f in LABELLERS.values())


def label_model(counts: dict[str, int], rounds: int = ROUNDS):
    """(prior of good, per labeller P(vote | class) as rows good and bad, posterior per pattern) by EM.

    The tables start from the labellers' intent: a vote for damage outweighs
    votes for prose. A labeller that nearly always votes the same learns that its
    vote says little, so its silence or dissent says more.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([[(GOOD, BAD, NONE).index(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    post = 1 / (1 + np.exp(-(1.0 + (v == 0).sum(1) - 3.0 * (v == 1).sum(1))))
    prior, tables = 0.5, []
    for _ in range(rounds):
        prior = (post @ n + 1) / (n.sum() + 2)
        tables = []
        for j in range(v.shape[1]):
            t = np.ones((2, 3))  # one pseudo-count a vote
            for k in range(3):
                t[0, k] += (post * n)[v[:, j] == k].sum()
                t[1, k] += ((1 - post) * n)[v[:, j] == k].sum()
            tables.append(t / t.sum(1, keepdims=True))
        log = np.log(prior) - np.log1p(-prior) + sum(
            np.log(t[0, v[:, j]]) - np.log(t[1, v[:, j]]) for j, t in enumerate(tables))
        post = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
    return prior, tables, dict(zip(patterns, post))


def _shape(word: str) -> str:
    out = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) >> (32 - BITS)


def word_slots(word: str) -> tuple[int, int]:
    return _slot("w " + word.lower()), _slot("s " + _shape(word))


def text_slots(text: str) -> list[int]:
    """Hashed bins of the measures; they weigh as much as all words together."""
    return [_slot(f"m {k} {round(v * 10) if k != 'n_words' else min(10, int(v).bit_length())}")
            for k, v in measures(text).items()]


def features(text: str, slots) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values) of a text; ``slots`` maps a word to its two slots."""
    words = text.split()
    own = text_slots(text)
    flat = np.fromiter((i for w in words for i in slots[w]), np.int32, 2 * len(words))
    at, inverse = np.unique(np.concatenate([flat, np.array(own, np.int32)]), return_inverse=True)
    value = np.bincount(inverse, np.concatenate([np.full(len(flat), 1 / max(1, len(flat))),
                                                 np.full(len(own), 1 / len(own))]))
    return at, value


def train_scorer(rows: list, steps: int = 200, rate: float = 2.0, ridge: float = 1e-6):
    """Logistic weights from [(slots, values, soft label)], by full-batch adaptive steps."""
    w, bias = np.zeros(1 << BITS), 0.0
    if not rows:
        return w, bias
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    used, local = np.unique(at, return_inverse=True)
    weight = np.where(y > 0.5, 0.5 / max(1e-9, y.sum()), 0.5 / max(1e-9, (1 - y).sum()))  # classes weigh the same
    weight = weight / weight.sum()
    u, g2, b2 = np.zeros(len(used)), np.full(len(used), 1e-12), 1e-12
    for _ in range(steps):
        z = np.bincount(owner, u[local] * value, len(rows)) + bias
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        g = np.bincount(local, error[owner] * value, len(used)) + ridge * u
        g2 += g * g
        u -= rate * g / np.sqrt(g2)
        b = error.sum()
        b2 += b * b
        bias -= 0.1 * b / np.sqrt(b2)
    w[used] = u
    return w, bias


class Scorer:
    def __init__(self, weights, bias):
        self.weights, self.bias, self.memo = weights.astype(np.float32), float(bias), None

    def score(self, text: str | None) -> float:
        words = (text or "").split()
        if not words:
            return 0.0
        if self.memo is None:
            w = self.weights
            self.memo = Recent(lambda x: float(sum(w[i] for i in word_slots(x))))
        own = text_slots(text)
        z = (sum(map(self.memo.turn().__getitem__, words)) / (2 * len(words))
             + float(sum(self.weights[i] for i in own)) / len(own) + self.bias)
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Scorer:
    """Label model over all rows, scorer on the sample."""
    ship_package(docs.sparkSession)
    docs = docs.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t"))

    def vote(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([votes(x) for x in b.column(0).to_pylist()], pa.string())],
                                             ["votes"])
    counts = {r[0]: r[1] for r in docs.select("t").mapInArrow(vote, "votes string").groupBy("votes").count().collect()}
    total = sum(counts.values())
    if not total:
        return Scorer(np.zeros(1 << BITS), 0.0)
    posterior = label_model(counts)[2]
    every = max(1, -(-total // sample))

    def describe(batches):
        memo = Recent(word_slots)
        for b in slices(batches):
            out = [(votes(x), *features(x or "", memo.turn())) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in out], pa.string()),
                 pa.array([x[1].astype("<i4").tobytes() for x in out], pa.binary()),
                 pa.array([x[2].astype("<f4").tobytes() for x in out], pa.binary())], ["k", "votes", "at", "value"])
    chosen = docs.filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).mapInArrow(
        describe, "k string, votes string, at binary, value binary")
    rows = sorted((r["k"] or "", bytes(r["at"]), bytes(r["value"]), r["votes"]) for r in chosen.toLocalIterator())
    return Scorer(*train_scorer([(np.frombuffer(a, "<i4"), np.frombuffer(v, "<f4").astype(float), posterior[p])
                                 for _, a, v, p in rows]))


def score(df: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row, by its whole text."""
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        s = Scorer(*shared.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.score(x) for x in b.column(1).to_pylist()], pa.float64())], [key, "score"])
    return df.select(key, text).mapInArrow(run, f"`{key}` {ktype}, score double")


def keep(docs: DataFrame, scorer: Scorer, text: str = "text", least: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``least``; nothing is shuffled."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((scorer.weights, scorer.bias))
    at = docs.columns.index(text)

    def run(batches):
        s = Scorer(*shared.value)
        for b in slices(batches):
            yield b.filter(pa.array([s.score(x) >= least for x in b.column(at).to_pylist()], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, and which are kept."""
    docs = load(spark, sf_dir, "documents")
    return score(docs, fit(docs)).withColumn("kept", F.col("score") >= KEEP)


QUERIES = {"op2_quality": op2_quality}
SQL: dict[str, str] = {}
