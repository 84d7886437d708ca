"""Operator 6, language identification with bit-sliced n-gram filters.

Learning counts letter trigrams per language over all training rows. A trigram
belongs to a language if its relative frequency there is at least 1 / RATIO of
its highest relative frequency in any language, and at least RARE of that
language's trigrams; so a language has at most 1 / RARE trigrams and the model is
bounded whatever the corpus. The filter is one array of language bitmasks: the
AND of a trigram's K positions gives at once all languages that contain it.

A text is scored by all its trigrams: per-language popcounts, corrected for the
language's false-positive rate (the share of set bits to the power K); the
largest decides and, divided by the number of trigrams, is the score. Ties go to
the first language in order; texts without any known trigram get the most
common training language and score 0.

Nulls and texts without a letter give ``und`` and score 0. Rows with null lang are
not learned from. Without training rows every text gives ``und``. Repeated rows
count each; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load, slices
from sqlweave.session import ship_package

K = 3  # positions of a trigram
RATIO = 8
RARE = 2e-6
CHUNK = 1 << 20  # characters held as trigrams at a time
FLUSH = 1 << 20

_LETTERS: list = []


def letters() -> np.ndarray:
    """Per code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def trigrams(text: str):
    """Packed trigrams (21 bits a character) around every letter, in chunks; others count as space."""
    is_letter = letters()
    text = " " + text.lower() + " "
    for i in range(0, len(text) - 2, CHUNK):
        c = np.frombuffer(text[i:i + CHUNK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        ok = is_letter[c]
        c = np.where(ok, c, 32).astype(np.int64)
        yield ((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[ok[1:-1]]


def positions(grams: np.ndarray, bits: int):
    """K positions of each trigram in a filter of 2 ** bits."""
    x = grams.astype(np.uint64)
    for k in range(K):
        h = (x ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        yield (h >> np.uint64(64 - bits)).astype(np.int64)


def gram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n) over all rows with a language; counted in the task before the shuffle."""
    ship_package(df.sparkSession)

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def rows():
            langs, grams, counts = [], [], []
            for k, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                langs += [k] * len(g)
                grams.append(g)
                counts.append(n)
            held.clear()
            if not langs:
                return pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()),
                                                   pa.array([], pa.int64())], ["lang", "gram", "n"])
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(np.concatenate(grams)),
                                               pa.array(np.concatenate(counts).astype(np.int64))],
                                              ["lang", "gram", "n"])
        for b in slices(batches):
            for x, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g in trigrams(x or ""):
                    held.setdefault(k, []).append(g)
                    size += len(g)
                    if size >= FLUSH:
                        yield rows()
                        size = 0
        yield rows()
    parts = df.filter(F.col(lang).isNotNull()).select(text, lang).mapInArrow(run, "lang string, gram long, n long")
    return parts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Languages, the filter, false-positive rates and the default language."""

    def __init__(self, langs, table, fp, default, bits):
        self.langs, self.table, self.fp, self.default, self.bits = langs, table, fp, default, bits

    def predict(self, text) -> tuple[str, float]:
        n, counts = 0, np.zeros(len(self.langs), np.int64)
        for g in trigrams(text or ""):
            n += len(g)
            if not len(g) or not self.langs:
                continue
            at = positions(g, self.bits)
            mask = self.table[next(at)]
            for p in at:
                mask = mask & self.table[p]
            for i in range(len(counts)):
                counts[i] += np.count_nonzero(mask & self.table.dtype.type(1 << i))
        if not n or not self.langs:
            return "und", 0.0
        fixed = np.maximum(0.0, (counts - n * self.fp) / np.maximum(1e-9, 1 - self.fp))
        best = int(np.argmax(fixed))
        if fixed[best] <= 0:
            return self.default, 0.0
        return self.langs[best], float(min(1.0, fixed[best] / n))


def fit(train: DataFrame, text: str = "text", lang: str = "lang", max_langs: int = 64) -> Model:
    """Learn the filter from all rows of ``train`` that have a language."""
    from sqlweave.session import write_table
    counts = write_table(gram_counts(train, text, lang), "grams")
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    if len(langs) > max_langs:
        raise ValueError(f"{len(langs)} languages; a mask has {max_langs} bits")
    if not langs:
        return Model([], None, None, "und", 0)
    total = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v))])
    bit = F.create_map(*[F.lit(x) for i, k in enumerate(langs) for x in (k, 1 << i if i < 63 else -(1 << 63))])
    share = counts.withColumn("share", F.col("n") / total[F.col("lang")])
    top = share.groupBy("gram").agg(F.collect_list(F.struct("share", "lang")).alias("each"),  # a row per language
                                    F.max("share").alias("top")).filter(F.col("top") >= RARE)
    mask = F.aggregate(F.filter("each", lambda x: (x["share"] * RATIO >= F.col("top")) & (x["share"] >= RARE)),
                       F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(bit[x["lang"]]))
    rows = top.select("gram", mask.alias("mask")).toPandas()  # at most len(langs) / RARE rows
    bits = max(10, int(np.ceil(np.log2(max(1, len(rows)) * K / np.log(2)))))
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    table = np.zeros(1 << bits, kind)
    masks = rows["mask"].to_numpy(np.int64).astype(np.uint64).astype(kind)
    for p in positions(rows["gram"].to_numpy(np.int64), bits):
        np.bitwise_or.at(table, p, masks)
    fp = np.array([np.count_nonzero(table & kind(1 << i)) / len(table) for i in range(len(langs))]) ** K
    default = min(langs, key=lambda k: (-totals[k], k))
    return Model(langs, table, fp, default, bits)


def predict(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) for every row."""
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in slices(batches):
            out = [shared.value.predict(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()),
                                              pa.array([x[1] for x in out], pa.float64())],
                                             [key, "lang_pred", "score"])
    return df.select(key, text).mapInArrow(run, f"`{key}` {ktype}, lang_pred string, score double")


def keep(docs: DataFrame, model: Model, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that have a language with at least that score."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        for b in slices(batches):
            found = [shared.value.predict(x) for x in b.column(at).to_pylist()]
            yield b.filter(pa.array([k != "und" and s >= least for k, s in found], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def held_out(key: str = "doc_id"):
    """True for the fold that is never learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from three of four folds."""
    docs = load(spark, sf_dir, "documents")
    model = fit(docs.filter(F.coalesce(~held_out(), F.lit(True))))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
                                       "lang_pred", "score")


QUERIES = {"op6_langid": op6_langid}
SQL: dict[str, str] = {}
