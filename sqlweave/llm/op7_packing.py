"""Operator 7, packing by minimum bin slack.

A document of n tokens gives floor(n / capacity) full pieces, each a sequence
of its own, and one remainder. The remainders' lengths are below the capacity,
so the whole corpus enters the search as one count per length, whatever its
size. Windows are filled from the longest remaining length: a bitset
subset-sum over the bounded counts finds the multiset of remaining lengths that
comes closest to the capacity, backtracking gives its counts, and the window is
repeated as often as the counts allow. A length that no multiset completes is
set aside; at the end these pieces are laid end to end and cut at every
capacity, so that only the last sequence has padding.

Where a piece lies follows from its length and its rank among pieces of that
length: ranks come from one range-partitioned pass, so no length, however
common, meets in one task.

Nulls: a null text counts as empty; an empty text is its end id alone. Repeated
rows are documents of their own. Very long texts are cut into full pieces like others. Ties
between pieces of one length go by row number. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load, slices
from sqlweave.llm.op1_bpe import PATTERN, tables_of, vocabulary
from sqlweave.operators.numbering import row_numbers
from sqlweave.session import write_table

CAPACITY = 1024
LONG_TEXT = 400_000  # characters from which texts go through this package's encoder
END_ID = 0


def fill_window(counts: dict[int, int], target: int) -> tuple[int, dict[int, int]]:
    """(largest reachable sum <= target, how many of each length make it)."""
    mask, reach, steps = (1 << target + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, lot = min(counts[length], target // length), 1
        while left > 0:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= (reach << length * lot) & mask
            left, lot = left - lot, lot * 2
        if reach >> target & 1:
            break
    best = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, lot, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + lot
            at -= length * lot
    return best, used


def plan_windows(counts: dict[int, int], capacity: int) -> tuple[list, dict[int, int]]:
    """([(times, {length: how many})], counts of the lengths set aside)."""
    counts = {k: n for k, n in counts.items() if n > 0 and k > 0}
    windows, aside = [], {}
    while counts:
        seed = max(counts)
        rest = {k: n - (k == seed) for k, n in counts.items() if n > (k == seed)}
        best, used = fill_window(rest, capacity - seed)
        if best < capacity - seed:
            aside[seed] = counts.pop(seed)
            continue
        used[seed] = used.get(seed, 0) + 1
        times = min(counts[k] // m for k, m in used.items())
        windows.append((times, used))
        for k, m in used.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
    return windows, aside


def segments(windows: list, aside: dict[int, int], counts: dict[int, int], capacity: int):
    """Per length the rank ranges (first rank, sequence, pieces a sequence, offset, wrapped).

    In a wrapped range ``offset`` is the place of its first piece on the line that is cut.
    """
    out: dict[int, list] = {k: [] for k in counts}
    at, sequence = {k: 0 for k in counts}, 0
    for times, used in windows:
        offset = 0
        for length, m in used.items():
            out[length].append((at[length], sequence, m, offset, False))
            at[length] += m * times
            offset += m * length
        sequence += times
    place = 0
    for length in sorted(aside, reverse=True):
        out[length].append((at[length], sequence, 0, place, True))
        place += length * aside[length]
    return out, sequence + -(-place // capacity)


_QUICK: dict[int, object] = {}


def quick_encoder(spec):
    """A function from text to ids with the vocabulary's own exact results, built once per worker.

    Rank-ordered vocabularies are encoded by the tiktoken library; it takes ids for
    ranks, so others go to this package's encoder.
    """
    if spec.id not in _QUICK:
        t = tables_of(spec)
        made = [(r, i) for i, r in enumerate(t.rank) if r >= 0]
        singles = [i for i, r in enumerate(t.rank) if r < 0 and t.length[i] == 1]
        ordered = sorted(made) == sorted(made, key=lambda x: x[1]) and max(singles) < min(i for _, i in made)
        _QUICK.clear()
        if ordered:
            import tiktoken
            ranks = {t.blob[t.offsets[i]:t.offsets[i + 1]].tobytes(): i for i in range(len(t.length)) if t.length[i]}
            lib = tiktoken.Encoding("vocabulary", pat_str=PATTERN.replace("++", "+"), mergeable_ranks=ranks,
                                    special_tokens=t.added)
            # the library's pattern gives up on runs of about a million characters
            _QUICK[spec.id] = lambda x: (np.array(t.encode(x), np.uint32) if len(x) >= LONG_TEXT else
                                         lib.encode_to_numpy(x, allowed_special="all", disallowed_special=()))
        else:
            _QUICK[spec.id] = lambda x: np.array(t.encode(x), np.uint32)
    return _QUICK[spec.id]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenize(df: DataFrame, spec, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, full array<long>, rest_len, rest_crc long, rest binary, wide).

    ``full`` has the CRC-32 of each full piece; ``rest`` the ids left over, in 2 bytes
    each, or 4 where the vocabulary is ``wide``.
    """
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        ids_of, wide = quick_encoder(spec), tables_of(spec).wide
        for b in slices(batches):
            n, full, crc, rest = [], [], [], []
            for x in b.column(1).to_pylist():
                ids = np.append(ids_of(x or ""), np.uint32(END_ID))
                cut = len(ids) // capacity * capacity
                n.append(len(ids))
                full.append([_crc(ids[i:i + capacity]) for i in range(0, cut, capacity)])
                crc.append(_crc(ids[cut:]))
                rest.append(ids[cut:].astype("<u4" if wide else "<u2").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())),
                 pa.array([x % capacity for x in n], pa.int32()), pa.array(crc, pa.int64()),
                 pa.array(rest, pa.binary()),
                 pa.array([wide] * len(n), pa.bool_())],
                [key, "n_tokens", "full", "rest_len", "rest_crc", "rest", "wide"])
    return df.select(key, text).mapInArrow(
        run, f"`{key}` {ktype}, n_tokens long, full array<long>, rest_len int, rest_crc long, "
             "rest binary, wide boolean")


def place_pieces(docs: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """Pieces of tokenized documents: where each lies, and the CRC-32 of its ids."""
    spark = docs.sparkSession
    docs = write_table(docs.withColumn("_row", F.monotonically_increasing_id()), "tokens")
    counts = {r[0]: r[1] for r in docs.groupBy("rest_len").count().collect()}  # < capacity rows
    lengths = {k: n for k, n in counts.items() if k}
    parts, n_windows = segments(*plan_windows(lengths, capacity), lengths, capacity)
    first, base = {}, 0
    for k in sorted(counts):
        first[k], base = base, base + counts[k]
    ranked = row_numbers(
        docs.select("_row", key, "n_tokens", "rest_len", "rest_crc", F.size("full").cast("long").alias("_full")),
        ["rest_len", "_row"], sums={"_full_before": "_full"})
    shared = spark.sparkContext.broadcast((parts, first))  # bounded by the capacity, not by the rows

    def place(batches):
        parts, first = shared.value
        starts = {k: np.array([p[0] for p in v]) for k, v in parts.items()}
        for b in batches:
            lens, rns = b.column("rest_len").to_pylist(), b.column("rn").to_pylist()
            rows, seq, off, at, size, cut = [], [], [], [], [], []
            for i, (k, rn) in enumerate(zip(lens, rns)):
                rank = rn - first[k]
                a, s, m, o, wraps = parts[k][int(np.searchsorted(starts[k], rank, "right")) - 1]
                if not wraps:
                    j = rank - a
                    pieces = [(s + j // m, o + j % m * k, 0, k)]
                else:
                    p = o + (rank - a) * k
                    head = min(k, capacity - p % capacity)
                    pieces = [(s + p // capacity, p % capacity, 0, head)]
                    if head < k:
                        pieces.append((s + p // capacity + 1, 0, head, k - head))
                for q, f, begin, n in pieces:
                    for to, x in zip((rows, seq, off, at, size, cut), (i, q, f, begin, n, n < k)):
                        to.append(x)
            kept = b.select(["_row", key, "n_tokens", "rest_len", "rest_crc"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(at, pa.int64()), pa.array(size, pa.int64()),
                 pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(cut, pa.bool_())],
                [*kept.schema.names, "_at", "length", "sequence_id", "offset", "_cut"])

    ktype = docs.schema[key].dataType.simpleString()
    placed = write_table(
        ranked.filter("rest_len > 0").select("_row", key, "n_tokens", "rest_len", "rest_crc", "rn").mapInArrow(
            place, f"_row long, `{key}` {ktype}, n_tokens long, rest_len int, rest_crc long, _at long, "
                   "length long, sequence_id long, offset long, _cut boolean"), "placed")

    def checksum(batches):
        for b in batches:
            sums = [_crc(np.frombuffer(ids, "<u4" if wide else "<u2")[at:at + size]) for ids, wide, at, size in
                    zip(*(b.column(c).to_pylist() for c in ("rest", "wide", "_at", "length")))]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in out), pa.array(sums, pa.int64())], [*out, "rest_crc"])

    # only pieces that were cut need their ids again
    out = [key, "n_tokens", "rest_len", "_at", "length", "sequence_id", "offset"]
    cut = (placed.filter("_cut").select("_row", *out).join(docs.select("_row", "rest", "wide"), "_row")
           .mapInArrow(checksum, f"`{key}` {ktype}, n_tokens long, rest_len int, _at long, length long, "
                                 "sequence_id long, offset long, rest_crc long"))
    tails = placed.filter("not _cut").select(*out, "rest_crc").unionByName(cut).select(
        key, (F.col("n_tokens") - F.col("rest_len") + F.col("_at")).alias("start"), "length",
        F.col("rest_crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset")
    whole = (docs.filter(F.size("full") > 0).select("_row", key, "n_tokens", "full")
             .join(ranked.filter("_full > 0").select("_row", "_full_before"), "_row")
             .select(key, "n_tokens", "_full_before", F.posexplode("full").alias("_i", "ids_crc32"))
             .select(key, (F.col("_i").cast("long") * capacity).alias("start"),
                     F.lit(capacity).cast("long").alias("length"), "ids_crc32",
                     F.col("n_tokens").alias("doc_tokens"),
                     (F.lit(n_windows) + F.col("_full_before") + F.col("_i")).alias("sequence_id"),
                     F.lit(0).cast("long").alias("offset")))
    return tails.unionByName(whole)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text) packed into sequences of ``capacity`` ids."""
    spec = vocabulary(docs.sparkSession, path)
    return place_pieces(tokenize(docs, spec, capacity), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return pack(load(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
