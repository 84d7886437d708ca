"""Operator 9, near-duplicate detection with DartMinHash signatures.

A text is the weighted set of its 5-word shingles, weighted by their counts; the
similarity of two texts is sum of minima over sum of maxima, linked from 0.8.
An element of weight w owns the region [0, w] of unit cells. Every cell throws
darts at the times of a hashed Poisson process, each at a hashed coordinate; a
coordinate keeps its earliest dart. The time limit is set from the total weight
so that about K (ln K + 3) darts land in all, and doubles while a coordinate is
empty; the earliest dart doesn't depend on the limit, so signatures of different
texts agree on a coordinate with exactly their weighted similarity.

Signatures are cut into BANDS bands of ROWS coordinates; a pair of similarity
0.8 shares no band with probability (1 - 0.8^5)^28 < 2e-5.

Texts of equal words are one node, named by a 128-bit hash of its words, so copies cost one row each and rows
that share an id but not their text stay apart. In every bucket the members are first compared
with one leader, not with each other: the member that meets most others over all its buckets, which
in a group of edited copies is the text they were made from; verified links give components.
Buckets that still hold several components are then searched whole, in blocks of bounded size, by
parity bitmaps: every unit cell flips one bit, so bitmaps differ in no more bits than the
sets in cells, and texts of similarity 0.8 differ in at most a ninth of both weights. Only pairs of
different components that pass this bound, which loses none, leave the block. All links
are verified on the exact shingle multisets.

Words are runs of non-space characters of the lower-cased text; a text of one
to four words is one shingle. Very long texts are signed whole.

Nulls: a null text or doc_id is in a class of its own (a null doc_id has a null
class). Texts without words are copies of each other. Repeated rows share a
class. Ties for a class's first member go to the smallest id, then the smallest text hash. Where rows share an
id but not their text, classes of one id are told apart by ``class_key``. Empty tables give no
rows. Extra columns are ignored by the query.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import Recent, load, slices
from sqlweave.operators.graph import connected_components
from sqlweave.session import drop_table, ship_package, write_table

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 5, 28
BLOCK = 512  # members of a bucket that are compared with as many others in one step
BLOOM_IDS = 1 << 23  # ids up to which a broadcast filter (16 bits each) picks candidates' texts

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def shingles(words: list[str], memo) -> np.ndarray:
    """Hashes of all 5-word windows in order; short texts are one window."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    out = np.zeros(n - size + 1, np.uint64)
    for i in range(size):
        out = mix(out + h[i:n - size + 1 + i] + _U(0x9E3779B97F4A7C15 * (i + size) % 2**64))
    return out


def unit_cells(elements: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell hashes, part of each cell that is owned) of weighted elements."""
    n = np.ceil(weights).astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    part = np.minimum(1.0, weights[owner] - level)
    return mix(elements[owner] + mix(level.astype(np.uint64) + _U(0x632BE59BD9B4E019))), part


def cells_of(words: list[str], memo) -> np.ndarray:
    """One hash per shingle occurrence: the text's weighted set as a plain set."""
    elements, counts = np.unique(shingles(words, memo), return_counts=True)
    return unit_cells(elements, counts.astype(float))[0]


def signature(cells: np.ndarray, parts: np.ndarray | None = None, k: int = ROWS * BANDS) -> np.ndarray:
    """Time of the earliest dart per coordinate, as its 64 bits; ``cells`` must not be empty."""
    total = len(cells) if parts is None else parts.sum()
    limit = k * (np.log(k) + 3) / total
    while True:
        best = np.full(k, np.inf)
        live, time, step = cells, np.zeros(len(cells)), 0
        part = parts
        block = 1 if limit < 1 else int(limit + 3 * np.sqrt(limit)) + 2
        while len(live):
            h = mix(live[:, None] + (np.arange(step, step + block, dtype=np.uint64) + _U(1)) * _U(0xD1B54A32D192ED03))
            when = time[:, None] + np.cumsum(-np.log(((h >> _U(11)).astype(float) + 0.5) * 2.0**-53), axis=1)
            hit = when < limit
            again = hit[:, -1]
            if part is not None:
                hit = hit & (((mix(h + _U(7)) >> _U(11)).astype(float) * 2.0**-53) < part[:, None])
                part = part[again]
            np.minimum.at(best, (mix(h[hit] + _U(3)) % _U(k)).astype(np.int64), when[hit])
            live, time, step = live[again], when[again, -1], step + block
        if np.isfinite(best).all():
            return best.view(np.uint64)
        limit *= 2


def band_hashes(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = mix(out + parts[:, i])
    return out.view(np.int64)


def _words(text: str) -> list[str]:
    return text.lower().split()


def sign(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, t, k, w, bands): hashes of the text and of its words, the weight, the band hashes."""
    ktype = docs.schema[key].dataType.simpleString()

    def run(batches):
        memo = Recent(word_hash)
        for b in slices(batches):
            names, weights, bands = [], [], []
            for x in b.column(1).to_pylist():
                if x is None:
                    for to in (names, weights, bands):
                        to.append(None)
                    continue
                words = _words(x)
                names.append(_name(words))
                cells = cells_of(words, memo.turn())
                weights.append(len(cells))
                bands.append(band_hashes(signature(cells)) if words else [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(names, pa.binary()), pa.array(weights, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))], ["id", "t", "k", "w", "bands"])
    digest = F.md5(F.col(text).cast("binary"))
    return docs.filter(F.col(key).isNotNull()).select(F.col(key), F.col(text), F.unhex(digest).alias("_t")).mapInArrow(
        run, f"id {ktype}, t binary, k binary, w long, bands array<long>")


def _name(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _filter(rows: DataFrame, places: list, bits: int) -> np.ndarray:
    """Bit table of a filter of the rows' ``places``; false positives only cost time."""
    words = rows.select(F.explode(F.array(*places)).alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")).toPandas()
    table = np.zeros(bits // 64, np.int64)
    table[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return table.view(np.uint64)


def _bits(n: int) -> int:
    return max(1 << 10, 1 << (16 * n).bit_length())


def _in(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows all of whose places are set."""
    return ((table[places >> 6] >> (places & 63).astype(np.uint64)) & _U(1)).all(1)


def shared_members(firsts: DataFrame) -> DataFrame:
    """(bucket, k, w, n) of the buckets of several texts.

    Buckets are counted first; up to BLOOM_IDS shared ones a broadcast filter drops most members
    of other buckets before they are shuffled, and the join drops the rest.
    """
    sizes = write_table(firsts.select(F.explode("bands").alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1"), "sizes")
    n = sizes.count()
    if n > BLOOM_IDS:
        members = firsts.select(F.explode("bands").alias("bucket"), "k", "w")
    else:
        bits = _bits(n)
        # bucket hashes are uniform, so parts of them serve as places
        parts = [F.shiftrightunsigned("bucket", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 18, 36)]
        shared = firsts.sparkSession.sparkContext.broadcast(_filter(sizes, parts, bits))

        def run(batches):
            table = shared.value
            for b in batches:
                lists = b.column(2)
                found = np.asarray(lists.flatten(), np.int64).view(np.uint64)
                places = np.stack([(found >> _U(s)) & _U(bits - 1) for s in (0, 18, 36)], 1).astype(np.int64)
                ok = _in(table, places)
                owner = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(lists.offsets)))[ok]
                yield pa.RecordBatch.from_arrays([pa.array(found[ok].view(np.int64)), b.column(0).take(pa.array(owner)),
                                                  b.column(1).take(pa.array(owner))], ["bucket", "k", "w"])
        members = firsts.select("k", "w", "bands").mapInArrow(run, "bucket long, k binary, w long")
    out = write_table(members.join(sizes, "bucket"), "members")
    drop_table(sizes)
    return out


def _led(shared: DataFrame) -> DataFrame:
    """Members of shared buckets with the bucket's leader and its weight ``lw``.

    The leader meets most others over all its buckets; ties go to the smallest name.
    """
    met = shared.groupBy("k").agg(F.sum("n").alias("met"))
    lead = shared.join(met, "k").groupBy("bucket").agg(F.min(F.struct(-F.col("met"), "k", "w")).alias("x"))
    led = write_table(shared.join(lead.select("bucket", F.col("x.k").alias("leader"), F.col("x.w").alias("lw")),
                                  "bucket"), "led")
    drop_table(shared)
    return led


def candidate_cells(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """(k, cells) of the texts whose id is in ``ids``, from one more pass over the texts.

    Up to BLOOM_IDS ids a broadcast filter picks the rows where they lie; more ids are
    joined by a shuffle. Rows that share an id give their cells too; joins by ``k`` pass over them.
    """
    n = ids.count()
    rows, bits, shared = docs.filter(F.col(key).isNotNull() & F.col(text).isNotNull()), _bits(min(n, BLOOM_IDS)), None
    places = lambda c: [F.pmod(F.xxhash64(F.col(c), F.lit(s)), F.lit(bits)) for s in range(3)]
    if n > BLOOM_IDS:
        rows = rows.join(ids.select(F.col("id").alias(key)), key, "left_semi")
    else:
        shared = docs.sparkSession.sparkContext.broadcast(_filter(ids, places("id"), bits))

    def run(batches):
        memo = Recent(word_hash)
        for b in slices(batches):
            if shared:
                b = b.filter(pa.array(_in(shared.value, np.asarray(b.column(1).flatten(), np.int64).reshape(-1, 3))))
            words = [_words(x) for x in b.column(0).to_pylist()]
            cells = [cells_of(x, memo.turn()).view(np.int64) for x in words]
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in words], pa.binary()),
                                              pa.array(cells, pa.list_(pa.int64()))], ["k", "cells"])
    return rows.select(F.col(text).alias("text"), F.array(*places(key)).alias("probe")).mapInArrow(
        run, "k binary, cells array<long>")


def verify(pairs: DataFrame, cells: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose exact weighted similarity is at least ``similar``."""
    left = cells.select(F.col("k").alias("a"), F.col("cells").alias("x"))
    right = cells.select(F.col("k").alias("b"), F.col("cells").alias("y"))
    d = pairs.join(left, "a")
    # sizes alone rule many pairs out
    d = d.join(right, "b").filter(F.least(F.size("x"), F.size("y")) >= F.greatest(F.size("x"), F.size("y")) * similar)
    both = F.size(F.array_intersect("x", "y"))
    return d.filter(both >= (F.size("x") + F.size("y") - both) * similar).select("a", "b").distinct()


def parity(cells: np.ndarray) -> np.ndarray:
    """Bitmap with a bit flipped by every cell; its width, a power of two, grows with the weight."""
    width = max(64, 1 << (2 * len(cells) - 1).bit_length())
    return np.packbits(np.bincount((cells.view(np.uint64) % _U(width)).astype(np.int64), minlength=width).astype(np.uint8) & 1,
                       bitorder="little").view(np.uint64)


def parities(cells: DataFrame) -> DataFrame:
    """(k, w, bits): weight and bitmap of every text."""
    def run(batches):
        for b in slices(batches):
            lists = [np.asarray(x.values, np.int64) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) for x in lists], pa.int64()),
                 pa.array([parity(x).tobytes() for x in lists], pa.binary())], ["k", "w", "bits"])
    return cells.select("k", "cells").mapInArrow(run, "k binary, w long, bits binary")


def likely(pairs: DataFrame, bits: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose weights and bitmaps allow the similarity."""
    def run(batches):
        for b in batches:
            ok = [bool(near_by_parity([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)], np.array([w, v]),
                                      np.arange(2), None, similar))
                  for w, x, v, y in zip(*(b.column(i).to_pylist() for i in range(2, 6)))]
            b = b.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"])
    side = lambda k, w, x: bits.select(F.col("k").alias(k), F.col("w").alias(w), F.col("bits").alias(x))
    both = pairs.join(side("a", "w1", "x1"), "a").join(side("b", "w2", "x2"), "b")
    return both.select("a", "b", "w1", "x1", "w2", "x2").mapInArrow(run, "a binary, b binary")


def near_by_parity(bits: list[np.ndarray], weights: np.ndarray, group: np.ndarray, side: np.ndarray | None,
                   similar: float) -> list[tuple[int, int]]:
    """Pairs of different groups (and sides) whose weights and bitmaps allow the similarity."""
    by_width: dict[int, list[int]] = {}
    for i, x in enumerate(bits):
        by_width.setdefault(len(x), []).append(i)
    part, out = (1 - similar) / (1 + similar), []
    for width, rows in by_width.items():
        at = np.array(rows)
        table = np.stack([bits[i] for i in rows])
        for other in (width, 2 * width):  # weights that allow the similarity are at most one width apart
            for i in by_width.get(other, ()):
                x = bits[i] if other == width else bits[i][:width] ^ bits[i][width:]
                ok = (group[at] != group[i]) & (np.minimum(weights[at], weights[i]) >= np.maximum(weights[at], weights[i]) * similar)
                if side is not None:
                    ok &= side[at] != side[i]
                if other == width:
                    ok &= at < i
                near = np.flatnonzero(ok)
                if len(near):
                    apart = np.bitwise_count(table[near] ^ x).sum(1)
                    for j in at[near[apart <= (weights[at[near]] + weights[i]) * part + 1e-6]].tolist():
                        out.append((i, j))
    return out


def open_pairs(members: DataFrame, bits: DataFrame, similar: float) -> DataFrame:
    """(a, b): pairs in one bucket, of different components, that may be similar.

    ``members`` (k, bucket, n, component) are those of buckets with several components.
    Large buckets are cut into hashed blocks, and each pair of blocks is one step of a task.
    """
    def compare(batches):
        from itertools import groupby

        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))
        left, right = [], []
        for (_, a, b), group in groupby(rows(), key=lambda r: r[:3]):
            group = list(group)  # at most two blocks
            _, _, _, own, k, component, w, bits = zip(*group)
            number = {c: i for i, c in enumerate(dict.fromkeys(component))}
            if len(number) > 1:
                for i, j in near_by_parity([np.frombuffer(x, np.uint64) for x in bits], np.array(w),
                                           np.array([number[c] for c in component]), None if a == b else np.array(own), similar):
                    left.append(min(k[i], k[j]))
                    right.append(max(k[i], k[j]))
            if len(left) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    blocks = F.ceil(F.col("n") / BLOCK)
    rows = members.withColumn("own", F.pmod(F.xxhash64("k"), blocks)).withColumn(
        "with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))).join(bits, "k")
    rows = rows.select("bucket", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"),
                       "own", "k", "component", "w", "bits")
    parts = int(bits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.repartition(parts, "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
            .mapInArrow(compare, "a binary, b binary").distinct())


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(id, t, class_id, class_key, first) for every row of ``docs`` with an id.

    ``class_id`` and ``class_key`` are the smallest (id, text hash) that copies and links reach from the row;
    ``first`` tells whether they are the row's own.
    """
    ship_package(docs.sparkSession)
    rows = write_table(sign(docs, key, text).withColumn("row", F.monotonically_increasing_id()), "signed")
    known = rows.filter("k is not null")
    nodes = write_table(known.groupBy("k").agg(F.min("row").alias("row"), F.min(F.struct("id", "t")).alias("head")), "nodes")
    firsts = write_table(known.select("row", "k", "w", "bands").join(nodes.select("row"), "row", "left_semi")
                         .filter(F.size("bands") > 0).drop("row"), "firsts")
    members = _led(shared_members(firsts))
    drop_table(firsts)
    ids = nodes.join(members.select("k").distinct(), "k", "left_semi").select(F.col("head.id").alias("id")).distinct()
    cells = write_table(candidate_cells(docs, ids, key, text), "cells")
    bits = write_table(parities(cells).dropDuplicates(["k"]), "bits")
    star = members.filter((F.col("k") != F.col("leader"))
                          & (F.least("w", "lw") >= F.greatest("w", "lw") * similar)).select(
        F.least("k", "leader").alias("a"), F.greatest("k", "leader").alias("b")).distinct()
    star = likely(star, bits, similar)
    links = write_table(verify(star, cells, similar), "links")
    part = connected_components(links)
    labelled = write_table(members.join(part, members.k == part.node, "left").select(
        "k", "bucket", "n", F.coalesce("component", "k").alias("component")), "labelled")
    drop_table(members)
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter(
        "lo != hi").select("bucket")
    still = write_table(labelled.join(mixed, "bucket", "left_semi"), "open")
    drop_table(labelled)
    more = write_table(verify(open_pairs(still, bits, similar), cells, similar), "links")
    for used in (still, cells, bits):
        drop_table(used)
    if not more.isEmpty():
        part = connected_components(links.union(more))
    found = nodes.join(part, nodes.k == part.node, "left").select("k", "head", F.coalesce("component", "k").alias("component"))
    heads = found.groupBy("component").agg(F.min("head").alias("first"))
    found = found.join(heads, "component").select("k", "first")
    classes = known.select("id", "t", "k").join(found, "k").select(
        "id", "t", F.col("first.id").alias("class_id"), F.col("first.t").alias("class_key"))
    alone = rows.filter("k is null").select("id", "t", F.col("id").alias("class_id"), F.col("t").alias("class_key"))
    out = classes.union(alone).withColumn("first", F.col("class_id").eqNullSafe(F.col("id"))
                                          & F.col("class_key").eqNullSafe(F.col("t")))
    out._used = [rows, nodes, links, more]  # for callers that write what they need and read no more
    return out


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs``, all columns, without later members of a class.

    A row goes only if its own text's class has another first member; of rows with the first
    member's id and text one stays. Rows with a null id or a null text stay.
    """
    classes = near_classes(docs, key, text, similar)
    per_text = classes.filter("t is not null").groupBy("id", "t").agg(
        F.max("first").alias("first"), F.count(F.lit(1)).alias("n"))
    dropped = write_table(per_text.filter("not first or n > 1").select(
        F.col("id").alias("_near_id"), F.col("t").alias("_near_t"), F.col("first").alias("_near_first")), "dropped")
    for used in classes._used:  # all that they gave is in ``dropped``
        drop_table(used)
    rows = docs.withColumn("_near_hash", F.unhex(F.md5(F.col(text).cast("binary"))))
    clear, rows = _apart(rows, dropped, [key, "_near_hash"], ["_near_id", "_near_t"])
    same = (F.col(key) == F.col("_near_id")) & (F.col("_near_hash") == F.col("_near_t"))
    rest = rows.join(dropped, same, "left_anti")
    if clear is not None:
        rest = rest.unionByName(clear)
    again = dropped.filter("_near_first")
    if not again.isEmpty():
        rest = rest.unionByName(rows.join(again, same, "left_semi").dropDuplicates([key, "_near_hash"]))
    return rest.select(*docs.columns)


def _apart(rows: DataFrame, marked: DataFrame, on: list[str], names: list[str]):
    """(rows that certainly aren't marked, the others): most rows with their texts then need no shuffle.

    Beyond BLOOM_IDS marked rows all are among the others.
    """
    n = marked.count()
    if n > BLOOM_IDS:
        return None, rows
    bits = _bits(n)
    places = lambda cols: [F.pmod(F.xxhash64(*cols, F.lit(s)), F.lit(bits)) for s in range(3)]
    shared = rows.sparkSession.sparkContext.broadcast(_filter(marked, places(names), bits))

    @F.pandas_udf("boolean")
    def perhaps(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(_in(shared.value, np.stack([a.to_numpy(np.int64), b.to_numpy(np.int64), c.to_numpy(np.int64)], 1)))
    told = rows.withColumn("_near_perhaps", perhaps(*places(on)))
    return (told.filter("not _near_perhaps").drop("_near_perhaps"), told.filter("_near_perhaps").drop("_near_perhaps"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = load(spark, sf_dir, "documents")
    out = near_classes(docs).select(F.col("id").alias("doc_id"), "class_id", F.lower(F.hex("class_key")).alias("class_key"),
                                    F.col("first").alias("kept"))
    lost = docs.filter("doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"),
                                                F.lit(None).cast("string").alias("class_key"), F.lit(True).alias("kept"))
    return out.union(lost)


QUERIES = {"op9_minhash": op9_minhash}
SQL: dict[str, str] = {}
