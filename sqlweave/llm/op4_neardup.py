"""Operator 4, embedding near-duplicates with iterative quantisation.

A rotation of the principal directions is learned on a bounded sample so that
the signs of the rotated vector are balanced codes close to the vector
(alternating sign assignment and an orthogonal fit). Codes have 64 bits; vectors of
fewer dimensions use several learned rotations. Every vector is coded and indexed.

Retrieval is a multi-index Hamming search: a code is cut into TABLES substrings;
two codes meet in a table if their substrings differ in at most two bits, found
by letting each side flip at most one bit. That finds every pair of codes
within 11 bits and most beyond; pairs over RADIUS bits are dropped. Each pair is
counted in the first table and at the one flip that it meets at, so no distinct
step is needed. All found pairs are reranked by the cosine of the original
vectors in double precision.

Equal vectors are collapsed first and counted, so copies never form pairs. Groups
are (label, dimension); only vectors of one group are compared.

Nulls: vectors that are null, empty, zero or hold a null or non-finite component, or
have a null label or id, link with nothing and are their own component. Repeated rows
are vectors of their own. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load
from sqlweave.operators.graph import connected_components
from sqlweave.session import ship_package, write_table

BITS, TABLES = 64, 4
PART = BITS // TABLES
RADIUS = 20
COSINE = 0.93
SAMPLE = 16_384  # vectors that the rotation is learned from


def learn_rotation(x: np.ndarray, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Projection to BITS columns learned from unit vectors in the rows of ``x``.

    The vectors aren't centred: planes through the origin part two vectors with a
    probability that depends on their angle alone, also inside a dense group.
    """
    d = x.shape[1]
    c = min(d, BITS)
    axes = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :c] if len(x) else np.eye(d)[:, :c]
    rng, parts, v = np.random.default_rng(seed), [], x @ axes
    while sum(p.shape[1] for p in parts) < BITS:
        rotation = np.linalg.qr(rng.standard_normal((c, c)))[0]
        for _ in range(rounds if len(x) else 0):
            signs = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ v)
            rotation = (left @ right).T
        parts.append(axes @ rotation)
    return np.concatenate(parts, axis=1)[:, :BITS]


def codes(x: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """64-bit codes of unit vectors, as signed integers."""
    return np.packbits(x @ projection >= 0, axis=1, bitorder="little").view("<i8").ravel()


def _matrix(column, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _usable(vector):
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    return (vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite)
            & F.exists(vector, lambda e: e != 0))


def encode(firsts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Add ``code`` to rows with id, d (dimension) and vector."""
    spark = firsts.sparkSession
    n = firsts.count()
    every = max(1, -(-n // sample))
    models = {}
    # F.xxhash64 of the id chooses the sample, so it doesn't depend on the partitions
    picked = firsts.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).orderBy("id").select("d", "vector").toPandas()
    for (d,) in firsts.select("d").distinct().collect():
        rows = [np.asarray(v, float) for v in picked["vector"][picked["d"] == d]]
        models[d] = learn_rotation(_unit(np.stack(rows)) if rows else np.zeros((0, d)))
    shared = spark.sparkContext.broadcast(models)

    def run(batches):
        for b in batches:
            dims = np.asarray(b.column("d"))
            out = np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                out[at] = codes(_unit(_matrix(b.column("vector").take(pa.array(at)), d)), shared.value[d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*b.schema.names, "code"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in firsts.schema.fields)
    return firsts.mapInArrow(run, schema + ", code long")


def _part(code, t: int):
    return F.shiftrightunsigned(code, t * PART).bitwiseAND((1 << PART) - 1)


def hamming_pairs(coded: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b of one group whose codes meet in a table and differ in at most ``radius`` bits."""
    flips = F.array(*[F.lit(x).cast("long") for x in [0, *(1 << i for i in range(PART))]])
    each = coded.select("id", "group", "code", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), _part(F.col("code"), t).alias("s")) for t in range(TABLES)])).alias("x"))
    each = each.select("id", "group", "code", F.col("x.t").alias("t"), F.explode(
        F.transform(flips, lambda f: F.col("x.s").bitwiseXOR(f))).alias("z"))
    each = each.withColumn("bucket", F.xxhash64("group", "t", "z"))
    left = each.select("bucket", "t", "z", "group", F.col("id").alias("a"), F.col("code").alias("ca"))
    right = each.select("bucket", F.col("t").alias("t2"), F.col("z").alias("z2"), F.col("group").alias("group2"),
                        F.col("id").alias("b"), F.col("code").alias("cb"))
    diff = F.col("ca").bitwiseXOR(F.col("cb"))
    first = F.lit(TABLES)
    meet = F.lit(None).cast("long")
    for t in reversed(range(TABLES)):
        d = _part(diff, t)
        close = F.bit_count(d) <= 2
        # with two differing bits the sides meet where the lower one is flipped, else at the left side's own part
        at = _part(F.col("ca"), t).bitwiseXOR(F.when(F.bit_count(d) == 2, d.bitwiseAND(-d)).otherwise(F.lit(0)))
        first = F.when(close, F.lit(t)).otherwise(first)
        meet = F.when(close, at).otherwise(meet)
    same = ((left.bucket == right.bucket) & (F.col("a") < F.col("b")) & (F.col("t") == F.col("t2"))
            & (F.col("z") == F.col("z2")) & (F.col("group") == F.col("group2")))
    return left.join(right, same & (F.bit_count(diff) <= radius) & (F.col("t") == first)
                     & (F.col("z") == meet)).select("a", "b")


def rerank(pairs: DataFrame, coded: DataFrame, cosine: float) -> DataFrame:
    """(a, b, na, nb): pairs of at least that cosine, with how many copies each end has."""
    a = coded.select(F.col("id").alias("a"), F.col("d").alias("d"), F.col("vector").alias("x"), F.col("n").alias("na"))
    b = coded.select(F.col("id").alias("b"), F.col("vector").alias("y"), F.col("n").alias("nb"))

    def run(batches):
        for rows in batches:
            keep = np.zeros(rows.num_rows, bool)
            dims = np.asarray(rows.column("d"))
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i in range(0, len(at), 4096):
                    part = pa.array(at[i:i + 4096])
                    x = _unit(_matrix(rows.column("x").take(part), d))
                    y = _unit(_matrix(rows.column("y").take(part), d))
                    keep[at[i:i + 4096]] = np.einsum("ij,ij->i", x, y) >= cosine
            yield rows.select(["a", "b", "na", "nb"]).filter(pa.array(keep))
    kind = coded.schema["id"].dataType.simpleString()
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "d", "x", "y").mapInArrow(
        run, f"a {kind}, b {kind}, na long, nb long")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cosine: float = COSINE) -> DataFrame:
    """(key, n_links, component_id) for every row of ``df``."""
    ship_package(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.col(label).alias("label"))
    ok = F.coalesce(_usable(F.col("vector")), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = write_table(rows.withColumn("ok", ok).withColumns(
        {"k1": F.xxhash64("label", "vector"), "k2": F.xxhash64("vector", "label", F.lit(1))}), "vectors")
    good = rows.filter("ok")
    copies = write_table(good.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "copies")
    # a distinct vector's key starts with its first id, so a component's smallest key has its smallest id
    node = F.struct(F.col("first").alias("id"), "k1", "k2")
    firsts = good.join(copies.select("k1", "k2", F.col("first").alias("id"), "n"), ["k1", "k2", "id"]).select(
        F.struct("id", "k1", "k2").alias("id"), F.size("vector").alias("d"),
        F.xxhash64("label", F.size("vector")).alias("group"), "vector", "n").dropDuplicates(["id"])
    coded = write_table(encode(write_table(firsts, "firsts")), "coded")
    pairs = hamming_pairs(coded.select("id", "group", "code"))
    links = write_table(rerank(pairs, coded, cosine), "links")
    counts = (links.select(F.col("a").alias("node"), F.col("nb").alias("m"))
              .union(links.select("b", "na")).groupBy("node").agg(F.sum("m").alias("m")))
    parts = connected_components(links)
    known = write_table(copies.withColumn("node", node).join(counts, "node", "left").join(parts, "node", "left").select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_links"),
        F.coalesce("component.id", "first").alias("component_id")), "known")
    done = good.select("id", "k1", "k2").join(known, ["k1", "k2"]).select(F.col("id").alias(key), "n_links", "component_id")
    return done.union(rows.filter("not ok").select("id", F.lit(0).cast("long"), "id"))


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(load(spark, sf_dir, "embeddings")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


QUERIES = {"op4_neardup": op4_neardup}
SQL: dict[str, str] = {}
