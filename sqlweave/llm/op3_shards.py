"""Operator 3, sharding by a minimax contiguous partition.

Groups of equal texts are atoms, ordered by the SHA-256 of their text. The
smallest feasible shard capacity is found by binary search; a capacity is
feasible if greedy filling needs no more than the given number of shards. The
cuts then lie as near to the even split as that capacity allows.

Nothing of the corpus' size reaches the driver. The search works on prefix
sums of a tree of hash prefixes: the first level has at most 65,536 nodes with
their bytes; where a cut falls inside a node of more than one group, that node
alone is opened one level further, until every cut that the search asks about
is exact. A group larger than the even share can't be balanced by any cut: it
gets a shard of its own (there are fewer such groups than shards) and the
others are balanced among the remaining shards.

Nulls: a null text counts as empty. Empty tables give no rows; shards may stay
empty if there are fewer groups than shards. Repeated rows are rows of their
own in the same shard. Extra columns are ignored by the query.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load
from sqlweave.operators.numbering import row_numbers
from sqlweave.session import write_table

ROOT, STEP = 4, 2  # hex digits of the first level and of each further level


class PrefixSums:
    """Sizes of key ranges by hash prefix, refined where a lookup needs it."""

    def __init__(self, groups: DataFrame):
        self.groups = groups
        self.nodes = {r[0]: (r[1], r[2]) for r in self._level(groups, ROOT).collect()}
        self._sums()

    @staticmethod
    def _level(groups, digits):
        return groups.groupBy(F.substring("key", 1, digits).alias("p")).agg(
            F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"))

    def _sums(self):
        self.prefixes = sorted(self.nodes)
        self.ends = list(accumulate((self.nodes[p][0] for p in self.prefixes), initial=0))
        self.total, self.wanted = self.ends[-1], set()

    def at_most(self, x: int) -> int:
        """Index of the last known boundary whose prefix sum is at most ``x``."""
        i = bisect_right(self.ends, x) - 1
        if i < len(self.prefixes) and self.ends[i] < x and self.nodes[self.prefixes[i]][1] > 1:
            self.wanted.add(self.prefixes[i])
        return i

    def refine(self) -> None:
        by_length: dict[int, list] = {}
        for p in self.wanted:
            by_length.setdefault(len(p), []).append(p)
        for digits, wanted in by_length.items():
            picks = self.groups.sparkSession.createDataFrame([(p,) for p in wanted], "q string")
            inside = self.groups.join(F.broadcast(picks), F.substring("key", 1, digits) == F.col("q"))
            rows = self._level(inside, digits + STEP).collect()
            for p in wanted:
                del self.nodes[p]
            self.nodes.update({r[0]: (r[1], r[2]) for r in rows})
        self._sums()


def _fill(sums: PrefixSums, capacity: int, shards: int) -> int:
    """Bytes covered by greedy filling of ``shards`` shards."""
    done = 0
    for _ in range(shards):
        done = sums.ends[sums.at_most(done + capacity)]
        if done >= sums.total:
            break
    return done


def minimax_cuts(sums: PrefixSums, shards: int, largest: int) -> tuple[int, list[str]]:
    """Smallest capacity and the first key prefix of every shard after the first."""
    while True:
        low, high = max(largest, -(-sums.total // shards)), -(-sums.total // shards) + largest
        while low < high:
            mid = (low + high) // 2
            if _fill(sums, mid, shards) >= sums.total:
                high = mid
            else:
                low = mid + 1
        # the latest cuts from the left are greedy; the earliest ones fill from the right
        need = [sums.total]
        for _ in range(shards - 1):
            x = max(0, need[-1] - low)
            i = sums.at_most(x)
            need.append(sums.ends[i] if sums.ends[i] >= x else sums.ends[min(i + 1, len(sums.prefixes))])
        need.reverse()  # need[i]: shard i must end at or after this
        at, cuts = 0, []
        for i in range(shards - 1):
            even = round((i + 1) * sums.total / shards)
            want = min(max(even, need[i]), at + low)
            k = sums.at_most(want)
            if sums.ends[k] < need[i]:
                k = min(k + 1, len(sums.prefixes))
            at = max(at, sums.ends[k])
            cuts.append(sums.prefixes[k] if k < len(sums.prefixes) else "g")
        if not sums.wanted:
            return low, cuts
        sums.refine()


def assign_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` to rows with columns key (hex hash of the group) and bytes."""
    if shards < 1:
        raise ValueError("shards must be positive")
    groups = write_table(rows.groupBy("key").agg(F.sum("bytes").alias("bytes")), "groups")
    alone: list[str] = []
    while True:
        rest = groups.filter(~F.col("key").isin(alone)) if alone else groups
        left = shards - len(alone)
        total, largest = rest.agg(F.sum("bytes"), F.max("bytes")).first()
        if total is None or left <= 1:
            break
        # at most left - 1 groups exceed the even share
        more = [r[0] for r in rest.filter(F.col("bytes") * left > F.lit(total)).select("key").collect()]
        if not more:
            break
        alone += more
    alone.sort()
    shard = F.lit(len(alone))
    if total is not None and left > 1:
        _, cuts = minimax_cuts(PrefixSums(rest), left, largest)
        shard = shard + F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("key")))
    for i, key in enumerate(alone):
        shard = F.when(F.col("key") == key, F.lit(i)).otherwise(shard)
    return rows.withColumn("shard", shard.cast("int"))


def op3_shards(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All documents in byte-balanced shards; slots number the documents of a shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = load(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("bytes"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("key"))
    rows = write_table(rows, "sizes")
    placed = row_numbers(assign_shards(rows, shards), ["shard", "key", "doc_id"])
    first = placed.groupBy("shard").agg(F.min("rn").alias("first"))  # one row per shard
    return (placed.join(F.broadcast(first), "shard")
            .select("doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"),
                    "shard", (F.col("rn") - F.col("first")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))


QUERIES = {"op3_shards": op3_shards}
SQL: dict[str, str] = {}
