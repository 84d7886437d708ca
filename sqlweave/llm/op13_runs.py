"""Operator 13, periodic run detection by descending-LCP Kruskal.

A run is a stretch of consecutive words with smallest period q and a length of at least
max(``least``, ``times`` q) that no neighbouring word extends keeping the period. Suffixes of a text
form classes of equal prefixes. Going through the LCP values from the largest, neighbours in the
suffix array are united (union-find), and every class keeps its positions in order; the smaller
class is inserted into the larger. Positions i < j that become neighbours while classes
unite at LCP value l seed the stretch [i, j + l) of period j - i where j - i is within l. With
l >= (times - 1) (j - i) and differing words before i and j it is a run: l is the exact
agreement of both suffixes, so it can't be extended; a smaller period p would have put i + p
between them at a higher level, and for the run's true first period nothing can lie
between. So each run is seeded once, and levels under the smallest LCP that allows a run
of ``least`` words are not visited.

Texts without any repeated window of that many words are told apart by doubling ranks over a whole
batch; only the others get a suffix array.

Words are runs of characters other than blank and U+0009 to U+000D.

Nulls: a null text has no words and no runs; null keys stay. Empty texts have no runs. Repeated
rows each give a row. Very long texts are handled whole, in memory linear in their words. Ties
of the greatest exponent go to the smallest start, then period. Extra columns are
ignored; tables without rows give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load, slices
from sqlweave.session import ship_package

LEAST, TIMES = 24, 3
BATCH_WORDS = 400_000  # words whose ranks are doubled together (a longer text alone)


class Positions:
    """An ordered set of positions in blocks, so an insertion moves a bounded number of them."""

    BLOCK = 512

    def __init__(self, x: int):
        self.blocks, self.lows, self.size = [[x]], [x], 1

    def __iter__(self):
        for b in self.blocks:
            yield from b

    def add(self, x: int) -> tuple[int, int]:
        """Insert ``x``; its neighbours (-1 where there is none)."""
        k = max(0, bisect_left(self.lows, x) - 1)
        b = self.blocks[k]
        i = bisect_left(b, x)
        low = b[i - 1] if i else self.blocks[k - 1][-1] if k else -1
        high = b[i] if i < len(b) else self.blocks[k + 1][0] if k + 1 < len(self.blocks) else -1
        b.insert(i, x)
        self.lows[k] = b[0]
        self.size += 1
        if len(b) > 2 * self.BLOCK:
            self.blocks[k:k + 1] = [b[:self.BLOCK], b[self.BLOCK:]]
            insort(self.lows, b[self.BLOCK])
        return low, high


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys, equal for equal ones."""
    return np.unique(keys, return_inverse=True)[1].reshape(-1).astype(np.int64)


def repeats(words: np.ndarray, text: np.ndarray, window: int) -> np.ndarray:
    """Numbers of the texts in which a window of that many words is found twice.

    ``text`` has each word's text. Ranks of 1, 2, 4 ... words are doubled; positions whose
    rank is alone in its text leave the search.
    """
    n = len(words)
    rank = np.full(n, -1, np.int64)
    if not n:
        return np.zeros(0, np.int64)
    at, size = np.arange(n), 1
    keys = dense(text * (int(words.max()) + 1) + words)
    while True:
        alike = np.bincount(keys)[keys] > 1
        at, keys = at[alike], keys[alike]
        if size == window or not len(at):
            return np.unique(text[at])
        rank[:] = -1
        rank[at] = keys
        step = min(size, window - size)  # the last one overlaps, unless window is a power of two
        ahead = at + step
        ok = ahead < n
        at, ahead = at[ok], ahead[ok]
        ok = (rank[ahead] >= 0) & (text[at] == text[ahead])
        at, ahead = at[ok], ahead[ok]
        keys = dense(rank[at] * (n + 1) + rank[ahead])
        size += step


def suffix_array(words: np.ndarray) -> np.ndarray:
    """Start of every suffix in order, by doubling ranks."""
    n, size = len(words), 1
    rank = dense(words)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[:max(0, n - size)] = rank[size:] + 1
        keys = rank * (n + 1) + ahead
        order = np.argsort(keys, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(keys[order]) != 0)))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        size *= 2


def common_prefixes(words: list[int], order: list[int]) -> list[int]:
    """LCP of each suffix and the one before it in the suffix array, in one pass over the text."""
    n = len(words)
    before = [-1] * n
    for a, b in zip(order, order[1:]):
        before[b] = a
    length, out = 0, [0] * n
    for i in range(n):
        j = before[i]
        if j < 0:
            length = 0
            continue
        most = n - max(i, j)
        while length < most and words[i + length] == words[j + length]:
            length += 1
        out[i] = length
        length -= length > 0
    return [out[i] for i in order]


def runs_of(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text's word numbers, by start and period."""
    n = len(words)
    if n < least:
        return []
    order = suffix_array(words)
    seq, order = words.tolist(), order.tolist()
    lcp = np.array(common_prefixes(seq, order))
    floor = lowest_level(least, times)
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")].tolist()
    parent: dict[int, int] = {}
    classes: dict[int, Positions] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], classes[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for e in edges:
        level = int(lcp[e])
        a, b = root(order[e - 1]), root(order[e])
        if classes[a].size < classes[b].size:
            a, b = b, a
        into, small = classes[a], list(classes.pop(b))
        parent[b] = a
        for last, x, after in zip([-1, *small], small, [*small[1:], n]):
            low, high = into.add(x)
            for i, j in ((low, x), (x, high)):
                if i < 0 or j < 0 or i == last != -1 or i == x and j > after:
                    continue  # neighbours before the union, or not neighbours after it
                if (times - 1) * (j - i) > level or level + j - i < least:
                    continue
                if (i == 0 or seq[i - 1] != seq[j - 1]) and (j + level == n or seq[j + level] != seq[i + level]):
                    found.append((i, level + j - i, j - i))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def lowest_level(least: int, times: int) -> int:
    """The smallest LCP of a run's start and the place a period on."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


def batch_runs(texts: list[np.ndarray], least: int, times: int) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of the texts that have any, by the text's place in the list."""
    out, begin = {}, 0
    while begin < len(texts):
        end, total = begin, 0
        while end < len(texts) and (end == begin or total + len(texts[end]) <= BATCH_WORDS):
            total += len(texts[end])
            end += 1
        part = texts[begin:end]
        owner = np.repeat(np.arange(len(part)), [len(x) for x in part])
        for i in repeats(np.concatenate(part), owner, lowest_level(least, times)).tolist():
            if found := runs_of(part[i], least, times):
                out[begin + i] = found
        begin = end
    return out


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words without those that a run has after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    stay = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stay.tolist()) if s]


def find_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES,
              change=None) -> DataFrame:
    """(key, runs array<struct<start, length, period>>, collapsed string) for every row of ``df``.

    ``change(key, n)`` may give the word numbers to read in place of 0 to n - 1 (None: as they are).
    """
    ship_package(df.sparkSession)
    ktype = df.schema[key].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in slices(batches, 512):
            number: dict[bytes, int] = {}
            split, ids = [], []
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = x.encode().split() if x else []  # bytes are split at exactly these six characters
                mine = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
                if words and change is not None and (take := change(k, len(words))) is not None:
                    mine = mine[take]
                    words = [words[i] for i in take.tolist()]
                split.append(words)
                ids.append(mine)
            found = batch_runs(ids, least, times)
            kept = [b" ".join(collapsed(w, found[i]) if i in found else w) for i, w in enumerate(split)]
            rows = [[dict(zip(("start", "length", "period"), r)) for r in found.get(i, [])] for i in range(len(ids))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, run_type), pa.array(kept, pa.binary()).cast(pa.string())],
                [key, "runs", "collapsed"])
    return df.select(key, text).mapInArrow(
        run, f"`{key}` {ktype}, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(doc_id, n: int):
    """Every tenth document's words repeat with a period from some word on (a null id: no)."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document, after every tenth has been made periodic."""
    found = find_runs(load(spark, sf_dir, "documents"), change=planted)
    # greatest exponent first; exact by cross products, which stay far below 2^63
    best = F.expr("""element_at(array_sort(runs, (a, b) -> case
        when a.length * b.period != b.length * a.period
          then case when a.length * b.period > b.length * a.period then -1 else 1 end
        when a.start != b.start then case when a.start < b.start then -1 else 1 end
        when a.period != b.period then case when a.period < b.period then -1 else 1 end
        else 0 end), 1)""")
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')))")
    return (found.withColumn("best", F.when(F.size("runs") > 0, best))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                    F.col("best.length").alias("length"), F.col("best.period").alias("period"),
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                    F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))


QUERIES = {"op13_runs": op13_runs}
SQL: dict[str, str] = {}
