"""Operator 12, byte-level BPE with vectorised pre-tokenisation.

No regex runs over the texts. Every code point has a class (letter, number, space, other) in
an array that is read off the tiktoken library's own classes once on the driver. With
the two following characters it gives the character's symbol, and every symbol is a function
from the splitter's eight states to its next state. These functions are
closed under composition in a small monoid, so an associative scan (blocked: local prefixes
in all blocks at once, then the blocks' totals by doubling, then both together) gives the state
before every character of a whole Arrow slice, and state and symbol say whether a pre-token
starts there. The first character of a text has a constant function, so texts scan as one.

The slices between starts are merged lowest rank first (leftmost of equal ranks), remembered
per worker in a two-generation memo of bounded size. Beside the ids, the byte offset of every
token's end is kept; decoding copies each token to its place and can decode any span of ids.

Nulls: a null text counts as empty (no ids); null keys stay. Repeated rows each give a row.
Very long texts and runs are scanned whole; a merge step costs the logarithm of its piece.
Extra columns are ignored; tables without rows give no rows. Ids outside the vocabulary raise.
Ties between equal ranks are settled as in the library, by place.
"""

from __future__ import annotations

import base64
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import Recent, load, slices
from sqlweave.session import ship_package

OTHER, LETTER, NUMBER, SPACE = range(4)
STATES = 8
FRESH, IN_L, IN_N, IN_O, PREFIXED, IN_SPACE, ONE_LEFT, TWO_LEFT = range(STATES)
SYMBOLS = 8
#: The first four equal their class: PRE is a blank before a non-space, LONE another space before one,
#: SHORT and LONGER an apostrophe before a contraction's one or two letters.
S_O, S_L, S_N, S_SPACE, PRE, LONE, SHORT, LONGER = range(SYMBOLS)
BLOCK = 256  # characters of a block of the scan
SHORT_PIECE = 128  # bytes up to which searching all pairs is faster than a heap


def code_point_classes() -> np.ndarray:
    """Class of every code point, as the library's patterns see it."""
    import tiktoken
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        probe = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)},
                                  special_tokens={})
        for i in range(0, len(points), 1 << 15):
            ids = probe.encode_ordinary("".join(map(chr, points[i:i + (1 << 15)])))  # other characters give none
            out[np.frombuffer(bytes(ids).decode().encode("utf-32-le"), "<u4")] = kind
    return out


def _next_state(state: int, symbol: int) -> int:
    if state == TWO_LEFT:
        return ONE_LEFT
    if state == ONE_LEFT:
        return FRESH
    if symbol in (SHORT, LONGER):
        return IN_O if state in (IN_O, PREFIXED) else ONE_LEFT if symbol == SHORT else TWO_LEFT
    return {S_O: IN_O, S_L: IN_L, S_N: IN_N, S_SPACE: IN_SPACE, PRE: PREFIXED, LONE: FRESH}[symbol]


def _starts(state: int, symbol: int) -> bool:
    """True if a pre-token starts at a character with this symbol that is met in this state."""
    goes_on = {IN_L: {S_L}, IN_N: {S_N}, IN_O: {S_O, SHORT, LONGER}, IN_SPACE: {S_SPACE}}
    return state == FRESH or symbol not in goes_on.get(state, range(SYMBOLS))


def _monoid():
    """(step, times, apply): element x symbol, element x element, element x state.

    Symbols from SYMBOLS on are those of a text's first character, which forget what came before.
    """
    plain = [tuple(_next_state(s, x) for s in range(STATES)) for x in range(SYMBOLS)]
    symbols = plain + [(f[FRESH],) * STATES for f in plain]
    found = {tuple(range(STATES)): 0}
    for f in (queue := list(found)):
        for g in symbols:
            h = tuple(g[s] for s in f)
            if h not in found:
                found[h] = len(found)
                queue.append(h)
    step = np.array([[found[tuple(g[s] for s in f)] for g in symbols] for f in queue], np.uint16)
    times = np.array([[found[tuple(g[s] for s in f)] for g in queue] for f in queue], np.uint16)
    return step, times, np.array(queue, np.uint8)


STEP, TIMES, APPLY = _monoid()
START = np.array([[_starts(s, x) for x in range(SYMBOLS)] for s in range(STATES)])


def states_before(symbols: np.ndarray) -> np.ndarray:
    """State before every symbol, by a blocked scan over composed transition functions."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint8)
    padded[:n] = symbols
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T)
    local = np.empty((BLOCK, blocks), np.uint16)
    so_far = np.zeros(blocks, np.uint16)
    for i in range(BLOCK):
        local[i] = so_far
        so_far = STEP[so_far, columns[i]]
    before, reach = so_far, 1
    while reach < blocks:  # inclusive prefixes of the blocks' totals, doubling their reach
        before = np.concatenate([before[:reach], TIMES[before[:-reach], before[reach:]]])
        reach *= 2
    entry = np.concatenate([[FRESH], APPLY[before[:-1], FRESH]]).astype(np.uint8)
    return np.ascontiguousarray(APPLY[local, entry].T).reshape(-1)[:n]


def symbols_of(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of the code points; ``first`` marks the first character of each text."""
    kind = classes[points]
    out = kind.copy()
    n = len(points)
    goes_on = np.zeros(n, bool)  # a character of the same text follows
    goes_on[:-1] = ~first[1:]
    at = np.flatnonzero(kind == SPACE)
    at = at[goes_on[at]]
    at = at[kind[at + 1] != SPACE]
    out[at] = np.where(points[at] == 32, PRE, LONE)
    at = np.flatnonzero(points == 39)
    at = at[goes_on[at]]
    one = points[at + 1]
    out[at[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
    wide = goes_on[at + 1]
    at, one = at[wide], one[wide]
    two = points[at + 2]
    pair = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        pair |= (one == ord(a)) & (two == ord(b))
    out[at[pair]] = LONGER
    return out + SYMBOLS * first.astype(np.uint8)


class Codec:
    """What a rank file and the class array give; one per Python worker."""

    def __init__(self, ranks_file: bytes, classes: bytes):
        self.classes = np.frombuffer(classes, np.uint8)
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.words = {token: i.to_bytes(4, "little") for token, i in self.ranks.items()}
        size = max(self.ranks.values()) + 1
        blob = [b""] * size
        for token, i in self.ranks.items():
            blob[i] = token
        self.length = np.array([len(t) for t in blob], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.memo = Recent(self.merged)

    def merged(self, piece: bytes) -> bytes:
        """Ids of one pre-token as little-endian words: itself if it is a token, else merged by rank."""
        whole = self.words.get(piece)
        if whole is not None:
            return whole
        cuts = self._short(piece) if len(piece) <= SHORT_PIECE else self._long(piece)
        return b"".join([self.words[piece[a:b]] for a, b in zip(cuts, cuts[1:])])

    def _short(self, piece: bytes) -> list[int]:
        """Ends of the merged parts; every step searches the pairs of a short piece anew."""
        get, none = self.ranks.get, len(self.length)
        cuts = list(range(len(piece) + 1))
        pair = [get(piece[i:i + 2], none) for i in range(len(piece) - 1)] + [none]
        while (r := min(pair)) != none:
            i = pair.index(r)
            del cuts[i + 1], pair[i]
            if i + 2 < len(cuts):
                pair[i] = get(piece[cuts[i]:cuts[i + 2]], none)
            if i:
                pair[i - 1] = get(piece[cuts[i - 1]:cuts[i + 1]], none)
        return cuts

    def _long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs, in time n log n."""
        get, n = self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [get(piece[i:i + 2], -1) for i in range(n - 1)] + [-1]
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            x = heapq.heappop(heap)
            i = x & 0xFFFFFFFF
            if pair[i] != x >> 32:
                continue  # its parts have been merged otherwise
            j = after[i]
            k = after[i] = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                r = pair[i] = get(piece[i:after[k]], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                r = pair[h] = get(piece[h:k], -1)
                if r >= 0:
                    heapq.heappush(heap, r << 32 | h)
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(after[cuts[-1]])
        return cuts

    def boundaries(self, data: bytes, begins: np.ndarray) -> np.ndarray:
        """Byte offsets in UTF-8 ``data`` where pre-tokens start; texts start at ``begins``."""
        if not data:
            return np.zeros(0, np.int64)
        points = np.frombuffer(data.decode().encode("utf-32-le"), "<u4")
        lead = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        first = np.zeros(len(points), bool)
        first[np.searchsorted(lead, begins[begins < len(data)])] = True
        symbols = symbols_of(points, first, self.classes)
        state = states_before(symbols)
        state[first] = FRESH
        return lead[START[state, symbols % SYMBOLS]]

    def encode_batch(self, data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids up to each text's end, byte offset of each id's end in its text).

        ``ends`` are the ends of consecutive texts in ``data``.
        """
        begins = np.concatenate(([0], ends))[:-1]
        starts = self.boundaries(data, begins)
        cuts = [*starts.tolist(), len(data)]
        memo = self.memo.turn()
        parts = [memo[data[a:b]] for a, b in zip(cuts, cuts[1:])]
        ids = np.frombuffer(b"".join(parts), "<u4")
        stop = np.cumsum(self.length[ids])
        last = np.searchsorted(stop, ends, "right")
        base = np.repeat(begins, np.diff(last, prepend=0))
        return ids, last, (stop - base).astype("<u4")

    def decode_batch(self, ids: np.ndarray, last: np.ndarray, stops: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bytes of all texts, each text's end), tokens copied to the places that ``stops`` keeps."""
        if ids.size and ids.max() >= len(self.length):
            raise ValueError("id outside the vocabulary")
        first = np.concatenate(([0], last))[:-1]
        sizes = np.zeros(len(last), np.int64)
        some = last > first
        sizes[some] = stops[last[some] - 1]
        ends = np.cumsum(sizes)
        stop = stops.astype(np.int64) + np.repeat(ends - sizes, last - first)
        size = self.length[ids]
        if not np.array_equal(np.diff(stop, prepend=0), size):
            raise ValueError("offsets and ids differ")
        at = np.arange(stop[-1] if stop.size else 0) + np.repeat(self.offsets[ids] - (stop - size), size)
        return self.blob[at].tobytes(), ends


class Vocabulary:
    """A rank file and the code point classes, sent to the executors once."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        import public_tokenizers
        ship_package(spark)
        with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            ranks = f.read()
        self.id = zlib.crc32(ranks)
        self.shared = spark.sparkContext.broadcast((ranks, code_point_classes().tobytes()))  # of fixed size


_CODECS: dict[int, Codec] = {}


def codec_of(vocabulary) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    if vocabulary[0] not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary[0]] = Codec(*vocabulary[1].value)
    return _CODECS[vocabulary[0]]


def _binary(values: bytes, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], ends))
    if offsets[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype("<i4").tobytes()),
                                                              pa.py_buffer(values)])
    raise ValueError("a slice of texts is over 2 GB")


def encode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, stops binary): per row the ids and the ends of their bytes, as 4-byte words."""
    shared = (vocabulary.id, vocabulary.shared)
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        codec = codec_of(shared)
        for b in slices(batches):
            texts = [x.encode() if x else b"" for x in b.column(1).to_pylist()]
            ids, last, stops = codec.encode_batch(b"".join(texts), np.cumsum([len(x) for x in texts], dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), _binary(ids.tobytes(), last * 4), _binary(stops.tobytes(), last * 4)],
                [key, "ids", "stops"])
    return df.select(key, text).mapInArrow(run, f"`{key}` {ktype}, ids binary, stops binary")


def decode(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, ids, decoded binary) of rows that ``encode`` made; null ids give no bytes."""
    shared = (vocabulary.id, vocabulary.shared)
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        codec = codec_of(shared)
        for b in slices(batches):
            ids, stops = ([x or b"" for x in b.column(i).to_pylist()] for i in (1, 2))
            flat, places = (np.frombuffer(b"".join(x), "<u4") for x in (ids, stops))
            data, ends = codec.decode_batch(flat, np.cumsum([len(x) // 4 for x in ids], dtype=np.int64), places)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(data, ends)], [key, "ids", "decoded"])
    return df.select(key, "ids", "stops").mapInArrow(run, f"`{key}` {ktype}, ids binary, decoded binary")


def op12_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    vocabulary = Vocabulary(spark)
    out = decode(encode(load(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return out.select("doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op12_bytebpe": op12_bytebpe}
SQL: dict[str, str] = {}
