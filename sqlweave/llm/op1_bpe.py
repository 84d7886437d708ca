"""Operator 1, byte-level BPE encoding and decoding.

Encoding of one pre-token is the backtracking method: an Aho-Corasick pass
finds the longest vocabulary token starting at every byte; the encoder takes
the longest token, checks it against the token before it in a
pair-compatibility table, falls back to the next shorter prefix token, and
backtracks over boundaries that no valid encoding reaches. Each boundary is
given up at most once, so the work is linear in the text, and the result is
exactly that of applying the merges in rank order. Decoding gathers bytes
through an offset table, whole Arrow batches at a time.

A text is first split at the vocabulary's added tokens, then by the byte-level
pattern. Distinct pre-tokens are remembered per worker in a two-generation
memo of bounded size; it changes speed only.

Nulls: a null text counts as empty (no ids). Empty texts give empty id lists.
Repeated rows each give a row. Extra columns are ignored; tables without rows
give no rows. Ids outside the vocabulary raise.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load, slices, vocab_path
from sqlweave.session import ship_package

# Fixed value: the pattern of byte-level pre-tokenization.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++"
           r"|\s+(?!\S)|\s+")
MEMO = 250_000  # pre-tokens per generation of the memo (two are kept)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tables:
    """Everything derived from a vocabulary file: tokens, splits, prefixes, the automaton."""

    def __init__(self, spec: bytes):
        import ahocorasick
        import regex
        d = json.loads(spec)
        alpha = byte_alphabet()
        vocab = {"".join(chr(alpha[c]) for c in t): i for t, i in d["model"]["vocab"].items()
                 if all(c in alpha for c in t)}
        self.added = {a["content"]: a["id"] for a in d.get("added_tokens", [])}
        for t in self.added:
            vocab.pop(t, None)
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.wide = size > 1 << 16  # ids need more than 16 bits
        self.length = [0] * size
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.shorter = [-1] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for r, m in enumerate(d["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = ("".join(chr(alpha[c]) for c in x) for x in (a, b))
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.merge_rank[i, j] = r
            self.rank[k], self.left[k], self.right[k] = r, i, j
        self.ac = ahocorasick.Automaton()
        blob = [b""] * size
        for t, i in vocab.items():
            self.length[i] = len(t)
            blob[i] = t.encode("latin-1")
            self.ac.add_word(t, i)
            for cut in range(len(t) - 1, 0, -1):
                if t[:cut] in vocab:
                    self.shorter[i] = vocab[t[:cut]]
                    break
        self.ac.make_automaton()
        for t, i in self.added.items():
            blob[i] = t.encode()
        self.offsets = np.zeros(size + 1, np.int64)
        np.cumsum([len(b) for b in blob], out=self.offsets[1:])
        self.blob = np.frombuffer(b"".join(blob), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") \
            if self.added else None
        self.fits = Fits(self)
        self.memo = Memo(self)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token, given as one character per byte."""
        n, length, shorter, fits = len(piece), self.length, self.shorter, self.fits
        longest = [0] * n
        for end, t in self.ac.iter(piece):
            longest[end + 1 - length[t]] = t  # later ends are longer
        ids, pos, dead, last, t = [], 0, bytearray(n + 1), -1, longest[0]
        while True:
            end = pos + length[t]
            if (last < 0 or fits[last, t]) and not dead[end]:
                ids.append(t)
                if end == n:
                    return ids
                pos, last, t = end, t, longest[end]
            elif shorter[t] >= 0:
                t = shorter[t]
            else:
                dead[pos] = 1
                t = ids.pop()
                pos -= length[t]
                last = ids[-1] if ids else -1

    def encode(self, text: str) -> list[int]:
        memo = self.memo.new
        if self.cut is None or "<" not in text and not self.cut.search(text):
            parts = (text,)
        else:
            parts = self.cut.split(text)
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.added[part])
            else:
                for x in map(memo.__getitem__, self.pattern.findall(part)):
                    ids += x
                memo = self.memo.turn()
        return ids

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of consecutive id runs; ``ends`` are the runs' ends in ``ids``."""
        if ids.size and (ids.min() < 0 or ids.max() >= len(self.offsets) - 1):
            raise ValueError("id outside the vocabulary")
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        stop = np.cumsum(size)
        at = np.arange(stop[-1] if size.size else 0) + np.repeat(begin - (stop - size), size)
        out = self.blob[at].tobytes()
        byte_ends = np.concatenate(([0], stop))[ends]
        begins = np.concatenate(([0], byte_ends[:-1]))
        return [out[a:b].decode("utf-8", "replace") for a, b in zip(begins, byte_ends)]


class Fits(dict):
    """Pair compatibility, filled as pairs are met; bounded, as it only saves time."""

    def __init__(self, tables: Tables):
        super().__init__()
        self.tables = tables

    def __missing__(self, pair: tuple[int, int]) -> bool:
        """True if a merge never joins the last part of one token with the first of the next.

        Undo the two tokens' merges from the latest to the earliest. Between
        two undone merges the parts at the boundary are fixed; a merge of these
        parts that ranks before the merge undone last would have come first.
        Of equal ranks the left one comes first.
        """
        x, (a, b) = self.tables, pair
        before, ok = len(x.merge_rank), True
        while True:
            m = x.merge_rank.get((a, b))
            if m is not None and m < before:
                ok = False
                break
            if x.rank[a] > x.rank[b]:
                before, a = x.rank[a], x.right[a]
            elif x.rank[b] >= 0:
                before, b = x.rank[b] + 1, x.left[b]
            else:
                break
        if len(self) >= MEMO:
            self.clear()
        self[pair] = ok
        return ok


class Memo:
    """Two generations of pre-token -> ids; the older one goes when the newer is full."""

    def __init__(self, tables: Tables):
        self.tables, self.old = tables, {}
        self.new = self._fresh()

    def _fresh(self):
        outer = self

        class Generation(dict):
            def __missing__(self, piece: str):
                ids = outer.old.get(piece)
                if ids is None:
                    ids = tuple(outer.tables.encode_piece(piece.encode().decode("latin-1")))
                if len(piece) <= 64:  # long pieces rarely come back
                    self[piece] = ids
                return ids
        return Generation()

    def turn(self):
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, self._fresh()
        return self.new


_TABLES: dict[int, Tables] = {}


def tables_of(spec) -> Tables:
    """Tables of a broadcast vocabulary, built once per Python worker."""
    if spec.id not in _TABLES:
        _TABLES.clear()
        _TABLES[spec.id] = Tables(spec.value)
    return _TABLES[spec.id]


class _Spec:
    """A broadcast vocabulary with a stable id."""

    def __init__(self, spark: SparkSession, path: str):
        import zlib
        with open(path, "rb") as f:
            data = f.read()
        self.id, self._data = zlib.crc32(data), spark.sparkContext.broadcast(data)

    @property
    def value(self) -> bytes:
        return self._data.value


def vocabulary(spark: SparkSession, path: str | None = None) -> _Spec:
    """Read a vocabulary on the driver (a file of fixed size) and send it to the executors."""
    ship_package(spark)
    return _Spec(spark, path or vocab_path())


def encode(df: DataFrame, spec: _Spec, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row of ``df``."""
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        t = tables_of(spec)
        for b in slices(batches):
            ids = [t.encode(x) if x else [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))],
                                             [key, "ids"])
    return df.select(key, text).mapInArrow(run, f"`{key}` {ktype}, ids array<int>")


def decode(df: DataFrame, spec: _Spec, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text) for every row of ``df``; a null id list gives an empty text."""
    ktype = df.schema[key].dataType.simpleString()

    def run(batches):
        t = tables_of(spec)
        for b in slices(batches):
            lists = b.column(1)
            lens = np.array([len(x) if x is not None else 0 for x in lists], np.int64)
            flat = np.asarray(lists.flatten(), np.int64)
            texts = t.decode_batch(flat, np.cumsum(lens)) if len(lens) else []
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.string())],
                                             [key, "ids", "text"])
    return df.select(key, ids).mapInArrow(run, f"`{key}` {ktype}, ids array<int>, text string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    spec = vocabulary(spark)
    out = decode(encode(load(spark, sf_dir, "documents"), spec), spec)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                      F.sha2("text", 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}
