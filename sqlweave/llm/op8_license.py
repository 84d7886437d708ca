"""Operator 8, license scans by fuzzy search of short notices.

A notice may occur with a bounded number of edits. By the pigeonhole principle
a notice cut into (edits + 1) pieces keeps at least one piece unchanged, so an
Aho-Corasick pass over all pieces finds every place where a match can lie.
The regex library then verifies each candidate window with its bounded-error
matching and gives the span and the edits. Of a notice's matches the one with the
fewest edits is taken first, then the leftmost, then the same among those that don't
overlap the ones taken, until none is left. Exact notices are the zero-error case:
their word places are counted on the normalised words.

Text: A-Z lower-cased; words are runs of digits, a-z and characters outside
ASCII; the search text is the words joined by one space.

Nulls: a null text counts as empty: no words, no labels, score 0. Repeated
rows give repeated results; empty tables none; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.llm.common import load, slices
from sqlweave.session import ship_package

#: Fixed values of the query's contract: phrase -> label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices searched with errors: text -> (label, edits allowed).
FUZZY = {
    "under the mit license": ("mit", 2),
    "apache license version 2": ("apache-2", 2),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 6),
    "redistribution and use in source and binary forms": ("bsd", 4),
    "gnu general public license": ("gpl", 2),
    "gnu lesser general public license": ("lgpl", 3),
    "mozilla public license": ("mpl", 2),
    "creative commons attribution noncommercial": ("cc-by-nc", 4),
}

_KEEP = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32
              for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_KEEP).split()


class Notices:
    """Seeds and verifying patterns of the notices."""

    def __init__(self, base: dict, fuzzy: dict):
        import ahocorasick
        import regex
        self.base = [(f" {p} ", label) for p, label in base.items()]
        self.fuzzy = []
        seeds: dict[str, set] = {}
        for k, (notice, (label, edits)) in enumerate(fuzzy.items()):
            self.fuzzy.append((label, edits, len(notice), [
                regex.compile(f"(?:{regex.escape(notice)}){{e<={e}}}") for e in range(edits + 1)]))
            step, extra, at = *divmod(len(notice), edits + 1), 0
            for i in range(edits + 1):
                size = step + (i < extra)
                seeds.setdefault(notice[at:at + size], set()).add((k, at))
                at += size
        self.ac = ahocorasick.Automaton()
        for s, where in seeds.items():
            self.ac.add_word(s, (len(s), tuple(sorted(where))))
        self.ac.make_automaton()

    def scan(self, text: str):
        """(n_words, base hits as (word, label), fuzzy hits as (label, begin, end, edits))."""
        words = words_of(text)
        joined = " " + b" ".join(words).decode() + " "
        exact = []
        for phrase, label in self.base:
            at = joined.find(phrase)
            seen, n = 0, 0
            while at >= 0:
                n += joined.count(" ", seen, at)
                seen = at
                exact.append((n, label))
                at = joined.find(phrase, at + 1)
        return len(words), exact, self._near(joined)

    def _near(self, joined: str):
        # windows in which a match can lie, merged per notice
        windows: dict[int, list] = {}
        for end, (size, where) in self.ac.iter(joined):
            for k, at in where:
                _, edits, length, _ = self.fuzzy[k]
                a = max(0, end + 1 - size - at - edits)
                b = min(len(joined), a + length + 3 * edits)
                spans = windows.setdefault(k, [])
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], b)
                    spans[-1][0] = min(spans[-1][0], a)
                    spans[-1][2].add(at)
                else:
                    spans.append([a, b, {at}])
        found = []
        for k, spans in windows.items():
            label, edits, length, patterns = self.fuzzy[k]
            for a, b, _ in spans:
                if not patterns[-1].search(joined, a, b):
                    continue
                free = [(a, b)]  # parts of the window without a match of fewer edits than the pass's
                for e, pattern in enumerate(patterns):
                    rest = []
                    for at, end in free:
                        for m in pattern.finditer(joined, at, end) if end - at >= length - e else ():
                            found.append((label, m.start(), m.end(), sum(m.fuzzy_counts), length))
                            rest.append((at, m.start()))
                            at = m.end()
                        rest.append((at, end))
                    free = rest
        return sorted(found)


SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<label:string,begin:int,end:int,edits:int>>")


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", base: dict = BASE,
                  fuzzy: dict = FUZZY) -> DataFrame:
    """One row per row of ``df``: counts, labels, best similarity, spans in the normalised text."""
    ship_package(df.sparkSession)
    ktype = df.schema[key].dataType.simpleString()

    def row(notices, text):
        n, exact, near = notices.scan(text or "")
        places = [w for w, _ in exact]
        sure = sorted({x for _, x in exact})
        score = max([1.0 if exact else 0.0, *(1 - e / size for _, _, _, e, size in near)])
        return {"n_words": n, "n_base": len(places), "first_word": min(places, default=None),
                "last_word": max(places, default=None), "base_labels": ",".join(sure),
                "labels": ",".join(sorted({*sure, *(x[0] for x in near)})), "score": score,
                "spans": [{"label": a, "begin": b, "end": c, "edits": d} for a, b, c, d, _ in near]}

    kinds = pa.struct([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                       ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                       ("score", pa.float64()),
                       ("spans", pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int32()),
                                                     ("end", pa.int32()), ("edits", pa.int32())])))])

    def run(batches):
        notices = Notices(base, fuzzy)
        for b in slices(batches):
            out = pa.array([row(notices, x) for x in b.column(1).to_pylist()], kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *out.flatten()],
                                             [key, *(f.name for f in kinds)])
    return df.select(key, text).mapInArrow(run, f"`{key}` {ktype}, {SCHEMA}")


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan_licenses(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.size("spans").alias("n_near"))


QUERIES = {"op8_license": op8_license}
SQL: dict[str, str] = {}
