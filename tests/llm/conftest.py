import random

import pytest

from sqlweave.llm.registry import MODULES

SYLLABLES = "ba ke lo mi nu ra se ti vo za".split()


def prose(seed, words=60):
    r = random.Random(seed)
    out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(words)]
    return " ".join(w + (". " if i % 9 == 8 else "") for i, w in enumerate(out))


LONG = prose(7, 30_000)

#: doc_id, text, lang, source: nulls in any column, empty and very long texts, ties, repeated rows.
ODD_ROWS = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "word", "en", None),
    (5, prose(1), "en", "a"), (6, prose(1), "en", "b"), (6, prose(1), "en", "b"), (7, prose(2), None, None),
    (8, LONG, "de", "a"), (9, "x" * 50_000, "en", "a"), (10, "\x00 <|endoftext|> ' 's", "fr", "a"),
    (11, "line here\n" * 40, "en", "a"), (12, "É　ñ 漢字 \U0001f389 1.5", "fr", "c"),
    (None, prose(3), "en", "a"), (13, None, None, None), (2, "", "en", "a"),
    (14, "under the MIT license. " + prose(4), "en", "a"),
]
DOC_SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Folder -> tables with odd rows ('odd') and without rows ('empty')."""
    from pyspark.sql import functions as F
    out = {}
    for kind, rows in (("odd", ODD_ROWS), ("empty", [])):
        root = str(tmp_path_factory.mktemp(kind))
        docs = spark.createDataFrame(rows, DOC_SCHEMA)
        # names that the operators use themselves
        for c in ("ids", "key", "k1", "shard", "bytes", "score", "kept", "bucket", "n", "id", "rest", "_row", "votes",
                  "_again", "class_id", "w", "cells", "rn", "full", "k", "t", "row", "first", "probe", "runs", "stops"):
            docs = docs.withColumn(c, F.lit("clash"))
        docs.withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{root}/documents.parquet")
        vec = [(1, [1.0, 0.0], 1, "z"), (2, [1.0, 0.01], 1, "z"), (3, [1.0, 0.0], 2, "z"), (4, None, 1, "z"),
               (5, [0.0, 0.0], 1, "z"), (6, [float("nan"), 1.0], 1, "z"), (7, [1.0, None], 1, "z"),
               (8, [1.0, 0.0], None, "z"), (9, [2.0, 0.0], 1, "z"), (10, [1.0, 0.0], 1, "z"), (10, [1.0, 0.0], 1, "z"),
               (11, [float("inf"), 0.0], 1, "z"), (None, [1.0, 0.0], 1, "z"), (12, [], 1, "z"), (13, [1.0, 0.0, 0.0], 1, "z")]
        spark.createDataFrame(vec if rows else [], "vec_id long, embedding array<float>, label int, code string"
                              ).write.parquet(f"{root}/embeddings.parquet")
        big = "<p>" + "y" * 2000
        page = [(1, "u1", big, "d"), (2, "u2", big, "d"), (3, None, big, "d"), (4, "u4", None, "d"), (5, "u5", "", "d"),
                (6, "u 6\n", "small", "d"), (7, "u7", "small", "d"), (None, "u8", big, "d"), (2, "u2", big, "d"),
                (8, "u1", "<p>" + "z" * 300_000, "d")]
        spark.createDataFrame(page if rows else [], "page_id long, url string, html string, digest string"
                              ).write.parquet(f"{root}/pages.parquet")
        turn = [(1, 0, "system", "Be kind.", "c"), (1, 1, "user", "What now?", "c"), (1, 2, "assistant", "This.", "c"),
                (2, None, "user", "Hello", "c"), (2, None, None, "Odd.", "c"), (2, 1, "assistant", None, "c"),
                (2, 1, "assistant", "Yes.", "c"), (2, 1, "assistant", "Yes.", "c"), (2, 9, "tool", "Ran.", "c"),
                (None, None, None, None, "c"), (None, 3, "user", "", "c"), (None, 3, "user", " \t\n", "c"),
                (3, 5, "", "x!", "c"), (4, 1, "user", "\u3000", "c"), (5, 2, "assistant", LONG, "c")]
        turn += [(6, i, "user" if i % 2 else "assistant", f"Line {i % 700}.", "c") for i in range(3000)]
        spark.createDataFrame(turn if rows else [], "conv_id long, turn long, role string, text string, syms string"
                              ).withColumns({c: F.lit("clash") for c in ("part", "seq", "fault", "digest", "_row", "kind", "audit", "cost")}
                                            ).write.parquet(f"{root}/conversations.parquet")
        out[kind] = root
    return out


@pytest.fixture(scope="session")
def query():
    from sqlweave.llm.registry import queries
    qs = queries()
    return lambda n: qs[next(k for k in qs if k.startswith(f"op{n}_"))]


assert len(MODULES) == 13
