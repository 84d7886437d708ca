"""BPE against the tokenizers library, packing against its definition."""
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sqlweave.llm.common import vocab_path
from sqlweave.llm.op1_bpe import Tables, decode, encode, vocabulary
from sqlweave.llm.op7_packing import fill_window, pack, place_pieces, plan_windows, segments, tokenize

from .conftest import DOC_SCHEMA, ODD_ROWS


@pytest.fixture(scope="module")
def own():
    with open(vocab_path(), "rb") as f:
        return Tables(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocab_path())


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("aabeorst' 's\n\té漢1²<|>.,🎉　"), max_size=80))
def test_equals_library(own, library, text):
    assert own.encode(text) == ids_of(library, text)


@pytest.mark.parametrize("text", ["<|endoftext|>a<|endoftext|>  b", " <|endoftext|> ", "a" * 20_000, "ab" * 9_000,
                                  " " * 3_000, "'s 're''ll x's's  's", "\x00\x01\x1c\x85"])
def test_equals_library_on_hard_texts(own, library, text):
    assert own.encode(text) == ids_of(library, text)


def test_characters_fall_in_the_same_classes(own, library):
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    for i in range(0, len(points), 512):
        text = "".join(f"a{chr(c)}1 {chr(c)}." for c in points[i:i + 512])
        assert own.encode(text) == ids_of(library, text)


def test_every_token_encodes_to_itself(own):
    for i in random.Random(1).sample(range(len(own.length)), 5_000):
        piece = own.blob[own.offsets[i]:own.offsets[i + 1]].tobytes().decode("latin-1")
        if i not in own.added.values():
            assert own.encode_piece(piece) == [i]


def test_decode_round_trip_and_broken_bytes(own, library):
    ids = [np.array(own.encode(t or ""), np.int64) for _, t, _, _ in ODD_ROWS]
    texts = own.decode_batch(np.concatenate(ids), np.cumsum([len(x) for x in ids]))
    assert texts == [t or "" for _, t, _, _ in ODD_ROWS]
    r = random.Random(2)
    for _ in range(200):
        some = [r.randrange(256) for _ in range(6)]  # single bytes, mostly not UTF-8
        assert own.decode_batch(np.array(some), np.array([6]))[0] == library.decode(some, skip_special_tokens=False)
    with pytest.raises(ValueError):
        own.decode_batch(np.array([10**6]), np.array([1]))


def test_operators(spark, library):
    docs = spark.createDataFrame(ODD_ROWS, DOC_SCHEMA)
    spec = vocabulary(spark)
    rows = decode(encode(docs, spec), spec).collect()
    want = {(r[0], tuple(ids_of(library, r[1] or "")), r[1] or "") for r in ODD_ROWS}
    assert {(r["doc_id"], tuple(r["ids"]), r["text"]) for r in rows} == want


def test_fill_window_is_closest():
    r = random.Random(3)
    for _ in range(200):
        counts = {r.randint(1, 30): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        target = r.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        best, used = fill_window(counts, target)
        assert best == max(s for s in sums if s <= target) == sum(k * n for k, n in used.items())
        assert all(n <= counts[k] for k, n in used.items())


def test_plan_uses_every_piece():
    r = random.Random(4)
    for _ in range(50):
        counts = {r.randint(1, 99): r.randint(1, 40) for _ in range(r.randint(0, 20))}
        windows, aside = plan_windows(counts, 100)
        seen = dict(aside)
        for times, used in windows:
            assert sum(k * m for k, m in used.items()) == 100
            for k, m in used.items():
                seen[k] = seen.get(k, 0) + m * times
        assert seen == counts
        segments(windows, aside, counts, 100)


def check_packing(rows, ids, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (str(r["doc_id"]), r["start"])):
        want = ids[r["doc_id"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(want)
        part = want[r["start"]:r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {k: len(v) for k, v in ids.items()}
    used = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= capacity
    assert sum(v < capacity for v in used.values()) <= 1


def test_packing(spark, library):
    texts = {i: ("word " * (i * 7 % 90) + "x" * (i % 5)) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    rows = pack(docs, capacity=64).collect()
    check_packing(rows, {i: ids_of(library, t) + [0] for i, t in texts.items()}, 64)


def test_packing_one_length(spark, library):
    docs = spark.createDataFrame([(i, "one two three") for i in range(100)], "doc_id long, text string")
    rows = place_pieces(tokenize(docs, vocabulary(spark), 7), 7).collect()
    check_packing(rows, {i: ids_of(library, "one two three") + [0] for i in range(100)}, 7)


def test_quick_encoder_equals_library(own, library):
    from sqlweave.llm import op7_packing

    class Spec:
        id = -1
        with open(vocab_path(), "rb") as f:
            value = f.read()
    quick = op7_packing.quick_encoder(Spec)
    texts = [t or "" for _, t, _, _ in ODD_ROWS] + ["'s 're <|endoftext|> x\n\n y", "a" * 9_999]
    texts += ["".join(f"a{chr(c)}1 {chr(c)}." for c in range(i, i + 512)) for i in range(0, 0xD800, 512)]
    for t in texts:
        assert quick(t).tolist() == ids_of(library, t) == own.encode(t)


@pytest.mark.parametrize("c", [" ", "\n", "\t", "\u3000", "x", "#"])
def test_runs_of_two_million_characters(own, c):
    from sqlweave.llm import op7_packing

    class Spec:
        id = -1
        with open(vocab_path(), "rb") as f:
            value = f.read()
    text = "a" + c * 2_000_000 + "b"
    ids = op7_packing.quick_encoder(Spec)(text)
    assert ids.tolist() == own.encode(text)
    assert own.decode_batch(np.asarray(ids, np.int64), np.array([len(ids)])) == [text]


@pytest.mark.parametrize("c", [" ", "\n", "\t", "\u3000", "x", "#"])
def test_long_runs_equal_library(own, library, c):
    text = "a" + c * 300_000 + "b"
    assert own.encode(text) == ids_of(library, text)
