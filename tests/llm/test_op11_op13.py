"""Conversation repair and periodic runs against brute force, byte-level BPE against the library."""
import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken

from sqlweave.llm import op11_conversations as op11
from sqlweave.llm import op12_bytebpe as op12
from sqlweave.llm import op13_runs as op13

from .conftest import ODD_ROWS, prose

SF = "/root/testdata/sf0.001"


# conversation repair

def cheapest(rows):
    """(cost, audit) over all edits of (initial, must go, truncated), strings built from the back."""
    nxt = {"": "u", "s": "u", "a": "u", "u": "a"}
    rest: dict = {}  # (state, insertions so far) -> cheapest for the rows that follow
    for i in range(len(rows), -1, -1):
        here: dict = {}
        for inserted in (3, 2, 1, 0):
            for state in nxt:
                ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
                ways += [(5 + w[0], "I" + w[1]) for w in [here.get((nxt[state], inserted + 1))] if w]
                if i < len(rows):
                    initial, gone, cut = rows[i]
                    ways += [(2 + w[0], "D" + w[1]) for w in [rest.get((state, 0))] if w]
                    if not gone:
                        ways += [(1 + 5 * cut + w[0], "R" + w[1]) for w in [rest.get((nxt[state], 0))] if w]
                        if initial == nxt[state] or initial == "s" and state == "":
                            ways += [(5 * cut + w[0], "K" + w[1]) for w in [rest.get((initial, 0))] if w]
                if ways:
                    here[state, inserted] = min(ways)
        rest = here
    return rest["", 0]


def expected(conversations):
    """The query's result by its contract, conversation by conversation."""
    convs = {}
    for conv, turn, role, text in conversations:
        role, text = (" " if x is None else x for x in (role, text))
        rows = convs.setdefault(conv, [])
        case = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if case:
            text = "" if case == 1 else "".join(c for c in text if c not in ".!?") if case == 2 else text
            rows += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen
                          else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = cheapest(tuple((r[1][:1], f in ("blank", "duplicate"), f == "truncated")
                                     for r, f in zip(rows, faults)))
        lines, at, state = [], 0, ""
        for e in audit:
            role, text = ("assistant" if state == "u" else "user"), ""
            if e != "I":
                text, role = rows[at][2], rows[at][1] if e == "K" else role
                at += 1
            if e != "D":
                state = role[0]
                lines.append(f"{role}:{text}")
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [r[1][:1] for r in rows]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def as_dict(rows):
    return {r["conv_id"]: tuple(r[c] for c in (*op11.FACTS, "audit", "repaired_sha256")) for r in rows}


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_repaired_conversations(spark, tables, query, table, monkeypatch):
    root = SF if table == "sf" else tables["odd"]
    if table == "odd":
        monkeypatch.setattr(op11, "BLOCK_ROWS", 64)  # one conversation has 3,000 rows
    rows = query(11)(spark, root).collect()
    source = spark.read.parquet(f"{root}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    want = expected([tuple(r) for r in source])
    assert len(rows) == len(want) and as_dict(rows) == want


def test_products_of_any_grammar_are_cheapest():
    r = random.Random(3)
    for _ in range(500):
        syms = bytes(r.choices(range(9), [2, 3, 0, 8, 1, 8, 1, 0.3, 0.2], k=r.randint(1, 14)))
        rounds, new = [], 9
        for _ in range(r.randint(0, 4)):
            rounds.append({(r.randrange(new), r.randrange(new)): new})
            new += 1
        grammar = op11.Grammar([p for x in rounds for p in x])
        seq = op11.parse(syms, rounds)
        cost, rank = grammar.compose(seq)
        total, _, end = min((cost[0][s] + 5 * op11.TO_END[s], rank[0][s], s) for s in range(4) if cost[0][s] is not None)
        audit = grammar.audit(seq, 0, end) + "I" * op11.TO_END[end]
        rows = tuple(("sua "[(s - 1) // 2] if s else "x", s == 0, bool(s) and (s - 1) % 2 == 1) for s in syms)
        assert (total, audit) == cheapest(rows)


def test_grammar_shares_long_sequences(spark):
    rows = [(bytes([1] + [3, 5] * 200),)] * 3 + [(bytes([3, 5] * i),) for i in range(1, 30)]
    rounds = op11.repair_grammar(spark.createDataFrame(rows, "syms binary"))
    assert rounds[0] == {(3, 5): 9}
    assert all(len(op11.parse(x, rounds)) < 60 for x, in rows)


# byte-level BPE

@pytest.fixture(scope="module")
def codec():
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return op12.Codec(f.read(), op12.code_point_classes().tobytes())


@pytest.fixture(scope="module")
def library(codec):
    import public_tokenizers
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def check_codec(codec, library, texts):
    data = [x.encode() for x in texts]
    ends = np.cumsum([len(x) for x in data], dtype=np.int64)
    ids, last, stops = codec.encode_batch(b"".join(data), ends)
    begin = 0
    for x, end in zip(texts, last.tolist()):
        assert ids[begin:end].tolist() == library.encode_ordinary(x)
        begin = end
    assert codec.decode_batch(ids, last, stops)[0] == b"".join(data)


def test_random_texts(codec, library):
    r = random.Random(1)
    letters = "aabeorst' 's\n\té漢1²<|>.,🎉　 reveldmSTt\x00"
    for _ in range(60):
        check_codec(codec, library, ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(100)])
    check_codec(codec, library, [])
    check_codec(codec, library, ["", "x", "", "'s", " ", "' re", "'ll've", "  'd", "\n's", "''s", "\r\n \n"])


def test_every_code_point(codec, library):
    points = [c for c in range(0xE0200) if not 0xD800 <= c <= 0xDFFF and not 0x33500 <= c < 0xE0000]  # the assigned planes
    for i in range(0, len(points), 1 << 14):
        check_codec(codec, library, ["".join(f"a{chr(c)}1 {chr(c)}." for c in points[i:i + (1 << 14)])])


def test_long_runs(codec, library):
    check_codec(codec, library, [c * 20_000 for c in (" ", "\n", "a", "1", "#", "　", "ab", "\t x")])
    for c in (" ", "\n", "x"):
        ids, last, stops = codec.encode_batch(c.encode() * 2_000_000, np.array([2_000_000]))
        assert codec.decode_batch(ids, last, stops)[0] == c.encode() * 2_000_000


def test_both_merge_orders_agree(codec):
    r = random.Random(2)
    for _ in range(300):
        piece = "".join(r.choice("abcdeéthin") for _ in range(r.randint(2, 100))).encode()
        assert codec._short(piece) == codec._long(piece)


def test_scan_equals_stepping():
    r = np.random.default_rng(4)
    symbols = r.integers(0, 2 * op12.SYMBOLS, 3_000).astype(np.uint8)
    state, want = op12.FRESH, []
    for s in symbols.tolist():
        want.append(state)
        state = op12._next_state(op12.FRESH if s >= op12.SYMBOLS else state, s % op12.SYMBOLS)
    assert op12.states_before(symbols).tolist() == want


def test_offsets_are_kept(codec):
    ids, last, stops = codec.encode_batch("one two 漢字".encode(), np.array([14]))
    data = "one two 漢字".encode()
    assert b"".join(codec.blob[codec.offsets[i]:codec.offsets[i + 1]].tobytes() for i in ids) == data
    for i, a, b in zip(ids.tolist(), [0, *stops.tolist()], stops.tolist()):
        assert data[a:b] == codec.blob[codec.offsets[i]:codec.offsets[i + 1]].tobytes()
    with pytest.raises(ValueError):
        codec.decode_batch(np.array([10**6]), np.array([1]), np.array([1]))


def test_encoding_query(spark, tables, query, library):
    def row(doc_id, text):
        ids = library.encode_ordinary(text or "")
        return (doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest())
    got = [tuple(r) for r in query(12)(spark, tables["odd"]).collect()]
    assert sorted(got, key=str) == sorted((row(d, t) for d, t, *_ in ODD_ROWS), key=str)


# periodic runs

def slow_runs(words, least, times):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(least, times * q) and not any(
                    all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    r, seen = random.Random(5), 0
    for _ in range(1500):
        n, k = r.randint(0, 90), r.choice([1, 2, 2, 3, 5])
        words = [r.randrange(k) for _ in range(n)]
        for _ in range(r.randint(0, 3) if n > 10 else 0):
            a, p = r.randrange(n), r.randint(1, 8)
            for i in range(a, min(n, a + r.randint(1, 60))):
                words[i] = words[a + (i - a) % p]
        least, times = r.choice([(24, 3), (6, 3), (5, 2), (4, 4), (1, 3)])
        want = slow_runs(words, least, times)
        seen += len(want)
        assert op13.batch_runs([np.array(words, np.int64)], least, times).get(0, []) == want
    assert seen > 500


def test_long_periodic_text():
    for p in (1, 1000):
        words = np.concatenate([np.arange(60_000) % p, np.arange(5) + p])
        assert op13.batch_runs([words], 24, 3) == {0: [(0, 60_000, p)]}


def test_ordered_positions():
    r = random.Random(6)
    some = r.sample(range(100_000), 5_000)
    one, have = op13.Positions(some[0]), [some[0]]
    for x in some[1:]:
        low, high = one.add(x)
        assert low == max((y for y in have[-50:] if y < x), default=low) or low > max(y for y in have[-50:] if y < x)
        assert low < x and (high == -1 or high > x)
        have.append(x)
    assert list(one) == sorted(have)


@pytest.mark.parametrize("table", ["odd", "sf"])
def test_run_query(spark, tables, query, table):
    root = SF if table == "sf" else tables["odd"]
    docs = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for doc_id, text in docs:
        words = (text or "").encode().split()
        if words and (take := op13.planted(doc_id, len(words))) is not None:
            words = [words[i] for i in take]
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        found = slow_runs([number[w] for w in words], 24, 3) if len(words) < 3_000 else op13.runs_of(
            np.array([number[w] for w in words]))
        best = max(found, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        sha = [hashlib.sha256(x).hexdigest() for x in (
            "".join(f"{s},{n},{q}\n" for s, n, q in found).encode(),
            b" ".join(w for i, w in enumerate(words) if i not in gone))]
        want.append((doc_id, len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], *sha))
    got = [tuple(r) for r in query(13)(spark, root).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_every_tenth_document_is_planted():
    ids = range(2_000)
    hit = [i for i in ids if op13.planted(i, 100) is not None]
    assert 100 < len(hit) < 300
    assert op13.planted(None, 5) is None
    take = op13.planted(hit[0], 100).tolist()
    g = zlib.crc32(str(hit[0]).encode()) // 10
    a, p = g % 100, 1 + (100 - g % 100) // (3 + g % 8)
    assert take == [i if i < a else a + (i - a) % p for i in range(100)]


def test_prose_has_no_runs():
    words = prose(3, 3_000).encode().split()
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    assert op13.batch_runs([np.array([number[w] for w in words])], 24, 3) == {}
