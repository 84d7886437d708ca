"""Sharding (3), WARC (5), license scans (8), MinHash (9), rules (10), pipeline: against brute force."""
import collections
import gzip
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from sqlweave.llm import op3_shards, op5_warc, op8_license, op9_minhash, op10_rules
from sqlweave.llm.common import Recent

from .conftest import DOC_SCHEMA, prose

SF = "/root/testdata/sf0.001"


# --- sharding

def best_capacity(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 4, 9])
def test_minimax_is_optimal(spark, shards):
    r = random.Random(shards)
    sizes = {f"{r.getrandbits(256):064x}": r.randint(1, 50) for _ in range(400)}
    groups = spark.createDataFrame(list(sizes.items()), "key string, bytes long")
    rows = op3_shards.assign_shards(groups, shards).collect()
    used = collections.Counter()
    for x in rows:
        used[x["shard"]] += x["bytes"]
    assert max(used.values()) <= best_capacity([sizes[k] for k in sorted(sizes)], shards)
    order = [x["shard"] for x in sorted(rows, key=lambda x: x["key"])]
    assert order == sorted(order) and set(order) <= set(range(shards))
    # also with most of the tree below the first level
    sums = op3_shards.PrefixSums(groups)
    cap, cuts = op3_shards.minimax_cuts(sums, shards, max(sizes.values()))
    assert cap == best_capacity([sizes[k] for k in sorted(sizes)], shards) and len(cuts) == shards - 1


def test_tree_of_prefixes_is_exact(spark, monkeypatch):
    monkeypatch.setattr(op3_shards, "ROOT", 1)
    monkeypatch.setattr(op3_shards, "STEP", 1)
    r = random.Random(5)
    sizes = {f"{r.getrandbits(256):064x}": r.randint(1, 90) for _ in range(300)}
    sums = op3_shards.PrefixSums(spark.createDataFrame(list(sizes.items()), "key string, bytes long"))
    cap, _ = op3_shards.minimax_cuts(sums, 6, max(sizes.values()))
    assert cap == best_capacity([sizes[k] for k in sorted(sizes)], 6)


def test_shards_of_a_hot_group(spark, tmp_path):
    texts = ["copy " * 40] * 150 + [prose(i, 30) for i in range(300)] + [None, ""]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOC_SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op3_shards.op3_shards(spark, str(tmp_path), 10).toPandas()
    assert len(got) == len(texts)
    by_text = got.assign(t=[texts[i] or "" for i in got.doc_id]).groupby("t").shard.nunique()
    assert (by_text == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert (got["size"] == [len((texts[i] or "").encode()) + 16 for i in got.doc_id]).all()
    assert (got.text_crc32 == [zlib.crc32((texts[i] or "").encode()) for i in got.doc_id]).all()
    hot = got.shard[got.doc_id == 0].iloc[0]
    rest = got[got.shard != hot].groupby("shard")["size"].sum()
    assert len(rest) == 9 and rest.max() < 1.2 * rest.mean()


# --- WARC

def page_rows():
    big = "<p>" + "y" * 1500
    return [(i, f"http://h{i % 7}.example/{i}", big if i % 3 == 0 else "<i>" + prose(i, 300)) for i in range(120)]


def test_warc_files_are_deterministic_and_rolled(spark, tmp_path):
    docs = spark.createDataFrame(page_rows(), "page_id long, url string, html string")
    made = []
    for k, parts in enumerate((3, 8)):
        folder = f"{tmp_path}/w{k}"
        m = op5_warc.write_warc(docs.repartition(parts), folder, shard_bytes=40_000, roll_bytes=9_000).toPandas()
        made.append(sorted(map(tuple, m.itertuples(index=False))))
        files = sorted(f for f in os.listdir(folder) if f.endswith(".warc.gz"))
        assert files == sorted(m.file) and m.shard.nunique() > 2 and len(m) > m.shard.nunique()
        data = b"".join(gzip.open(f"{folder}/{f}").read() for f in files)
        assert data.count(b"WARC/1.1\r\n") == 120 == m.records.sum()
    assert made[0] == made[1]
    rows = op5_warc.read_warc(spark, f"{tmp_path}/w0", payloads=True).collect()
    text = {i: h for i, _, h in page_rows()}
    for r in rows:
        if r["record_type"] == "response":
            assert r["payload"].decode() == text[r["page_id"]]
        else:
            assert r["refers_to"] == 117 and r["page_id"] % 3 == 0
    assert sum(r["record_type"] == "revisit" for r in rows) == 39


def test_warc_reader_finds_damage():
    data = gzip.decompress(op5_warc.record(1, "u", b"payload"))
    assert op5_warc.parse(data)["payload"] == b"payload"
    with pytest.raises(ValueError):
        op5_warc.parse(data.replace(b"payload\r\n", b"paYload\r\n"))


def test_warc_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(op5_warc.SQL["op5_warc"])
    names = [c[0] for c in cur.description]
    want = sorted(cur.fetchall(), key=repr)
    assert sorted(map(tuple, op5_warc.op5_warc(spark, SF).select(*names).collect()), key=repr) == want


# --- license scans

def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in op8_license.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), sorted(places), labels


def test_license_scan(spark):
    texts = {1: "Released under the MIT License. " + prose(1), 2: prose(2) + " Licensed under CC BY-NC 4.0; cc by nc cc by nc",
             3: "released under the MTT licence, Version 2", 4: "Apache License,\nversion 2.0", 5: None, 6: "", 7: prose(3),
             8: "the GNU Genral Public License", 9: "É under—the mit license", 10: "under the mit licenses and more"}
    rows = op8_license.scan_licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    got = {r["doc_id"]: r for r in rows}
    for i, t in texts.items():
        n, places, labels = brute_base(t or "")
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (
            n, len(places), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[3]["labels"] == "mit" and got[3]["base_labels"] == "" and got[3]["spans"][0]["edits"] == 2
    assert got[8]["labels"] == "gpl" and got[7]["labels"] == "" and got[10]["labels"] == "mit"


def test_seeds_find_what_the_whole_text_search_finds():
    import regex
    r = random.Random(6)
    notices = op8_license.Notices(op8_license.BASE, op8_license.FUZZY)
    for _ in range(150):
        notice, (label, edits) = r.choice(list(op8_license.FUZZY.items()))
        s = list(notice)
        for _ in range(r.randint(0, edits + 2)):
            i = r.randrange(len(s))
            s[i:i + 1] = r.choice([[], ["q"], [s[i], "q"]])
        joined = f" {prose(1, 12).replace('.', '')} {''.join(s)} {prose(2, 12).replace('.', '')} "
        want = {k for n, (k, e) in op8_license.FUZZY.items() if regex.search(f"(?:{regex.escape(n)}){{e<={e}}}", joined)}
        assert {x[0] for x in notices._near(joined)} == want


def edit_ends(notice, part, most):
    """For each begin in ``part``: end -> edits, of the substrings within ``most`` edits of ``notice``."""
    out = []
    for i in range(len(part) + 1):
        row = list(range(len(notice) + 1))
        ends = {}
        for j in range(i, min(len(part), i + len(notice) + most) + 1):
            if j > i:
                new = [j - i]
                for n, c in enumerate(notice, start=1):
                    new.append(min(new[-1] + 1, row[n] + 1, row[n - 1] + (c != part[j - 1])))
                row = new
            if row[-1] <= most:
                ends[j] = row[-1]
        out.append(ends)
    return out


def test_adjacent_notices_are_all_found():
    r = random.Random(8)
    notices = op8_license.Notices(op8_license.BASE, op8_license.FUZZY)
    assert len(notices._near(" under the mit licence under the mit license ")) == 2
    for notice in ("under the mit license", "gnu lesser general public license"):
        label, most = op8_license.FUZZY[notice]
        for _ in range(8):
            parts = []
            for _ in range(r.randint(2, 5)):
                s = list(notice)
                for _ in range(r.randint(0, most)):
                    i = r.randrange(len(s))
                    s[i:i + 1] = r.choice([[], ["q"], [s[i], "q"], [" "]])
                parts.append("".join(s) + r.choice(["", " ", " or ", " license "]))
            joined = f" {''.join(parts)} "
            spans = [x[1:4] for x in notices._near(joined) if x[0] == label and x[4] == len(notice)]
            assert len(spans) >= 2 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
            # by the edits, then from the left: each span is the first match that overlaps no span before it
            matches = [(e, i, j) for i, ends in enumerate(edit_ends(notice, joined, most)) for j, e in ends.items()]
            taken = []
            for begin, end, edits in sorted(spans, key=lambda x: (x[2], x[0])):
                left = [m for m in matches if all(m[2] <= a or m[1] >= b for a, b in taken)]
                assert (edits, begin, end) in left and min(left)[:2] == (edits, begin)
                taken.append((begin, end))
            assert not [m for m in matches if all(m[2] <= a or m[1] >= b for a, b in taken)]


# --- MinHash

def multiset(text):
    w = text.lower().split()
    n = min(5, len(w))
    return collections.Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if w else collections.Counter({(): 1})


def brute_classes(texts):
    ids = [i for i, t in texts.items() if t is not None]
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    sets = {i: multiset(texts[i]) for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            both = sum((sets[a] & sets[b]).values())
            if both >= 0.8 * (sum(sets[a].values()) + sum(sets[b].values()) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in texts}


def changed(text, seed, n):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_classes_against_brute_force(spark):
    base = [prose(i, 150) for i in range(8)]
    texts = dict(enumerate([changed(base[i % 8], i, i % 9) for i in range(160)] + [prose(99, 50)] * 40
                           + [prose(200 + i, 60) for i in range(40)] + [None, None, "", " ", "one", "one", "one two"]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["class_id"] for r in op9_minhash.near_classes(docs).collect()}
    assert got == brute_classes(texts)


def test_rows_that_share_an_id_keep_their_own_class(spark):
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(5, a), (5, b), (6, changed(a, 1, 1)), (7, changed(b, 2, 1)), (5, a), (8, c), (8, None), (None, a), (9, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = sorted(((r["doc_id"], r["text"]) for r in op9_minhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(5, a), (5, b), (8, c), (8, None), (None, a), (9, None)], key=str)
    got = op9_minhash.near_classes(docs).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(bytes(r["class_key"] or b""), set()).add((r["id"], r["class_id"]))
    assert len(got) == 8 and {(5, 5), (6, 5)} in by_key.values() and {(5, 5), (7, 5)} in by_key.values()


def test_many_edited_copies_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(op9_minhash, "BLOCK", 16)  # several blocks a bucket
    base = prose(11, 120)
    texts = {i: changed(base, i, 3 + i % 5) for i in range(150)} | {200 + i: changed(base, i % 7, 6) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["class_id"] for r in op9_minhash.near_classes(docs).collect()}
    want = brute_classes(texts)
    assert got == want and len(set(want.values())) > 20


def test_parity_bound_loses_no_pair():
    r = np.random.default_rng(8)
    sets, memo = [], Recent(op9_minhash.word_hash)
    for i in range(120):
        words = prose(i % 4, int(r.integers(40, 700))).split()
        for _ in range(int(r.integers(0, 12))):
            words[int(r.integers(len(words)))] = f"new{r.integers(10**6)}"
        sets.append(op9_minhash.cells_of(words, memo.turn()))
    bits, w = [op9_minhash.parity(x) for x in sets], np.array([len(x) for x in sets])
    found = {tuple(sorted(p)) for p in op9_minhash.near_by_parity(bits, w, np.arange(120), None, 0.8)}
    alike = set()
    for i in range(120):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                alike.add((j, i))
    assert alike and alike <= found and len(found) < 3 * len(alike)
    side = np.arange(120) % 2
    across = {tuple(sorted(p)) for p in op9_minhash.near_by_parity(bits, w, np.arange(120), side, 0.8)}
    assert across == {p for p in found if side[p[0]] != side[p[1]]}


def test_signatures_agree_with_weighted_similarity():
    r = np.random.default_rng(1)
    agree, k = [], 140
    for _ in range(60):
        e = r.integers(0, 2**63, 40).astype(np.uint64)
        x, y = r.uniform(0.1, 3, 40), r.uniform(0.1, 3, 40)
        same = np.mean([np.mean(op9_minhash.signature(*op9_minhash.unit_cells(e, x)) ==
                                op9_minhash.signature(*op9_minhash.unit_cells(e, y)))])
        agree.append(same - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(agree)) < 4 * 0.5 / np.sqrt(60 * k)


def test_signature_does_not_depend_on_order_or_block():
    cells = op9_minhash.cells_of(prose(5, 30).split(), Recent(op9_minhash.word_hash).new)
    a = op9_minhash.signature(cells)
    assert (a == op9_minhash.signature(cells[::-1])).all()
    extra = np.concatenate([cells, cells * np.uint64(3)])  # another time limit, another block
    b = op9_minhash.signature(extra)
    assert (b.view(float) <= a.view(float)).all() and (a == b).mean() > 0.25


# --- rules

def test_rules_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(op10_rules.SQL["op10_rules"])
    names = [c[0] for c in cur.description]
    got = op10_rules.op10_rules(spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_rule_columns(spark):
    block = " ".join(f"w{i}" for i in range(12))
    texts = {1: f"{block} x {block} y {block}", 2: "a\n\na\n \nb\na", 3: "#*$ %&|<> é\x0b漢", 4: "same " * 40, 5: None,
             6: block, 7: "\x1c \x85　"}
    rows = op10_rules.base_columns(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = collections.Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
        cover = {i + k for i in range(len(words) - 7) if seen[tuple(words[i:i + 8])] > 1 for k in range(8)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))


def test_sketches_merge(spark):
    rows = spark.createDataFrame([("en", f"s{i % 4}", i % 37, (i * 7) % 90) for i in range(500)],
                                 "lang string, source string, symbols long, repeats long")
    names = ["symbols", "repeats"]
    parts = op10_rules.merge(op10_rules.sketches(rows, ["lang", "source"], names), ["lang"])
    whole = op10_rules.sketches(rows, ["lang"], names)
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, whole.collect()))
    widths = {"symbols": 1, "repeats": 1}
    f = op10_rules.fences(whole, ["lang"], widths).first()
    v = sorted(i % 37 for i in range(500))
    q1, q3 = v[124], v[374]
    assert (f["symbols_lo"], f["symbols_hi"]) == (q1 - 4 * (q3 - q1), q3 + 4 * (q3 - q1))


def test_long_words_have_adaptive_fences(spark):
    # a source without spaces inside its lines, words of 420 to 1,000 characters; one with far longer words
    docs = [(i, "zh", "a", "\n".join(chr(0x4E00 + (i * 30 + k) % 20_000) * (420 + 20 * (i % 30)) for k in range(25)))
            for i in range(60)]
    docs += [(60, "zh", "a", "\n".join(chr(0x4E00 + k) * 9_000 for k in range(25)))]
    df = spark.createDataFrame([(i, t, a, b) for i, a, b, t in docs], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in op10_rules.adaptive_rules(df).collect()}
    assert all(kept[i] for i in range(60)) and not kept[60]


def test_sketch_buckets_have_no_top(spark):
    values = [0, 1, 4095, 4096, 4097, 8191, 8192, 8195, 1_000_003, 2**40 + 12345]
    rows = spark.createDataFrame([("en", v) for v in values], "lang string, word_length long")
    got = sorted(r["bucket"] for r in op10_rules.sketches(rows, ["lang"], ["word_length"]).collect())
    want = [v - v % (1 << max(0, v.bit_length() - 12)) for v in values]
    assert got == sorted(set(want)) and all(v - w <= v / 2048 for v, w in zip(values, want))


# --- pipeline

def test_pipeline_is_its_stages(spark):
    import corpus_pipeline as p
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    scorer = p.op2_quality.fit(docs)
    texts = {i: t for i, t in texts.items() if scorer.score(t) >= p.op2_quality.KEEP}
    model = p.op6_langid.fit(docs.filter(docs.doc_id.isin(list(texts))))
    found = {i: model.predict(t) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if found[i][0] != "und" and found[i][1] >= p.LEAST_LANGUAGE}
    kept = {i for i, c in brute_classes(texts).items() if i == c}
    rows = p.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == kept
    from .test_op1_op7 import check_packing
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(p.op7_packing.vocabulary.__globals__["vocab_path"]())
    check_packing(rows, {i: lib.encode(texts[i], add_special_tokens=False).ids + [0] for i in kept}, 1024)
