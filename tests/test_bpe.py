"""Byte-pair vocabulary: training, exact round trip on unseen text, persistence."""

import os
import tempfile


def test_train_encode_round_trip(spark, small):
    from pyspark.sql import functions as F
    from sqlweave.operators.bpe import Vocabulary, bpe_decode, bpe_encode, bpe_train
    docs = small.documents
    train = docs.filter(F.col("doc_id") % 2 == 0)
    unseen = docs.filter(F.col("doc_id") % 2 == 1).select("doc_id", "text")
    merges = bpe_train(train, 256 + 24)
    rows = merges.collect()
    assert 0 < len(rows) <= 24 and [r.new_id for r in rows] == list(range(256, 256 + len(rows)))
    dec = bpe_decode(bpe_encode(unseen, merges), merges)
    assert dec.filter(F.col("decoded") != F.col("text")).count() == 0
    codec = Vocabulary([(r.left_id, r.right_id, r.new_id) for r in rows])
    ids = codec.encode("<question> héllo wörld <sql>")
    assert ids[0] == codec.special_ids["<question>"] and ids[-1] == codec.special_ids["<sql>"]
    assert codec.decode(ids) == "<question> héllo wörld <sql>"


def test_histogram_counts_every_pretoken(small):
    from pyspark.sql import functions as F
    from sqlweave.functions.text import pretokens
    from sqlweave.operators.bpe import pretoken_histogram
    h = pretoken_histogram(small.documents).agg(F.sum("cnt")).first()[0]
    n = small.documents.select(F.size(pretokens("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert h == n
    joined = small.documents.select(F.array_join(pretokens("text"), "").alias("j"), "text")
    assert joined.filter(F.col("j") != F.col("text")).count() == 0


def test_save_load(spark):
    from sqlweave.operators.bpe import DEFAULT_SPECIALS, bpe_load, bpe_save
    m = spark.createDataFrame([(0, 116, 104, 256)], "rank int, left_id int, right_id int, new_id int")
    path = os.path.join(tempfile.mkdtemp(prefix="sqlweave-bpe-"), "tok")
    bpe_save(m, path)
    m2, sp = bpe_load(spark, path)
    assert m2.collect() == m.collect() and sp == DEFAULT_SPECIALS


def test_heap_order_equals_repeated_merging():
    """Merging pairs in learned order over the whole piece, one merge at a time."""
    import random
    from sqlweave.operators.bpe import Vocabulary
    r = random.Random(3)
    merges, ids = [], [97, 98, 99]
    for new in range(256, 280):
        merges.append((r.choice(ids), r.choice(ids), new))
        ids.append(new)
    merges = [m for i, m in enumerate(merges) if (m[0], m[1]) not in {(x[0], x[1]) for x in merges[:i]}]
    v = Vocabulary(merges, ())
    def merge_all(ids, a, b, new):
        out = []
        for x in ids:
            if out and out[-1] == a and x == b:
                out[-1] = new
            else:
                out.append(x)
        return out
    for _ in range(300):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 40)))
        want = list(text.encode())
        while made := [(new, a, b) for a, b, new in merges if (a, b) in set(zip(want, want[1:]))]:
            new, a, b = min(made)
            want = merge_all(want, a, b, new)
        assert v.encode(text, False) == want and v.decode(want) == text


def test_merges_of_one_round_equal_single_merges(spark):
    import random
    from sqlweave.operators.bpe import bpe_train, safe_prefix
    assert safe_prefix([(1, 2), (3, 4), (2, 5), (6, 7)]) == 2 and safe_prefix([]) == 0
    r = random.Random(5)
    texts = [(" ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(30)),) for _ in range(60)]
    df = spark.createDataFrame(texts, "text string")
    one = bpe_train(df, 256 + 30, together=1).collect()
    assert len(one) == 30 and bpe_train(df, 256 + 30).collect() == one


def test_pairs_that_cannot_overlap_go_together(spark):
    from sqlweave.operators.bpe import safe_prefix
    assert safe_prefix([(1, 2), (1, 3), (4, 2), (5, 1)]) == 3  # same left or same right: no place in common


def test_registered_jobs_train_2048_entries(small, monkeypatch):
    from sqlweave.operators import bpe
    from sqlweave.plans import corpus_jobs, text_jobs
    sizes = []
    monkeypatch.setattr(bpe, "bpe_train", lambda texts, size, *a, **k: sizes.append(size) or 1 / 0)
    monkeypatch.setattr("sqlweave.memo.memo", lambda spark, root, name, make: make())
    monkeypatch.setattr(corpus_jobs, "corpus", lambda t: (None,) * 5)
    monkeypatch.setattr(corpus_jobs, "_schema_text", lambda t: None)
    monkeypatch.setattr(corpus_jobs, "split_by_schema", lambda *a: (None, None))
    monkeypatch.setattr(corpus_jobs, "corpus_texts", lambda x: None)
    for job in (text_jobs.q_bpe_train, text_jobs.q_bpe_encode, text_jobs.q_compression_stats, corpus_jobs.q_frame_pair):
        try:
            job(small)
        except ZeroDivisionError:
            pass
    assert len(sizes) == 4 and min(sizes) >= 2048


def test_blocks_encode_like_the_vocabulary(spark, monkeypatch):
    """Null, empty, repeated and long texts over several blocks; other columns stay."""
    from sqlweave.operators import bpe
    from sqlweave.plans import text_jobs
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 40)
    monkeypatch.setattr(bpe, "BLOCK_ROWS", 3)
    texts = [None, "", "the the the cat", "the cat <sql> the", " ", "a" * 90, "x y " * 60, "héllo the", None, "the", ""] * 3
    df = spark.createDataFrame([(None if i == 3 else i % 30, x) for i, x in enumerate(texts)], "k int, text string")
    merges = [(116, 104, 256), (256, 101, 257), (97, 97, 258), (32, 257, 259)]
    table = spark.createDataFrame([(i, *m) for i, m in enumerate(merges)], "rank int, left_id int, right_id int, new_id int")
    codec = bpe.Vocabulary(merges)
    for special in (False, True):
        got = bpe.bpe_encode(df, table, allow_special=special).collect()
        want = [(None if i == 3 else i % 30, x, None if x is None else codec.encode(x, special)) for i, x in enumerate(texts)]
        assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))
    empty = spark.createDataFrame([(1, None), (2, "")], "k int, text string")
    assert sorted(map(tuple, bpe.bpe_encode(empty, table).select("k", "ids").collect())) == [(1, None), (2, [])]
    blocks = bpe.coded_blocks(df, text_jobs.pretokens("text"), ["k"])
    counts = {r.piece: r.n for r in bpe.block_counts(blocks).collect()}
    assert counts == {r.piece: r.cnt for r in bpe.pretoken_histogram(df).collect()}
    assert blocks.filter("_new is not null").count() > 5
    numbered = bpe.dictionary_join(blocks, bpe.block_counts(blocks).selectExpr("piece", "array(n) ids"))
    assert [r.ids for r in numbered.filter("k = 2 and size(ids) > 0").collect()] == [
        [counts[x] for x in codec.plain.findall("the the the cat")]]


def test_blocks_follow_the_pieces(spark, monkeypatch):
    """A small corpus is one block however many shuffle partitions there are; a larger one is cut by pieces and by bytes."""
    from sqlweave.operators import bpe
    hist = spark.createDataFrame([(f"w{i:03d}", i) for i in range(300)] + [("a", 9)], "piece string, cnt long")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert bpe.piece_blocks(hist).count() == 1
        monkeypatch.setattr(bpe, "BLOCK", 100)
        assert 3 <= bpe.piece_blocks(hist).count() <= 6
        monkeypatch.setattr(bpe, "BLOCK_BYTES", 40)
        assert bpe.piece_blocks(hist).count() >= 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_rounds_of_an_epoch_equal_counting_anew(spark, monkeypatch):
    """Merges of merges, doubled ids and several epochs, against a training that counts all pairs for each merge."""
    import random
    from collections import Counter
    from sqlweave.operators import bpe
    r = random.Random(11)
    words = ["".join(r.choice("aab") for _ in range(r.randint(1, 12))) for _ in range(80)] + ["a" * 17, "abab" * 5]
    texts = [" ".join(r.choice(words) for _ in range(20)) for _ in range(40)]
    v = bpe.Vocabulary([], ())
    pieces = Counter(m for x in texts for m in v.plain.findall(x))
    held = [(list(p.encode()), n) for p, n in pieces.items()]
    want = []
    while len(want) < 60:
        counts = Counter()
        for ids, n in held:
            for pair in zip(ids, ids[1:]):
                counts[pair] += n
        (a, b), n = min(counts.items(), key=lambda x: (-x[1], x[0]), default=((0, 0), 0))
        if n < 2:
            break
        want.append((len(want), a, b, 256 + len(want)))
        for ids, _ in held:
            i = 0
            while i < len(ids) - 1:
                if ids[i:i + 2] == [a, b]:
                    ids[i:i + 2] = [want[-1][3]]
                i += 1
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    monkeypatch.setattr(bpe, "BLOCK", 16)
    assert len(want) > 40
    for epoch in (2, 7, 100):
        assert [tuple(x) for x in bpe.bpe_train(df, 256 + 60, checkpoint_every=epoch).collect()] == want
