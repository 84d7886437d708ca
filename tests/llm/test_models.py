"""Learned operators: quality classifier (2), embedding dedup (4), language ID (6)."""
import numpy as np
import pyarrow.parquet as pq
import pytest

from sqlweave.llm import op2_quality, op4_neardup, op6_langid

SF = "/root/testdata/sf0.01"


def test_em_finds_planted_accuracies():
    r = np.random.default_rng(1)
    truth = r.random(20_000) < 0.8
    names = list(op2_quality.LABELLERS)
    right = [0.95, 0.9, 0.85, 0.8, 0.9, 0.85, 0.95, 0.9, 0.8, 0.9]
    counts: dict = {}
    votes = np.array([[("+" if g == (r.random() < a) else "-") if r.random() < 0.7 else "." for a in right] for g in truth])
    for row in votes:
        counts["".join(row)] = counts.get("".join(row), 0) + 1
    prior, tables, post = op2_quality.label_model(counts)
    assert abs(prior - 0.8) < 0.02 and len(names) == len(right)
    for t, a in zip(tables, right):
        assert abs(t[0, 0] / (t[0, 0] + t[0, 1]) - a) < 0.03
        assert abs(t[1, 1] / (t[1, 0] + t[1, 1]) - a) < 0.06
    guess = np.array([post["".join(v)] > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.97


def test_quality_against_labels(spark):
    got = op2_quality.op2_quality(spark, SF).toPandas()
    m = got.merge(pq.read_table(f"{SF}/labels.parquet").to_pandas(), on="doc_id")
    assert m[m.quality == 1].kept.mean() > 0.99
    assert m[m.quality == 0].kept.mean() < 0.1


def test_score_is_the_linear_scorer():
    r = np.random.default_rng(2)
    w = r.standard_normal(1 << op2_quality.BITS)
    s = op2_quality.Scorer(w, 0.1)
    text = "Some words. Some OTHER words!! 12 a|b"
    at, value = op2_quality.features(text, {x: op2_quality.word_slots(x) for x in text.split()})
    words, own = text.split(), op2_quality.text_slots(text)
    z = (sum(w[i] for x in words for i in op2_quality.word_slots(x)) / (2 * len(words))
         + sum(w[i] for i in own) / len(own) + 0.1)
    assert s.score(text) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-5)
    assert s.score(None) == s.score(" ") == 0.0
    assert value.sum() == pytest.approx(2.0) and at[w[at] != 0].size == len(at)


def test_vectors_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(3)
    centres = r.standard_normal((30, 24))
    x = np.concatenate([c + s * r.standard_normal((12, 24)) for c in centres for s in (0.05, 0.25)])
    x = np.concatenate([x, np.repeat(x[:1], 300, 0)])  # one vector in many copies
    labels = [int(i % 3) if i < 720 else 0 for i in range(len(x))]
    rows = [(i, [float(v) for v in x[i]], labels[i]) for i in range(len(x))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(7).write.parquet(
        f"{tmp_path}/embeddings.parquet")
    got = op4_neardup.op4_neardup(spark, str(tmp_path)).toPandas().set_index("vec_id")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(near, False)
    want = near.sum(1)
    have = got.n_links.sort_index().to_numpy()
    assert (have <= want).all() and have.sum() >= 0.98 * want.sum()
    for i, row in got.iterrows():
        assert row.kept == (row.component_id == i) and row.component_id <= i


def test_vectors_that_share_an_id(spark):
    r = np.random.default_rng(4)
    rows, want = [], {}
    for k in range(20):  # id 100 holds 20 unlike vectors; each has one near neighbour of its own
        x = r.normal(size=32)
        rows += [(100, x.tolist(), 1), (200 + k, (x + 0.01 * r.normal(size=32)).tolist(), 1)]
        want[200 + k] = (1, 100)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = op4_neardup.near_vectors(df).collect()
    assert {x[0]: (x[1], x[2]) for x in got if x[0] >= 200} == want
    assert [(x[1], x[2]) for x in got if x[0] == 100] == [(1, 100)] * 20


def test_language_held_out(spark):
    got = op6_langid.op6_langid(spark, SF).toPandas()
    docs = pq.read_table(f"{SF}/documents.parquet").to_pandas()
    m = got.merge(docs, on="doc_id")
    held = m[m.held_out & m.lang.notna()]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() > 0.97
    import zlib
    assert (m.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in m.doc_id]).all()


def test_filter_against_sets(spark):
    texts = {"aa": ["kalomi zeta rano " * 20, "belo kimi"], "bb": ["strunk wolf gras " * 20, "brinz kraft"]}
    rows = [(t, k) for k, v in texts.items() for t in v] + [("no language", None)]
    model = op6_langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    grams = {k: np.unique(np.concatenate([g for t in v for g in op6_langid.trigrams(t)])) for k, v in texts.items()}
    both = np.intersect1d(grams["aa"], grams["bb"])
    for i, k in enumerate(model.langs):
        sure = np.setdiff1d(grams[k], both)
        mask = np.bitwise_and.reduce([model.table[p] for p in op6_langid.positions(sure, model.bits)])
        assert ((mask >> i) & 1).all()  # no false negatives
    assert 0 < model.fp.max() < 0.3
    assert model.predict("kalomi zeta")[0] == "aa" and model.predict("wolf gras")[0] == "bb"
    assert model.predict("12 !?") == ("und", 0.0) and model.predict(None) == ("und", 0.0)


def test_long_text_in_chunks(monkeypatch):
    text = "Ein Satz mit Wörtern. " * 50
    whole = np.concatenate(list(op6_langid.trigrams(text)))
    monkeypatch.setattr(op6_langid, "CHUNK", 37)
    assert (np.concatenate(list(op6_langid.trigrams(text))) == whole).all()
