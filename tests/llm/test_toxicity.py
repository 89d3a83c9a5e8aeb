"""Toxicity: the machine learns pairs that no sum of word weights can express, and held-out documents are told apart."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from weekwise.llm import toxicity
from weekwise.llm._common import BYTE_VALUE, prefix_hash, span_hash
from weekwise.llm.registry import QUERIES


def test_pairs_are_learnt():
    """Toxic only where an insult meets a group: each word alone is as frequent in clean texts."""
    rng = np.random.default_rng(3)
    filler = [f"word{i}" for i in range(40)]
    texts, labels = [], []
    for _ in range(4000):
        insult, group = (bool(x) for x in rng.random(2) < 0.5)
        words = list(rng.choice(filler, 6)) + ["vermin"] * insult + ["foreigners"] * group
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(float(insult and group))
    model = toxicity.fit(texts[:3000], np.array(labels[:3000]))
    found = toxicity.score(model, texts[3000:]) >= 0.7
    assert (found == np.array(labels[3000:], bool)).mean() > 0.98
    assert toxicity.fit(texts[:500], np.array(labels[:500])).w.tolist() == toxicity.fit(texts[:500], np.array(labels[:500])).w.tolist()


def test_odd_texts(spark, docs):
    texts = ["you idiot"] * 30 + ["a fine day"] * 30 + ["", None, "\n", "é" * 50000, "idiot*** day", "you idiot"]
    ids = [*range(65), None]
    labels = spark.createDataFrame([(i, 1, int(i < 30), "x") for i in range(60)] + [(5, 1, 1, "x"), (6, 1, None, "x"), (None, 1, 1, "x")], "doc_id bigint, quality int, toxic int, text string")
    model = toxicity.learn(docs(texts, ids), labels)
    rows = {r.doc_id: r for r in toxicity.toxicity(docs(texts, ids), model).collect()}
    assert len(rows) == 66 and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[i].predicted == (i < 30) for i in range(60)) and rows[60].predicted == 0 and rows[None].predicted == 1
    assert rows[60].score == rows[61].score == rows[62].score
    assert toxicity.toxicity(docs([]), model).count() == 0
    assert toxicity.toxicity(docs(["a"]), toxicity.learn(docs([]), labels.limit(0))).count() == 1


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op1_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    right = sum(p and t for p, t in held)
    # 300 toxic documents to learn from, in four languages; on larger tables recall is above 0.95
    assert right / sum(t for _, t in held) > 0.8 and right / sum(p for p, _ in held) > 0.95


def test_labels_of_held_out_rows_do_not_matter(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(toxicity.fold("doc_id", 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    turned.write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(map(tuple, QUERIES["op1_toxicity"](spark, sf).collect())) == sorted(map(tuple, QUERIES["op1_toxicity"](spark, str(tmp_path)).collect()))


def plain_logit(model, text):
    """Bias, weight of every distinct term, and the product of factors of every pair of them."""
    place = {int(t): k for k, t in enumerate(model.terms)}

    def hashed(word):
        return int(span_hash(prefix_hash(BYTE_VALUE[np.frombuffer(word, np.uint8)]), np.array([0]), np.array([len(word)]))[0])

    terms = set()
    for word in re.findall(rb"[a-z\x80-\xff]+", (text or "").lower().encode()):
        terms |= {hashed(word), *(hashed(word[:k]) ^ k for k in toxicity.STEMS if len(word) > k)}
    known = sorted(place[t] for t in terms if t in place)
    products = model.v[known] @ model.v[known].T
    return model.bias + sum(float(model.w[i]) for i in known) + float(np.triu(products, 1).sum())


def test_scores_equal_the_sum_over_all_pairs(spark):
    """The query's scores on a whole table against a loop over pairs of terms."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.learn(docs, labels.where(toxicity.fold("doc_id", 3) != 1))
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in QUERIES["op1_toxicity"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert set(got) == set(texts) and len(model.terms)
    for doc_id, text in texts.items():
        want = 1 / (1 + np.exp(-plain_logit(model, text)))
        assert abs(got[doc_id][0] - want) < 1e-9
        assert got[doc_id][1:] == (int(got[doc_id][0] >= 0.7), zlib.crc32(str(doc_id).encode()) % 3 == 1)
    # a model of many terms, each text with thousands of pairs
    whole = [(t or "").encode() for t in texts.values()] + ["\u00c9T\u00c9 caf\u00e9 don't stop-stopping".encode(), b""]
    terms = np.unique(toxicity.terms_of(whole)[1])[::2]
    rng = np.random.default_rng(1)
    many = toxicity.Model(terms, -0.5, rng.normal(0, 0.1, len(terms)), rng.normal(0, 0.1, (len(terms), toxicity.FACTORS)))
    want = [1 / (1 + np.exp(-plain_logit(many, t.decode()))) for t in whole]
    assert np.allclose(toxicity.score(many, whole), want, atol=1e-9) and np.std(want) > 0.05
