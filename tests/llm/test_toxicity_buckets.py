"""Small label sets follow the same rule as large ones: every hash bucket is a feature."""

import numpy as np

from evenlend.llm import toxicity


def test_few_labels_still_separate(spark):
    plain = "lorem ipsum dolor sit amet sed do eiusmod tempor magna aliqua".split()
    rng = np.random.RandomState(1)
    docs, labels = [], []
    for i in range(40):
        w = list(rng.choice(plain, 12))
        if i % 4 == 0:
            w.insert(5, "grumblefool")
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    docs += [(100, ""), (101, None)]
    labels.append((100, 0))
    spark_docs = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.classify(spark_docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert min(got[i] for i in range(40) if i % 4 == 0) > max(got[i] for i in range(40) if i % 4)


def test_sparse_products_match_dense():
    rng = np.random.RandomState(2)
    at = [np.sort(rng.choice(50, n, replace=False)).astype(np.int32) for n in (3, 0, 20, 1, 0)]
    ratio = rng.randn(50)
    dense = np.zeros((5, 51))
    for i, a in enumerate(at):
        dense[i, a] = ratio[a]
    dense[:, -1] = 1
    x, w, r = toxicity._Sparse(at, ratio), rng.randn(51), rng.randn(5)
    assert np.allclose(x.dot(w), dense @ w) and np.allclose(x.back(r), dense.T @ r)


def test_distinct_buckets_of_short_and_long_texts():
    for text in (None, "", "ab", "word " * 5, " ".join(map(str, range(5000)))):
        assert sorted(toxicity.distinct_buckets(text).tolist()) == sorted(set(toxicity.buckets(text).tolist()))


def test_unseen_buckets_have_no_ratio():
    ratio = toxicity.log_ratios(np.array([0, 5, 0]), np.array([0, 0, 5]), (20, 10))
    assert ratio[0] == 0 and ratio[1] < 0 < ratio[2]
