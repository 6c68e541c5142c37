"""Word vectors against a dense factorisation, and what they are good for."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.operators import topics as tp
from gristmill.operators.word_vectors import WordVectors, cooccurrence, fit_words

ANIMALS, STARS = "cat dog cow horse sheep goat".split(), "sun moon star comet planet orbit".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(ANIMALS if i % 2 else STARS) for _ in range(rnd.randint(5, 30)))) for i in range(60)] + [(60, None), (61, ""), (62, "rare words only")]
    return spark.createDataFrame(rows, "i int, t string").repartition(3)


@pytest.fixture(scope="module")
def model(corpus):
    return fit_words(corpus, "t", dims=4, window=3, min_count=5, spare=8)


def test_pairs_and_factors_by_brute_force(corpus, model):
    texts = [(r.t or "").split() for r in corpus.collect()]
    pairs = Counter((x, y) for t in texts for i, a in enumerate(t) for b in t[i + 1 : i + 4] for x, y in ((a, b), (b, a)))
    assert {(r.a, r.b): r.n for r in cooccurrence(corpus, "t", 3).collect()} == pairs
    words = sorted(ANIMALS + STARS)
    n = np.asarray([[pairs[a, b] for b in words] for a in words], float)
    with np.errstate(divide="ignore"):
        m = np.maximum(0, np.log(n * n.sum() / np.outer(n.sum(1), n.sum(1))))
    values, axes = np.linalg.eigh(np.where(np.isfinite(m), m, 0))
    best = np.argsort(-values)[:4]
    want = (axes[:, best] * np.sqrt(np.maximum(values[best], 0))) @ (axes[:, best] * np.sqrt(np.maximum(values[best], 0))).T
    found = {r.term: np.asarray(r.v) for r in model.words.collect()}
    assert sorted(found) == words and model.dims == 4
    got = np.asarray([[found[a] @ found[b] for b in words] for a in words])
    assert np.abs(got - want).max() < 1e-4  # vectors are unique up to a rotation, their products are not


def test_texts_of_a_topic_lie_together(spark, corpus, model, tmp_path):
    model.write(f"{tmp_path}/m")
    again = WordVectors.read(spark, f"{tmp_path}/m")
    vectors = {r.i: np.asarray(r.embedding) for r in again.embed(corpus, "i", "t").collect()}
    assert len(vectors) == 63 and all(not vectors[i].any() for i in (60, 61, 62)) and math.isclose(np.linalg.norm(vectors[3]), 1, rel_tol=1e-5)
    near = [max((float(vectors[i] @ vectors[j]), j) for j in range(60) if j != i)[1] for i in range(60)]
    assert all((i - j) % 2 == 0 for i, j in enumerate(near))
    terms = again.of_terms(spark.createDataFrame([("cat dog",), ("sun",), ("unknown",)], "term string"))
    assert {r.term: len(r.tv) for r in terms.collect()} == {"cat dog": 4, "sun": 4}
    with pytest.raises(FileNotFoundError):
        WordVectors.read(spark, f"{tmp_path}/none")
    empty = fit_words(corpus.limit(0), "t", dims=2)
    assert empty.words.count() == 0 and empty.total == 0


def test_neighbours_beat_word_overlap(spark):
    """Documents of a language: the five nearest by vector are of it at least as often as the five that share most words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) between 1500 and 6000").select("doc_id", "lang", "text")
    model = fit_words(docs, "text", dims=32, window=4, min_count=3)
    vectors = model.embed(docs, "doc_id", "text")
    nearest = tp.cosine_topk(vectors, "doc_id", "embedding", F.lit(True), 5)
    langs = {r.doc_id: r.lang for r in docs.collect()}
    by_vector = np.mean([langs[r.query_id] == langs[r.doc_id] for r in nearest.collect()])
    words = {r.doc_id: frozenset(r.w) for r in docs.select("doc_id", tp.tokens(F.col("text")).alias("w")).collect()}
    overlap = []
    for q in words:
        best = sorted(((-len(words[q] & words[o]) / len(words[q] | words[o]), o) for o in words if o != q))[:5]
        overlap += [langs[q] == langs[o] for _, o in best]
    assert by_vector >= np.mean(overlap) and by_vector > 0.95
