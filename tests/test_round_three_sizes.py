"""What the queries move and hold while their tables grow."""

import numpy as np
from pyspark.sql import functions as F

from gristmill.operators import word_vectors as wv


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_get_vectors_without_moving_words(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"{c}{d}" for c in "abcdefgh"[i % 3 :] for d in ("x", "y", "z")[: 1 + i % 3])) for i in range(40)], "i int, t string").repartition(3)
    models = []
    for rows in (wv.ROWS, 5):  # one block of rows, and several
        monkeypatch.setattr(wv, "ROWS", rows)
        models.append(wv.fit_words(docs, "t", dims=3, window=2, min_count=2, spare=4))
    one, many = ({r.term: np.asarray(r.v) for r in m.words.collect()} for m in models)
    assert len(one) == 21 and max(abs(one[a] @ one[b] - many[a] @ many[b]) for a in one for b in one) < 1e-4
    made = models[0].embed(docs, "i", "t")
    assert plan(made).count("Exchange") == plan(docs).count("Exchange") and "Join" not in plan(made)
    total = sum(r.n for r in models[0].words.collect())
    counts = {r.term: r.n for r in models[0].words.collect()}
    for r in docs.join(made, "i").collect():
        want = sum(one[w] * (1e-3 / (1e-3 + counts[w] / total)) for w in r.t.split())
        assert np.abs(np.asarray(r.embedding) - want / np.linalg.norm(want)).max() < 1e-5


def test_only_shared_runs_are_counted(spark, monkeypatch):
    from collections import Counter, defaultdict

    from gristmill.operators import shared_runs as sr

    said = "one two three four five six".split()
    rows = [(f"c{i % 6}", [said[(i * j + j * j) % 6] for j in range(i % 9)] + [f"only{chr(97 + i)}"] * 2) for i in range(24)] + [("c0", []), ("c1", None), (None, said)]
    words = spark.createDataFrame(rows, "class string, words array<string>").repartition(3)
    runs = lambda t: [" ".join(t[a : a + n]) for n in (1, 2, 3) for a in range(len(t) - n + 1)]
    counts, classes = Counter((c, x) for c, t in rows for x in runs(t or [])), defaultdict(set)
    for c, x in counts:
        classes[x].add(c)
    for size in (sr.RUNS, 3):
        monkeypatch.setattr(sr, "RUNS", size)
        got = Counter()
        for r in sr.counted(words, ["class"], 3, sr.shared(words, 3, 4)).collect():
            got[r["class"], r.term] += r.n
        assert {k: n for k, n in got.items() if k[1]}.items() >= {k: n for k, n in counts.items() if len(classes[k[1]]) >= 4}.items()
        assert sum("only" in x for _, x in got) < 8 and all(  # the filter lets some through
            n == counts[k] for k, n in got.items() if k[1])
        assert {c: n for (c, x), n in got.items() if not x} == Counter(c for c, t in rows if t)


def test_documents_of_several_texts(spark):
    from gristmill.operators import topics as tp

    docs = spark.createDataFrame([(1, "a", "red red blue"), (1, "a", "red sky"), (2, "a", "sky"), (3, "b", "blue sky sea")], "i long, c string, t string")
    weights = tp.class_weights(tp.term_table(docs, "c", "t", min_df=1), max_df=1.0)
    found = {(r["class"], r.id, r.term): r.n for r in tp.document_terms(docs, weights, "c", "i", "t").collect()}
    assert found["a", 1, "red"] == 3 and found["a", 1, "red sky"] == 1 and found["b", 3, "blue sky sea"] == 1 and ("a", 1, "blue red") not in found


def shuffled(spark) -> int:
    """Bytes that all tasks so far have written for shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def test_vectors_are_not_sent_pair_by_pair(spark):
    from gristmill.operators import neighbour_map as nm

    n, dims = 1500, 64
    x = np.random.default_rng(5).standard_normal((n, dims))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "i long, v array<float>").repartition(3)
    before, threshold = shuffled(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many vectors
    try:
        found = nm.neighbour_graph(rows, "i", "v", 30, leaf=128).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(found) == 30 * n and shuffled(spark) - before < 14_000 * n


def peak_mb(spark) -> int:
    """The most memory that a Python worker has had."""

    def run(batches):
        import resource

        for batch in batches:
            yield batch.from_arrays([[resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024] * batch.num_rows], names=["mb"])

    return spark.range(64).repartition(16).mapInArrow(run, "mb long").agg(F.max("mb")).first()[0]


def test_scores_of_a_chunk_are_few_at_a_time(spark):
    from gristmill.operators import topics as tp

    rnd = np.random.default_rng(6).integers(-9, 9, (12_000, 8))
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(rnd)], "i long, v array<float>").coalesce(1).cache()
    rows.count()
    before = peak_mb(spark)
    assert tp.cosine_topk(rows, "i", "v", F.col("i") % 10 == 0, 3).count() == 3600
    assert peak_mb(spark) - before < 150


def test_batch_files_without_rows_in_python(spark, tmp_path):
    import csv
    import io

    from gristmill.sources import storage

    texts = [None, "", " a", 'say "x"', "a,b", "a;b", "line\nend", "cr\r", "ü€", "'q'", "\\", '"']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "a int, b string").groupBy().agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("r"))
    for columns, sep in ((["a", "b"], ","), (["b"], ";"), (["b", "a"], "|")):
        made = rows.select(storage.csv_text(F.col("r"), columns, sep).alias("t"))
        assert "Python" not in plan(made)
        out = io.StringIO()
        writer = csv.writer(out, delimiter=sep, lineterminator="\n")
        writer.writerows([columns, *([("" if t is None else t) if c == "b" else i for c in columns] for i, t in enumerate(texts))])
        assert made.first().t == out.getvalue()
    assert spark.range(2).select(storage.csv_text(F.when(F.col("id") == 0, F.array(F.struct(F.lit("x").alias("b")))), ["b"]).alias("t")).where("t is null").count() == 1
