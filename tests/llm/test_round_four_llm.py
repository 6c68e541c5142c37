"""What the third round's findings asked of the training-data operators."""

import random

from gristmill.llm import components as cc
from gristmill.llm import decontam


def test_components_read_a_forest_of_many_links(spark, monkeypatch):
    """A group in which each node has many links is as many rows as it has nodes, in each of the dealt tasks."""
    seen, keep = [], cc.write_table
    monkeypatch.setattr(cc, "write_table", lambda df, name: (seen.append((name, (out := keep(df, name))[0].count())), out)[1])
    rnd, n = random.Random(3), 400
    links = [(i, j) for i in range(1, n) for j in {*rnd.sample(range(i), min(i, 12)), i - 1}] + [(1000, 1001), (5, 5)]
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
    assert dict(seen[:1])["links"] <= 2 * 2 * n


def test_latent_cosines_choose_the_windows(spark):
    """Places below `min_cosine` are not leaks, whatever words they share; the space decides, and -1 leaves all to the rule."""
    rnd = random.Random(31)
    words = [f"term{k}" for k in range(3000)]
    items = [(k, rnd.sample(words, 40)) for k in range(30)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    hosts = [(100 + k, " ".join(rnd.sample(words, 120))) for k in range(60)]
    half = [(i, " ".join([x for k, x in enumerate(w) if k % 5 > 1] + rnd.sample(words, 60))) for i, w in items]
    docs = spark.createDataFrame(hosts + half, "doc_id long, text string")
    rule = {(r.doc_id, r.item_id): r.cosine for r in decontam.find_leaks(docs, bench, min_cosine=-1.0).collect()}
    assert {(i, i) for i, _ in items} <= set(rule)
    assert decontam.find_leaks(docs, bench, min_cosine=-1.0).count() > decontam.find_leaks(docs, bench, min_cosine=0.97).count()
    found = {(r.doc_id, r.item_id): r.cosine for r in decontam.find_leaks(docs, bench).collect()}
    assert found.keys() <= rule.keys() and min(found.values()) >= 0.5
    assert len(found) >= 0.9 * len(rule)
