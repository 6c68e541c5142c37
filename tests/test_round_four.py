"""What the third round's findings asked for."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.plans import texts


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"create view {name} as select * from '{folder}/{name}.parquet/*.parquet'")
    return con


def test_titles_with_cut_references_are_those_of_the_sql(spark, tmp_path):
    heads = ["a &amp b", "and&amp", "x = &quot;0b", "p &amp; q", "&amp;amp; &lt;b&gt;", "&#38; &#x26", "R&D &copy", "one (  two ) ."]
    pages = [(i, f"<html><head><title>{h}</title></head><body><h1>{h}</h1><p>text</p></body></html>") for i, h in enumerate(heads)]
    con = saved(spark, str(tmp_path), "pages", pages, "page_id long, html string")
    got = sorted(map(tuple, texts.QUERIES["html_titles"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(texts.ORACLE["html_titles"]).fetchall()) and len(got) == 2 * len(heads)


def test_numeric_ratio_reads_each_character_once(spark):
    """A token of many letters without a digit takes no time that grows with its square."""
    import re
    import time

    from gristmill.functions import text as tx

    cases = ["", " ", "a1 b 22\t3c4\x85x", "1", "no digits", "4　5 a 4b5c6", "a" * 30 + "9 " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i long, t string")
    got = {r.i: r.x for r in df.select("i", tx.numeric_ratio(F.col("t")).alias("x")).collect()}
    for i, t in enumerate(cases):
        tokens = re.findall(f"[^{re.escape(tx.WS_CHARS)}]+", t)
        assert got[i] == (sum(any(c in "0123456789" for c in x) for x in tokens) / len(tokens) if tokens else 0.0)
    start = time.perf_counter()
    assert spark.range(1).select(tx.numeric_ratio(F.repeat(F.lit("a"), 400_000)).alias("x")).first()[0] == 0.0
    assert time.perf_counter() - start < 20


def test_density_prunes_without_loss_and_has_no_limit_of_its_own():
    import inspect

    from gristmill.operators import density as dn

    rnd = np.random.default_rng(9)
    points = np.concatenate([rnd.normal(c, 0.2, (150, 3)) for c in ((0, 0, 0), (9, 0, 0), (0, 9, 1))] + [np.zeros((20, 3))])
    boxes, every = dn.Boxes(points, 32), np.arange(len(points))
    core = dn.core_distances(points, every, 3, 32)
    assert np.allclose(np.concatenate([dn.core_distances(points, b, 3, 32, boxes) for b in boxes.blocks]), core[np.concatenate(boxes.blocks)], atol=1e-6)
    group = every // 150 * 150
    _, far = dn.nearest_edges(points, core, group, every, 32)
    least = {g: far[group == g].min() for g in set(group)}
    for bound in (np.inf, 1e-5):
        held = np.asarray([least[g] + bound for g in group])
        got = [dn.nearest_edges(points, core, group, b, 32, boxes, held) for b in boxes.blocks]
        d = np.concatenate([x for _, x in got])
        own = group[np.concatenate(boxes.blocks)]
        assert all(abs(d[own == g].min() - least[g]) < 1e-5 for g in least)
    assert inspect.signature(dn.density_clusters).parameters["max_points"].default is None
