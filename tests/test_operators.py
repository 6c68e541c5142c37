"""Small tables for the edges that SQL cannot show."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gristmill.functions import blocks as bl
from gristmill.functions import text as tx
from gristmill.operators import density as dn
from gristmill.operators import tables as ops
from gristmill.operators import topics as tp
from gristmill.operators.topic_model import TopicEstimator, TopicModel
from gristmill.sources import connectors, files, storage
from gristmill.streaming.incremental import collect_new


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("  tado° Heating ", "tado Heating"),
        ("tadoÂ°Â Air Conditioning", "tado Air Conditioning"),
        ("Lutron CasÃ©ta Wireless", "Lutron Caseta Wireless"),
        ("Hive Active Heating™ [beta]", "Hive Active Heating [beta]"),
        ("Hive Active Heating™", "Hive Active Heating"),
        ("Hive Active Light™", "Hive Active Light"),
        ("naïve", "nave"),
        ("", ""),
        (None, None),
    ],
)
def test_channel_names(spark, given, want):
    assert one(spark, given, tx.normalize_name) == want


def test_text_normalising(spark):
    assert one(spark, " ﬁ­t​  ( a ) , b c ", tx.normalize_text) == "fit (a), b c"
    assert one(spark, "Straße É", tx.normalize_heading) == "strasse é"
    assert one(spark, "ener-\ngy\n\n\n\nx \t y ", tx.clean_pdf_text) == "energy\n\nx y"
    assert bl.normalize(" ﬁ­t​  ( a ) , b c ") == "fit (a), b c"


@pytest.mark.parametrize("t", ["", "12345", "1234", "doi.org/10.1/x", "Figure 2. A plot", "data from here", "A: b. C: d. E: f.", "a? b? c?", "Vol. 3 of x no. 4 page 12", "x" * 50, "café naïve élan", "1999 2000 2001 2002"])
def test_both_classifiers_agree(spark, t):
    category, reason = tx.classify_block(F.col("t"), F.lit("main"))
    got = spark.createDataFrame([(t,)], "t string").select(category, reason).first()
    assert tuple(got) == bl.classify(t, "main")


TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><titleStmt><title>A title</title></titleStmt></teiHeader><text><body>
<div><head>Intro</head><p>First <ref type="bibr">[1]</ref>words<hi>bold </hi>end.</p>
<list type="ordered"><item>one</item><item>two</item></list><figure><head>Fig</head></figure>
<div><head>Deep</head><quote>said</quote><note>lost<p>kept</p></note></div></div>
<div><head>Box 1</head><p>aside</p></div><div><head>References</head><p>gone</p></div>
<wrap><p>inside</p></wrap></body></text></TEI>"""


def test_tei_walk(spark):
    rows = spark.createDataFrame([(1, TEI), (2, "<a>"), (3, None), (4, "<TEI/>")], "id long, x string")
    got = bl.blocks_of(rows, "id", "x").orderBy("id", "ordinal").collect()
    first = [(r.kind, r.text, r.category, r.level) for r in got if r.id == 1]
    assert first == [
        ("title", "A title", "main", 1),
        ("heading", "Intro", "main", 3),
        ("paragraph", "First wordsboldend.", "main", 3),
        ("list_item", "1. one", "main", 3),
        ("list_item", "2. two", "main", 3),
        ("figure", "Fig", "discard", 3),
        ("heading", "Deep", "main", 4),
        ("quote", "said", "main", 4),
        ("paragraph", "kept", "supplementary", 5),
        ("heading", "Box 1", "supplementary", 3),
        ("paragraph", "aside", "supplementary", 3),
        ("container", "Referencesgone", "discard", 3),
        ("paragraph", "inside", "main", 2),
    ]
    assert [r.section_path for r in got if r.text == "said"] == [["Intro", "Deep"]]
    assert all(r.error for r in got if r.id != 1)


WARNED = """<TEI><teiHeader><titleStmt><title type="main"></title><title>Never</title></titleStmt><analytic><title>Second</title></analytic></teiHeader><text><front><div type="abstract"><p>1234</p><p>Front abstract.</p></div></front><body>
<div type="funding"><p>money</p></div><div rend="boxed-text"><p>extra</p></div><div><head>Glossary</head><p>word</p></div><div><head>Text</head><p>{long}</p><p>all rights reserved</p><p>Figure 1. A plot</p>
<p>What? Why? How?</p><table>cells</table></div><div place="sidebar"><head>References to come</head><p>gone</p></div></body></text></TEI>"""


def test_reasons_and_warnings_of_blocks():
    long = " ".join(["word"] * 90)
    blocks = list(bl.document_blocks(WARNED.format(long=long)))
    assert [b["text"] for b in blocks[:2]] == ["Second", "Front abstract."]
    got = [(b["kind"], b["category"], b["reason"]) for b in blocks[2:]]
    assert got == [
        ("container", "discard", "excluded_container_type"),
        ("paragraph", "supplementary", "supplementary_parent"),
        ("heading", "supplementary", "supplementary_heading"),
        ("paragraph", "supplementary", "supplementary_parent"),
        ("heading", "main", "inherited"),
        ("paragraph", "main", "main_content"),
        ("paragraph", "discard", "boilerplate_or_noise"),
        ("paragraph", "discard", "figure_or_table_caption"),
        ("paragraph", "supplementary", "question_block"),
        ("table", "discard", "excluded_table"),
        ("container", "discard", "excluded_section"),
    ]
    assert [b["warnings"] for b in blocks if b["text"] == long] == [["missing_terminal_punctuation"]]
    assert {b["body_chars"] for b in blocks} == {len(bl.normalize(" ".join(bl.all_text(bl.parse_xml(WARNED.format(long=long)).find("text", "body")))))}


def test_element_counts(spark):
    source = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><p coords="1"><s>a</s><s coords="2">b</s></p><note><p/></note><figure coords=""/></TEI>'
    got = {r.id: r for r in bl.element_counts(spark.createDataFrame([(1, source), (2, "<a"), (3, None)], "id long, x string"), "id", "x").collect()}
    assert tuple(got[1])[1:] == (2, 2, 1, 1, 3, None) and got[2].error.startswith("invalid XML") and got[3].n_p is None


def test_html_walk():
    page = "<!DOCTYPE html><html><head><title>T &amp; U</title></head><body><nav>n</nav><h1>H</h1><p>a<br>b<p>c<ul><li>x<li>y</ul><script>var a='</p>';</script></body></html>"
    got = [(b["kind"], b["text"]) for b in bl.document_blocks(page, html=True)]
    assert got[:2] == [("title", "T & U"), ("fw", "n")]
    assert got[2:] == [("heading", "H"), ("paragraph", "a b"), ("paragraph", "c"), ("list_item", "- x"), ("list_item", "- y"), ("fw", "var a='</p>';")]


def test_numbering_by_blocks(spark):
    rows = spark.range(0, 10_000, 3).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    got = ops.number_in_group(rows, "g", "k", block=100).orderBy("g", "k").collect()
    for g in (0, 1):
        assert [r.rn for r in got if r.g == g] == list(range(1, 1 + sum(r.g == g for r in got)))


def test_one_to_one_fails_on_repeats(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(PySparkException):
        ops.one_to_one_left(left, right, "k").collect()
    assert ops.one_to_one_left(left, right.limit(1), "k").count() == 2


def test_a_join_reports_what_it_has_seen(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "e"), (None, "f")], "k int, _left_n string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (9, "w"), (9, "v"), (None, "u")], "k int, r string")
    joined, report = ops.reported_left(left, right, "k")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # one a side
    got = sorted(map(tuple, joined.collect()), key=str)
    assert len(got) == 6 and joined.columns == ["k", "_left_n", "r"]
    assert {(k, r) for k, _, r in got} in ({(1, "x"), (2, y), (3, None), (None, None)} for y in "yz")
    assert report.get == {"rows": 6, "unmatched": 3, "left_repeats": 2, "right_repeats": 4}
    empty, report = ops.reported_left(left.limit(0), right, "k")
    assert empty.count() == 0 and report.left.get["rows"] == 0


def test_selection():
    assert ops.parse_selection(["1-3,7", "outliers"]) == {-1, 1, 2, 3, 7}
    assert ops.parse_selection(["all"]) is None
    for bad in ([], ["3-1"], ["x"]):
        with pytest.raises(ValueError, match=r"nothing|backwards|not a"):
            ops.parse_selection(bad)


def test_missing_topic_and_column(spark):
    df = spark.createDataFrame([(1,)], "topic int")
    with pytest.raises(ValueError, match="no such topics"):
        ops.select_topics(df, "topic", {1, 2})
    with pytest.raises(ValueError, match="missing columns: x"):
        ops.require_columns(df, ["topic", "x"])


def test_files(spark, tmp_path):
    for topic, text in ((-1, 'a "quoted"\nline'), (10, "b"), (2, "c")):
        folder = tmp_path / f"topic_{topic}"
        folder.mkdir()
        quoted = text.replace('"', '""')
        (folder / f"topic_{topic}_batch_001.csv").write_text(f'sample_id,topic_name,topic_text\nS{topic},n,"{quoted}"\n')
        (folder / f"topic_{topic}.csv").write_text("sample_id,topic_name,topic_text\nstale,n,x\n")
    got = {r.topic_id: r.topic_text for r in files.read_batches(spark, str(tmp_path)).collect()}
    assert got == {-1: 'a "quoted"\nline', 10: "b", 2: "c"}


def test_label_documents_to_rules(spark, tmp_path):
    context = {"topic_id": 1, "llm_topic_name": "t", "topic_summary": "s", "green_category": "c", "global_green_relevance": "high"}
    rows = [
        {"sample_id": "1", "if_then_rule": "IF a THEN b", "green_relevance": " High ", "keep_for_rag": False},
        {"sample_id": "2", "if_then_rule": "IF x THEN y", "green_relevance": "medium", "green_category": "own"},
        {"sample_id": "3", "if_then_rule": "IF x", "green_relevance": "low"},
        {"sample_id": "", "if_then_rule": "IF q", "green_relevance": "high"},
        {"sample_id": "5", "if_then_rule": "IF r", "green_relevance": None},
    ]
    (tmp_path / "b1.json").write_text(json.dumps({"topic_context": context, "rows": rows}))
    (tmp_path / "b2.json").write_text(json.dumps({"topic_context": context, "rows": [rows[0] | {"sample_id": "9"}]}))
    documents = files.read_label_documents(spark, str(tmp_path / "*.json"))
    got = {r.if_then_rule: (r.sample_id, r.green_category) for r in files.final_rules(files.label_rows(documents)).collect()}
    assert got == {"IF a THEN b": ("1", "c"), "IF x THEN y": ("2", "own")}
    (tmp_path / "b3.json").write_text(json.dumps({"topic_context": context, "rows": None}))
    with pytest.raises(PySparkException):
        files.label_rows(files.read_label_documents(spark, str(tmp_path / "*.json"))).collect()


def test_model_connector_retries(spark):
    def client(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return json.dumps({"rows": []}) if prompt == "a" else prompt

    inputs = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "no json"), (4, '{"rows": [], "more": 1}'), (5, None)], "k int, p string")
    got = {r.k: (r.response, r.error) for r in connectors.ask(inputs, "k", "p", client, connectors.BATCH_SCHEMA, backoff=0, pause=0).collect()}
    assert got[1] == ('{"rows": []}', None) and got[2] == (None, "ValueError: no") and got[5] == (None, "no prompt")
    assert got[3][1].startswith("not JSON") and got[4] == (None, "$.more: unknown")


def test_strict_schema():
    row = {"sample_id": "1", "if_then_rule": "IF a THEN b", "green_relevance": "high", "keep_for_rag": True}
    good = {"rows": [row]}
    assert connectors.violations(good, connectors.BATCH_SCHEMA) == []
    for change, problem in (({"keep_for_rag": 1}, "not boolean"), ({"green_relevance": "huge"}, "not allowed"), ({"x": 1}, "unknown"), ({"sample_id": None}, "not string")):
        assert problem in connectors.violations({"rows": [row | change]}, connectors.BATCH_SCHEMA)[0]
    assert connectors.violations({"rows": [{}]}, connectors.BATCH_SCHEMA)[0].endswith("sample_id: missing")
    assert connectors.violations([], connectors.BATCH_SCHEMA) == ["$: not object"]
    context = {"topic_id": True, "llm_topic_name": "n", "topic_summary": "s", "green_category": "c", "global_green_relevance": "low"}
    assert connectors.violations(context, connectors.CONTEXT_SCHEMA) == ["$.topic_id: not integer"]


def test_client_settings(tmp_path):
    dotenv = tmp_path / ".env"
    dotenv.write_text("# a comment\nOPEN-ROUTER-KEY='from file'\n")
    assert connectors.load_key({}, str(dotenv)) == "from file" and connectors.load_key({"OPENROUTER_API_KEY": "k"}, "none") == "k"
    with pytest.raises(ValueError, match="no service key"):
        connectors.load_key({}, "none")
    (tmp_path / "p.txt").write_text(" ask this \n")
    assert connectors.load_prompt(str(tmp_path / "p.txt")) == "ask this"
    with pytest.raises(FileNotFoundError):
        connectors.load_prompt(str(tmp_path / "q.txt"))
    sent = connectors.ChatClient("k", "system", "name", connectors.BATCH_SCHEMA).request("hello")
    assert sent["temperature"] == 0 and sent["response_format"]["json_schema"]["strict"] and [m["content"] for m in sent["messages"]] == ["system", "hello"]


def test_extraction_service(spark):
    def old(service, input_path, n, force, output, generateIDs=None, segmentSentences=None): ...
    def new(service, input_path, n, force, output_path, generate_ids=None, tei_coordinates=None, consolidate_header=None): ...
    def none(service, input_path, n, force): ...

    assert connectors.service_call(old, "i", "o").keywords == {"service": "processFulltextDocument", "input_path": "i", "n": 1, "force": True, "output": "o", "generateIDs": True, "segmentSentences": True}
    got = connectors.service_call(new, "i", "o", 3).keywords
    assert got["output_path"] == "o" and got["tei_coordinates"] is True and got["consolidate_header"] is False and got["n"] == 3
    with pytest.raises(RuntimeError, match="output_path"):
        connectors.service_call(none, "i", "o")
    with pytest.raises(ValueError, match="worker"):
        connectors.service_call(old, "i", "o", 0)
    made = connectors.service_client(lambda grobid_server, timeout=1: (grobid_server, timeout), "http://x", timeout=300, coordinates=["p"])
    assert made == ("http://x", 300)
    files_ = spark.createDataFrame([("a", b"1"), ("b", b"x")], "id string, c binary")
    out = {r.id: (r.source, r.error) for r in connectors.extract(files_, "id", "c", lambda c: f"<TEI n='{int(c)}'/>").collect()}
    assert out["a"] == ("<TEI n='1'/>", None) and out["b"][1].startswith("ValueError")


def test_pages_and_their_reports(spark, tmp_path):
    (tmp_path / "article_1.pdf").write_bytes(b"one ener-\ngy|two")
    (tmp_path / "article_2.pdf").write_bytes(b"!")

    def reader(content):
        if content == b"!":
            raise OSError("no pages")
        return content.decode().split("|")

    got = {r.article_id: r for r in connectors.read_pages(spark, f"{tmp_path}/*.pdf", reader).collect()}
    assert got["article_1"].text == "--- PAGE 1 ---\n\none energy\n\n--- PAGE 2 ---\n\ntwo" and got["article_2"].error == "OSError: no pages"
    texts = spark.createDataFrame([("a", "Some words.\nMore é.")], "id string, t string")
    assert storage.write_text_reports(texts, "id", "t", f"{tmp_path}/out") == 2
    assert (tmp_path / "out/texts/a.txt").read_text() == "Some words.\nMore é."
    assert json.loads((tmp_path / "out/reports/a_report.json").read_text())["num_words"] == 4


def test_metadata_and_vectors(spark):
    flags = dict.fromkeys(connectors.CATEGORIES, 0) | {"water_saving": 1}
    answer = json.dumps({"article_id": "a", "source_title": "T", "year": "2024", "article_summary": "s", "normalized_green_categories_one_hot": flags})
    docs = spark.createDataFrame([("a", "text"), ("b", "other")], "id string, t string")
    got = {r.id: r for r in connectors.article_metadata(docs, "id", "t", lambda p: answer if "article_id: a" in p else "{}", backoff=0, pause=0).collect()}
    assert got["a"].metadata.normalized_green_categories_one_hot == flags and got["a"].metadata.year == "2024" and got["b"].error
    vectors = {r.id: list(r.embedding) for r in connectors.embed(docs, "id", "t", lambda texts: [[len(t), 1] for t in texts]).collect()}
    assert vectors == {"a": [4.0, 1.0], "b": [5.0, 1.0]}


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([(1, 'a "q";\nb', None), (2, "é", "x")], "k int, t string, n string").coalesce(1)
    storage.write_delimited(rows, f"{root}/semi", bom=True)
    body = next((tmp_path / "semi").glob("part-*.csv")).read_bytes()
    assert body.startswith(b"\xef\xbb\xbfk;t;n\n")
    back = files.read_delimited(spark, f"{root}/semi", ["k", "t", "n"]).orderBy("k").collect()
    assert [(r.k, r.t, r.n) for r in back] == [("1", 'a "q";\nb', None), ("2", "é", "x")]
    batched = spark.createDataFrame([(-1, 1, f"S{i:02d}", "n", f'text "{i}", and\nmore') for i in range(3)] + [(10, 12, "S9", "n", None)], "topic_id int, batch_id int, sample_id string, topic_name string, topic_text string")
    assert storage.write_batch_files(batched, f"{root}/batches", ["sample_id", "topic_name", "topic_text"]) == 2
    assert sorted(str(p.relative_to(tmp_path / "batches")) for p in (tmp_path / "batches").rglob("*.csv")) == ["topic_-1/topic_-1_batch_001.csv", "topic_10/topic_10_batch_012.csv"]
    again = {r.sample_id: r for r in files.read_batches(spark, f"{root}/batches").collect()}
    assert again["S01"].topic_text == 'text "1", and\nmore' and (again["S9"].topic_id, again["S9"].batch_id, again["S9"].topic_text) == (10, 12, None)
    lines = spark.createDataFrame([("a", 2, "y"), ("a", 1, None), ("b", 1, "é")], "doc string, ordinal int, t string")
    names = spark.createDataFrame([("a.jsonl",), ("b.jsonl",)], "name string")
    assert storage.write_json_lines(lines, f"{root}/lines", F.concat("doc", F.lit(".jsonl")), names) == 2
    assert [json.loads(x) for x in (tmp_path / "lines/a.jsonl").read_text().splitlines()] == [{"doc": "a", "t": None}, {"doc": "a", "t": "y"}]
    assert "é" in (tmp_path / "lines/b.jsonl").read_text()
    assert storage.write_json_lines(lines.where("doc = 'a'"), f"{root}/lines", F.concat("doc", F.lit(".jsonl")), names) == 1
    assert not (tmp_path / "lines/b.jsonl").exists()
    assert storage.write_json_documents(lines.where("doc = 'b'"), f"{root}/docs", F.lit("x/b.json"), F.to_json(F.struct("doc", "t"))) == 1
    assert (tmp_path / "docs/x/b.json").read_text() == '{\n  "doc": "b",\n  "t": "é"\n}'
    good, todo = storage.reuse(spark, spark.createDataFrame([(1,), (2,), (3,)], "k int"), spark.createDataFrame([(1, "ok"), (2, None)], "k int, v string"), ["k"], F.col("v") == "ok")
    assert [r.k for r in good.collect()] == [1] and sorted(r.k for r in todo.collect()) == [2, 3]


def test_article_files_and_command_line(spark, tmp_path, capsys):
    from gristmill import cli

    src, out = tmp_path / "tei", tmp_path / "out"
    src.mkdir()
    body = "The rules were applied to forty homes for one year and the savings were large enough to matter, said the 40 42 44 46 48."
    (src / "article_1.grobid.tei.xml").write_text(ARTICLE.format(a="In this paper we present rules. " * 12, b=body))
    (src / "article_2.xml").write_text("<TEI")
    (src / "article_3.xml").write_text("<TEI><text><body/></text></TEI>")
    (src / "article_4.xml").write_text('<TEI><text><body><div><head>Box 1</head><p>Aside.</p></div><p>Main.</p></body></text></TEI>')
    args = ["articles", "--source", str(src), "--out", str(out)]
    assert cli.JOBS["articles"](spark, cli.parser().parse_args([*args, "--all"])) == 1
    said = capsys.readouterr().out
    assert "files done: 2/4" in said and "- article_2: invalid XML" in said and "- article_3: no useful main content" in said
    text = (out / "cleaned_markdown/article_1.md").read_text()
    assert text.startswith("# Green homes\n\n## Abstract\n\nIn this paper we present rules.") and text.count(body) == 1
    report = json.loads((out / "cleaning_reports/article_1.json").read_text())
    assert report["counts"]["discard_reasons"] == {"duplicate_content": 2, "figure_content": 1} and report["title_found"]
    assert report["source_tei"].endswith("/tei/article_1.grobid.tei.xml") and report["main_output"] == f"{out}/cleaned_markdown/article_1.md" and report["supplementary_output"] is None
    assert json.loads((out / "cleaning_reports/article_4.json").read_text())["supplementary_output"] == f"{out}/supplementary_markdown/article_4.md"
    assert report["counts"]["review_blocks"] == 0 and report["quality"]["raw_body_characters"] > report["quality"]["main_text_characters"] == len(body)
    assert (out / "supplementary_markdown/article_4.md").read_text() == "# article_4 — Supplementary Content\n\n### Box 1\n\nAside.\n"
    assert len((out / "discarded_blocks/article_1.jsonl").read_text().splitlines()) == 3 and not (out / "review_blocks/article_1.jsonl").exists()
    (src / "article_4.xml").write_text("<TEI><text><body><p>Main.</p></body></text></TEI>")
    assert cli.JOBS["articles"](spark, cli.parser().parse_args([*args, "--article", "4"])) == 0
    assert not (out / "supplementary_markdown/article_4.md").exists() and "files done: 1/1" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        cli.JOBS["articles"](spark, cli.parser().parse_args([*args, "--article", "9"]))
    with pytest.raises(SystemExit):
        cli.parser().parse_args([*args, "--article", "9", "--all"])
    clustered = tmp_path / "clustered.csv"
    clustered.write_text("topic_id,topic_name,topic_text\n" + "".join(f"{i % 2 - 1},name,text {i}\n" for i in range(7)))
    assert cli.JOBS["batches"](spark, cli.parser().parse_args(["batches", "--source", str(clustered), "--out", str(tmp_path / "b"), "--rows", "2"])) == 0
    assert len(list((tmp_path / "b").glob("topic_*/*.csv"))) == 4


def test_labelling_run(spark, tmp_path):
    from gristmill.operators import labelling as lab

    batches = spark.createDataFrame([(t, b, f"T{t}_S{s}", "n", f"text {s}") for t in (1, 2) for b in (1, 2) for s in (2 * b - 1, 2 * b)], "topic_id int, batch_id int, sample_id string, topic_name string, topic_text string")
    context = {"llm_topic_name": "name", "topic_summary": "sum", "green_category": "cat", "global_green_relevance": "high"}
    stored = spark.createDataFrame([(1, "old", "sum", "cat_1", "low"), (2, "bad", "sum", "Not Snake", "low")], lab.CONTEXT)

    def topic_client(prompt):
        return json.dumps({"topic_id": 2} | context)

    contexts = lab.get_contexts(batches, batches, stored, topic_client, backoff=0, pause=0)
    assert {r.topic_id: (r.llm_topic_name, r.error) for r in contexts.collect()} == {1: ("old", None), 2: ("name", None)}
    row = lambda s: {"sample_id": s, "if_then_rule": f"IF {s}", "green_relevance": "low", "keep_for_rag": True}

    def client(prompt):
        ids = [line.split(": ")[1] for line in prompt.splitlines() if line.startswith("sample_id: ")]
        return json.dumps({"rows": [row(i) for i in (ids[:1] if "T2_S3" in ids else ids)]})

    old = spark.createDataFrame([(1, 1, (1, *context.values()), [("T1_S1", "IF old", "high", True), ("T1_S2", "IF old", "none", False)]), (1, 2, (1, *context.values()), [("T1_S3", "IF half", "high", True)])], "topic_id int, batch_id int, topic_context struct<topic_id: int, llm_topic_name: string, topic_summary: string, green_category: string, global_green_relevance: string>, rows array<struct<sample_id: string, if_then_rule: string, green_relevance: string, keep_for_rag: boolean>>")
    made = lab.label_batches(batches, contexts, old, client, backoff=0, pause=0)
    got = {(r.topic_id, r.batch_id): r for r in made.collect()}
    assert got[1, 1].reused and got[1, 1].rows[0].if_then_rule == "IF old" and not got[1, 2].reused and got[1, 2].rows[1].if_then_rule == "IF T1_S4"
    assert got[2, 1].error is None and got[2, 1].topic_context.llm_topic_name == "name" and got[2, 2].error == "missing: T2_S4" and got[2, 2].rows is None
    flat = {r.sample_id: r for r in lab.flat_labels(made).collect()}
    assert len(flat) == 6 and tuple(flat["T1_S3"].asDict()) == lab.FLAT and flat["T1_S3"].llm_topic_name == "old"
    assert lab.write_documents(made, f"{tmp_path}/done") == 3 and lab.write_contexts(contexts, f"{tmp_path}/done") == 2
    back = files.read_label_documents(spark, f"{tmp_path}/done/topic_*/topic_*_batch_*.json")
    assert files.label_rows(back).count() == 6
    with pytest.raises(ValueError, match="repeated sample_id: T1_S1"):
        lab.label_batches(batches.union(batches.limit(1)), contexts, old, client)
    assert lab.non_empty(batches.select("topic_id").distinct(), batches.where("topic_id = 1"), "topic_id").count() == 1
    with pytest.raises(ValueError, match="no topic_id"):
        lab.non_empty(batches, batches.limit(0), "topic_id")


def test_incremental_collection(spark, tmp_path, monkeypatch):
    from gristmill.streaming import incremental

    schema = spark.createDataFrame([], "k int, v string").schema
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    looked = []
    monkeypatch.setattr(incremental, "pending", lambda rows, done, key: looked.append(done) or ops.pending(rows, done, key))
    late = [{"k": 1, "v": "late"}, {"k": 4, "v": "w"}]  # an id that comes once more, two batches later
    for name, rows in (("a", [{"k": 1, "v": "x"}, {"k": 2, "v": "y"}]), ("b", [{"k": 2, "v": "again"}, {"k": 3, "v": "z"}]), ("c", late), ("d", [])):
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))
        collect_new(spark, src, schema, out, check, "k").awaitTermination()
    assert {r.k: r.v for r in spark.read.parquet(out).collect()} == {1: "x", 2: "y", 3: "z", 4: "w"} and spark.read.parquet(out).count() == 4
    plan = looked[-2]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:int>" in plan and "PartitionFilters: [" in plan and "key_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    again = f"{tmp_path}/check2"  # a checkpoint that is lost: all files come once more
    collect_new(spark, src, schema, out, again, "k").awaitTermination()
    assert spark.read.parquet(out).count() == 4


def test_ngrams_and_nearest(spark):
    docs = spark.createDataFrame([("c", "One two, two ones a")], "c string, t string")
    got = {r.term: r.n for r in tp.terms(docs, "c", "t", ("ones",), longest=2).collect()}
    assert got == {"one": 1, "two": 2, "one two": 1, "two two": 1}
    empty = spark.createDataFrame([], "i long, v array<float>")
    assert tp.cosine_topk(empty, "i", "v", F.col("i") == 0, 3).count() == 0


ARTICLE = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title type="main">Green homes</title></titleStmt></fileDesc>
<profileDesc><abstract xml:lang="en"><p>{a}</p></abstract></profileDesc></teiHeader><text><front><div type="abstract"><p>Short one.</p></div></front>
<body><div><head>Results</head><p>{b}</p><p>{b}</p><p>{a}</p><figure><head>F</head></figure></div></body></text></TEI>"""


def test_article_report(spark):
    from gristmill.operators import articles

    abstract = "In this paper we present a method. " + "It saves energy in many homes by careful rules. " * 8
    body = "The rules were applied to forty homes for one year and the savings were large enough to matter."
    rows = spark.createDataFrame([("a", ARTICLE.format(a=abstract.strip(), b=body)), ("b", "<TEI><text><body><p>Only this.</p></body></text></TEI>")], "id string, x string")
    got = {r.id: r for r in articles.report(bl.blocks_of(rows, "id", "x"), "id").collect()}
    a = got["a"]
    assert a.title == "Green homes" and a.abstract == abstract.strip() and [c.score for c in a.candidates] == [9.5, -2.0]
    assert (a.main_blocks, a.discarded_blocks, a.block_kinds, a.discard_reasons) == (2, 3, {"heading": 1, "paragraph": 1}, {"duplicate_content": 2, "figure_content": 1})
    assert got["b"].warnings == ["abstract_not_found", "abstract_not_selected", "title_not_found"] and not got["b"].title_found


def brute_tree(points, k):
    """The total weight of the spanning tree of mutual reachability, by Prim."""
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, k - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, inside, total = reach[0].copy(), {0}, []
    while len(inside) < len(points):
        j = min((x for x in range(len(points)) if x not in inside), key=lambda x: best[x])
        total.append(best[j])
        inside.add(j)
        best = np.minimum(best, reach[j])
    return core, sorted(total)


def test_density_tree():
    rnd = np.random.default_rng(3)
    points = np.concatenate([rnd.normal(0, 1, (40, 3)), rnd.integers(0, 3, (40, 3)).astype(float)])  # with many ties
    core, want = brute_tree(points, 4)
    every = np.arange(len(points))
    assert np.allclose(dn.core_distances(points, every, 4, 16), core, atol=1e-6)
    groups, tree = dn.Groups(len(points)), []
    while len(tree) < len(points) - 1:
        group = np.asarray([groups.root(i) for i in every])
        to, far = dn.nearest_edges(points, core, group, every, 16)
        done = set()
        for p in np.lexsort((np.maximum(every, to), np.minimum(every, to), far)).tolist():
            if group[p] not in done:
                done.add(group[p])
                if groups.join(p, int(to[p])):
                    tree.append(far[p])
    assert np.allclose(sorted(tree), want, atol=1e-6)


def test_density_clusters(spark):
    rnd = np.random.default_rng(5)
    blobs = [rnd.normal(c, 0.3, (n, 2)) for c, n in (((0, 0), 80), ((6, 0), 60), ((0, 6), 50))]
    noise = np.asarray([[20.0 + 5 * i, -20.0 + 3 * i] for i in range(6)])
    points = np.concatenate([*blobs, noise])
    rows = [(i, p.tolist()) for i, p in enumerate(points)] + [(None, [0.0, 0.0]), (999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = {r.id: r.topic_id for r in dn.density_clusters(df, "id", "v", min_size=20, block=37).collect()}
    assert len(got) == len(points) and {got[i] for i in range(190, 196)} == {-1}
    for k, (a, b) in enumerate(((0, 80), (80, 140), (140, 190))):
        own = [got[i] for i in range(a, b)]
        assert own.count(k) >= 0.9 * len(own) and set(own) <= {k, -1}
    assert {r.topic_id for r in dn.density_clusters(df.limit(5), "id", "v").collect()} <= {-1} and dn.density_clusters(df.limit(0), "id", "v").count() == 0
    with pytest.raises(ValueError, match="cluster a sample"):
        dn.density_clusters(df, "id", "v", max_points=10)


def test_a_topic_model_is_written_and_read(spark, tmp_path):
    rnd = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rnd.normal(i % 3 * 10, 1, 6)]) for i in range(90)] + [(200, [500.0] * 6), (201, None)]
    vectors = spark.createDataFrame(rows, "id int, v array<double>").withColumn("distance", F.lit("own"))
    estimator = TopicEstimator(k=3, dims=2, spread=2.0)
    model = estimator.fit(vectors.where("id < 200"), "v")
    model.write(f"{tmp_path}/model")
    model.write(f"{tmp_path}/model")
    again = TopicModel.read(spark, f"{tmp_path}/model")
    place = lambda m: {r.id: (r.t, r.d) for r in m.transform(vectors, "v", "t", "d").collect()}
    got = place(again)
    assert got == place(model) and got[200][0] == -1 and got[201] == (None, None)
    assert {len({got[i][0] for i in range(k, 90, 3)} - {-1}) for k in range(3)} == {1} and len({t for t, _ in got.values()}) == 5
    alone = {r.id: (r.t, r.d) for i in (0, 200) for r in again.transform(vectors.where(f"id = {i}"), "v", "t", "d").collect()}
    assert alone == {i: got[i] for i in (0, 200)}  # a row's topic does not depend on its company
    vectors.write.parquet(f"{tmp_path}/in")
    stream = again.transform(spark.readStream.schema(vectors.schema).parquet(f"{tmp_path}/in"), "v", "t", "d")
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    assert {r.id: (r.t, r.d) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == got
    with pytest.raises(FileNotFoundError):
        TopicModel.read(spark, f"{tmp_path}/none")


def test_nearest_in_chunks(spark):
    rnd = np.random.default_rng(4)
    rows = [(int(i), None if i == 7 else [float(x) for x in rnd.integers(-2, 3, 4)]) for i in range(60)]
    vectors = spark.createDataFrame(rows, "i long, v array<float>").repartition(3)
    unit = {i: np.asarray(v) / max(np.linalg.norm(v), 1e-300) for i, v in rows if v}
    want = {(q, i, s) for q in unit if q % 5 == 0 for s, i in sorted((-round(float(unit[q] @ unit[i]), 6), i) for i in unit if i != q)[:4]}
    for block, chunk in ((1024, 16_384), (3, 1)):
        got = tp.cosine_topk(vectors, "i", "v", F.col("i") % 5 == 0, 4, block, chunk).collect()
        assert {(r.query_id, r.i, round(-r.score, 6)) for r in got} == {(q, i, round(s, 6)) for q, i, s in want}


def test_topic_terms_by_similarity(spark):
    from gristmill.operators import topics as tp_

    docs = spark.createDataFrame([("a", "solar panel light", [1.0, 0.0]), ("a", "solar lamp", [1.0, 0.2]), ("b", "rain water panel", [0.0, 1.0]), ("b", "rain the rule naïve x1y", [0.0, 1.0])], "c string, t string, v array<double>")
    docs = docs.withColumn("i", F.monotonically_increasing_id())
    tf = tp_.terms(docs, "c", "t", tp_.stop_words(), 3)
    assert {r.term for r in tf.where("class = 'b'").collect()} == {"rain", "water", "panel", "rain water", "water panel", "rain water panel"}
    counted = tp_.term_table(docs, "c", "t", tp_.stop_words(), min_df=1)
    assert {(r["class"], r.term, r.n) for r in counted.where("term != ''").collect()} == {(r["class"], r.term, r.n) for r in tf.collect()}
    assert {r.term for r in tp_.vocabulary(tp_.term_table(docs, "c", "t", tp_.stop_words(), min_df=2), max_df=1.0).collect()} == {"panel"}
    weights = tp_.class_weights(counted, max_df=1.0)
    found = tp_.document_terms(docs, weights, "c", "i", "t", tp_.stop_words())
    ranked = tp_.rerank(weights, found, docs.select(F.col("i").alias("id"), "v"), top=2)
    got = {(r["class"], r["rank"]): r.term for r in ranked.collect()}
    assert got["b", 1] in ("rain", "rain water", "rain water panel", "water", "water panel") and got["a", 1].startswith(("solar", "lamp"))


def test_class_weights_and_representatives_by_brute_force(spark):
    from gristmill.operators import topics as tp_

    rnd = random.Random(3)
    rows = [(i, f"c{i % 4}", " ".join(rnd.choice(["sun"] * 40 + "moon star sea rock tree leaf wind".split()) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "i long, c string, t string")
    runs = lambda t: [" ".join(t.split()[a : a + n]) for n in (1, 2, 3) for a in range(len(t.split()) - n + 1)]
    counts = {c: Counter(x for _, c2, t in rows if c2 == c for x in runs(t)) for c in ("c0", "c1", "c2", "c3")}
    freq, classes = sum(counts.values(), Counter()), Counter(t for c in counts.values() for t in c)
    for max_df in (0.6, 1.0):
        kept = {t for t in freq if 2 <= classes[t] <= max_df * 4}
        size = {c: sum(n for t, n in counts[c].items() if t in kept) for c in counts}
        mean = math.floor(sum(size.values()) / sum(v > 0 for v in size.values()))
        idf = {t: math.log(1 + (mean - freq[t] + 0.5) / (freq[t] + 0.5)) for t in kept}
        want = {(c, t): math.sqrt(n / size[c]) * idf[t] for c in counts for t, n in counts[c].items() if t in kept}
        weights = tp_.class_weights(tp_.term_table(docs, "c", "t", min_df=2), max_df)
        assert {(r["class"], r.term): round(r.weight, 9) for r in weights.collect()} == {k: round(v, 9) for k, v in want.items()}
        if max_df == 1.0:
            assert min(want.values()) < 0  # a term with more than the mean's occurrences stays
        near = {}
        for i, c, t in rows:
            own = {x: math.sqrt(n) * idf[x] for x, n in Counter(runs(t)).items() if x in kept}
            norms = math.sqrt(sum(v * v for v in own.values())) * math.sqrt(sum(v * v for (c2, _), v in want.items() if c2 == c))
            if own:
                near.setdefault(c, []).append((-round(sum(v * want[c, x] for x, v in own.items()) / norms, 6), i))
        found = tp_.representatives(tp_.document_terms(docs, weights, "c", "i", "t"), weights, 3)
        assert {(r["class"], r["rank"]): (r.id, r.similarity) for r in found.collect()} == {(c, k): (i, -s) for c, x in near.items() for k, (s, i) in enumerate(sorted(x)[:3], 1)}


def test_labelling(spark):
    from gristmill.operators import labelling as lab

    samples = spark.createDataFrame([(1, 1, "s2", "n", "t2"), (1, 1, "s1", "n", "t1")], "topic_id int, batch_id int, sample_id string, topic_name string, topic_text string")
    contexts = spark.createDataFrame([(1, "name", "sum", "cat_1", "high"), (2, "name", "sum", "Cat", "high"), (3, "name", None, "cat", "high"), (4, "n", "s", "cat", "huge")], "topic_id int, llm_topic_name string, topic_summary string, green_category string, global_green_relevance string")
    assert [r.v for r in contexts.select("topic_id", lab.context_verdict(F.col("topic_id")).alias("v")).orderBy("topic_id").collect()] == [None, "not_snake_case", "missing_topic_summary", "relevance"]
    prompt = lab.batch_prompts(samples, contexts).first().prompt
    assert "[1]\nsample_id: s1\ntopic_name: n\ntopic_text: t1\n\n[2]\nsample_id: s2" in prompt and prompt.endswith("Preserve every sample_id exactly.")
    assert prompt.startswith("Input file: topic_1/topic_1_batch_001.csv\nTopic id: 1\n\nFixed topic-level context:\nllm_topic_name: name\n")
    asked = lab.topic_prompts(samples).first().prompt
    assert asked.startswith("Topic id: 1\nAutomatic BERTopic topic name: n\nNumber of representative samples: 2\n\nRepresentative samples:\n\n[1]\n") and asked.endswith("text: t2\n\nInfer the topic-level context for this BERTopic cluster.")
    labels = spark.createDataFrame([("s1", "high", True), ("s1", "high", True), ("x", "odd", None)], "sample_id string, green_relevance string, keep_for_rag boolean")
    assert {(r.sample_id, r.problem) for r in lab.label_problems(samples, labels).collect()} == {("s2", "missing"), ("x", "extra"), ("s1", "repeated"), ("x", "relevance"), ("x", "keep_for_rag")}


def test_resolve_file(spark, tmp_path):
    for n in ("article_1.tei.xml", "Article_2.xml", "article_30.xml", "article_31.xml", "x.txt"):
        (tmp_path / n).write_text("<TEI/>")
    found = lambda a: files.resolve_file(spark, f"file://{tmp_path}", a, (".tei.xml", ".xml")).rpartition("/")[2]
    assert [found(a) for a in ("article_1", "article_2", "article_30")] == ["article_1.tei.xml", "Article_2.xml", "article_30.xml"]
    for bad in ("article_3", "article_9"):
        with pytest.raises(FileNotFoundError):
            found(bad)
    assert files.read_documents(spark, f"file://{tmp_path}/*.xml").count() == 4
