"""Durable answers, paced calls, folders read by filter, file sets that change as a whole."""

import json
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gristmill.sources import connectors, files, filesets, folders, ledger, storage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import tests
SCHEMA = connectors.strict_object({"n": {"type": "integer"}})


class CountingClient:
    """Answers a prompt "p<n>" by n; every call leaves a file with its time."""

    model, system = "counting", ""

    def __init__(self, folder, die_at=None):
        self.folder, self.die_at = str(folder), die_at

    def __call__(self, prompt):
        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/{prompt}-{time.time_ns()}", "w"):
            pass
        if prompt == self.die_at:
            os._exit(1)
        if prompt == "bad":
            raise ValueError("no")
        return json.dumps({"n": int(prompt[1:])})

    def calls(self):
        return sorted(x.partition("-")[0] for x in os.listdir(self.folder)) if os.path.isdir(self.folder) else []


def prompts(spark, names):
    return spark.createDataFrame(list(enumerate(names)), "k int, p string").repartition(3)


def ask(inputs, client, book, **options):
    return ledger.ask_once(inputs, "k", "p", client, SCHEMA, book, backoff=0, pause=0, **options)


def test_answers_are_asked_for_once(spark, tmp_path):
    book, client = ledger.Ledger(spark, f"{tmp_path}/book"), CountingClient(tmp_path / "calls")
    inputs = prompts(spark, ["p1", "p2", "p2", "bad", None])
    got = {r.k: (r.response, r.error, r.reused) for r in ask(inputs, client, book, attempts=2).collect()}
    assert got == {0: ('{"n": 1}', None, False), 1: ('{"n": 2}', None, False), 2: ('{"n": 2}', None, False), 3: (None, "ValueError: no", False), 4: (None, "no prompt", False)}
    assert client.calls() == ["bad", "bad", "p1", "p2"]
    more = ask(prompts(spark, ["p3", "p2", "p1"]), client, book)
    assert more.count() == 3 and {r.k: r.reused for r in more.collect()} == {0: False, 1: True, 2: True}
    assert client.calls() == ["bad", "bad", "p1", "p2", "p3"]
    assert not [f for _, _, fs in os.walk(f"{tmp_path}/book/attempts") for f in fs] and len(os.listdir(f"{tmp_path}/book/log")) == 2
    other = CountingClient(tmp_path / "other")
    other.model = "another"
    assert ask(prompts(spark, ["p1"]), other, book).first().response == '{"n": 1}' and other.calls() == ["p1"]


def test_a_job_killed_between_asking_and_writing_asks_nothing_twice(spark, tmp_path, monkeypatch):
    book, client = ledger.Ledger(spark, f"{tmp_path}/book"), CountingClient(tmp_path / "calls")
    inputs = prompts(spark, [f"p{i}" for i in range(20)])
    commit, seen = ledger.Ledger.commit, []

    def killed(self, *args):
        seen.append(1)
        if len(seen) == 2:  # when all answers have come, and none is published
            raise KeyboardInterrupt
        return commit(self, *args)

    monkeypatch.setattr(ledger.Ledger, "commit", killed)
    with pytest.raises(KeyboardInterrupt):
        ask(inputs, client, book)
    assert len(client.calls()) == 20 and not book._entries()
    monkeypatch.undo()
    got = ask(inputs, client, ledger.Ledger(spark, f"{tmp_path}/book"))
    assert got.where("reused and error is null").count() == 20 and len(client.calls()) == 20


def test_a_worker_that_dies_loses_the_call_in_flight_only(spark, tmp_path):
    book, client = ledger.Ledger(spark, f"{tmp_path}/book"), CountingClient(tmp_path / "calls", die_at="p7")
    inputs = prompts(spark, [f"p{i}" for i in range(12)]).coalesce(1)
    with pytest.raises(Exception, match="."):
        ask(inputs, client, book)
    done = len(client.calls())
    client.die_at = None
    assert ask(inputs, client, book).where("error is null").count() == 12
    assert len(client.calls()) == 13 and done <= 12 and client.calls().count("p7") == 2


def test_the_first_published_answer_stays(spark, tmp_path):
    books = [ledger.Ledger(spark, f"{tmp_path}/book") for _ in range(2)]
    fs, base = storage.open_fs(f"{tmp_path}/book/attempts")
    put = lambda key, text: ledger.put_first(fs, f"{base}/{ledger.attempt_name(key)}", json.dumps({"answer_key": key, "response": text, "answered_at": 1.0}))
    assert put("aa1", "first") and not put("aa1", "second") and put("bb1", "x")
    entries = ledger.Ledger._entries
    late = entries(books[0])
    assert books[1].commit() == 2
    assert put("aa1", "later") and put("cc1", "y")
    stale = iter([late])  # this run looked before the other had published
    books[0].__class__._entries = lambda self: next(stale, None) or entries(self)
    try:
        assert books[0].commit() == 1
    finally:
        ledger.Ledger._entries = entries
    assert {r.answer_key: r.response for r in books[0].answers().collect()} == {"aa1": "first", "bb1": "x", "cc1": "y"}
    with ThreadPoolExecutor(2) as pool:
        got = pool.map(lambda b: sorted(ask(prompts(spark, ["p1", "p2"]), CountingClient(tmp_path / "calls"), b).select("response", "error").collect()), books)
        assert [list(map(tuple, g)) for g in got] == [[('{"n": 1}', None), ('{"n": 2}', None)]] * 2
    answers = books[0].answers()
    assert answers.count() == 5 == answers.select("answer_key").distinct().count()


@pytest.mark.parametrize("partitions", [1, 7])
def test_pace_of_the_whole_service(spark, tmp_path, partitions):
    client = CountingClient(tmp_path / "calls")
    inputs = spark.createDataFrame([(i, f"p{i}") for i in range(12)], "k int, p string").repartition(partitions)
    assert connectors.ask(inputs, "k", "p", client, SCHEMA, pause=0.2, slots=3).where("error is null").count() == 12
    at = sorted(int(x.partition("-")[2]) / 1e9 for x in os.listdir(client.folder))
    assert min(b - a for a, b in zip(at, at[1:])) > 0.1 and at[-1] - at[0] > 0.2 * 11 - 0.1


def test_slots_share_no_instant():
    pace = connectors.Pace(0.01, 3, time.time())
    took = []
    for slot in range(3):
        turns = pace.turns(slot)
        took += [round((next(turns) - pace.start) / 0.01) for _ in range(3)]
    assert len(set(took)) == 9
    assert next(connectors.Pace(0, 2).turns(1)) <= time.time()


# ----------------------------------------------------------------------------- folders


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("batches"))
    rows = [(t, b, f"T{t}_B{b}_{s}", "naïve name" if s else None, f'text "{s}",\nof {t}') for t in (-1, 0, 3, 12) for b in (1, 2, 3) for s in range(3)]
    made = spark.createDataFrame(rows, "topic_id int, batch_id int, sample_id string, topic_name string, topic_text string")
    assert storage.write_batch_files(made, root, ["sample_id", "topic_name", "topic_text"]) == 12
    return root


def test_topics_read_like_all_batches(spark, batches):
    columns = ["topic_id", "batch_id", "sample_id", "topic_name", "topic_text"]
    plain = sorted(map(tuple, files.read_batches(spark, batches).select(columns).collect()), key=str)
    assert sorted(map(tuple, folders.read_topics(spark, batches).select(columns).collect()), key=str) == plain
    some = folders.read_topics(spark, batches, {3, -1}).where("batch_id >= 2 and sample_id like '%_1'")
    assert sorted(map(tuple, some.select(columns).collect()), key=str) == [r for r in plain if r[0] in (3, -1) and r[1] >= 2 and r[2].endswith("_1")]


def test_only_wanted_folders_are_listed(batches):
    reader = folders.BatchReader({"path": batches})
    left = list(reader.pushFilters([folders.In(("topic_id",), (3, 12)), folders.LessThan(("topic_id",), 10), folders.EqualTo(("batch_id",), 2), kept := folders.EqualTo(("sample_id",), "x")]))
    assert left == [kept]
    listed = []
    fs, _ = storage.open_fs(batches)

    class Spy:
        def get_file_info(self, x):
            listed.append(getattr(x, "base_dir", x))
            return fs.get_file_info(x)

    original = folders.open_fs
    folders.open_fs = lambda path: (Spy(), original(path)[1])
    try:
        parts = reader.partitions()
    finally:
        folders.open_fs = original
    assert [p for part in parts for p, _ in part.paths] == [f"{batches}/topic_3/topic_3_batch_002.csv"]
    assert listed == [batches, f"{batches}/topic_3"]


def test_filters_reach_the_folders(spark, batches):
    text = folders.read_topics(spark, batches, {3})._jdf.queryExecution().executedPlan().toString()
    assert "topic_batches" in text and "Filter (topic_id" not in text.replace("#", " #")
    from pyspark.sql import functions as F

    read = folders.read_topics(spark, batches, {3, 12}).select(F.spark_partition_id(), "file_path").distinct().collect()
    assert {r.file_path.split("/")[-2] for r in read} == {"topic_3", "topic_12"}


def test_missing_topics_and_files_are_errors(spark, batches, tmp_path):
    with pytest.raises(PySparkException, match="no such topic_id.*7, 8"):
        folders.read_topics(spark, batches, {3, 8, 7}).collect()
    with pytest.raises(PySparkException, match="no batch files"):
        folders.read_topics(spark, str(tmp_path)).collect()
    lenient = spark.read.format("topic_batches").option("missing", "empty")
    assert lenient.load(batches).where("topic_id in (3, 8)").count() == 9 and lenient.load(str(tmp_path)).count() == 0
    (tmp_path / "topic_1").mkdir()
    (tmp_path / "topic_1/topic_1_batch_001.csv").write_text("sample_id,text\n1,2\n")
    with pytest.raises(PySparkException, match="lacks the columns topic_name, topic_text"):
        folders.read_topics(spark, str(tmp_path)).collect()


def test_article_files(spark, tmp_path):
    for name in ("a.grobid.tei.xml", "b.tei.xml", "c.xml", "d.txt"):
        (tmp_path / name).write_text(f"<TEI n='{name}'>é</TEI>")
    folders.register(spark)
    read = spark.read.format("article_files").load(str(tmp_path))
    assert {r.article_id: r.source for r in read.collect()} == {x[0]: f"<TEI n='{x}'>é</TEI>" for x in ("a.grobid.tei.xml", "b.tei.xml", "c.xml")}
    assert {r.article_id for r in files.read_documents(spark, str(tmp_path)).collect()} == {"a", "b", "c"}
    assert [r.article_id for r in read.where("article_id = 'b'").collect()] == ["b"]
    with pytest.raises(PySparkException, match="no such article_id.*x"):
        read.where("article_id in ('a', 'x')").collect()
    with pytest.raises(PySparkException, match="no .xml files"):
        spark.read.format("article_files").option("suffixes", ".xml").load(f"{tmp_path}/none").collect()


# --------------------------------------------------------------------------- file sets


def tree(root):
    return {str(p.relative_to(root)): p.read_text() for p in root.rglob("*") if p.is_file() and not str(p.relative_to(root)).startswith("_")}


def rows_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "name string, body string").repartition(3)


def test_a_set_is_replaced_or_added_to(spark, tmp_path):
    assert filesets.write_file_set(rows_of(spark, {"a/1.txt": "one", "b.txt": "é\n"}), str(tmp_path)) == 2
    (tmp_path / "own.txt").write_text("of nobody")
    assert filesets.write_file_set(rows_of(spark, {"a/1.txt": "two", "c.txt": ""}), str(tmp_path)) == 2
    assert tree(tmp_path) == {"a/1.txt": "two", "c.txt": "", "own.txt": "of nobody"}
    assert filesets.write_file_set(rows_of(spark, {"c.txt": None, "d.txt": "d"}), str(tmp_path), replace=False) == 2
    assert tree(tmp_path) == {"a/1.txt": "two", "d.txt": "d", "own.txt": "of nobody"} and filesets.manifest(str(tmp_path), "files") == ["a/1.txt", "d.txt"]
    assert filesets.write_file_set(rows_of(spark, {"x.txt": "x"}), str(tmp_path), "others") == 1
    assert "d.txt" in tree(tmp_path) and not (tmp_path / "_staging").exists()


def test_a_failing_task_leaves_the_old_set_whole(spark, tmp_path):
    filesets.write_file_set(rows_of(spark, {f"{i}.txt": f"old {i}" for i in range(20)}), str(tmp_path))
    before = tree(tmp_path)
    fails = rows_of(spark, {f"{i}.txt": f"new {i}" for i in range(40)}).withColumn("body", F.when(F.col("name") == "33.txt", F.raise_error(F.lit("in the middle"))).otherwise(F.col("body")))
    for broken in (fails, rows_of(spark, {"1.txt": "new", "../out.txt": "x"}), rows_of(spark, {"1.txt": "new"}).unionByName(rows_of(spark, {"1.txt": "again"}))):
        with pytest.raises(PySparkException):
            filesets.write_file_set(broken, str(tmp_path))
        assert tree(tmp_path) == before and len(filesets.manifest(str(tmp_path), "files")) == 20
    assert filesets.write_file_set(rows_of(spark, {"1.txt": "new"}), str(tmp_path)) == 1
    assert tree(tmp_path) == {"1.txt": "new"} and not (tmp_path / "_staging").exists()


def test_a_commit_that_was_broken_off_is_ended(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    filesets.write_file_set(rows_of(spark, {"a.txt": "old", "b.txt": "old"}), root)
    writer = filesets.FileSetWriter({"path": root}, True)
    import pyarrow as pa

    message = writer.write(iter([pa.RecordBatch.from_pydict({"name": ["a.txt", "c/d.txt"], "body": ["new", "new"]})]))
    monkeypatch.setattr(filesets, "recover", lambda _: None)  # the driver dies when the journal is there
    writer.commit([message, None])
    monkeypatch.undo()
    fs, base = storage.open_fs(root)
    staged = [s for _, s in filesets.listed(fs, message.listing)]
    fs.move(staged[0], f"{base}/a.txt")  # or after the first rename
    assert filesets.recover(root) and not filesets.recover(root)
    assert tree(tmp_path) == {"a.txt": "new", "c/d.txt": "new"} and filesets.manifest(root, "files") == ["a.txt", "c/d.txt"]


def test_batches_of_an_earlier_run_go(spark, tmp_path):
    made = spark.createDataFrame([(1, b, f"s{b}", "n", "t") for b in range(1, 6)], "topic_id int, batch_id int, sample_id string, topic_name string, topic_text string")
    columns = ["sample_id", "topic_name", "topic_text"]
    assert storage.write_batch_files(made, str(tmp_path), columns) == 5
    assert storage.write_batch_files(made.where("batch_id < 3"), str(tmp_path), columns) == 2
    assert {r.batch_id for r in files.read_batches(spark, str(tmp_path)).collect()} == {1, 2}


# ------------------------------------------------------------------------- command line


def made_client(system, name, schema):
    """A client that counts its calls in the folder that its instructions name."""

    def answer(prompt):
        os.makedirs(system, exist_ok=True)
        with open(f"{system}/{time.time_ns()}", "w"):
            pass
        ids = [line.split(": ")[1] for line in prompt.splitlines() if line.startswith("sample_id: ")]
        if name == "topic_context":
            topic = next(line.split(": ")[1] for line in prompt.splitlines() if line.startswith("Topic id: "))
            return json.dumps({"topic_id": int(topic), "llm_topic_name": f"name {topic}", "topic_summary": "s", "green_category": "cat_a", "global_green_relevance": "high"})
        return json.dumps({"rows": [{"sample_id": i, "if_then_rule": f"IF {i}", "green_relevance": "low", "keep_for_rag": True} for i in (ids[:1] if "T12_B2_0" in ids else ids)]})

    return answer


def test_labelling_from_the_command_line(spark, batches, tmp_path, capsys):
    from gristmill import cli

    for name in ("topic", "batch"):
        (tmp_path / f"{name}.txt").write_text(f"{tmp_path}/calls-{name}\n")
    out = str(tmp_path / "out")
    args = ["label", "--source", batches, "--out", out, "--context-prompt", f"{tmp_path}/topic.txt", "--batch-prompt", f"{tmp_path}/batch.txt", "--client", f"{__name__}:made_client", "--pause", "0"]
    calls = lambda: [len(list(tmp_path.glob(f"calls-{n}/*"))) for n in ("topic", "batch")]
    assert cli.JOBS["label"](spark, cli.parser().parse_args([*args, "--topics", "3", "outlier"])) == 0 and calls() == [2, 6]
    assert cli.JOBS["label"](spark, cli.parser().parse_args([*args, "--topics", "3", "outlier"])) == 0 and calls() == [2, 6]
    capsys.readouterr()
    assert cli.JOBS["label"](spark, cli.parser().parse_args([*args, "--topics", "3,12"])) == 1 and calls() == [3, 9]
    said = capsys.readouterr().out
    assert "files done: 5/6" in said and "- 12/2: missing: T12_B2_1" in said and "labelled batches: 8" in said
    rows = files.final_rules(files.label_rows(files.read_label_documents(spark, f"{out}/topic_*/topic_*_batch_*.json")))
    assert rows.count() == 0 and files.read_labelled(spark, out).count() == 8
    with pytest.raises(PySparkException, match="no such topic_id.*99"):
        cli.JOBS["label"](spark, cli.parser().parse_args([*args, "--topics", "99"]))
