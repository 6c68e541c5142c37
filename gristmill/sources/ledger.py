"""A durable record of paid answers: each is kept as it comes, and asked for once."""

from __future__ import annotations

import contextlib
import json
import os
import time
import uuid
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.sources import connectors
from gristmill.sources.storage import open_fs, scratch, written

ANSWER = "answer_key string, response string, answered_at double"
OUTCOME = "answer_key string, error string"


def put_first(fs: pafs.FileSystem, path: str, body: str) -> bool:
    """Write a file whole unless there is one; whether this call did.

    A local file system links a finished file to its name, which fails if the name is taken. Elsewhere the
    name is looked up before the rename; of two writers in that moment one remains, whole.
    """
    if fs.get_file_info(path).type == pafs.FileType.File:
        return False
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    temp = f"{folder}/.{name}.{uuid.uuid4().hex}"  # readers skip names that begin with a dot
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(body.encode())
    if fs.type_name != "local":
        fs.move(temp, path)
        return True
    try:
        os.link(temp, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(temp)
    return True


def read_text(fs: pafs.FileSystem, path: str) -> str:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read().decode()


@dataclass(frozen=True)
class Ledger:
    """Answers by key under `root`, in a folder that all executors see.

    A task writes each answer to a file of its own the moment it has come (`attempts`). `commit` moves new
    attempts into a Parquet segment and publishes it under the next number of `log`, which only one
    run can get; another run then leaves out what is there and tries the number after. So a
    key has one answer for ever, the first that was published, whoever else was asked meanwhile, and what a
    killed run had been told is published by the next.
    """

    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _entries(self) -> list[dict]:
        """The published segments, one small entry for each commit."""
        fs, base = open_fs(self._path("log"))
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        names = sorted(f.path for f in found if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith("."))
        return [json.loads(read_text(fs, n)) for n in names]

    def answers(self) -> DataFrame:
        """answer_key, response, answered_at: every published answer, one for each key."""
        paths = [self._path(f"segments/{e['segment']}") for e in self._entries()]
        reader = self.spark.read.schema(ANSWER)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], ANSWER)

    def _attempts(self) -> DataFrame:
        fs, base = open_fs(self._path("attempts"))
        if fs.get_file_info(base).type != pafs.FileType.Directory:
            return self.spark.createDataFrame([], ANSWER)
        # a file that goes meanwhile is an answer that another run has published
        return self.spark.read.schema(ANSWER).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).json(self._path("attempts"))

    def commit(self, tries: int = 50) -> int:
        """Publish the attempts that have no answer yet; how many there were."""
        for _ in range(tries):
            entries = self._entries()
            fresh = self._attempts().join(self.answers(), "answer_key", "left_anti").dropDuplicates(["answer_key"])
            segment = uuid.uuid4().hex
            fresh.write.parquet(self._path(f"segments/{segment}"))
            n = self.spark.read.schema(ANSWER).parquet(self._path(f"segments/{segment}")).count()
            fs, base = open_fs(self.root)
            if not n or put_first(fs, f"{base}/log/{len(entries):012d}.json", json.dumps({"segment": segment, "rows": n})):
                if not n:
                    fs.delete_dir(f"{base}/segments/{segment}")
                self._forget_attempts()
                return n
            fs.delete_dir(f"{base}/segments/{segment}")  # another run was first: look again at what is there
        raise OSError(f"no commit to {self.root} in {tries} tries")

    def _forget_attempts(self) -> None:
        """Delete the attempts whose key is published, by the executors."""
        root = self._path("attempts")

        def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = open_fs(root)
            for batch in batches:
                for key in batch.column(0).to_pylist():
                    with contextlib.suppress(FileNotFoundError, OSError):  # another run may have
                        fs.delete_file(f"{base}/{attempt_name(key)}")
                yield batch

        done = self._attempts().select("answer_key").join(self.answers(), "answer_key", "left_semi")
        done.mapInArrow(drop, "answer_key string").count()


def attempt_name(key: str) -> str:
    return f"{key[:2]}/{key}.json"


def answer_key(prompt: Column, schema: Mapping[str, Any], client: Callable[[str], str]) -> Column:
    """The name of an answer: what was asked, under which schema, of which model with which instructions."""
    head = json.dumps([getattr(client, "model", ""), getattr(client, "system", ""), schema], sort_keys=True)
    return F.sha2(F.concat(F.lit(head + "\n"), prompt), 256)


def ask_once(inputs: DataFrame, key: str, prompt: str, client: Callable[[str], str], schema: Mapping[str, Any], ledger: Ledger | None = None, attempts: int = connectors.MAX_RETRIES, backoff: float = 2.0, pause: float = connectors.SLEEP_BETWEEN_REQUESTS_SECONDS, slots: int = connectors.SLOTS) -> DataFrame:
    """key, response, error, reused: each prompt's answer from the ledger; what it lacks is asked for now, once.

    First, what an earlier run was told but did not publish is published. Then the distinct prompts
    without an answer are asked, at the pace of `connectors.Pace`; each answer is in the ledger's
    folder before the next prompt is sent, so a task, a job or a driver that dies loses at most the calls in
    flight. A task that is run again looks there first. Equal prompts share an answer. A prompt
    that fails has its error and is asked again by the next run; a null prompt is an error. Without a ledger one
    is kept in the shared folder for this call alone.
    """
    spark = inputs.sparkSession
    ledger = ledger or Ledger(spark, scratch(spark, "answers"))
    ledger.commit()
    keyed = written(inputs.select(key, F.col(prompt).alias("_prompt"), answer_key(F.col(prompt), schema, client).alias("answer_key")), "prompts")
    old = ledger.answers()
    todo = keyed.where("answer_key is not null").dropDuplicates(["answer_key"]).join(old, "answer_key", "left_anti").select("answer_key", "_prompt")
    pace, root = connectors.Pace(pause, slots), f"{ledger.root.rstrip('/')}/attempts"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        turns = pace.turns(TaskContext.get().partitionId())
        for batch in batches:
            errors = []
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, error = f"{base}/{attempt_name(name)}", None
                if fs.get_file_info(path).type != pafs.FileType.File:
                    answer, error = connectors.answered(client, text, schema, attempts, backoff, turns)
                    if error is None:
                        put_first(fs, path, json.dumps({"answer_key": name, "response": answer, "answered_at": time.time()}))
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["answer_key", "error"])

    outcome = written(pace.dealt(todo, "answer_key").mapInArrow(run, OUTCOME), "asked").withColumn("_now", F.lit(True))
    ledger.commit()
    found = keyed.join(ledger.answers().select("answer_key", "response"), "answer_key", "left").join(outcome, "answer_key", "left")
    error = F.when(F.col("response").isNull(), F.coalesce("error", F.lit("no prompt")))
    return found.select(key, "response", error.alias("error"), (F.col("response").isNotNull() & F.col("_now").isNull()).alias("reused"))
