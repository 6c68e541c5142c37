"""Connectors to what lies outside: chat models, extraction services, page readers, encoders."""

from __future__ import annotations

import functools
import inspect
import json
import math
import os
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.text import pages_text

# ---- fixed values: where a key and a model are looked for --------------------------------

KEY_VARIABLES = ("OPEN-ROUTER-KEY", "OPEN_ROUTER_KEY", "OPENROUTER_API_KEY")
BASE_URL = "https://openrouter.ai/api/v1"
MODEL = "openai/gpt-4o-mini"
MAX_RETRIES = 3
SLEEP_BETWEEN_REQUESTS_SECONDS = 1.0
RELEVANCE = ("high", "medium", "low", "none")
CATEGORIES = (
    "hvac_optimization", "lighting_efficiency", "water_saving", "standby_reduction", "appliance_energy_management",
    "energy_monitoring", "occupancy_based_control", "environmental_awareness", "scheduling_optimization",
)

#: Calls that may be under way at once.
SLOTS = 8


def strict_object(properties: dict[str, Any]) -> dict[str, Any]:
    """The JSON schema of an object that has all these fields and no others."""
    return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}


TEXT, LEVEL = {"type": "string"}, {"type": "string", "enum": list(RELEVANCE)}
CONTEXT_SCHEMA = strict_object({"topic_id": {"type": "integer"}, "llm_topic_name": TEXT, "topic_summary": TEXT, "green_category": TEXT, "global_green_relevance": LEVEL})
BATCH_SCHEMA = strict_object({"rows": {"type": "array", "items": strict_object({"sample_id": TEXT, "if_then_rule": TEXT, "green_relevance": LEVEL, "keep_for_rag": {"type": "boolean"}})}})
FLAG = {"type": "integer", "enum": [0, 1]}
METADATA_SCHEMA = strict_object({"article_id": TEXT, "source_title": TEXT, "year": TEXT, "article_summary": TEXT, "normalized_green_categories_one_hot": strict_object(dict.fromkeys(CATEGORIES, FLAG))})

_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "integer": int, "number": (int, float)}


def violations(value: Any, schema: Mapping[str, Any], at: str = "$") -> list[str]:
    """What a parsed JSON value does that its schema forbids: types, enums, missing and extra fields."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    shown = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    allowed = "enum" not in schema or shown in [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in schema["enum"]]  # 1 is not true
    out = [] if allowed else [f"{at}: {shown} is not allowed"]
    if kind == "array":
        for i, item in enumerate(value):
            out += violations(item, schema.get("items", {}), f"{at}[{i}]")
    if kind == "object":
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in value if k not in known]
        for k, own in known.items():
            if k in value:
                out += violations(value[k], own, f"{at}.{k}")
    return out


def checked(answer: str | None, schema: Mapping[str, Any]) -> tuple[str | None, str | None]:
    """An answer as plain JSON, or why it is none: empty, no JSON, against the schema."""
    if not answer:
        return None, "empty answer"
    try:
        value = json.loads(answer)
    except ValueError as problem:
        return None, f"not JSON: {problem}"
    found = violations(value, schema)
    return (None, "; ".join(found[:10])) if found else (json.dumps(value, ensure_ascii=False), None)


def load_prompt(path: str) -> str:
    """The text of a prompt file without white space at its ends; a missing file is an error."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"no prompt file: {path}")
    with open(path, encoding="utf-8") as f:
        return f.read().strip()


def load_key(env: Mapping[str, str] | None = None, dotenv: str = ".env") -> str:
    """The service key: from the environment, else from a file of NAME=value lines."""
    found = dict(os.environ if env is None else env)
    if os.path.exists(dotenv):
        with open(dotenv, encoding="utf-8") as f:
            pairs = [line.strip().partition("=") for line in f if "=" in line and not line.lstrip().startswith("#")]
        found = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs} | found
    for name in KEY_VARIABLES:
        if found.get(name):
            return found[name]
    raise ValueError(f"no service key: set one of {', '.join(KEY_VARIABLES)}")


@dataclass(frozen=True)
class ChatClient:
    """A client of a chat-completions service; picklable, so executors can call it.

    Temperature 0, one system and one user message, an answer under a strict JSON schema.
    """

    key: str
    system: str
    schema_name: str
    schema: Mapping[str, Any] = field(hash=False)
    model: str = MODEL
    base_url: str = BASE_URL
    timeout: float = 120.0

    def request(self, prompt: str) -> dict[str, Any]:
        return {
            "model": self.model,
            "messages": [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}],
            "temperature": 0,
            "response_format": {"type": "json_schema", "json_schema": {"name": self.schema_name, "strict": True, "schema": dict(self.schema)}},
            "provider": {"require_parameters": True},
        }

    def __call__(self, prompt: str) -> str:
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        call = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(self.request(prompt)).encode(), head)
        with urllib.request.urlopen(call, timeout=self.timeout) as response:
            return json.loads(response.read())["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class Pace:
    """When a service may be called: every `pause` seconds at most, however many tasks there are.

    The prompts are dealt to `slots` partitions. Slot k of n calls at the instants start + (k + n * m) *
    pause only, for whole m, so no two slots share one, and a slot that runs late misses its turns. Without a pause
    nothing is dealt or delayed. Clocks should agree to less than a pause, and tasks should not
    be run twice at a time (spark.speculation off, its default).
    """

    pause: float
    slots: int = SLOTS
    start: float = field(default_factory=time.time)

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(self.slots, key) if self.pause > 0 else rows

    def turns(self, partition: int) -> Iterator[float]:
        """The instants of a slot from now on; each is waited for."""
        last = -1
        while True:
            if self.pause > 0:
                slot = partition % self.slots
                behind = (time.time() - self.start) / self.pause - slot
                last = max(last + 1, math.ceil(behind / self.slots), 0)
                time.sleep(max(0.0, self.start + (slot + last * self.slots) * self.pause - time.time()))
            yield time.time()


def answered(client: Callable[[str], str], text: str | None, schema: Mapping[str, Any], attempts: int, backoff: float, turns: Iterator[float]) -> tuple[str | None, str | None]:
    """A client's answer to a prompt as plain JSON, or the last reason why there is none.

    A call that raises or gives no valid answer is tried again up to `attempts` times, after backoff,
    backoff**2, … seconds. Each call waits for its turn.
    """
    answer, error = None, "no prompt"
    for n in range(1, attempts + 1 if text is not None else 1):
        next(turns)
        try:
            answer, error = checked(client(text), schema)
        except Exception as problem:  # noqa: BLE001  whatever a client raises is data here
            answer, error = None, f"{type(problem).__name__}: {problem}"
        if error is None:
            break
        if n < attempts and backoff:
            time.sleep(backoff**n)
    return answer, error


def ask(inputs: DataFrame, key: str, prompt: str, client: Callable[[str], str], schema: Mapping[str, Any], attempts: int = MAX_RETRIES, backoff: float = 2.0, pause: float = SLEEP_BETWEEN_REQUESTS_SECONDS, slots: int = SLOTS) -> DataFrame:
    """key, response, error: a client's answer to each prompt, checked against a strict schema.

    The service is called every `pause` seconds at most (see `Pace`). A prompt that keeps failing is a row
    with its error, not a failed job. The client is any callable that executors can unpickle. Nothing
    is kept: whoever reads the outcome twice asks twice; `ledger.ask_once` asks once.
    """
    pace = Pace(pause, slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = pace.turns(TaskContext.get().partitionId())
        for batch in batches:
            out = [answered(client, text, schema, attempts, backoff, turns) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], pa.string()) for i in (0, 1))], names=[key, "response", "error"])

    kind = inputs.schema[key].dataType.simpleString()
    return pace.dealt(inputs.select(key, prompt), key).mapInArrow(run, f"{key} {kind}, response string, error string")


def article_metadata(articles: DataFrame, id_col: str, text_col: str, client: Callable[[str], str], **options) -> DataFrame:
    """id, metadata, error: document-level metadata of each article with one flag per category."""
    prompts = articles.select(id_col, F.concat(F.lit("article_id: "), F.col(id_col).cast("string"), F.lit("\n\n"), F.col(text_col)).alias("_prompt"))
    kind = "struct<article_id: string, source_title: string, year: string, article_summary: string, normalized_green_categories_one_hot: map<string, int>>"
    asked = ask(prompts, id_col, "_prompt", client, METADATA_SCHEMA, **options)
    return asked.select(id_col, F.from_json("response", kind).alias("metadata"), "error")


# ------------------------------------------------------------------ extraction services


# ---- fixed values: an option's names in different versions of the service's client, and its value

SERVICE = "processFulltextDocument"
CALL_OPTIONS = {
    ("output", "output_path"): None,
    ("generateIDs", "generate_ids"): True,
    ("tei_coordinates", "teiCoordinates"): True,
    ("segment_sentences", "segmentSentences"): True,
    ("consolidate_header", "consolidateHeader"): False,
    ("consolidate_citations", "consolidateCitations"): False,
    ("include_raw_citations", "includeRawCitations"): False,
    ("include_raw_affiliations", "includeRawAffiliations"): False,
    ("markdown_output",): False,
    ("json_output",): False,
}


class Options:
    """What to pass to a callable of unknown version: a table of names and values, held against its signature."""

    def __init__(self, target: Callable[..., Any]):
        self.target, self.names, self.chosen = target, frozenset(inspect.signature(target).parameters), {}

    def always(self, **values: Any) -> Options:
        self.chosen.update(values)
        return self

    def offer(self, table: Mapping[tuple[str, ...], Any], needed: bool = False) -> Options:
        """Each value under the first of its names that the callable has; one it needs must be among them."""
        for aliases, value in table.items():
            usable = [a for a in aliases if a in self.names]
            if usable:
                self.chosen[usable[0]] = value
            elif needed:
                raise RuntimeError(f"{getattr(self.target, '__name__', self.target)} takes none of {', '.join(aliases)}")
        return self


def service_call(process: Callable[..., Any], input_dir: str, output_dir: str, workers: int = 1) -> Callable[[], Any]:
    """An extraction client's `process` over a folder, ready to run, under the options that its version knows."""
    if workers < 1:
        raise ValueError("at least one worker")
    (output, _), *optional = CALL_OPTIONS.items()
    options = Options(process).always(service=SERVICE, input_path=input_dir, n=workers, force=True)
    return functools.partial(process, **options.offer({output: output_dir}, needed=True).offer(dict(optional)).chosen)


def service_client(factory: Callable[..., Any], server: str, **settings: Any) -> Any:
    """An extraction client for a server; settings that its version doesn't know are left out."""
    return factory(**Options(factory).always(grobid_server=server).offer({(k,): v for k, v in settings.items()}).chosen)


def extract(files: DataFrame, id_col: str, content_col: str, service: Callable[[bytes], str]) -> DataFrame:
    """id, source, error: what a service makes of each file's bytes; a failing file is a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append((service(content), None))
                except Exception as problem:  # noqa: BLE001  whatever a service raises is data here
                    out.append((None, f"{type(problem).__name__}: {problem}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], pa.string()) for i in (0, 1))], names=[id_col, "source", "error"])

    kind = files.schema[id_col].dataType.simpleString()
    return files.select(id_col, content_col).mapInArrow(run, f"{id_col} {kind}, source string, error string")


def read_pages(spark: SparkSession, path: str, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """article_id, text, error: page texts that a reader finds in files, marked by page, then cleaned.

    `reader` turns a file's bytes into its pages' texts; any PDF library will do.
    """
    files = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*\z", "").alias("article_id"), "content")
    made = extract(files, "article_id", "content", lambda content: json.dumps(reader(content)))
    return made.select("article_id", pages_text(F.from_json("source", "array<string>")).alias("text"), "error")


def embed(docs: DataFrame, id_col: str, text_col: str, encoder: Callable[[list[str]], Any]) -> DataFrame:
    """id, embedding: an encoder's vector for each text, a batch at a time; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [[float(x) for x in v] for v in encoder(["" if t is None else t for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[id_col, "embedding"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")
