"""Personal data: pattern spans, and terms whose co-occurrence with protected values discloses them."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import column, drop_path, shuffle_partitions, slices, texts, write_table
from gristmill.llm.counting import PACKED, KeyCounts, packed_rows

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
SHIFT = 54  # 1024 buckets of terms
Span = tuple[int, int, str]


# ----------------------------------------------------------------------- base spans


def emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern, found from each @ so that long runs cost once."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            pos = m.end()
        at = text.find("@", max(at + 1, pos))
    return out


def ips(text: str) -> list[Span]:
    out = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) // 4 * 4, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                out.append((at, end, "ip"))
            at = end + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    return out


def phones(text: str) -> list[Span]:
    return [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by start, then kind."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        out += ips(text) + cards(text) + (phones(text) if "+" in text else [])
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def value(text: str, span: Span) -> int:
    """The protected value's hash: an address in lower case, numbers by their digits."""
    raw = text[span[0] : span[1]]
    plain = raw.lower() if span[2] == "email" else raw if span[2] == "ip" else re.sub(r"[^0-9]", "", raw)
    return signed(f"{span[2]}:{plain}")


def signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


# -------------------------------------------------------------------- co-occurrence


def neighbours(text: str, span: Span, reach: int, step: int = 256) -> list[str]:
    """The `reach` terms on each side of a span, however far away, in lower case.

    To the left the text is read in stretches that double until there are enough terms.
    """
    right = [m[0].lower() for m in islice(TERM.finditer(text, span[1]), reach)]
    width, left = step, []
    while True:
        at = max(0, span[0] - width)
        found = [m for m in TERM.finditer(text, at, span[0]) if m.start() > at or at == 0]  # one at the edge may be cut
        left = [m[0].lower() for m in found[-reach:]]
        if len(left) == reach or at == 0:
            return left + right
        width *= 2


def _contexts(text_col: str, reach: int):
    def run(batches):
        for batch in slices(batches, (text_col,)):
            rows = set()
            for text in texts(column(batch, text_col)):
                for span in base_spans(text):
                    near = neighbours(text, span, reach)
                    entity, context = value(text, span), signed(" ".join(near))
                    rows.update((entity, signed(t), context) for t in near)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*sorted(rows), strict=True)], names=["entity", "term", "context"])

    return run


def _document_counts(text_col: str, table):
    """How many texts have each term that the bit table lets pass, packed; group 0."""

    def run(batches):
        bits, held = table.value, KeyCounts()
        for batch in slices(batches, (text_col,)):
            keys = [np.fromiter((signed(t) for t in {m.lower() for m in TERM.findall(text)}), np.int64) for text in texts(column(batch, text_col))]
            every = np.concatenate(keys).view(np.uint64)
            at = every & np.uint64(len(bits) * 64 - 1)
            held.add(0, every[bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1) == 1])
        yield from held.packed(SHIFT)

    return run


def _sum(batches):
    """The counts of each bucket's terms added up."""
    parts: dict[int, KeyCounts] = {}
    for batch in batches:
        for bucket, grp, keys, counts in packed_rows(batch):
            parts.setdefault(bucket, KeyCounts()).add_counts(grp, keys, counts)
    for held in parts.values():
        keys, counts = held.merged(0)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["term", "n_term"])


def bit_table(terms: DataFrame, words: int) -> np.ndarray:
    """64 * words bits, those set that the low bits of some `term` name."""
    low = F.col("term").bitwiseAND(words * 64 - 1)
    found = terms.groupBy(F.shiftright(low, 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(term & 63 as int))")).alias("bits")).collect()  # `words` rows at most
    table = np.zeros(words, np.uint64)
    for r in found:
        table[r["w"]] = np.uint64(r["bits"] & (1 << 64) - 1)
    return table


def disclosing_terms(docs: DataFrame, text_col: str = "text", reach: int = 8, min_support: int = 1, threshold: float = 0.9, bit_words: int = 1 << 16) -> DataFrame:
    """Pairs of a protected value and a term near it that discloses it: entity, term, disclosure.

    Around each protected value the `reach` terms on each side are its context. Equal contexts
    count once, so copies of a document are no evidence. With c contexts of the value that have
    the term, n(t) texts with the term, n(e) contexts of the value and N texts, the disclosure is
    PMI / IC = log2(c N / (n(t) n(e))) / log2(N / n(e)): 1 where the term gives the value away, 0
    where it says nothing. Pairs with c >= `min_support` and disclosure >= `threshold` are kept: a
    name that stands beside one value and next to nowhere else is one, a common word is none.

    Terms are counted over all texts; a table of 64 * bit_words bits, whatever the corpus, spares
    most of those that stand near no value.
    """
    spark = docs.sparkSession
    seen = docs.select(text_col).mapInArrow(_contexts(text_col, reach), "entity long, term long, context long").distinct()
    seen, seen_path = write_table(seen, "pii-contexts")
    pairs, pairs_path = write_table(seen.groupBy("entity", "term").agg(F.count("*").alias("c")).where(F.col("c") >= min_support), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"))
    total = docs.count()
    entities = seen.select("entity", "context").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    table = spark.sparkContext.broadcast(bit_table(pairs.select("term"), bit_words))
    partial = docs.select(text_col).mapInArrow(_document_counts(text_col, table), PACKED)
    terms = partial.repartition(shuffle_partitions(spark), "bucket").mapInArrow(_sum, "term long, n_term long")
    scored = pairs.join(terms, "term").join(entities, "entity")
    pmi = F.log2(F.col("c") * F.lit(float(total)) / (F.greatest("n_term", "c") * F.col("n_entity")))
    ic = F.log2(F.lit(float(total)) / F.col("n_entity"))
    found = scored.select("entity", "term", F.when(ic > 0, pmi / ic).otherwise(0.0).alias("disclosure")).where(F.col("disclosure") >= threshold)
    found, _ = write_table(found, "pii-disclosing")
    drop_path(spark, seen_path, pairs_path)
    return found


# -------------------------------------------------------------------------- operator


def term_spans(text: str, base: list[Span], terms: dict[int, float]) -> list[tuple[Span, float]]:
    """Occurrences of the terms outside the base spans, with their disclosure."""
    out, at = [], 0
    ends = sorted((a, b) for a, b, _ in base)
    for m in TERM.finditer(text):
        while at < len(ends) and ends[at][1] <= m.start():
            at += 1
        if any(a < m.end() and m.start() < b for a, b in ends[at : at + 4]):
            continue
        d = terms.get(signed(m[0].lower()))
        if d is not None:
            out.append(((m.start(), m.end(), "term"), d))
    return out


def general(term: str) -> str:
    """The class that stands for a term: a name, an abbreviation or a word, by its letters' case."""
    return "<NAME>" if term.istitle() else "<ABBREVIATION>" if term.isupper() else "<WORD>"


def sanitise(text: str, base: list[Span], terms: list[tuple[Span, float]], remove_at: float) -> str:
    """Base spans give way to their kind, strongly disclosing terms to nothing, others to their class.

    Overlapping spans are one, named by the first.
    """
    spans = sorted([(a, b, f"<{k.upper()}>") for a, b, k in base] + [(a, b, "" if d >= remove_at else general(text[a:b])) for (a, b, _), d in terms])
    out, pos = [], 0
    for a, b, by in spans:
        if a >= pos:
            out += [text[pos:a], by]
        pos = max(pos, b)
    return "".join(out) + text[pos:]


def free_name(name: str, taken: list[str]) -> str:
    """The name, after as many underscores as no column is named so."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


FIELDS = [("n_email", T.LongType()), ("n_ip", T.LongType()), ("n_card", T.LongType()), ("n_phone", T.LongType()), ("n_term", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType()), ("sanitised", T.StringType())]


def find_pii(
    docs: DataFrame,
    text_col: str = "text",
    reach: int = 8,
    min_support: int = 1,
    threshold: float = 0.9,
    remove_at: float = 0.98,
    broadcast_pairs: int = 200_000,
) -> DataFrame:
    """Add counts, spans and the sanitised text to every row.

    `spans` lists all spans by start, then kind; `base_sha256` is the digest of the base spans
    alone. A disclosing term is a span wherever it occurs in a text that holds the value it
    discloses. The pairs found are broadcast up to `broadcast_pairs`; beyond that they are joined
    to the rows by the hash of their texts.

    A null text counts as empty: no spans, sanitised to an empty text. Repeated rows are handled
    each, null ids do not matter, an empty table gives no rows. Input columns named like an output
    are replaced; all others pass through.
    """
    spark = docs.sparkSession
    taken = {n for n, _ in FIELDS}
    rows = docs.drop(*(c for c in docs.columns if c.lower() in taken))
    pairs = disclosing_terms(rows, text_col, reach, min_support, threshold)
    fits = pairs.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    schema = T.StructType(rows.schema.fields + [T.StructField(n, t) for n, t in FIELDS])
    names, passed = schema.names, rows.columns
    known: dict[int, dict[int, float]] = {}
    key, key2, listed = (free_name(n, passed) for n in ("_key", "_key2", "_terms"))
    if fits:
        for r in pairs.collect():  # broadcast_pairs at most
            known.setdefault(r["entity"], {})[r["term"]] = r["disclosure"]
    else:
        keyed = rows.withColumns({key: F.xxhash64(text_col), key2: F.crc32(F.coalesce(text_col, F.lit("")).cast("binary"))})
        found = keyed.select(F.col(key).alias("k"), F.col(key2).alias("k2"), F.col(text_col).alias("t")).mapInArrow(_entities, "k long, k2 long, entity long").distinct()
        most = found.join(pairs, "entity").groupBy("k", "k2", "term").agg(F.max("disclosure").alias("disclosure"))
        own = most.groupBy("k", "k2").agg(F.collect_list(F.struct("term", "disclosure")).alias(listed))
        rows = keyed.join(own.withColumnsRenamed({"k": key, "k2": key2}), [key, key2], "left").select(*passed, listed)
    shared = spark.sparkContext.broadcast(known)

    def run(batches):
        lookup = shared.value
        for batch in slices(batches, (text_col,)):
            extra = column(batch, listed).to_pylist() if not fits else [None] * batch.num_rows
            out = []
            for text, more in zip(texts(column(batch, text_col)), extra, strict=True):
                base = base_spans(text)
                terms = {t["term"]: t["disclosure"] for t in more or []}
                if lookup and base:
                    for s in base:
                        for t, d in lookup.get(value(text, s), {}).items():
                            terms[t] = max(d, terms.get(t, -math.inf))
                extra_spans = term_spans(text, base, terms) if terms else []
                every = sorted(base + [s for s, _ in extra_spans], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                kinds = [s[2] for s in base]
                out.append((*(kinds.count(k) for k in KINDS[:4]), len(extra_spans), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sanitise(text, base, extra_spans, remove_at)))
            new = [pa.array(list(c), pa.int64() if i < 5 else pa.string()) for i, c in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays([*(column(batch, c) for c in passed), *new], names=names)

    return rows.mapInArrow(run, schema)


def _entities(batches):
    for batch in slices(batches, ("t",)):
        keys = zip(column(batch, "k").to_pylist(), column(batch, "k2").to_pylist(), texts(column(batch, "t")), strict=True)
        rows = [(a, b, value(text, s)) for a, b, text in keys for s in base_spans(text)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["k", "k2", "entity"])
