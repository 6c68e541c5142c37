"""Text functions as Column expressions, with Python only where the JVM has no counterpart."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: the rules' patterns and word lists, equal to what they are to match -------

WS_SET = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_SET}]"
INK = f"[^{WS_SET}]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"[\p{L}\p{N}_]+"
YEAR = r"\A(?:19|20)[0-9]{2}\z"
DEFINITION = rf"(?:\A|[.;]{WS}+)[A-Z][A-Za-z0-9 ()/\-]{{1,70}}:"
CAPTION = rf"(?i)\A(?:figure|fig\.?|table|scheme|chart|plate){WS}+(?:[0-9]+|[ivxlcdm]+)[{WS_SET}.:)-]"
CREDITS = ("photo credit", "image credit", "figure credit", "data from")
FOOTER = rf"(?i)\A.{{0,100}}\b(?:vol\.?|volume){WS}*[0-9]+.*\b(?:no\.?|issue){WS}*[0-9]+.*\b[0-9]{{1,4}}\z"
NOISE_MARKERS = ("all rights reserved", "journal homepage", "available online", "contents lists available")
DOI = rf"\A(?:https?://)?doi\.org/{INK}+\z"
SIDEBAR = r"\b(?:Glossary|Highlights|Key Points|Key Messages|Outstanding Questions|Research Questions|Trends)\b"
SENTENCE_END = rf"[.!?](?:{WS}|\z)"
ABSTRACT_MARKERS = ("in this paper", "in this study", "we present", "we review", "we investigate", "we examine", "our study", "our analysis")
BOILERPLATE = (
    rf"(?i)Contents lists available at.*?journal homepage:{WS}*(?:https?://)?{INK}+",
    rf"(?i)©{WS}*[0-9]{{4}}.*?all rights reserved\.?",
)
ZERO_WIDTH = r"[\x{ad}\x{200b}\x{200c}\x{200d}\x{feff}]"
CHANNEL_FORMS = (
    (r"tado.{0,8}Heating", "tado Heating"),
    (r"tado.{0,8}Air Conditioning", "tado Air Conditioning"),
    (r"Lutron Cas.{0,8}ta Wireless", "Lutron Caseta Wireless"),
    (r"Hive Active Light.{0,10}\z", "Hive Active Light"),
    (r"GE Appliances GeoSpring.{0,10}\z", "GE Appliances GeoSpring"),
    (r"Donation Manager RedCloud.{0,10}\z", "Donation Manager RedCloud"),
)
HIVE_HEATING = r"Hive Active Heating.{0,15}?(\[beta\])?\z"
EXCLUDED_TITLES = (
    "references", "bibliography", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
    "author contributions", "authors contributions", "funding", "funding information", "conflict of interest",
    "conflicts of interest", "competing interests", "declaration of interests", "data availability",
    "data availability statement", "ethical approval", "ethics statement", "informed consent",
    "supplementary material", "supplemental material",
)
SUPPLEMENTARY_TITLES = (
    "glossary", "highlights", "key points", "key messages", "research highlights", "outstanding questions",
    "research questions", "trends", "sidebar", "case study",
)
EXCLUDED_ATTRS = (
    "references", "bibliography", "acknowledgment", "acknowledgement", "funding", "conflict", "competing-interests",
    "data-availability", "ethics", "supplementary-material",
)
SUPPLEMENTARY_ATTRS = (
    "box", "boxed-text", "sidebar", "panel", "glossary", "highlights", "key-points", "questions", "trends", "case-study",
)
#: Reason codes of blocks, in the order of the rules.
TEXT_REASONS = (
    "discarded_parent", "boilerplate_or_noise", "figure_or_table_caption", "chart_text", "supplementary_parent",
    "definition_block", "question_block", "main_content",
)
#: Reason codes of containers, in the order of the rules.
CONTAINER_REASONS = (
    "excluded_section", "excluded_container_type", "boxed_content", "supplementary_section",
    "supplementary_container_type", "inherited",
)

# ----------------------------------------------------------------------- normalising


def strip(c: Column) -> Column:
    """Without white space, in the Unicode sense, at both ends."""
    return F.btrim(c, F.lit(WS_CHARS))


def single_spaced(c: Column) -> Column:
    """Every run of white space is one blank; single blanks are not touched."""
    return F.regexp_replace(c, rf"\x20{WS}+|[{WS_SET}&&[^\x20]]{WS}*", " ")


def clean(c: Column) -> Column:
    """A null becomes empty, ends are stripped."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def normalize_name(c: Column) -> Column:
    """Known spellings of a channel name become one; other characters than ASCII go; null stays."""
    out = strip(c)
    for pattern, form in CHANNEL_FORMS:
        out = F.regexp_replace(out, f"(?d){pattern}", form)
    hive = f"(?d){HIVE_HEATING}"
    beta = F.contains(F.regexp_extract(out, hive, 0), F.lit("[beta]"))
    out = F.when(beta, F.regexp_replace(out, hive, "Hive Active Heating [beta]")).otherwise(F.regexp_replace(out, hive, "Hive Active Heating"))
    return strip(F.regexp_replace(out, r"[^\x00-\x7F]+", ""))


def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t))


def _nfkc_casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def _beyond_ascii(c: Column) -> Column:
    """The text where it has other characters than ASCII, else null: only such goes to Python."""
    return F.when(F.length(c) < F.octet_length(c), c)


def nfkc(c: Column) -> Column:
    return F.coalesce(F.pandas_udf(_nfkc, "string")(_beyond_ascii(c)), c)


def nfkc_casefold(c: Column) -> Column:
    return F.coalesce(F.pandas_udf(_nfkc_casefold, "string")(_beyond_ascii(c)), F.lower(c))


def tidy(c: Column) -> Column:
    """The native part of text normalisation: invisible characters, spacing, publisher boilerplate."""
    out = strip(single_spaced(F.regexp_replace(c, ZERO_WIDTH, "")))
    for pattern, sign in zip(BOILERPLATE, ("journal homepage:", "all rights reserved"), strict=True):
        out = F.when(F.contains(F.lower(out), F.lit(sign)), F.regexp_replace(out, f"(?d){pattern}", " ")).otherwise(out)
    out = F.regexp_replace(out, rf"{WS}+([,.;:!?%)\]}}])", "$1")
    out = F.regexp_replace(out, rf"([(\[{{]){WS}+", "$1")
    return strip(single_spaced(out))


def normalize_text(c: Column) -> Column:
    return tidy(nfkc(c))


def normalize_heading(c: Column) -> Column:
    return strip(F.regexp_replace(nfkc_casefold(c), r"[^\p{L}\p{N}_]+", " "))


def clean_pdf_text(c: Column) -> Column:
    """Words split over lines are joined, runs of blank lines and of blanks shortened."""
    out = F.regexp_replace(c, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", "$1$2")
    return strip(F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " "))


def pages_text(pages: Column) -> Column:
    """Page texts in order as one cleaned text, each after a line that gives its number."""
    marked = F.transform(pages, lambda p, i: F.concat(F.lit("\n\n--- PAGE "), (i + 1).cast("string"), F.lit(" ---\n\n"), F.coalesce(p, F.lit(""))))
    return clean_pdf_text(F.array_join(marked, "\n"))


def normalize_article_id(c: Column) -> Column:
    """A file name without known endings, prefixed by `article_`."""
    stem = F.regexp_replace(strip(c), r"(?i)(\.grobid)?(\.tei)?\.(xml|pdf|html)\z|\.tei\z", "")
    return F.when(F.startswith(stem, F.lit("article_")), stem).otherwise(F.concat(F.lit("article_"), stem))


# -------------------------------------------------------------------------- measures


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def numeric_ratio(c: Column) -> Column:
    """Share of the tokens between white space that hold a digit; 0 without tokens."""
    tokens = F.regexp_count(c, F.lit(f"{INK}++"))
    digits = F.regexp_count(c, F.lit(f"[0-9]{INK}*+"))  # from a token's first digit to its end, so each character is read once
    return F.when(tokens > 0, digits.cast("double") / tokens).otherwise(0.0)


@dataclass(frozen=True)
class Measures:
    """What several rules ask of a text: its number of words, its colons, itself in lower case."""

    words: Column
    colons: Column
    low: Column

    @classmethod
    def of(cls, c: Column) -> Measures:
        return cls(word_count(c), count_char(c, ":"), F.lower(c))

    @classmethod
    def held(cls, name: str) -> Measures:
        """Those of a column that `measures` made, so that each is computed once."""
        return cls(F.col(f"{name}.words"), F.col(f"{name}.colons"), F.col(f"{name}.low"))


def measures(c: Column) -> Column:
    own = Measures.of(c)
    return F.struct(own.words.alias("words"), own.colons.alias("colons"), own.low.alias("low"))


def has_any(low: Column, markers: tuple[str, ...]) -> Column:
    """Whether a lower-cased text has one of the markers."""
    out = F.contains(low, F.lit(markers[0]))
    for m in markers[1:]:
        out = out | F.contains(low, F.lit(m))
    return out


def count_char(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def is_definition(c: Column, m: Measures | None = None) -> Column:
    m = m or Measures.of(c)
    return ((m.colons >= 3) & (F.regexp_count(c, F.lit(DEFINITION)) >= 3)) | ((m.colons >= 4) & (m.colons.cast("double") / F.greatest(m.words, F.lit(1)) >= 0.02))


def is_question(c: Column, m: Measures | None = None) -> Column:
    return (count_char(c, "?") >= 3) & ((m or Measures.of(c)).words <= 700)


def is_caption(c: Column, m: Measures | None = None) -> Column:
    m = m or Measures.of(c)
    return c.rlike(CAPTION) | ((m.words <= 160) & has_any(m.low, CREDITS))


def is_chart(c: Column, m: Measures | None = None) -> Column:
    years = F.size(F.filter(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: w.rlike(YEAR)))
    return ((m or Measures.of(c)).words <= 140) & (years >= 4) & (numeric_ratio(c) >= 0.30)


def is_noise(c: Column, m: Measures | None = None) -> Column:
    m = m or Measures.of(c)
    footer = F.contains(m.low, F.lit("vol")) & c.rlike(f"(?d){FOOTER}")
    return (c == "") | c.rlike(r"\A[0-9]{1,4}\z") | footer | ((m.words <= 45) & has_any(m.low, NOISE_MARKERS)) | c.rlike(DOI)


def block_warnings(c: Column, m: Measures | None = None) -> Column:
    """Array of warnings of a block of text."""
    words = (m or Measures.of(c)).words
    return F.array_compact(
        F.array(
            F.when(words >= 1200, "very_long_block"),
            F.when((words >= 80) & ~F.substring(c, -1, 1).isin(*".!?;:"), "missing_terminal_punctuation"),
            F.when(numeric_ratio(c) >= 0.25, "high_numeric_density"),
            F.when(F.regexp_instr(c, F.lit(SIDEBAR)) > 31, "possible_embedded_sidebar"),
        )
    )


def verdict(c: Column, parent: Column, m: Measures | None = None) -> Column:
    """category:reason of a block under its parent's category; the first rule that holds, in one pass."""
    m = m or Measures.of(c)
    tests = (parent == "discard", is_noise(c, m), is_caption(c, m), is_chart(c, m), parent == "supplementary", is_definition(c, m), is_question(c, m))
    categories = ("discard",) * 4 + ("supplementary",) * 3 + ("main",)
    out = F.lit(f"main:{TEXT_REASONS[-1]}")
    for test, category, reason in list(zip(tests, categories, TEXT_REASONS, strict=False))[::-1]:
        out = F.when(test, f"{category}:{reason}").otherwise(out)
    return out


def classify_block(c: Column, parent: Column, m: Measures | None = None) -> tuple[Column, Column]:
    """Category and reason of a block."""
    both = verdict(c, parent, m)
    return F.split_part(both, F.lit(":"), F.lit(1)), F.split_part(both, F.lit(":"), F.lit(2))


def abstract_score(c: Column, lang: Column, m: Measures | None = None) -> Column:
    m = m or Measures.of(c)
    by_length = F.when(m.words.between(50, 600), 3.0).when(m.words.between(30, 900), 1.0).otherwise(-2.0)
    return (
        by_length
        + F.when(F.regexp_count(c, F.lit(SENTENCE_END)) >= 3, 2.0).otherwise(0.0)
        + F.when(has_any(m.low, ABSTRACT_MARKERS), 4.0).otherwise(0.0)
        + F.when(F.startswith(F.lower(lang), F.lit("en")), 0.5).otherwise(0.0)
        + F.when(is_definition(c, m), -7.0).otherwise(0.0)
        + F.when(is_caption(c, m) | is_chart(c, m), -6.0).otherwise(0.0)
        + F.when(is_question(c, m), -3.0).otherwise(0.0)
    )


def container_verdict(heading: Column, attrs: Column, inherited: Column) -> Column:
    """category:reason of a container by its folded heading and attributes, else its parent's category."""
    excluded = heading.isin(*EXCLUDED_TITLES)
    for t in EXCLUDED_TITLES:
        excluded = excluded | F.startswith(heading, F.lit(t + " "))
    boxed = F.startswith(heading, F.lit("box ")) | F.startswith(heading, F.lit("case study "))
    tests = (excluded, has_any(attrs, EXCLUDED_ATTRS), boxed, heading.isin(*SUPPLEMENTARY_TITLES), has_any(attrs, SUPPLEMENTARY_ATTRS))
    categories = ("discard",) * 2 + ("supplementary",) * 3
    out = F.concat_ws(":", inherited, F.lit(CONTAINER_REASONS[-1]))
    for test, category, reason in list(zip(tests, categories, CONTAINER_REASONS, strict=False))[::-1]:
        out = F.when(test, f"{category}:{reason}").otherwise(out)
    return out


def pdf_quality(c: Column) -> dict[str, Column]:
    """Counts and flags of extracted text; lines are what stands between line feeds."""
    lines = F.filter(F.transform(F.split(c, r"\n"), strip), lambda x: x != "")
    total, short = F.size(lines), F.size(F.filter(lines, lambda x: F.length(x) < 35))
    ratio = F.when(total > 0, short.cast("double") / total).otherwise(1.0)
    chars = F.length(c)
    return {
        "num_chars": chars.cast("long"),
        "num_words": word_count(c),
        "num_lines": total.cast("long"),
        "short_line_ratio": F.round(ratio, 3),
        "looks_empty": chars < 2000,
        "may_be_bad_extraction": (chars < 2000) | ((total > 0) & (ratio > 0.65)),
    }


def topic_text(trigger: Column, trigger_channel: Column, action: Column, action_channel: Column, title: Column, desc: Column) -> Column:
    t, tc, a, ac, ti, d = (clean(x) for x in (trigger, trigger_channel, action, action_channel, title, desc))
    return F.concat(F.lit("When "), t, F.lit(" from "), tc, F.lit(", do "), a, F.lit(" using "), ac, F.lit(". "), ti, F.lit(". "), d)
