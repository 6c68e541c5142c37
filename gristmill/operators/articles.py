"""Articles from their blocks: the chosen abstract, repeated blocks, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as tx

REPEAT_CHARS = 80


def choose_abstract(blocks: DataFrame, id_col: str) -> DataFrame:
    """id, abstract, score, candidates, abstract_warnings: the best-scored candidate, the first on ties."""
    scored = blocks.where("kind = 'abstract_candidate'").withColumn("score", tx.abstract_score(F.col("text"), F.coalesce("source_type", F.lit(""))))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("score"), "ordinal"))
    ranked = scored.withColumn("rank", rank)
    details = F.array_sort(F.collect_list(F.struct("rank", "score", tx.word_count(F.col("text")).alias("word_count"), F.col("source_type").alias("language"), F.left("text", F.lit(300)).alias("preview"))))
    best = ranked.groupBy(id_col).agg(
        F.max(F.when(F.col("rank") == 1, F.col("text"))).alias("abstract"),
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("score"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"),
        details.alias("candidates"),
    )
    every = blocks.select(id_col).distinct().join(best, id_col, "left")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("abstract").isNull(), "abstract_not_found"),
            F.when(F.col("score") - F.col("second") <= 1.5, "ambiguous_abstract_selection"),
            F.when(F.col("score") < 0, "low_confidence_abstract"),
        )
    )
    return every.withColumn("abstract_warnings", warnings).drop("second")


def body_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of the bodies of readable documents."""
    return blocks.where("error is null and kind not in ('title', 'abstract_candidate', 'empty')")


def discard_repeats(blocks: DataFrame, id_col: str, abstracts: DataFrame) -> DataFrame:
    """Body blocks, those that repeat an earlier one or the abstract moved to discard.

    Texts are compared folded; headings, shorter texts and what is discarded anyway are left alone.
    """
    body = body_blocks(blocks).withColumn("_print", tx.normalize_heading(F.col("text")))
    known = abstracts.select(id_col, tx.normalize_heading(F.col("abstract")).alias("_abstract"))
    judged = (F.length("_print") >= REPEAT_CHARS) & (F.col("kind") != "heading") & (F.col("category") != "discard")
    first = F.min(F.when(judged, F.col("ordinal"))).over(Window.partitionBy(id_col, F.md5("_print")))
    repeated = judged & ((F.col("ordinal") > first) | F.coalesce(F.col("_print") == F.col("_abstract"), F.lit(False)))
    out = body.join(known, id_col, "left").withColumn("_repeated", repeated)
    reason, category = F.when(F.col("_repeated"), "duplicate_content").otherwise(F.col("reason")), F.when(F.col("_repeated"), "discard").otherwise(F.col("category"))
    return out.withColumns({"reason": reason, "category": category}).drop("_print", "_abstract", "_repeated")


def rendered(body: DataFrame, id_col: str) -> DataFrame:
    """id, main, supplementary: the blocks of each category in order as Markdown, null without any."""
    line = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.col("text"))).when(F.col("kind") == "quote", F.concat(F.lit("> "), F.col("text"))).otherwise(F.col("text"))
    lines = body.where("category <> 'discard'").select(id_col, "category", "ordinal", line.alias("line"))

    def of(category: str):
        own = F.array_sort(F.collect_list(F.when(F.col("category") == category, F.struct("ordinal", "line"))))
        joined = F.array_join(F.transform(own, lambda r: r["line"]), "\n\n")
        return F.nullif(tx.strip(F.regexp_replace(joined, r"\n{3,}", "\n\n")), F.lit("")).alias(category)

    return lines.groupBy(id_col).agg(of("main"), of("supplementary"))


def articles(blocks: DataFrame, id_col: str) -> DataFrame:
    """A row per document: title, abstract, Markdown of its main and supplementary parts, and its report.

    The main document has the title, the abstract under a heading of its own, and the main blocks. A
    document without any of these has its error, as one that cannot be read has; the share of
    main text is that of the whole body's characters.
    """
    readable, broken = blocks.where("error is null"), blocks.where("error is not null").select(id_col, "error")
    chosen = choose_abstract(readable, id_col)
    body = discard_repeats(readable, id_col, chosen)
    kept, main = F.col("category") != "discard", F.col("category") == "main"
    review = kept & (F.col("kind") != "heading") & (F.size("warnings") > 0)

    def tally(rows: DataFrame, key: str, name: str) -> DataFrame:
        counts = rows.groupBy(id_col, key).agg(F.count("*").cast("int").alias("n"))
        return counts.groupBy(id_col).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))

    totals = body.groupBy(id_col).agg(
        F.count_if(main).alias("main_blocks"),
        F.count_if(F.col("category") == "supplementary").alias("supplementary_blocks"),
        F.count_if(~kept).alias("discarded_blocks"),
        F.count_if(review).alias("review_blocks"),
        F.sum(F.when(main & (F.col("kind") != "heading"), F.length("text")).otherwise(0)).alias("main_text_characters"),
        F.bool_or(main & (F.col("kind") == "paragraph")).alias("has_paragraph"),
    )
    whole = readable.groupBy(id_col).agg(F.max("body_chars").alias("raw_body_characters"), F.min(F.when(F.col("kind") == "title", F.struct("ordinal", "text")))["text"].alias("title"))
    parts = [totals, whole, rendered(body, id_col), tally(body.where(kept), "kind", "block_kinds"), tally(body.where(~kept), "reason", "discard_reasons")]
    out = chosen
    for part in parts:
        out = out.join(part, id_col, "left")
    counts = ("main_blocks", "supplementary_blocks", "discarded_blocks", "review_blocks", "main_text_characters")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    ratio = F.when(F.col("raw_body_characters") > 0, F.col("main_text_characters").cast("double") / F.col("raw_body_characters")).otherwise(0.0)
    head = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("title")), F.concat(F.lit("## Abstract\n\n"), F.col("abstract")), F.col("main"))
    markdown = F.nullif(tx.strip(F.regexp_replace(head, r"\n{3,}", "\n\n")), F.lit(""))
    extra = F.when(F.col("supplementary").isNotNull(), F.concat(F.lit("# "), F.coalesce("title", F.col(id_col).cast("string")), F.lit(" — Supplementary Content\n\n"), F.col("supplementary")))
    found = F.array_compact(
        F.array(
            F.when(F.col("title").isNull(), "title_not_found"),
            F.when(F.col("abstract").isNull(), "abstract_not_selected"),
            F.when(~F.coalesce("has_paragraph", F.lit(False)), "no_main_paragraphs"),
            F.when(ratio < 0.25, "low_main_text_ratio"),
            F.when(F.col("review_blocks") > 0, "manual_review_recommended"),
        )
    )
    every = F.array_sort(F.array_distinct(F.concat("abstract_warnings", found)))
    shaped = out.withColumns({"title_found": F.col("title").isNotNull(), "main_text_ratio": F.round(ratio, 4), "warnings": every, "markdown": markdown, "supplementary_markdown": extra, "selected_abstract_preview": F.left(F.coalesce("abstract", F.lit("")), F.lit(500))})
    named = shaped.withColumn("error", F.when(F.col("markdown").isNull(), "no useful main content")).drop("abstract_warnings", "has_paragraph", "main", "supplementary")
    return named.unionByName(broken, allowMissingColumns=True)


def report(blocks: DataFrame, id_col: str) -> DataFrame:
    """The reports of the documents that have main content: counts by category, kind and reason, share, warnings."""
    return articles(blocks, id_col).where("error is null").drop("error", "markdown", "supplementary_markdown")


def report_json(out: DataFrame, source: Column, main: Column, supplementary: Column) -> Column:
    """The nested report document of a row of `articles`, as JSON, with where it was read and written; null without."""
    counts = F.struct("main_blocks", "supplementary_blocks", "discarded_blocks", "review_blocks", F.coalesce("block_kinds", F.create_map().cast("map<string,int>")).alias("block_kinds"), F.coalesce("discard_reasons", F.create_map().cast("map<string,int>")).alias("discard_reasons"))
    candidates = F.transform(F.coalesce("candidates", F.array().cast(out.schema["candidates"].dataType)), lambda c: F.struct(c["score"].alias("score"), c["word_count"].alias("word_count"), c["language"].alias("language"), c["preview"].alias("preview")))
    quality = F.struct("raw_body_characters", "main_text_characters", "main_text_ratio")
    extra = F.when(F.col("supplementary_markdown").isNotNull(), supplementary)
    fields = (F.col(out.columns[0]).cast("string").alias("article_id"), source.alias("source_tei"), main.alias("main_output"), extra.alias("supplementary_output"), "title_found", candidates.alias("abstract_candidates"), "selected_abstract_preview", counts.alias("counts"), quality.alias("quality"), "warnings")
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
