"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import best_fit, decontam, divergence, language_id, merkle, ngram_jaccard, packing, pii, quality, suffix_dedup, token_files, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = language_id.train(docs.where(~held_out))
    judged = language_id.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), min_revisit_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_groups(table(spark, sf_dir, "documents"), k=4, percent=85)


def op4_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents"))


def op5_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)


def op6_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op8_bucket_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=50)


def op9_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "lcs", "lcs_share", "answered")


def op11_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.pack_best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)


def op12_merkle_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return merkle.merkle_proofs(table(spark, sf_dir, "documents"), altered={"text": F.translate("text", upper, upper.lower())}, when=tampered)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"), min_docs=3, top=200)


QUERIES = {
    "op1_language_bits": op1_language_bits,
    "op2_warc_shards": op2_warc_shards,
    "op3_jaccard_product": op3_jaccard_product,
    "op4_kneser_ney_bands": op4_kneser_ney_bands,
    "op5_cost_packing": op5_cost_packing,
    "op6_elias_fano_tokens": op6_elias_fano_tokens,
    "op7_url_trees": op7_url_trees,
    "op8_bucket_pointers": op8_bucket_pointers,
    "op9_disclosure_pii": op9_disclosure_pii,
    "op10_latent_decontamination": op10_latent_decontamination,
    "op11_sum_of_squares": op11_sum_of_squares,
    "op12_merkle_traversal": op12_merkle_traversal,
    "op13_source_divergence": op13_source_divergence,
}

PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS last FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda j: ('0x' || substr(hex, 5 * j + 1, 5))::BIGINT) AS parts FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((parts[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM v
"""

JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
s AS (SELECT doc_id, CASE WHEN len(t) >= 4 THEN list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END AS g FROM w),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o WHERE 100 * shared >= 85 * (na + nb - shared)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM u UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.other = u.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c USING (doc_id)
"""

REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 50, true) AS new FROM w JOIN m USING (s) WHERE doc_id > first),
run AS (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
cut AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begins, a AS ends FROM cut UNION ALL
SELECT doc_id, coalesce(max(z), 0), length(any_value(h)) // 2 FROM d LEFT JOIN cut USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * begins + 1, 2 * (ends - begins)), '' ORDER BY begins) AS k FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM cut GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""


def _merkle_sql(levels: int = 12, top_levels: int = 6) -> str:
    """The tree level by level: 8**levels rows of a language, 8**top_levels languages."""

    def grow(name: str, first: str, n: int) -> str:
        out = [f"{name}0 AS MATERIALIZED ({first})"]
        for k in range(n):
            runs = f"SELECT g, i // 8 AS r, list(h ORDER BY i) AS hs, any_value((n + 7) // 8) AS m FROM {name}{k} WHERE n > 1 GROUP BY g, i // 8"
            out.append(f"{name}r{k} AS MATERIALIZED ({runs})")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, r AS i, sha256(array_to_string(hs, '')) AS h, m AS n FROM {name}r{k} UNION ALL SELECT g, i, h, n FROM {name}{k} WHERE n = 1)")
        return ", ".join(out)

    def climb(name: str, tree: str, first: str, n: int) -> str:
        out = [f"{name}0 AS ({first})"]
        for k in range(n):
            place = "(p.i % 8 + 1)"
            left, right = f"array_to_string(r.hs[:{place} - 1], '')", f"array_to_string(r.hs[{place} + 1:], '')"
            cols = f"p.id, p.leaf, p.g0, p.g, CASE WHEN r.hs IS NULL THEN p.i ELSE p.i // 8 END AS i, CASE WHEN r.hs IS NULL THEN p.cur ELSE sha256(concat({left}, p.cur, {right})) END AS cur, CASE WHEN r.hs IS NULL THEN p.sib ELSE concat(p.sib, {left}, {right}) END AS sib"
            out.append(f"{name}{k + 1} AS (SELECT {cols} FROM {name}{k} p LEFT JOIN {tree}r{k} r ON r.g = p.g AND r.r = p.i // 8)")
        return ", ".join(out)

    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256(concat({', '.join([field(c) for c in ('doc_id', 'source', 'lang', 'n_chars')] + [text])}))"
    step = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda j: ascii(substr(doc_id::VARCHAR, j, 1))::BIGINT)), lambda c, b: {step}))"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    docs = f"SELECT doc_id AS id, coalesce('=' || lang, '') AS g, {leaf(field('text'))} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(field(lower))} END AS other FROM documents"
    placed = "SELECT *, row_number() OVER (PARTITION BY g ORDER BY id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d"
    tops = f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n, g AS name FROM t{levels}"
    start = "SELECT id, leaf, g AS g0, g, i, coalesce(other, leaf) AS cur, '' AS sib FROM s"
    upper = f"SELECT p.id, p.leaf, p.g0, u.g, u.i, p.cur, p.sib FROM p{levels} p JOIN tops u ON u.name = p.g0"
    return (
        f"WITH d AS ({docs}), s AS MATERIALIZED ({placed}), {grow('t', 'SELECT g, i, leaf AS h, n FROM s', levels)}, tops AS MATERIALIZED ({tops}), {grow('u', 'SELECT g, i, h, n FROM tops', top_levels)}, "
        f"{climb('p', 't', start, levels)}, {climb('q', 'u', upper, top_levels)} "
        f"SELECT q.id AS doc_id, q.leaf, tops.h AS subroot, u{top_levels}.h AS root, sha256(q.sib) AS proof_sha256, q.cur AS folded_root, q.cur = u{top_levels}.h AS verified FROM q{top_levels} q JOIN tops ON tops.name = q.g0 CROSS JOIN u{top_levels}"
    )


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
e AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER o + count(*) OVER o) AS p FROM e WINDOW o AS (PARTITION BY lang, source)),
f AS (SELECT lang, term, sum(n) AS n FROM e GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER o + count(*) OVER o) AS q FROM f WINDOW o AS (PARTITION BY lang)),
s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM a)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

#: DuckDB SQL with the same rows, where SQL can express the query.
ORACLE_SQL: dict[str, str] = {"op2_warc_shards": PAGES_SQL, "op3_jaccard_product": JACCARD_SQL, "op8_bucket_pointers": REPEATS_SQL, "op12_merkle_traversal": _merkle_sql(), "op13_source_divergence": DIVERGENCE_SQL}
