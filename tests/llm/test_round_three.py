"""Sum-of-squares packing, Merkle proofs and the source audit against brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import best_fit, divergence, merkle, queries

LONG = "The long one. " + " ".join(f"word{i % 997} x{i}" for i in range(20_000))
EDGE = [
    (1, "The Cat sat on the mat and the dog sat on the log by the fire.", "en", "s", 10),
    (2, None, "en", "s", 0),
    (3, "", None, "s", None),
    (4, " \n\t 12!", "fr", None, 4),
    (5, "The Cat sat on the mat and the dog sat on the log by the fire.", "en", "t", 10),
    (5, "The Cat sat on the mat and the dog sat on the log by the fire.", "en", "t", 10),
    (5, "Another text with the id of those before.", "en", "", 5),
    (None, "Le chat est dans la maison avec le chien et la souris.", "fr", "s", 5),
    (None, "Le chat est dans la maison avec le chien et la souris.", "fr", "s", 5),
    (7, LONG, "en", "s", len(LONG)),
    (-8, "日本語 テキスト\n日本語 ÄÖ Äö ÇA ça", "", "s", 5),
    (9, "日本語 テキスト the cat", "ja", "s", 5),
    (10, "The mat: the LOG, the fire; the Émile", "en", None, 3),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("grp", "idx", "node", "other", "row", "part", "n", "total", "path", "root", "leaf", "term", "value", "rank", "piece", "sequence_id", "Start", "ids", "v", "g")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("clash") for c in CLASH}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(df):
    cell = lambda v: "" if pd.isna(v) else repr(float(v)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).to_numpy().tolist())


def sql_rows(spark, docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    return con.execute(sql).df()


# ---------------------------------------------------------------------------- 11 packing


def by_rule(lengths, size):
    """Sequences and offsets by the rule itself: the sum of squares is computed for every open gap."""
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n, counts = lengths[i], Counter(size - sum(b) for b in bins)
        best = None
        for gap in sorted({size - sum(b) for b in bins if size - sum(b) >= n and sum(b) < size}):
            after = counts.copy()
            after[gap] -= 1
            after[gap - n] += 1
            total = sum(c * c for g, c in after.items() if 0 < g < size)
            if best is None or total < best[0]:
                best = total, gap
        if best is None:
            bins.append([n])
            out[i] = (0, size - n)
        else:
            b = next(b for b in bins if size - sum(b) == best[1])
            out[i] = (size - best[1], best[1] - n)
            b.append(n)
    return out, sorted(map(tuple, map(sorted, bins)))


@pytest.mark.parametrize("seed", range(6))
def test_sum_of_squares_rule(seed):
    rnd = random.Random(seed)
    size = rnd.choice([7, 20, 64])
    lengths = np.asarray([rnd.randint(1, size) for _ in range(rnd.randint(0, 90))], np.int64)
    seq, offset, opened = best_fit.pack(lengths, size)
    want, bins = by_rule(lengths.tolist(), size)
    assert [int(o) for o in offset] == [want[i][0] for i in range(len(lengths))]  # the gap chosen for each piece is the rule's
    assert opened == len(bins) and (not len(lengths) or set(seq) == set(range(opened)))
    assert all(lengths[seq == s].sum() <= size for s in range(opened))


def pieces_hold(rows, texts, size, end_id):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for doc, text in texts:
        ids = np.asarray(tok.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        want.update((doc, k, at, len(p := ids[at : at + size]), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), size)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    used = defaultdict(list)
    for r in rows:
        used[r.sequence_id].append((r.offset, r.length))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(used), sum(r.length for r in rows)


def test_sum_of_squares_packs_all(spark, sf):
    rows = queries.op11_sum_of_squares(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    n, total = pieces_hold(rows, docs, 2048, 0)
    assert n <= -(-total // 2048) + 1


def test_sum_of_squares_edges(spark, edge, empty):
    rows = best_fit.pack_best_fit(edge, public_tokenizers.path("word_bpe_49k.json"), size=16, end_id=3, block_tokens=50).collect()
    pieces_hold(rows, [r[:2] for r in EDGE], 16, 3)
    got = best_fit.pack_best_fit(edge, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)
    assert all(zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length for r in got.collect())
    assert best_fit.pack_best_fit(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    with pytest.raises(ValueError):
        best_fit.pack_best_fit(edge, "x", size=0)


# ---------------------------------------------------------------------------- 12 proofs


def tree_hash(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_proofs(rows, arity=8):
    """id, leaf, subroot, root, siblings, folded root of each row, whole levels at a time."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = tree_hash(map(field, (doc, source, lang, n, text)))
        wrong = doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0
        groups[lang].append((doc is not None, doc or 0, leaf, tree_hash(map(field, (doc, source, lang, n, lower(text)))) if wrong else leaf, doc))

    def climb(nodes):
        """The root, and each leaf's list of (position, siblings)."""
        at, path = list(range(len(nodes))), [[] for _ in nodes]
        while len(nodes) > 1:
            for i, j in enumerate(at):
                lo = j - j % arity
                path[i].append((j % arity, nodes[lo:j] + nodes[j + 1 : lo + arity]))
            at, nodes = [j // arity for j in at], [tree_hash(nodes[k : k + arity]) for k in range(0, len(nodes), arity)]
        return nodes[0], path

    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = climb([trees[g][0] for g in names])
    for g, top in zip(names, tops, strict=True):
        for (_, _, leaf, given, doc), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            cur = given
            for place, siblings in path + top:
                cur = tree_hash([*siblings[:place], cur, *siblings[place:]])
            yield doc, leaf, trees[g][0], root, tree_hash(x for _, s in path + top for x in s), cur, cur == root


UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def proofs(docs, **options):
    when = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return merkle.merkle_proofs(docs, altered={"text": F.translate("text", UPPER, UPPER.lower())}, when=when, **options)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_merkle_by_brute_force(spark, sf, levels):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = proofs(docs, block_levels=levels).collect()
    assert sorted(map(tuple, got)) == sorted(brute_proofs(rows))
    assert any(r.verified for r in got) and any(not r.verified for r in got)


def test_merkle_edges(spark, edge, empty):
    order = lambda r: tuple(map(str, r))
    got = proofs(edge, block_levels=1, with_path=True).collect()
    assert sorted((tuple(r)[:7] for r in got), key=order) == sorted(brute_proofs(EDGE), key=order)
    assert all(merkle.fold(bytes.fromhex(r.leaf), r.path).hex() == r.root and merkle.path_digest(r.path) == r.proof_sha256 for r in got)
    sql = sql_rows(spark, edge, queries._merkle_sql())
    assert normal(proofs(edge).toPandas()) == normal(sql)
    assert proofs(empty).count() == 0 and merkle.merkle_manifest(empty).count() == 0
    one = proofs(edge.where("lang = 'ja'")).collect()
    assert [(r.leaf, r.proof_sha256) for r in one] == [(one[0].root, hashlib.sha256(b"").hexdigest())] and one[0].subroot == one[0].root
    listed = {r.group: (r.rows, r.subroot, r.root) for r in merkle.merkle_manifest(edge).collect()}
    assert {g: n for g, (n, _, _) in listed.items()} == Counter(r[2] for r in EDGE)
    assert {v[1:] for v in listed.values()} == {(r.subroot, r.root) for r in got}


def test_merkle_many_groups(spark):
    docs = spark.range(300).selectExpr("id doc_id", "concat('T', id) text", "cast(id % 90 as string) lang", "'s' source", "1 n_chars")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(map(tuple, proofs(docs, block_levels=1).collect())) == sorted(brute_proofs(rows))


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 130, 511, 512])
def test_traversal_is_every_path_in_turn(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    for levels in {merkle.height(n, 8), 3}:
        root = merkle.block_root(leaves, 8, levels)
        found = list(merkle.paths(leaves, 8, levels))
        assert [merkle.fold(x, p) for x, p in zip(leaves, found, strict=True)] == [root] * n
        assert all(len(list(merkle.steps(p))) == levels for p in found)


def test_treehash_keeps_less_than_a_run_a_level():
    tree = merkle.TreeHash(8, 3)
    for i in range(500):
        tree.push(bytes([i % 256]) * 32)
        assert all(len(x) < 8 for x in tree.stack)


# ----------------------------------------------------------------------------- 13 audit


def brute_audit(rows, min_docs=3, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(lang or "", source or "", words(text)) for _, text, lang, source, _ in rows]
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= min_docs), key=str.encode)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                yield from ((lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1))


def as_rows(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"max_terms": 7, "max_entries": 20}, {"top": 3, "min_docs": 1, "max_terms": 50}])
def test_audit_by_brute_force(spark, sf, options):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    limits = {k: v for k, v in options.items() if k in ("top", "min_docs")}
    assert as_rows(divergence.audit_sources(docs, **options)) == sorted(brute_audit(rows, **limits))


def test_audit_edges(spark, edge, empty, monkeypatch):
    assert as_rows(divergence.audit_sources(edge)) == sorted(brute_audit(EDGE))
    assert normal(divergence.audit_sources(edge).toPandas()) == normal(sql_rows(spark, edge, queries.DIVERGENCE_SQL))
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", 0)
    monkeypatch.setattr(divergence, "CELLS", 16)
    assert as_rows(divergence.audit_sources(edge, min_docs=2)) == sorted(brute_audit(EDGE, min_docs=2))
    assert divergence.audit_sources(empty).count() == 0


def test_shares_are_exact_beyond_64_bits():
    rnd = random.Random(5)
    total = np.asarray([[rnd.randrange(1, 9 * 10**15)] for _ in range(50)], np.int64)
    counts = np.asarray([[rnd.randrange(int(t))] for (t,) in total.tolist()], np.int64)
    got = divergence.scaled_shares(counts, total)
    assert got.tolist() == [[1 + 10**9 * (c + 1) // t] for (c,), (t,) in zip(counts.tolist(), total.tolist(), strict=True)]


# -------------------------------------------------------------------------------- pipeline


def test_stages_keep_columns_of_any_name(spark, sf):
    from gristmill.llm import stages

    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({c: F.concat(F.lit(f"own {c} "), "doc_id") for c in ("_order", "_lang_share", "_lang_score", "_lang_pred", "_row", "_first", "_n", "component_id")})
    docs = docs.unionByName(docs.where("doc_id < 3"))  # ids repeat
    for stage in (stages.identify_language, stages.drop_near_duplicates, stages.decontaminate):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert out.exceptAll(docs).isEmpty() and out.count() > 100


def test_no_text_is_lost_by_its_id(spark, sf):
    from gristmill.llm import stages

    texts = ["one two three four five six seven eight nine ten", "another text that has nothing to do with the first of them", "and a third one on its own with words that no other text has in it"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[0]), (3, texts[2]), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    got = Counter((r.doc_id, r.text) for r in stages.drop_near_duplicates(spark, docs, sf).collect())
    assert got == Counter([(1, texts[0]), (1, texts[1]), (3, texts[2]), (4, None), (4, None), (5, "")])
    unique = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate([texts[0], texts[0] + " ten", texts[1], None])], SCHEMA)
    assert {r.doc_id for r in stages.drop_near_duplicates(spark, unique, sf).collect()} == {0, 2, 3}
