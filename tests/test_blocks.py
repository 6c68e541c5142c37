"""Documents of any depth and size; the walk over events against a plain recursive one."""

import random
import resource
import sys
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from gristmill.functions import blocks as bl

# --------------------------------------------------- the rules once more, element inside element


def local(name):
    return name.rpartition("}")[2]


def attrs(e):
    return {local(k): v for k, v in e.attrib.items()}


def text_of(e):
    out = [e.text or ""]
    for c in e:
        role = local(c.tag)
        if role == "lb":
            out.append(" ")
        elif role not in bl.INLINE_SKIPPED and not (role == "ref" and attrs(c).get("type", "").lower() == "bibr"):
            inner = text_of(c)
            out.append(inner + " " * (role == "s" and inner != ""))
        out.append(c.tail or "")
    return bl.normalize("".join(out))


def class_of(e, parent):
    head = next((c for c in e if local(c.tag) == "head"), None)
    return bl.container_class(bl.fold(text_of(head)) if head is not None else "", bl.kind_attrs(attrs(e)), parent)


def walked(e, category, level, path):
    def block(x, kind, text, category, reason, level, path, warn=False):
        yield bl._block(local(x.tag), attrs(x), kind, text, category, reason, bl.Place(category, level, path)) | {"warnings": bl.warnings_of(text) if warn else []}

    own, why = class_of(e, category)
    if own == "discard":
        if text := text_of(e):
            yield from block(e, "container", text, own, why, level, path)
        return
    here, at = own, path
    for c in e:
        role, text, deeper = local(c.tag), text_of(c), min(level + 1, 6)
        if role == "head":
            if text and bl.excluded_title(text):
                here = "discard"
            elif text:
                here, why = ("supplementary", "supplementary_heading") if bl.supplementary_title(text) else class_of(e, here)
                at = (*path, text)
                yield from block(c, "heading", text, here, why, min(max(level, 2), 6), at)
        elif role in bl.FLOWS:
            if text:
                yield from block(c, bl.FLOWS[role], text, *bl.classify(text, here), level, at, True)
        elif role == "list":
            ordered = attrs(c).get("type", "").casefold() in ("ordered", "numbered")
            for n, item in enumerate((i for i in c if local(i.tag) == "item"), 1):
                if text := text_of(item):
                    text = (f"{n}. " if ordered else "- ") + text
                    yield from block(item, "list_item", text, *bl.classify(text, here), level, at, True)
        elif role == "div":
            yield from walked(c, here, deeper, at)
        elif role == "note" or role == "figure" and class_of(c, here)[0] == "supplementary":
            yield from walked(c, "supplementary", deeper, at)
        elif role == "figure" or role in bl.LEAF_EXCLUDED:
            if text:
                kind, why = ("figure", "figure_content") if role == "figure" else (role, f"excluded_{role}")
                yield from block(c, kind, text, "discard", why, level, at)
        elif len(c):
            yield from walked(c, here, level, at)


ROLES = "div div p p ab list item quote formula note figure head head table graphic figDesc fw s hi ref lb listBibl xx seg".split()
SAID = ["Methods", "References", "Introduction", "Box 1", "Acknowledgements", "a ", "b", "( c", ") d", ". ", "12 ", "1999 2000 2001 2003 12 13", "Glossary: A: B: C: D:", "what? why? how?", "Figure 1. x", "\n  ", "Funding", "&amp;", "<!-- c -->"]


def random_element(rnd, depth):
    role = rnd.choice(ROLES)
    own = f' type="{rnd.choice(["bibr", "ordered", "box", "references", "sidebar", "x"])}"' if rnd.random() < 0.3 else ""
    inside = [rnd.choice(SAID) if rnd.random() < 0.5 else random_element(rnd, depth + 1) for _ in range(rnd.randint(0, 5 if depth < 6 else 0))]
    return f"<{role}{own}>{''.join(inside)}</{role}>"


@pytest.mark.parametrize("seed", range(5))
def test_events_walk_like_recursion(seed):
    rnd, blocks = random.Random(seed), 0
    for _ in range(400):
        body = "".join(random_element(rnd, 0) for _ in range(4))
        source = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>T</title></teiHeader><text><body>{body}</body></text></TEI>'
        root = ET.fromstring(source).find("{*}text/{*}body")
        want = list(walked(root, "main", 2, ()))
        got = list(bl.document_blocks(source))
        size = len(bl.normalize(" ".join(t for t in bl.all_text(bl.parse_xml(source).find("text", "body")))))
        assert {b.pop("body_chars") for b in got} == {size}
        assert got == want or not want and [b["kind"] for b in got] == ["empty"]
        blocks += len(want)
    assert blocks > 1000


def test_any_depth():
    n = 100_000
    assert n > sys.getrecursionlimit()
    nested = "<div>" * n + "<p>" + "<hi>" * n + "the  end" + "</hi>" * n + "</p>" + "</div>" * n
    assert [(b["kind"], b["text"], b["level"]) for b in bl.document_blocks(f"<TEI><teiHeader/><text><body>{nested}</body></text></TEI>")] == [("paragraph", "the end", 6)]
    assert [b["text"] for b in bl.document_blocks(f"<body>{'<div>' * n}<p>end</p></body>", html=True)] == ["end"]
    header = "<note>" * n + "x" + "</note>" * n
    assert [b["kind"] for b in bl.document_blocks(f"<TEI><teiHeader><abstract>{header}<p>About.</p></abstract></teiHeader><text><body/></text></TEI>")] == ["abstract_candidate"]


def test_one_deep_or_broken_page_does_not_end_the_job(spark):
    n = 20_000
    rows = spark.createDataFrame([(1, f"<TEI><text><body>{'<div>' * n}<p>end</p>{'</div>' * n}</body></text></TEI>"), (2, "<TEI>" * n), (3, "<TEI/>"), (4, None)], "id long, x string")
    got = {r.id: (r.text, r.error) for r in bl.blocks_of(rows, "id", "x").collect()}
    assert got[1] == ("end", None) and got[2][1].startswith("invalid XML") and got[3][1] == "no body element" and got[4][1] == "no document"
    assert bl.element_counts(rows, "id", "x").where("id = 1").first().n_p == 1


def test_a_large_document_streams():
    paragraph = "<p>" + "The rules were applied to forty homes for a year and <hi>the savings</hi> were large. " * 10 + "</p>"
    source = "<TEI><teiHeader/><text><body>" + ("<div><head>Part</head>" + paragraph * 50 + "</div>") * 240 + "</body></text></TEI>"
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    blocks = bl.document_blocks(source)
    first = next(blocks)
    assert first["text"] == "Part" and sum(1 for _ in blocks) == 51 * 240 - 1
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) * 1024
    assert len(source) > 10_000_000 and grown < 20 * len(source)


def test_table_function_joins_laterally(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    bl.register(spark)
    pages.createOrReplaceTempView("pages_for_blocks")
    got = spark.sql("select p.page_id, b.ordinal, b.kind, b.text, b.category, b.error from pages_for_blocks p, lateral document_blocks(p.html, true) b")
    want = bl.blocks_of(pages, "page_id", "html", html=True).select("page_id", "ordinal", "kind", "text", "category", "error")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where(F.col("kind") == "paragraph").count() > 0
