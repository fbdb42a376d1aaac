"""Names, document structure and evidence checks on small cases with values worked out by hand."""

import random

from pyspark.sql import functions as F

from quillgraph.functions import names as N
from quillgraph.operators import structure as D
from quillgraph.operators import verify as C


def _of(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_names(spark):
    assert _of(spark, ["En–De WMT14 translation task", None, ""], N.ontology_text) == ["En-De WMT 2014", None, ""]
    assert _of(spark, ['“ "A b" ”', '"a', '""', '"', None], N.without_outer_quotes) == ["A b", '"a', "", '"', None]
    assert _of(spark, ["Ising model [3] (Rev. 1999)", "Phys. Rev. Lett. 12", "plain", None], N.without_citations) == ["Ising model", "", "plain", None]
    assert _of(spark, ["the GLUE benchmark, with care.", "our network", "Network 7", None], N.dataset_name) == ["GLUE", "", "Network 7", None]
    assert _of(spark, ["Graph-Neural Networks (GNN)", "GNN", "a b", "", None], N.concept_name) == ["graph neural network", "gnn", "a b", "", None]
    kinds = _of(spark, ["WMT14", "BLEU score", "ImageNet pictures", "image segmentation", "auto-encoder", "XYZ", "other things", "Cas9", "B12", None], N.concept_type)
    assert kinds == ["dataset", "metric", "dataset", "task", "method", "acronym", "keyword", "method", "identifier", None]
    assert _of(spark, ["milliseconds", "bananas", None], N.unit) == ["ms", "bananas", None]
    name = _of(spark, ["The misclassification rate drops", "nothing", None], lambda t: F.struct(*N.metric(t)))
    assert [tuple(x) for x in name] == [("Accuracy", "misclassification rate"), (None, None), (None, None)]
    m = _of(spark, ["Accuracy improves to 92.5% on CIFAR-10", "F1 rises to 0.87 on the dev set", "none", None], lambda t: N.measurement(t, F.lit("F1")))
    assert [tuple(x) if x else None for x in m] == [(92.5, "%", "percent"), (0.87, None, "decimal_ratio"), None, None]
    assert _of(spark, ["It", "our model", "this new approach", "the cat", "BERT", None], N.needs_antecedent) == [True, True, True, False, False, False]


def test_html_tree_and_sections(spark):
    html = "<html><head><title>T</title></head><body>intro<h1>One</h1><p>a <b>bold</b> z<br><p>b</p><script>x</script><h2>Two</h2><div><p>c &amp; d</p></div></body>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    nodes = D.html_nodes(pages)
    got = [(r["tag"], r["depth"], r["text"]) for r in nodes.filter("page_id = 1").orderBy("ordinal").collect()]
    assert got[:5] == [("html", 0, ""), ("head", 1, ""), ("title", 2, "T"), ("body", 1, "intro"), ("h1", 2, "One")]
    assert nodes.filter("page_id <> 1").count() == 0
    s = [(r["section"], r["title"], r["level"], r["content"]) for r in D.heading_sections(nodes).orderBy("section").collect()]
    assert s == [(0, None, None, "intro"), (1, "One", 1, "a z\nbold\nb"), (2, "Two", 2, "c & d")]


def test_paragraphs():
    assert [(p["start"], p["end"]) for p in D.paragraph_spans("ab\n\n cd \n \nefghij\n\nk", 4)] == [(0, 7), (11, 17), (19, 20)]
    assert D.paragraph_spans(None) == [] and D.paragraph_spans(" \n\n ") == []


def test_block_of_offsets(spark):
    blocks = spark.createDataFrame([("d", 1, "abcd"), ("d", 2, ""), ("d", 3, "xy")], "doc string, page int, t string")
    placed = D.running_offsets(blocks, "doc", ["page"], F.length("t"), 2)
    assert [(r["start"], r["end"]) for r in placed.orderBy("page").collect()] == [(0, 4), (6, 6), (8, 10)]
    at = spark.createDataFrame([("d", 5), ("d", 6), ("d", 99), ("e", 1)], "doc string, at long")
    assert {(r["doc"], r["at"], r["page"]) for r in D.block_of_offsets(at, placed, "doc", "page").collect()} == {("d", 5, 1), ("d", 6, 2), ("d", 99, 3), ("e", 1, None)}


def _fold(rows):
    """The history fold, mention by mention."""
    history, out = {}, {}
    for sec, pos, kind, value, needs in sorted(rows):
        h = history.setdefault(sec, {})
        v = value
        if needs:
            v = (h.get(kind) or next((x for x in h.values() if x), [None]))[-1]
            out[sec, pos] = v
        if v is not None:
            h.setdefault(kind, []).append(v)
    return out


def test_references_follow_the_fold(spark):
    r = random.Random(5)
    rows = [(r.randrange(12), i, r.choice("abc"), f"v{i}", r.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame(rows, "sec int, pos int, kind string, value string, needs boolean")
    got = {(x["sec"], x["pos"]): x["antecedent"] for x in C.resolve_references(df, "sec", "pos", "kind", "value", "needs").filter("needs").collect()}
    assert got == _fold(rows)


def test_evidence_table_and_aliases(spark):
    claims = spark.createDataFrame([("p", 1, " the cat sat "), ("p", 2, "The cat sit on the mat"), ("p", 3, "dogs"), ("q", 4, "the cat sat"), ("p", 5, None), ("p", 6, " ")], "p string, c int, quote string")
    sent = spark.createDataFrame([("p", 0, "Intro."), ("p", 1, "The cat sat on the mat"), ("p", 2, None)], "p string, i int, sentence string")
    got = {(r["c"], r["i"], r["start"], r["end"], r["fuzzy"]) for r in C.match_evidence(claims, sent, "p", "c", "i").collect()}
    # the near match's longest block, "t on the mat", is below 60 % of the quote
    assert got == {(1, 1, 0, 11, False)}
    assert C.near_span("We evaluate on the GLUE data", "We evaluate on the GLUE dates") == {"start": 0, "end": 27}
    cells = spark.createDataFrame([("s", 0, 0, 0, "head"), ("s", 0, 1, 2, "BLEU 41.80 %"), ("s", 1, 0, 0, "41.8"), ("t", 0, 0, 0, "41,8"), ("t", 0, 0, 1, None)], "s string, table_id int, row int, col int, cell string")
    m = spark.createDataFrame([("s", 1, 41.8), ("s", 2, 7.0), ("t", 3, 41.8), ("t", 4, None)], "s string, m int, value double")
    assert {tuple(r) for r in C.table_matches(m, cells, "s", "m").collect()} == {("s", 1, 0, 1, 2), ("t", 3, 0, 0, 0)}
    assert C.alias_values('["AB", "ab", {"x": ["b  c"], "y": ["Q", "T"]}, null]') == ["AB", "b c", "QT"]
    assert C.alias_values(None) == [] and C.alias_values("[broken") == ["[broken"]
    flat = spark.createDataFrame([('["x y", ["z"]]',), (None,)], "a string").select(C.flat_aliases(F.col("a")).alias("v"))
    assert [r["v"] for r in flat.collect()] == [["x y", "z"], []]
