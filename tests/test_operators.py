"""Small fixtures with expected values worked out by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import similarity, text
from quillgraph.operators import extract, graph, resolve, search, tables
from quillgraph.streaming import status


def test_jaro_reference_points():
    assert similarity.jaro_of("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    # three characters out of order count as one transposition: halves are dropped
    assert similarity.jaro_of("red gizmo", "large bolt") == pytest.approx(0.618519, abs=1e-6)
    assert similarity.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert similarity.jaro_winkler_of("dwayne", "duane") == pytest.approx(0.84, abs=1e-6)
    assert similarity.jaro_winkler_of("old anvil", "old widget") == pytest.approx(0.811111, abs=1e-6)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    assert get(text.sanitize(F.lit("Hello\0World\0"))) == "HelloWorld"
    assert get(text.sanitize(F.lit("\x01\x02"))) is None
    assert get(text.plain_number(F.lit(41.8))) == "41.8"
    assert get(text.plain_number(F.lit(100.0))) == "100"
    assert get(text.confidence(F.lit(None).cast("string"))) == 0.6
    assert get(text.stands_in(F.lit(41.8), F.lit("BLEU 41.8 on WMT"))) is True
    assert get(text.stands_in(F.lit(41.8), F.lit("BLEU is high"))) is False
    assert get(text.uuid5(F.lit("abc"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "abc"))
    assert get(text.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_edge_weights(spark):
    rows = [("A", 2021, "Alpha", "X", "F1", "S", 7800, 80, True, True), ("B", 2022, "Alpha", "X", "F1", "S", 7000, 60, True, False), ("B", 2022, "Beta", "X", "F1", "S", 6500, 70, False, False)]
    r = spark.createDataFrame(rows, "paper_id string, yr int, method_id string, dataset_id string, metric_id string, task_id string, value_cents long, conf long, verified boolean, is_sota boolean")
    edges = graph.weighted_edges(graph.edge_instances(r), 2022)
    assert edges.count() == 6
    assert graph.weighted_edges(graph.edge_instances(r), 2022, 75).count() == 0
    w = {(e["relation"], e["source"]): e["weight"] for e in edges.collect()}
    # papers x mean confidence x recency x evidence, with one statement for Alpha
    assert w["evaluates_on", "Alpha"] == pytest.approx(2 * 0.7 * 1.27 * 1.41)
    assert w["evaluates_on", "Beta"] == pytest.approx(1 * 0.7 * 1.25 * 1.03)
    pair = graph.compares(r).first()
    assert (pair["paper_count"], pair["mean_conf"]) == (1, 650_000)
    alpha = graph.outcome_bounds(r, ["method_id"]).filter("method_id = 'Alpha'").first()
    assert (alpha["best_cents"], alpha["worst_cents"], alpha["effect_cents"]) == (7800, 7000, 800)


def test_partial_rerank(spark):
    hits = spark.createDataFrame([("v1", 0.82, "relativity"), ("v2", 0.78, "the quantum entanglement experiments"), ("v3", 0.74, "content")], "vec_id string, score double, snippet string")
    got = [(r["vec_id"], r["blended"]) for r in search.partial_rerank(hits, "quantum entanglement").orderBy("rank").collect()]
    assert got == [("v2", 0.846), ("v1", 0.574), ("v3", 0.518)]


def test_components_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in resolve.components(edges).collect()}
    assert set(got[i] for i in range(21)) == {0} and got[101] == 100
    assert resolve.components(edges.limit(0)).count() == 0


def test_append_absent_treats_null_keys_as_equal(spark):
    have = spark.createDataFrame([(1, None)], "a int, b int")
    new = spark.createDataFrame([(1, None), (2, None), (2, None)], "a int, b int")
    assert [tuple(r) for r in tables.append_absent(have, new, ["a", "b"]).collect()] == [(2, None)]


def test_propose_pattern_is_case_insensitive(spark):
    df = spark.createDataFrame([("we propose FooNet-2 for fast translation, which",)], "t string")
    assert df.select(extract.proposed_method(F.col("t"))).first()[0] == "FooNet-2 for fast translation"


def test_stream_counts(spark, tmp_path, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/events.parquet")
    source.write.parquet(f"file://{tmp_path}/in")
    q = status.hourly_counts(spark.readStream.schema(source.schema).parquet(f"file://{tmp_path}/in")).writeStream.format("memory").queryName("hourly").outputMode("complete").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("hourly").agg(F.sum("n")).first()[0] == source.count()


def test_labels(spark):
    from quillgraph.functions import labels as L

    one = spark.range(1)
    get = lambda c: one.select(c.alias("v")).first()["v"]
    for t, low, good in [("The model", True, False), ("this", True, False), ("the proposed  Method", True, False), ("the presented approach", True, False), ("their work", True, False), ("results", False, True), ("authors", False, True), ("proposed", False, True), ("their", False, True),
                         ("ResNet-50", False, True), ("et al.", False, True), ("Phys. Rev.", False, False), ("[3] (4)", False, False), ("9 of 12345678", False, False), ("ab!?", False, False), ("a/b", False, True), (None, True, False)]:
        t = F.lit(t).cast("string")
        assert (get(L.low_info(t)), get(L.good_label(t))) == (low, good)
    for t, kind, fits in [("Accuracy", "metric", True), ("12 points", "metric", True), ("Winner", "metric", False), ("AUROC", "metric", True), ("hit@1", "metric", True), ("7 db gain", "metric", True), ("we use COCO", "dataset", False), ("reported gains", "task", False),
                          ("reporter gains", "task", True), ("COCO", "dataset", True), ("these reports", "", True), ("anything", None, True)]:
        assert get(L.fits_type(F.lit(t), F.lit(kind).cast("string"))) is fits, t
    for t, noise in [("Table 3: scores", True), ("our results here", True), ("cat or dog", True), ("two cats", True), ("Two cats", False), ("two cats run far", False), ("two 3d cats", False), ("COCO", False), ("big model", True), ("In table", True), ("see Section 3", True),
                     ("our approach", True), ("seesaw", False), ("the results", True), (None, True)]:
        assert get(L.noise_alias(F.lit(t).cast("string"))) is noise, t
    assert get(L.without_noise_lines(F.lit("Figure 2: a\n12 13\n\nkept 4\n  \nTable of contents\r\n tables follow \na <PAD> b\ninput input-input  layer 5"))) == "kept 4\ntables follow"
    for title, line, noise in [("Intro", "attention map of a", False), ("Self-attention", "attention map of a", True), ("Appendix B", "Attention maps", True), ("Intro", "attention weights", True), ("Intro", "attention and attention maps", True), ("Attention", "we pay attention", False)]:
        assert get(L.noise_line(F.lit(line), F.lit(title))) is noise, (title, line)
    words = [F.lit(x) for x in ("reports", "F1", "0.9", "%", "COCO", "QA", "It wins")]
    assert get(L.edge_summary(*words, F.lit(True))) == "It wins - F1 0.9% on COCO" and get(L.edge_summary(*words, F.lit(False))) is None
    span = lambda a, b, m: get(L.span_in(F.lit("abcdef"), F.lit(a), F.lit(b), F.lit(m)))
    assert tuple(span(-3, 2, "x")) == (0, 2) and tuple(span(5, 3, "cd")) == (2, 4) and span(9, 9, "x") is None


def test_selections_and_limits():
    assert graph.selection(" B, a,b", ["a", "b"], ["a"]) == ["b", "a"] and graph.selection(" ,", ["a", "b"], ["a"]) == ["a"]
    with pytest.raises(ValueError, match="unknown: c"):
        graph.selection("a,c", ["a", "b"], ["a"])
    assert [graph.limit_of(x, 150, 500) for x in (None, 0, 7, 9999)] == [150, 1, 7, 500]


def test_citation_tails(spark):
    from quillgraph.functions import names

    rows = [("COCO [1, 2]", "COCO"), ("COCO (Lin, 2014)", "COCO"), ("COCO (small)", "COCO (small)"), ("COCO vol. 3, no. 4", "COCO"), ("Graphene Phys. Rev. Lett. 12, 345 (1999) [7]", "Graphene"), ("Phys. Rev. Lett.", ""), ("BERT", "BERT")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [r["got"] for r in df.select(names.without_citations(F.col("t")).alias("got")).collect()] == [w for _, w in rows]


def test_fallback_only_without_rows(spark):
    a, b = spark.range(2), spark.range(5, 8)
    assert graph.else_fallback(a, b).count() == 2 and graph.else_fallback(a.limit(0), b).count() == 3


def test_aliases_are_trimmed_whatever_their_place(spark):
    rows = spark.createDataFrame([([" x ", "0 a", " ", "b 2", "b 2 ", "x"],)], "a array<string>")
    assert rows.select(text.clean_aliases(F.col("a"))).first()[0] == ["x", "0 a", "b 2"]
