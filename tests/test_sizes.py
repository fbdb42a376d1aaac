"""What a task holds does not grow with the tables."""

from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import graph, insights, linking, segment, structure, verify
from quillgraph.plans import adapt, catalog, tier_queries
from quillgraph.sources import readers


def test_shuffles_begin_with_many_parts(spark, sf_dir):
    spark.conf.unset(readers.INITIAL_KEY)
    readers.table(spark, sf_dir, "orders")
    assert int(spark.conf.get(readers.INITIAL_KEY)) == readers.INITIAL_PARTS
    spark.conf.set(readers.INITIAL_KEY, 7)  # a caller's own number stays
    try:
        readers.table(spark, sf_dir, "orders")
        assert spark.conf.get(readers.INITIAL_KEY) == "7"
    finally:
        spark.conf.unset(readers.INITIAL_KEY)


def test_parts_of_cells_are_numbers_only(spark):
    """Each value finds the first cell that holds it, and few of a cell's parts are rows."""
    cell = "a 1.17% of -20,5 or 0.0450 and 300 % x 12345678901234.5"
    cells = spark.createDataFrame([(1, 0, r, 1, c) for r, c in enumerate([cell, "7", None, ""])], "section long, table_id int, row int, col int, cell string")
    values = [1.17, 17.0, -20.5, 20.5, 0.045, 0.0, 300.0, 30.0, 45.0, 12345678901234.5, 7.0, 99.0]
    measures = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "section long, m int, value double")
    found = verify.table_matches(measures, cells, "section", "m")
    assert {r["m"]: r["row"] for r in found.collect()} == {i: 0 for i in range(11)}
    spelled = r"^-?(?:0|[1-9][0-9]*)(?:[.,][0-9]{0,3}[1-9])?(?: ?%)?$"
    assert verify.SPELLING == spelled
    odd = [0.0, -0.0, -0.00001, 1e15, 123.4567, 100.0, -5.5, 0.1, 1e-3, 99999.99999]
    df = spark.createDataFrame([(v,) for v in odd], "v double").select(F.explode(X.number_spellings(F.col("v"))).alias("s"))
    assert df.filter(~F.col("s").rlike(verify.SPELLING)).count() == 0


def test_pages_are_walked_in_small_batches(spark):
    html = "<div>" + "<p>some text</p>" * 3000 + "</div>"
    pages = spark.createDataFrame([(i, html if i % 2 else None) for i in range(40)], "page_id long, html string").coalesce(1)
    nodes = structure.html_nodes(pages)
    assert nodes.count() == 20 * 3001 and nodes.groupBy("page_id").count().count() == 20
    old, structure.OUT_BYTES = structure.OUT_BYTES, 1000
    try:
        few = structure.html_nodes(pages.filter("page_id < 4"))
        sizes = few.mapInArrow(lambda bs: bs, few.schema).count()
        assert sizes == 2 * 3001
    finally:
        structure.OUT_BYTES = old
    assert int(spark.conf.get(readers.BATCH_KEY).rstrip("bB")) <= readers.BATCH_BYTES


def test_sentences_of_short_and_long_texts_agree(spark):
    texts = ["", None, "..!", "?. A b. \U0001f600 c!? d", "x", " . . ", "One. Two.\n\nThree", "a. " * 100, "é. " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(tuple(r) for r in segment.sentences(docs).collect())
    want = [(d, i, m.group().strip(), m.start()) for d, t in enumerate(texts) for i, m in enumerate(segment.RUN.finditer(t or "")) if m.group().strip()]
    assert got == want


def test_links_of_papers_of_few_and_many_keys_agree(spark, monkeypatch):
    """Both ways of looking up a paper's keys give the same links, and words are rows for crowded papers only."""
    e = spark.createDataFrame([(p, i, k, s, t, False) for p in (1, 2) for i, (k, s, t) in enumerate([("alpha beta", "s", 5), ("beta", "s", 90), ("a b c d", "s", 3), ("no", "s", 1)])], "paper long, ordinal int, key string, section string, start int, in_table boolean")
    around = ["On Alpha-Beta it", "betas", "a b c d", "no one", None, "the beta", "alpha beta gamma beta"]
    r = spark.createDataFrame([(p, f"{p}-{i}", "s", 10 * i, a) for p in (1, 2, 3) for i, a in enumerate(around)], "paper long, id string, section string, pos int, around string")
    got = []
    for many in (64, 3, 0):
        monkeypatch.setattr(linking, "MANY", many)
        got.append(sorted(map(tuple, linking.link_results(r, e).collect())))
    assert got[0] == got[1] == got[2]
    assert ("1-0", 0, "named") in got[0] and ("1-5", 1, "named") in got[0] and ("1-6", 0, "named") in got[0] and ("1-2", 3, "near") not in got[0][:1] and ("3-0", 0, "near") in got[0]


def test_edges_of_results_are_made_behind_one_shuffle(spark, sf_dir, tmp_path, monkeypatch):
    """Edges of few and of crowded methods agree with those of exploded rows; the former are dealt by method once and aggregated in place."""
    rows = adapt.results(spark, sf_dir).withColumn("method_id", F.when(F.col("method_id") % 5 > 0, F.col("method_id")))
    want = sorted(map(tuple, graph.weighted_edges(graph.edge_instances(rows), 2001).collect()))
    each = rows.groupBy("method_id").count().agg(F.percentile("count", 0.5)).first()[0]
    for i, crowded in enumerate((10**9, int(each), 0)):
        got = insights.edges_of_results(rows, 2001, f"{tmp_path}/{i}", crowded=crowded)
        assert sorted(map(tuple, got.collect())) == want
    monkeypatch.setattr(insights, "DEALT", 1000)
    few, _ = insights._dealt_by_method(rows, f"{tmp_path}/few", 10**9)
    edges = graph.weighted_edges(graph.edge_instances(few), 2001)
    edges.collect()
    plan = edges._jdf.queryExecution().executedPlan().toString()
    plan = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning(cast(method_id") == 1 and "Exchange hashpartitioning(relation" not in plan and "Exchange hashpartitioning(source" not in plan


def test_overview_reads_edges_once_made(spark, sf_dir):
    """Nodes and edges come from one written table of edges, not from results each."""
    plan = catalog.graph_overview_edges(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.replace("Generate explode(array(struct(node", "") and "paper_id" not in plan


def test_lines_become_texts_in_parts_by_their_number(spark, sf_dir, monkeypatch):
    """A small file of many lines is no single task: a line costs far more than its bytes."""
    monkeypatch.setattr(tier_queries, "_LINES", 1000)
    sections = tier_queries._sections(spark, sf_dir)[0]
    sizes = [r["count"] for r in sections.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == sum(sizes) // 1000 + 1 and max(sizes) < 2000


def test_stripped_texts_equal_the_pattern(spark):
    odd = ["", " ", "a", " a b ", "\t\n\x0b\f\r a\x0bb \r\n", "\xa0a\xa0", "\x1ca\x1f", " \U0001f600 ", "a\n\n", None]
    rows = spark.createDataFrame([(t,) for t in odd], "t string")
    assert rows.filter(~X.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", X.EDGES, ""))).count() == 0
