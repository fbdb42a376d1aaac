"""Records: unions in order, first-wins merges, look-back, coercions, versions; values worked out by hand, with nulls, ties and empty tables."""

from pyspark.sql import functions as F

from quillgraph.operators import records


def _rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_ordered_union_keeps_first_appearance_and_breaks_ties_by_value(spark):
    rows = spark.createDataFrame([("a", "y", 2), ("a", "x", 2), ("a", "z", 1), ("a", "y", 1), ("a", None, 0), ("b", None, 1)], "k string, v string, at int")
    assert _rows(records.ordered_union(rows, ["k"], "v", "at"), "k") == [("a", ["y", "z", "x"])]


def test_first_known_takes_each_column_by_itself(spark):
    rows = spark.createDataFrame([(1, 2, None, "late"), (1, 1, None, "early"), (1, 3, "only", None), (2, 1, None, None)], "k int, at int, a string, b string")
    assert _rows(records.first_known(rows, ["k"], ["a", "b"], ["at"]), "k") == [(1, "only", "early"), (2, None, None)]


def test_terms_look_back_at_most_reach_rows(spark):
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(["BERT", "it", "this model", "they", "GPT", "our model"])] + [("t", 0, "it")], "g string, i int, t string")
    got = _rows(records.terms_resolved(rows, "g", ["i"], "t", reach=2).select("g", "i", "resolved"), "g", "i")
    assert [r[2] for r in got] == ["BERT", "BERT", "BERT", "they", "GPT", "GPT", "it"]


def test_writes_are_null_safe(spark):
    rows = spark.createDataFrame([(1, "a"), (1, None), (None, "a")], "id int, kind string")
    assert _rows(records.without(rows, id=1, kind="a"), F.col("id").asc_nulls_first()) == [(None, "a"), (1, None)]
    assert records.cleared(rows).count() == 0 and records.cleared(rows).schema == rows.schema
    added = records.inserted(rows, id=9)
    assert added.count() == 4 and _rows(added.filter("id = 9"), "id") == [(9, None)]
    assert records.with_optional(rows, "verified", "boolean").dtypes[-1] == ("verified", "boolean")
    assert records.with_optional(rows, "kind", "string").columns == ["id", "kind"]


def test_versions_follow_the_greatest_of_a_kind(spark):
    log = spark.createDataFrame([("task", 1), ("task", 3), ("metric", 0)], "kind string, version int")
    new = records.next_versions(log, "kind", "version").filter("state = 'new'")
    assert _rows(new, "kind") == [("metric", 1, "new"), ("task", 4, "new")]
    assert records.next_versions(records.cleared(log), "kind", "version").count() == 0


def test_slices_aliases_and_coercions(spark):
    rows = spark.createDataFrame([(0, "  ab cd  "), (1, "    "), (2, ""), (3, None), (4, "x\U0001f600 yz")], "i int, t string")
    got = dict(_rows(rows.select("i", records.trimmed_slice(F.col("t"), 1, 6).alias("s")), "i"))
    assert tuple(got[0]) == ("ab c", 2, 6) and got[1] is None and got[2] is None and got[3] is None and tuple(got[4]) == ("\U0001f600 yz", 1, 5)
    hit = dict(_rows(rows.select("i", records.first_alias(F.col("t"), ["zz", "cd", "ab"], 0, 100).alias("s")), "i"))
    assert tuple(hit[0]) == ("cd", 5) and hit[1] is None and hit[3] is None
    raw = spark.createDataFrame([('{"a": 1}',), ("[1]",), ("{",), ("",), (None,), ("3",)], "raw string")
    assert [r[0] for r in raw.select(records.object_text(F.col("raw"))).collect()] == ['{"a": 1}', None, None, None, None, None]


def test_degrees_count_each_neighbour_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "a"), ("a", "c")], "s string, t string")
    assert _rows(records.degrees(edges, "s", "t"), "node") == [("a", 2), ("b", 1), ("c", 1)]


def test_names_of_uploads_and_descriptions(spark):
    rows = spark.createDataFrame([(7, "My Paper (1).PDF", None), (8, "x", "application/pdf"), (9, "x.pdf.exe", " ")], "i int, name string, kind string")
    got = _rows(rows.select("i", records.upload_name(F.col("i"), F.col("name")), records.is_pdf(F.col("name"), F.col("kind")), records.described(F.col("kind"), F.col("name"))), "i")
    assert got == [(7, "papers/7-my-paper-1-.pdf", True, "My Paper (1).PDF"), (8, "papers/8-x", True, "application/pdf · x"), (9, "papers/9-x.pdf.exe", False, "x.pdf.exe")]
