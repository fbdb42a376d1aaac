"""Windows, section choice, linking, phrases and text vectors against cases by hand and plain Python."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import kinds as P
from quillgraph.operators import linking as L
from quillgraph.operators import search as V
from quillgraph.operators import sectioning as G
from quillgraph.operators import segment


def _windows(sizes, budget, overlap, most):
    """The greedy walk, sentence by sentence."""
    out, start = [], 0
    while start < len(sizes) and len(out) < most:
        end, chars = start, 0
        while end < len(sizes) and (end == start or chars + sizes[end] <= budget):
            chars += sizes[end]
            end += 1
        out.append((len(out) + 1, start, end - 1, chars))
        if end >= len(sizes):
            break
        start = end - overlap if end - overlap > start else end
    return out


@pytest.mark.parametrize("overlap,most", [(0, 3), (1, 3), (2, 5)])
def test_sentence_windows_equal_the_walk(spark, overlap, most):
    texts = {"a": [10, 150, 3, 40, 40, 200, 1, 60, 20, 20, 20], "b": [500], "c": [1] * 400, "d": [118, 119, 120, 121], "e": []}
    rows = [(k, i, "x" * n) for k, v in texts.items() for i, n in enumerate(v)]
    df = spark.createDataFrame(rows, "s string, i int, sentence string")
    got = sorted((r["s"], r["chunk"], r["first"], r["last"], r["chars"]) for r in G.sentence_windows(df, "s", "i", budget=121, overlap=overlap, most=most).collect())
    want = sorted((k, *w) for k, v in texts.items() for w in _windows([len(f"[{i}] ") + n + 1 for i, n in enumerate(v)], 121, overlap, most))
    assert got == want


def test_sentences_keep_offsets_and_repeated_ids(spark):
    df = spark.createDataFrame([(1, " One. Two?! \n Three"), (1, "A.B"), (2, None), (3, ""), (4, "...")], "doc_id int, text string")
    got = sorted((r["doc_id"], r["idx"], r["sentence"], r["start"]) for r in segment.sentences(df).collect())
    assert got == [(1, 0, "A.", 0), (1, 0, "One.", 0), (1, 1, "B", 2), (1, 1, "Two?!", 5), (1, 2, "Three", 11)]


def test_heading_rules(spark):
    rows = [("RESULTS", 10.0, 10.0, False, 10.0), ("results", 10.0, 10.0, False, 10.0), ("3 Setup", 10.0, 10.0, False, 10.0), ("plain words", 12.0, 12.0, False, 10.0), ("plain words", 10.0, 12.5, False, 10.0),
            ("plain words", 10.0, 10.0, True, 10.0), ("plain words", 10.5, 10.0, True, 10.0), ("plain words", None, None, None, None), ("a1", 30.0, 30.0, True, 10.0), (None, 30.0, 30.0, True, 10.0), ("x " * 90, 30.0, 30.0, True, 10.0)]
    df = spark.createDataFrame(rows, "text string, font double, largest double, bold boolean, median double")
    got = [r[0] for r in df.select(G.is_heading(*[F.col(c) for c in df.columns])).collect()]
    assert got == [True, True, True, True, True, False, True, False, False, False, False]


def test_choice_of_sections(spark):
    cand = [("a", 1, 0, "x" * 30), ("a", 1, 1, "x" * 20), ("a", 2, 0, "x" * 99), ("b", 1, 0, "x" * 99), ("b", 3, 0, "x" * 100), ("c", 1, 0, "x" * 9), ("c", 1, 1, "x" * 9), ("c", 1, 2, "x" * 9), ("d", 1, 0, "x"), ("d", 1, 1, "x"), ("d", 2, 0, "y"), ("d", 3, 0, "z")]
    c = spark.createDataFrame(cand, "doc string, strategy int, section int, content string")
    t = spark.createDataFrame([(d, 100) for d in "abcd"], "doc string, total int")
    got = {(r["doc"], r["strategy"]) for r in G.choose_sections(c, t, "doc").collect()}
    assert got == {("a", 1), ("b", 3), ("c", 1), ("d", 3)}


def test_block_sections_with_front_matter(spark):
    b = spark.createDataFrame([("p", 1, "Title", False), ("p", 2, "One", True), ("p", 3, "body", False), ("p", 4, "", False), ("p", 5, "more", False), ("p", 6, "Empty", True)], "doc string, n int, text string, is_heading boolean")
    got = sorted((r["section"], r["title"], r["content"]) for r in G.block_sections(b, "doc", "n").collect())
    assert got == [(0, None, "Title"), (1, "One", "body\nmore")]


def test_links_in_order_of_trust(spark):
    e = spark.createDataFrame([("p", 1, "set one", "s", 900, False), ("p", 2, "one", "s", 0, True), ("q", 3, "far", "s2", 0, False), ("r", 4, "xx", "s3", 100, False), ("r", 5, "yy", "s3", 5000, False)], "paper string, ordinal int, key string, section string, start int, in_table boolean")
    r = spark.createDataFrame([("p", 1, "s", 0, "F1 on Set-One."), ("p", 2, "s", 0, "F1"), ("q", 3, "s2", 0, ""), ("r", 4, "s3", 5100, "someone"), ("r", 5, "s3", 2000, None), ("z", 6, "s9", 0, "one")], "paper string, id int, section string, pos int, around string")
    got = {x["id"]: (x["entity"], x["how"]) for x in L.link_results(r, e).collect()}
    assert got == {1: (1, "named"), 2: (2, "tabled"), 3: (3, "only"), 4: (5, "near"), 5: (None, None), 6: (None, None)}


def test_evaluated_on(spark):
    said = {"Evaluated on SQuAD 2.0 and more": "SQuAD 2", "we trained the net on WMT-14, then": "WMT-14", "tested on a b c with d": "a b c", "measured in the andes on rock": "rock", "on its own": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in said.items()], "t string, want string")
    assert all(r[0] == r[1] for r in df.select("want", L.evaluated_on(F.col("t"))).collect())


def test_fallback_edges_look_up_names(spark):
    t = spark.createDataFrame([(1, "uses", "Big-Net", "Set A", 80), (2, "uses", "big net", "set  a", 60), (2, "uses", " ", "x", 60), (3, None, "a", "b", 1)], "paper int, relation string, source string, target string, conf long")
    c = spark.createDataFrame([(7, "BIG NET"), (5, "big net"), (9, "other")], "id int, name string")
    rows = L.fallback_edges(t, c).collect()
    assert len(rows) == 1 and rows[0]["source"] == "concept:5" and rows[0]["papers"] == 2 and rows[0]["mean_conf"] == 700000 and len(rows[0]["target"]) == 36


def test_phrase_kinds_and_names(spark):
    df = spark.createDataFrame([(None,), ("",), ("we",), ("ab",), ("a b",), ("NER task",)], "t string")
    got = [tuple(r["k"]) for r in df.select(P.phrase_kinds(F.col("t")).alias("k")).collect()]
    assert got == [(False,) * 4] * 3 + [(False,) * 4, (True, True, True, False), (True, True, True, False)]
    names = spark.createDataFrame([(None,), ("Result",), (" TASK",), ("zebra",)], "t string").select(P.node_kind(F.col("t")), P.relation_name(F.col("t"))).collect()
    assert [tuple(r) for r in names] == [("concept", None), ("finding", None), ("task", None), ("concept", None)]


def test_vectors_of_texts(spark):
    df = spark.createDataFrame([("one",), ("two",), ("one",), (" ",), (None,)], "text string")
    stored = df.filter("text = 'two'").select(F.sha2("text", 256).alias("hash"), V.hash_features(F.col("text")).alias("vector"))
    got = V.ingest(df, stored).collect()
    assert sorted(r["is_new"] for r in got) == [False, True] and all(len(r["vector"]) == 64 and all(-128 <= x < 128 for x in r["vector"]) for r in got)
    ids = spark.createDataFrame([(1, "one"), (2, "two"), (3, None)], "id int, t string")
    top = V.search_text(ids, "two", 3, "id", "t").collect()
    assert (top[0]["id"], top[0]["score"]) == (2, 1.0) and len(top) == 2
