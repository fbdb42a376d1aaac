"""What edges show, against a plain version; layouts on awkward files; the first tier on texts by hand."""

import json
import random

from pyspark.sql import functions as F

from quillgraph.operators import graph as K
from quillgraph.operators import insights as I
from quillgraph.operators import tier1 as T
from quillgraph.sources import layout

ORDER = ["paper_id", "value_cents", "conf"]
SCHEMA = "paper_id int, yr int, method_id int, dataset_id string, metric_id string, task_id string, value_cents long, conf long, verified boolean, is_sota boolean, claim string, statement string, snippets array<string>"


def result(r, paper, method=1):
    pick = lambda *x: r.choice(x)
    value = r.randint(1, 9)
    return (paper, 2000, method, pick("d", "e", None), pick("m", None), pick("t", None), pick(value, None), r.randint(60, 99), pick(True, False, None), True, pick(None, f"claim {value}"), pick(None, f"said {paper}"), pick(None, [], [f"a {paper}", None, f"b {value}"]))


def shown_by_hand(rows, relation, target, column):
    """Lists of texts of one edge, in plain Python; rows in order."""
    rows = [r for r in rows if r[column] == target]
    said, seen = [], set()
    for r in rows:
        where = f" on {r['dataset_id']}" if r["dataset_id"] else f" for {r['task_id']}" if r["task_id"] else ""
        value = "" if r["value_cents"] is None else f" {r['value_cents']}%"
        s = {"evaluates_on": f"Evaluated on {r['dataset_id']}", "reports": f"{r['metric_id']}{value}{where}", "proposes": f"Targets {r['task_id']}"}[relation]
        s = f"{r['claim']} - {s}" if r["claim"] else s
        if r["verified"] is not False and (s, r["paper_id"]) not in seen:
            seen.add((s, r["paper_id"]))
            said.append(s)
    values = [r["value_cents"] for r in rows if r["value_cents"] is not None]
    delta = max(values) - min(values) if len(set(values)) > 1 else None
    return said[:12], [x for r in rows for x in r["snippets"] or []][:12], [r["statement"] for r in rows if r["statement"]][:12], delta


def test_edges_show_what_a_plain_version_shows(spark):
    r = random.Random(5)
    # an order without ties: rows of one place would be interchangeable
    rows = {(x[0], x[6] or -1, x[7]): x for x in (result(r, r.randint(1, 40)) for _ in range(400))}
    df = spark.createDataFrame([rows[k] for k in sorted(rows)], SCHEMA)
    plain = [x.asDict() for x in df.collect()]
    got = {(x["relation"], x["source"], x["target"]): x for x in I.edge_details(K.edge_instances(df.repartition(5)), ORDER, "%").collect()}
    assert {k[0] for k in got} == set(K.RELATIONS)
    for (relation, _, target), x in got.items():
        want = shown_by_hand(plain, relation, target, K.RELATIONS[relation])
        assert ([i["text"] for i in x["insights"]], [i["text"] for i in x["evidence"]], [i["text"] for i in x["statements"]], x["delta"]) == want


def test_a_hot_edge_is_cut_before_the_shuffle(spark):
    rows = spark.range(20_000).select((F.col("id") % 7_000).cast("int").alias("paper_id"), F.lit(2000).alias("yr"), F.lit(1).alias("method_id"), F.lit("d").alias("dataset_id"), F.lit(None).cast("string").alias("metric_id"), F.lit(None).cast("string").alias("task_id"), F.col("id").alias("value_cents"), F.lit(90).cast("long").alias("conf"), F.lit(True).alias("verified"), F.lit(False).alias("is_sota"), F.lit(None).cast("string").alias("claim"), F.lit(None).cast("string").alias("statement"), F.array(F.lit("x")).alias("snippets"))
    details = I.edge_details(K.edge_instances(rows), ORDER)
    plan = details._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    x = details.first()
    assert len(x["insights"]) == len(x["evidence"]) == 12 and x["statements"] == [] and x["delta"] == 19_999
    assert [i["paper_id"] for i in x["insights"]] == list(range(12)) and [i["paper_id"] for i in x["evidence"]] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3]


def test_details_of_results_move_each_result_once(spark, tmp_path):
    """Both routes show what edge_details() shows, repeats of a place too; few methods' results are shuffled once, and no texts with them."""
    r = random.Random(7)
    rows = [result(r, r.randint(1, 30), r.choice([1, 1, 2, 3, None])) for _ in range(500)]
    df = spark.createDataFrame(rows + rows[:200], SCHEMA)
    texts, order = ["claim", "statement", "snippets"], [*ORDER, "dataset_id", "metric_id", "task_id", "verified", "claim", "statement", "snippets"]
    plain = lambda d: sorted(map(repr, d.select(sorted(d.columns)).collect()))
    want = plain(I.edge_details(K.edge_instances(df.repartition(3)), order, "%"))
    for k, crowded in enumerate((10**6, 150, 0)):
        got = I.details_of_results(df, lambda d: d, order, f"file://{tmp_path}/{k}", "%", crowded=crowded)
        assert plain(got) == want and len(want) == 12
    made = lambda d: d.withColumns({c: F.lit(None).cast("array<string>" if c == "snippets" else "string") for c in texts})
    dealt = df.drop(*texts).repartition(F.col("method_id").cast("string"))
    plan = I._details_in_place(K.edge_instances(dealt), made, ORDER, None, 12)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" in plan


def test_results_dealt_by_paper_meet_without_a_shuffle_by_paper(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "DEALT", 10)
    r = random.Random(8)
    df = spark.createDataFrame([result(r, p, m) for p in range(30) for m in (1, 2, None)], SCHEMA)
    edges = K.weighted_edges(K.edge_instances(I.dealt_by_paper(df, f"file://{tmp_path}/r")), 2001)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # results, and edges of all papers
    assert sorted(map(repr, edges.collect())) == sorted(map(repr, K.weighted_edges(K.edge_instances(df), 2001).collect()))


def test_response_of_few_and_of_no_rows(spark, tmp_path):
    r = random.Random(6)
    df = spark.createDataFrame([result(r, p, m) for p in range(30) for m in range(4)], SCHEMA)
    out = I.response(K.edge_instances(df), ORDER, 2001, f"file://{tmp_path}/a", nodes=5, edges=3)
    nodes, edges, meta = out["nodes"].collect(), out["edges"].collect(), out["meta"].first()
    assert len(nodes) == 5 == meta["node_count"] and len(edges) == 3 == meta["edge_count"] and meta["has_more"] and (meta["node_limit"], meta["edge_limit"], meta["min_conf"]) == (5, 3, 60)
    ids = {n["id"] for n in nodes}
    assert all(f"method:{e['source']}" in ids and f"{K.TARGET_TYPES[e['relation']]}:{e['target']}" in ids for e in edges)
    none = I.response(K.edge_instances(df.limit(0)), ORDER, 2001, f"file://{tmp_path}/b")
    assert none["nodes"].count() == none["edges"].count() == 0 and none["meta"].first()["edge_total"] == 0 and not none["meta"].first()["has_more"]


def block(text, box=None, size=10.0, flags=0, kind=0):
    return {"type": kind, "bbox": box, "lines": [{"spans": [{"text": t, "size": size, "flags": flags} for t in line.split("|")]} for line in text.split("\n")]}


def test_layouts_on_awkward_files(spark, tmp_path):
    page = {
        "blocks": [
            block("second", [5, 9.001]), block("first |part\nsecond line", [5, 2], flags=6), block("tie b", [1, 9.004]), block("tie c", [1, 9.004]),
            block("picture", kind=1), block(" \x01 "), {"lines": None}, {"lines": [{"spans": None}]}, {"lines": [{"spans": [{"text": "no size"}]}]},
        ],
        "tables": [[["a", None, " \x02b "], [], None, ["", 5]], [], None],
    }
    docs = [{"name": "x", "pages": [page, {}, {"blocks": [], "tables": None}, {"blocks": [block("last", [0])]}], "more": 1}, {"name": "y"}, {"pages": [page]}]
    lines = [*map(json.dumps, docs), "{no json", "[1, 2]", "", "3"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    (tmp_path / "in/b.json").write_text("")
    d = layout.documents(spark, f"file://{tmp_path}/in")
    assert layout.malformed(d).count() == 4
    got = [(x["name"], x["page"], x["block"], x["text"], x["font"], x["bold"]) for x in layout.blocks(d).collect()]
    assert got == [("x", 0, 0, "no size", 0.0, False), ("x", 0, 1, "first part\nsecond line", 10.0, True), ("x", 0, 2, "tie b", 10.0, False), ("x", 0, 3, "tie c", 10.0, False), ("x", 0, 4, "second", 10.0, False), ("x", 3, 0, "last", 10.0, False)]
    cells = [tuple(x) for x in layout.cells(d).collect()]
    assert cells == [("x", "table_1_1", 1, 0, 0, "a"), ("x", "table_1_1", 1, 0, 2, "b"), ("x", "table_1_1", 1, 3, 1, "5")]
    (tmp_path / "one").mkdir()
    (tmp_path / "one/a.json").write_text(json.dumps(docs[0], indent=1))
    assert layout.blocks(layout.documents(spark, f"file://{tmp_path}/one", whole=True)).count() == 6
    assert [(x["paper"], x["text"]) for x in T.table_texts(layout.cells(d)).collect()] == [("x", "a b 5")]


def test_first_tier_on_texts_by_hand(spark):
    sections = spark.createDataFrame([
        ("p", "s1", 1, "We propose DeepNet. It was evaluated on Corpus A. BLEU rises to 31.5 on Corpus A."), ("p", "s2", 2, "Others use OldNet here. F1 was 80% there."), ("p", "s3", 3, None), ("p", "s4", 4, " \x01 "),
        ("q", "s5", 1, "Accuracy of 5."), (None, "s6", 1, "ROUGE is 7 with oldnet."),
    ], "paper string, section string, place int, text string")
    lexicon = spark.createDataFrame([("method", "OldNet", "oldnet"), ("task", "Parsing", "parsing"), ("task", "Tagging", "pos tagging"), ("method", "...", "...")], "kind string, name string, alias string")
    tables = spark.createDataFrame([("p", "t1", 1, "POS tagging 3 parsing 4")], "paper string, section string, place int, text string")
    out = T.extract(sections, lexicon, tables)
    known = sorted((x["paper"] or "", x["kind"], x["ordinal"], x["name"], x["mentions"], x["in_table"]) for x in out["entities"].collect())
    assert known == [("", "method", 1, "OldNet", 1, False), ("p", "dataset", 1, "Corpus A", 1, False), ("p", "method", 1, "DeepNet", 1, False), ("p", "method", 2, "OldNet", 1, False), ("p", "task", 1, "Tagging", 1, True), ("p", "task", 2, "Parsing", 1, True)]
    got = {x["section"]: x for x in out["results"].collect()}
    assert set(got) == {"s1", "s2", "s5", "s6"}
    links = lambda s: tuple(got[s][c] for c in ("metric", "value", "method", "method_how", "dataset", "dataset_how", "task", "task_how"))
    assert links("s1") == ("BLEU", 31.5, "DeepNet", "named", "Corpus A", "named", "Tagging", "tabled")
    assert links("s2") == ("F1", 80.0, "OldNet", "named", "Corpus A", "only", "Tagging", "tabled")
    assert links("s5") == ("ACCURACY", 5.0, None, None, None, None, None, None)
    assert T.extract(sections.limit(0), lexicon)["results"].count() == 0
