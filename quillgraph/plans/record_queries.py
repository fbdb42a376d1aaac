"""Queries over records of entities, evidence, payloads and audits, and the SQL that states the same. Merged into the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import labels as L
from quillgraph.functions import text as X
from quillgraph.functions.similarity import jaro
from quillgraph.operators import graph as K
from quillgraph.operators import records as D
from quillgraph.plans.adapt import RESULTS_SQL, results
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table

QUERIES, query = collector()


def n_rows():
    return F.count(F.lit(1))


def _case(key, *values):
    """The value whose number is the key's remainder."""
    k = F.col(key) % len(values)
    return F.coalesce(*[F.when(k == i, v if isinstance(v, F.Column) else F.lit(v)) for i, v in enumerate(values) if v is not None])


# ---- writes as set operations


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'ANTARCTICA'")
def row_inserted(spark, sf):
    return D.inserted(table(spark, sf, "region"), r_regionkey=99, r_name="ANTARCTICA").select("r_regionkey", "r_name")


@query("SELECT 'nation' AS name, 0::BIGINT AS n UNION ALL SELECT 'region', 0 UNION ALL SELECT 'customer', count(*) FROM customer")
def graph_cleared(spark, sf):
    counted = lambda name, rows: rows.agg(n_rows().alias("n")).select(F.lit(name).alias("name"), "n")
    emptied = [counted(t, D.cleared(table(spark, sf, t))) for t in ("nation", "region")]
    return emptied[0].unionByName(emptied[1]).unionByName(counted("customer", table(spark, sf, "customer")))


@query("SELECT event_id, user_id FROM events WHERE user_id IS DISTINCT FROM 8")
def evidence_deleted(spark, sf):
    return D.without(table(spark, sf, "events"), user_id=8).select("event_id", "user_id")


@query(
    """WITH log AS (SELECT DISTINCT event_type AS kind, json_extract_string(props, '$.k')::INTEGER % 5 AS version FROM events)
SELECT kind, version, 'stored' AS state FROM log UNION ALL SELECT kind, max(version) + 1, 'new' FROM log GROUP BY 1"""
)
def audit_versions(spark, sf):
    log = table(spark, sf, "events").select(F.col("event_type").alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 5).alias("version")).distinct()
    return D.next_versions(log, "kind", "version")


@query(
    """SELECT event_type AS kind, (['hard', 'llm', 'manual'])[event_id % 3 + 1] AS source, count(*)::BIGINT AS n, max(greatest(0, least(1, (json_extract_string(props, '$.k')::INTEGER - 10) / 80)))::DOUBLE AS top_score
FROM events WHERE event_id % 3 < 2 GROUP BY 1, 2"""
)
def adjudications_by_type(spark, sf):
    score = X.clamp((F.get_json_object("props", "$.k").cast("int") - 10) / 80)
    rows = table(spark, sf, "events").select(F.col("event_type").alias("kind"), _case("event_id", "hard", "llm", "manual").alias("source"), score.alias("score"))
    return rows.filter(F.col("source").isin("hard", "llm")).groupBy("kind", "source").agg(n_rows().alias("n"), F.max("score").alias("top_score"))


@query("SELECT l_orderkey AS paper_id, concat_ws('|', l_suppkey, l_returnflag, CAST(l_extendedprice AS DECIMAL(12, 2))) AS result_key, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2")
def result_keys(spark, sf):
    key = F.concat_ws("|", F.col("l_suppkey").cast("string"), "l_returnflag", F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id"), key.alias("result_key")).agg(n_rows().alias("n"))


@query("SELECT l_orderkey, l_suppkey, l_returnflag, NULL::BOOLEAN AS verified FROM lineitem WHERE l_orderkey = 7")
def results_without_verdict(spark, sf):
    rows = table(spark, sf, "lineitem").filter("l_orderkey = 7").select("l_orderkey", "l_suppkey", "l_returnflag")
    return D.with_optional(rows, "verified", "boolean")


# ---- coercions


RAW_SQL = """raw AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '{"a": "' || p_name || '"}' WHEN 1 THEN '[1, 2]' WHEN 2 THEN p_name WHEN 3 THEN '' WHEN 5 THEN '"text"' END AS raw FROM part)"""


@query(
    f"""WITH {RAW_SQL}, t AS (SELECT *, json_type(CASE WHEN json_valid(raw) THEN raw END) AS kind FROM raw)
SELECT p_partkey, CASE WHEN kind = 'OBJECT' THEN raw END AS metadata, CASE WHEN kind = 'OBJECT' THEN raw ELSE '{{}}' END AS provenance FROM t"""
)
def coerced_payloads(spark, sf):
    raw = _case("p_partkey", F.concat(F.lit('{"a": "'), "p_name", F.lit('"}')), "[1, 2]", F.col("p_name"), "", None, '"text"')
    found = D.object_text(raw)
    return table(spark, sf, "part").select("p_partkey", found.alias("metadata"), F.coalesce(found, F.lit("{}")).alias("provenance"))


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size || '.5' WHEN 2 THEN p_name WHEN 3 THEN '' WHEN 4 THEN '6BA7B810-9dad-11d1-80b4-' || lpad(p_partkey::VARCHAR, 12, '0') END AS t FROM part)
SELECT p_partkey, TRY_CAST(t AS DOUBLE) AS number, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS whole, coalesce(TRY_CAST(t AS UUID) IS NOT NULL, false) AS uuid FROM t"""
)
def parsed_values(spark, sf):
    size = F.col("p_size").cast("string")
    t = _case("p_partkey", size, F.concat(size, F.lit(".5")), F.col("p_name"), "", F.concat(F.lit("6BA7B810-9dad-11d1-80b4-"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")), None)
    return table(spark, sf, "part").select("p_partkey", t.try_cast("double").alias("number"), D.whole_number(t).alias("whole"), D.is_uuid(t).alias("uuid"))


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '  ' || p_name || chr(10) || p_brand WHEN 1 THEN upper(p_name) || ' (' || p_type || ')' ELSE p_brand || chr(9) || '-' END AS t FROM part)
SELECT p_partkey, trim(regexp_replace(t, '\\s+', ' ', 'g')) AS flat, lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS surface, trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_') AS ident FROM t"""
)
def text_keys(spark, sf):
    t = _case("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("\n"), "p_brand"), F.concat(F.upper("p_name"), F.lit(" ("), "p_type", F.lit(")")), F.concat("p_brand", F.lit("\t-")))
    return table(spark, sf, "part").select("p_partkey", X.collapse(t).alias("flat"), F.lower(X.collapse(t)).alias("surface"), D.identifier(t).alias("ident"))


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' as in and [A1]' WHEN 1 THEN p_name || ' of 2024' ELSE '[' || p_name || '] shown' END AS cleaned FROM part"""
)
def texts_without_citations(spark, sf):
    p = F.col("p_name")
    t = _case("p_partkey", F.concat(p, F.lit(" as in [3,  4] and [A1]")), F.concat(p, F.lit(" [12] of  2024 [1,2,3]")), F.concat(F.lit("["), p, F.lit("] shown [7]")))
    return table(spark, sf, "part").select("p_partkey", D.without_number_citations(t).alias("cleaned"))


@query(
    """WITH n AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Paper ' || page_id || '.PDF' WHEN 1 THEN 'a/b_' || page_id || '.pdf' WHEN 2 THEN 'notes.html' ELSE 'scan' END AS name, CASE WHEN page_id % 8 = 3 THEN 'Application/PDF' END AS kind FROM pages)
SELECT page_id, lower(name) LIKE '%.pdf' OR coalesce(lower(kind) = 'application/pdf', false) AS pdf, 'papers/' || page_id || '-' || regexp_replace(lower(name), '[^a-z0-9.]+', '-', 'g') AS object_name, coalesce(kind, 'application/octet-stream') AS content_type FROM n"""
)
def upload_names(spark, sf):
    i = F.col("page_id").cast("string")
    name = _case("page_id", F.concat(F.lit("Paper "), i, F.lit(".PDF")), F.concat(F.lit("a/b_"), i, F.lit(".pdf")), "notes.html", "scan")
    kind = F.when(F.col("page_id") % 8 == 3, "Application/PDF")
    return table(spark, sf, "pages").select("page_id", D.is_pdf(name, kind).alias("pdf"), D.upload_name(F.col("page_id"), name).alias("object_name"), F.coalesce(kind, F.lit("application/octet-stream")).alias("content_type"))


@query(
    """SELECT p_partkey, concat_ws(' · ', CASE WHEN p_partkey % 2 = 0 THEN p_brand END, CASE WHEN p_partkey % 3 > 0 THEN p_type END, p_name) AS description, (p_size * 100 + p_partkey)::BIGINT AS absolute FROM part"""
)
def provenance_records(spark, sf):
    parts = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" "), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")), F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", D.described(*parts).alias("description"), (F.col("p_size") * 100 + F.col("p_partkey")).alias("absolute"))


@query(
    f"""WITH {RESULTS_SQL} SELECT paper_id, method_id, '{{' || concat_ws(',', '"metric":"' || metric_id || '"', CASE WHEN metric_id <> 'N' THEN '"value":' || value_cents END, CASE WHEN is_sota THEN '"sota":true' END) || '}}' AS payload FROM res"""
)
def results_serialised(spark, sf):
    fields = F.struct(F.col("metric_id").alias("metric"), F.when(F.col("metric_id") != "N", F.col("value_cents")).alias("value"), F.when(F.col("is_sota"), F.lit(True)).alias("sota"))
    return results(spark, sf).select("paper_id", "method_id", F.to_json(fields).alias("payload"))


@query(
    """SELECT p_partkey, p_partkey % 10 > 0 AS valid, CASE WHEN p_partkey % 10 > 0 THEN unnest(list_distinct([p_name, upper(p_name), p_brand])) END AS phrase FROM part WHERE p_partkey % 10 > 0
UNION ALL SELECT p_partkey, false, NULL FROM part WHERE p_partkey % 10 = 0"""
)
def lexicon_entries(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), "p_name")).alias("name"), F.array(F.upper("p_name"), F.lit(" "), F.concat("p_brand", F.lit(" "))).alias("aliases"))
    valid = F.trim("name") != ""
    phrases = F.when(valid, X.clean_aliases(F.concat(F.array("name"), F.col("aliases"))))
    return p.select("p_partkey", valid.alias("valid"), F.explode_outer(phrases).alias("phrase"))


@query("SELECT a.p_partkey, round(jaro_similarity(a.p_name, b.p_name), 6) AS jaro FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def jaro_scores(spark, sf):
    a = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("left"))
    b = table(spark, sf, "part").select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("right"))
    pairs = a.join(b, "p_partkey")
    scored = pairs.select("left", "right").distinct().withColumn("jaro", F.round(jaro("left", "right"), 6))
    return pairs.join(scored, ["left", "right"]).select("p_partkey", "jaro")


# ---- evidence, spans, contexts


@query("SELECT conv_id, string_agg('[' || turn || '] ' || text, chr(10) ORDER BY turn, text) AS rendered FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def rendered_contexts(spark, sf):
    c = table(spark, sf, "conversations").filter("text IS NOT NULL")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("["), x["turn"].cast("string"), F.lit("] "), x["text"]))
    return c.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("rendered"))


@query("SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS sentences FROM lineitem GROUP BY 1")
def sentence_indices(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("sentences"))


@query("SELECT l_orderkey, min(struct_pack(a := l_linenumber, b := l_suppkey)) FILTER (l_returnflag <> 'N').b AS section, min(struct_pack(a := l_linenumber, b := l_partkey)) FILTER (l_linestatus = 'F').b AS table_entity FROM lineitem GROUP BY 1")
def primary_spans(spark, sf):
    rows = table(spark, sf, "lineitem").withColumns({"section": F.when(F.col("l_returnflag") != "N", F.col("l_suppkey")), "table_entity": F.when(F.col("l_linestatus") == "F", F.col("l_partkey"))})
    return D.first_known(rows, ["l_orderkey"], ["section", "table_entity"], ["l_linenumber"])


@query("SELECT l_orderkey AS section, string_agg(l_linenumber || ',' || l_partkey % 10 || ':' || l_quantity::INTEGER, ' ' ORDER BY l_linenumber, l_partkey % 10, l_quantity) AS cells FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def tables_by_section(spark, sf):
    cells = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_orderkey")).alias("section"), F.struct(F.col("l_linenumber").alias("row"), (F.col("l_partkey") % 10).alias("col"), F.col("l_quantity").cast("int").alias("text")).alias("cell"))
    shown = F.transform(F.array_sort(F.collect_list("cell")), lambda c: F.concat(c["row"].cast("string"), F.lit(","), c["col"].cast("string"), F.lit(":"), c["text"].cast("string")))
    return cells.filter("section IS NOT NULL").groupBy("section").agg(F.array_join(shown, " ").alias("cells"))


ALIASES = ["zzz", "und ", "the ", "en", "a"]


@query(
    "WITH w AS (SELECT doc_id, substr(text, 101, 400) AS w FROM documents) SELECT doc_id, CASE " + " ".join(f"WHEN contains(w, '{a}') THEN '{a}'" for a in ALIASES) + " END AS alias, CASE " + " ".join(f"WHEN contains(w, '{a}') THEN instr(w, '{a}') + 99" for a in ALIASES) + " END::INTEGER AS place FROM w"
)
def first_alias_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.first_alias(F.col("text"), ALIASES, 100, 400).alias("hit")).select("doc_id", "hit.alias", "hit.place")


@query(
    """WITH s AS (SELECT doc_id, substr(text, 51, 100) AS s FROM documents), t AS (SELECT doc_id, regexp_replace(regexp_replace(s, '^\\s+', ''), '\\s+$', '') AS piece, length(s) - length(regexp_replace(s, '^\\s+', '')) + 50 AS a FROM s)
SELECT doc_id, nullif(piece, '') AS piece, CASE WHEN piece <> '' THEN a END::INTEGER AS "start", CASE WHEN piece <> '' THEN a + length(piece) END::INTEGER AS "end" FROM t"""
)
def trimmed_slices(spark, sf):
    return table(spark, sf, "documents").select("doc_id", D.trimmed_slice(F.col("text"), 50, 150).alias("s")).select("doc_id", "s.piece", "s.start", "s.end")


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 1 THEN 'it' WHEN 2 THEN 'this model' ELSE role || ' ' || turn END AS term FROM conversations),
u AS (SELECT *, CASE WHEN term NOT IN ('it', 'this model') THEN term END AS told FROM t)
SELECT conv_id, turn, role, coalesce(told, last_value(told IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), term) AS resolved FROM u"""
)
def terms_resolved(spark, sf):
    term = _case("turn", F.concat_ws(" ", "role", F.col("turn").cast("string")), "it", "this model")
    return D.terms_resolved(table(spark, sf, "conversations").withColumn("term", term), "conv_id", ["turn", "role"], "term").select("conv_id", "turn", "role", "resolved")


@query(
    """SELECT l_suppkey, CASE WHEN l_returnflag <> 'N' THEN 'result' WHEN l_linestatus = 'F' THEN 'method_relation' ELSE 'dropped' END AS route, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2"""
)
def candidates_routed(spark, sf):
    route = D.routed(F.when(F.col("l_returnflag") != "N", F.col("l_quantity")), F.when(F.col("l_linestatus") == "F", "improves").otherwise("mentions"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey", route.alias("route")).agg(n_rows().alias("n"))


# ---- entities, nodes, edges


@query(
    """WITH f AS (SELECT l_suppkey, l_returnflag || l_linestatus AS alias, min(l_orderkey * 10 + l_linenumber) AS a FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, string_agg(alias, ' ' ORDER BY a, alias) AS aliases FROM f GROUP BY 1"""
)
def aliases_in_order(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("aliases"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return D.ordered_union(rows, ["l_suppkey"], "aliases", "at").select("l_suppkey", F.array_join("aliases", " ").alias("aliases"))


@query(
    f"""WITH {RESULTS_SQL} SELECT method_id, min(struct_pack(a := paper_id, b := dataset_id)) FILTER (verified).b AS first_dataset, min(struct_pack(a := paper_id, b := task_id)) FILTER (task_id IS NOT NULL).b AS first_task, count(DISTINCT paper_id)::BIGINT AS papers FROM res GROUP BY 1"""
)
def node_details(spark, sf):
    r = results(spark, sf).withColumns({"first_dataset": F.when(F.col("verified"), F.col("dataset_id")), "first_task": F.col("task_id")})
    papers = r.groupBy("method_id").agg(F.countDistinct("paper_id").alias("papers"))
    return D.first_known(r, ["method_id"], ["first_dataset", "first_task"], ["paper_id"]).join(papers, "method_id")


@query(
    """SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rank FROM lineitem) WHERE rank <= 12"""
)
def evidence_capped(spark, sf):
    return D.capped(table(spark, sf, "lineitem"), ["l_suppkey"], ["l_discount", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 12).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "rank")


@query(f"WITH {RESULTS_SQL} SELECT dataset_id, metric_id, " + ", ".join(f"max(value_cents) FILTER (method_id = {m}) AS method_id_{m}" for m in (1, 2, 3)) + " FROM res GROUP BY 1, 2")
def result_matrix(spark, sf):
    return D.value_matrix(results(spark, sf), ["dataset_id", "metric_id"], "method_id", [1, 2, 3], "value_cents")


@query(
    f"""WITH {RESULTS_SQL}, e AS (SELECT method_id::VARCHAR AS a, dataset_id AS b FROM res WHERE dataset_id IS NOT NULL), n AS (SELECT a AS node, b AS other FROM e UNION SELECT b, a FROM e) SELECT node, count(*)::BIGINT AS degree FROM n GROUP BY 1"""
)
def node_degrees(spark, sf):
    edges = results(spark, sf).filter("dataset_id IS NOT NULL").select(F.col("method_id").cast("string").alias("method"), F.col("dataset_id").alias("dataset"))
    return D.degrees(edges, "method", "dataset")


@query(
    """WITH t AS (SELECT o_custkey AS paper, l_suppkey AS method, l_partkey % 50 AS tool, l_returnflag AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT paper, 'uses' AS relation, 'm' || method AS source, 't' || tool AS target FROM t UNION ALL SELECT paper, 'part_of', 't' || tool, kind FROM t)
SELECT relation, source, target, count(*)::BIGINT AS instances, count(DISTINCT paper)::BIGINT AS papers FROM p GROUP BY 1, 2, 3"""
)
def explicit_relations(spark, sf):
    t = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    method, tool = F.concat(F.lit("m"), F.col("l_suppkey").cast("string")), F.concat(F.lit("t"), (F.col("l_partkey") % 50).cast("string"))
    pair = lambda relation, a, b: F.struct(F.lit(relation).alias("relation"), a.alias("source"), b.alias("target"))
    pairs = t.select(F.col("o_custkey").alias("paper"), F.explode(F.array(pair("uses", method, tool), pair("part_of", tool, F.col("l_returnflag")))).alias("p")).select("paper", "p.*")
    # one row of each paper and edge first, so that no group holds all instances
    per_paper = pairs.groupBy("relation", "source", "target", "paper").agg(n_rows().alias("n"))
    return per_paper.groupBy("relation", "source", "target").agg(F.sum("n").alias("instances"), n_rows().alias("papers"))


@query(
    f"""WITH {RESULTS_SQL} SELECT paper_id, method_id, concat_ws(' ', CASE WHEN dataset_id IS NOT NULL THEN 'evaluates_on:' || dataset_id END, CASE WHEN metric_id <> 'N' THEN 'reports:' || metric_id END, CASE WHEN is_sota THEN 'proposes:' || task_id END) AS pairs FROM res"""
)
def measurement_pairs(spark, sf):
    pair = lambda relation, c, when: F.when(when, F.concat(F.lit(f"{relation}:"), F.col(c)))
    pairs = F.array(pair("evaluates_on", "dataset_id", F.col("dataset_id").isNotNull()), pair("reports", "metric_id", F.col("metric_id") != "N"), pair("proposes", "task_id", F.col("is_sota")))
    return results(spark, sf).select("paper_id", "method_id", F.array_join(F.array_compact(pairs), " ").alias("pairs"))


@query(
    """WITH b AS (SELECT l_orderkey, l_returnflag AS s, l_suppkey::VARCHAR AS n, max(l_quantity) AS k FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(s || ':' || n, ' ' ORDER BY s, k DESC, n) AS hints FROM b GROUP BY 1"""
)
def candidate_hints(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("name", F.col("l_suppkey").cast("string"))
    return D.hints_shown(rows, ["l_orderkey"], "l_returnflag", "l_quantity", "name")


@query(
    """SELECT o_orderkey, count(l_orderkey)::BIGINT AS results, count(*) FILTER (l_linestatus = 'F')::BIGINT AS verified, count(DISTINCT l_suppkey)::BIGINT AS methods FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""
)
def extraction_summaries(spark, sf):
    made = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n_rows().alias("results"), F.count_if(F.col("l_linestatus") == "F").alias("verified"), F.countDistinct("l_suppkey").alias("methods"))
    return table(spark, sf, "orders").select("o_orderkey").join(made, "o_orderkey", "left").na.fill(0)


@query(
    f"""WITH {RESULTS_SQL}, c AS (SELECT l_orderkey AS paper_id, count(*) AS claims FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT method_id, sum(coalesce(claims, 0))::BIGINT AS claims, count(*)::BIGINT AS results FROM res LEFT JOIN c USING (paper_id) GROUP BY 1"""
)
def claims_of_methods(spark, sf):
    claims = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("paper_id"))
    return D.claims_per_result(results(spark, sf), claims, "paper_id").groupBy("method_id").agg(F.sum("claims").alias("claims"), n_rows().alias("results"))


@query(
    """WITH m AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 4 = 0 THEN 'GPT-' || p_size WHEN p_partkey % 4 = 1 THEN p_name || ' ' || p_size ELSE p_name END AS surface FROM part)
SELECT p_partkey, surface, regexp_full_match(surface, '[A-Z][A-Z0-9-]+') AS acronym, regexp_matches(surface, '[0-9]') AS digits, n > 1 AS shared FROM m JOIN (SELECT surface, count(DISTINCT p_brand) AS n FROM m GROUP BY 1) USING (surface)"""
)
def mention_records(spark, sf):
    size = F.col("p_size").cast("string")
    surface = _case("p_partkey", F.concat(F.lit("GPT-"), size), F.concat_ws(" ", "p_name", size), F.col("p_name"), F.col("p_name"))
    m = table(spark, sf, "part").select("p_partkey", "p_brand", surface.alias("surface"))
    # brands of a surface are told apart before they are counted, so a frequent surface is no hot group
    brands = m.select("surface", "p_brand").distinct().groupBy("surface").agg((n_rows() > 1).alias("shared"))
    acronym, digits, _ = X.mention_features(F.col("surface"))
    return m.join(brands, "surface").select("p_partkey", "surface", acronym.alias("acronym"), digits.alias("digits"), "shared")


@query(
    """WITH d AS (SELECT doc_id, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), ['the', 'und', 'los'])) / 3 AS score FROM documents)
SELECT 'R' AS asked, 'result' AS kind, l_orderkey AS id, NULL::DOUBLE AS score FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey = 3
UNION ALL (SELECT 'X', 'snippet', doc_id, score FROM d WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10)"""
)
def grounded_answers(spark, sf):
    li, docs = table(spark, sf, "lineitem"), table(spark, sf, "documents")

    def answer(asked):
        found = li.filter((F.col("l_returnflag") == asked) & (F.col("l_suppkey") == 3)).select(F.lit(asked).alias("asked"), F.lit("result").alias("kind"), F.col("l_orderkey").alias("id"), F.lit(None).cast("double").alias("score"))
        ranked = docs.select(F.lit(asked).alias("asked"), F.lit("snippet").alias("kind"), F.col("doc_id").alias("id"), X.overlap_share(F.lit("the und los"), F.col("text")).alias("score"))
        return K.else_fallback(found, ranked.filter("score > 0").orderBy(F.desc("score"), "id").limit(10))

    return answer("R").unionByName(answer("X"))


@query(
    f"""WITH {RESULTS_SQL}, e AS (SELECT DISTINCT method_id, dataset_id FROM res WHERE dataset_id IS NOT NULL) SELECT count(*)::BIGINT AS total, least(count(*), 100)::BIGINT AS shown, count(*) > 100 AS has_more, count(DISTINCT method_id)::BIGINT AS methods FROM e"""
)
def response_meta(spark, sf):
    e = results(spark, sf).filter("dataset_id IS NOT NULL").groupBy("method_id", "dataset_id").agg(n_rows().alias("n")).groupBy("method_id").agg(n_rows().alias("n"))
    return e.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), n_rows().alias("methods")).select("total", F.least("total", F.lit(100)).cast("long").alias("shown"), (F.col("total") > 100).alias("has_more"), "methods")


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'the model' WHEN p_partkey % 3 = 1 THEN p_name ELSE 'node ' || p_partkey END AS label, CASE p_partkey % 4 WHEN 0 THEN 'uses' WHEN 1 THEN 'reports' WHEN 2 THEN 'proposes' ELSE 'other' END AS relation,
  CASE p_partkey % 4 WHEN 1 THEN 'metric' WHEN 2 THEN 'task' WHEN 0 THEN 'method' ELSE 'concept' END AS target_kind FROM part"""
)
def fallback_labels(spark, sf):
    raw = _case("p_partkey", "the model", F.concat(F.lit("  "), "p_name"), "  ")
    label = F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.concat(F.lit("node "), F.col("p_partkey").cast("string")))
    relation = _case("p_partkey", "uses", "reports", "proposes", "other")
    return table(spark, sf, "part").select("p_partkey", label.alias("label"), relation.alias("relation"), L.target_kind(relation).alias("target_kind"))
