"""Queries for names, document structure and evidence checks, and the SQL that states the same. Merged into the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import names as N
from quillgraph.operators import structure as D
from quillgraph.operators import verify as C
from quillgraph.plans.adapt import EVIDENCE_SQL, RESULTS_SQL, evidence, results
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table

QUERIES, query = collector()


# ---- names


@query("SELECT p_partkey, p_name || '-' || CASE WHEN p_size % 2 = 0 THEN 'WMT 2014' ELSE p_brand END AS name FROM part")
def ontology_names(spark, sf):
    p = table(spark, sf, "part")
    tail = F.when(F.col("p_size") % 2 == 0, F.lit("WMT14 Translation  Task ")).otherwise(F.concat("p_brand", F.lit(" task")))
    return p.select("p_partkey", N.ontology_text(F.concat(F.lit("  "), "p_name", F.lit("→"), tail)).alias("name"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '''' || p_name ELSE p_name END AS name FROM part")
def unquoted_names(spark, sf):
    p, name = table(spark, sf, "part"), F.col("p_name")
    quoted = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("“ '"), name, F.lit("' ”"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("\"'"), name, F.lit("'"))).otherwise(name)
    return p.select("p_partkey", N.without_outer_quotes(quoted).alias("name"))


@query("SELECT p_partkey, p_name AS name FROM part")
def names_without_citations(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_size") % 4
    tail = F.when(k == 0, " [12] [3, 4]").when(k == 1, " (Doe, 2014) [7]").when(k == 2, " Phys. Rev. Lett. 12, 345 (1999)").otherwise(" vol. 12")
    return p.select("p_partkey", N.without_citations(F.concat("p_name", tail)).alias("name"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_name WHEN 1 THEN '' ELSE p_name || ' model ' || p_size END AS name FROM part")
def dataset_names(spark, sf):
    p, k = table(spark, sf, "part"), F.col("p_size") % 3
    raw = F.when(k == 0, F.concat(F.lit(" the  "), "p_name", F.lit(" Dataset with care."))).when(k == 1, F.concat("p_name", F.lit(" model"))).otherwise(F.concat(F.lit("a "), "p_name", F.lit(" model ("), "p_size", F.lit(") reports")))
    return p.select("p_partkey", N.dataset_name(raw).alias("name"))


PHRASE_SQL = """ph AS (SELECT p_partkey, p_name, p_size % 3 AS k, CASE p_size % 3 WHEN 0 THEN 'neural-parsing models ' || split_part(p_name, ' ', 1) WHEN 1 THEN upper(split_part(p_name, ' ', 2)) ELSE 'top-down (Parsers) TDP' END AS phrase FROM part)"""


def _phrases(spark, sf):
    k = F.col("p_size") % 3
    phrase = F.when(k == 0, F.concat(F.lit("neural-parsing models "), F.split("p_name", " ")[0])).when(k == 1, F.upper(F.split("p_name", " ")[1])).otherwise("top-down (Parsers) TDP")
    return table(spark, sf, "part").select("p_partkey", "p_name", k.alias("k"), phrase.alias("phrase"))


@query(f"WITH {PHRASE_SQL} SELECT p_partkey, CASE k WHEN 0 THEN 'neural parsing model ' || split_part(p_name, ' ', 1) WHEN 1 THEN lower(phrase) ELSE 'top down parser' END AS concept FROM ph WHERE NOT (length(split_part(p_name, ' ', k::INTEGER + 1)) > 4 AND split_part(p_name, ' ', k::INTEGER + 1) LIKE '%s') OR k = 2")
def concept_names(spark, sf):
    word = F.get(F.split("p_name", " "), F.col("k").cast("int"))
    ph = _phrases(spark, sf).filter(~((F.length(word) > 4) & word.endswith("s")) | (F.col("k") == 2))
    return ph.select("p_partkey", N.concept_name(F.col("phrase")).alias("concept"))


@query(f"WITH {PHRASE_SQL} SELECT p_partkey, CASE k WHEN 0 THEN 'keyword' WHEN 1 THEN 'acronym' ELSE 'keyword' END AS type, round((1 + CASE k WHEN 0 THEN 4 WHEN 1 THEN 1 ELSE 3 END * 0.3 + CASE WHEN k = 1 THEN 0.6 ELSE 0.2 END)::DOUBLE, 6) AS score FROM ph")
def concept_candidates(spark, sf):
    ph = _phrases(spark, sf)
    return ph.select("p_partkey", N.concept_type(F.col("phrase")).alias("type"), F.round(N.concept_score(F.col("phrase"), F.lit(True)), 6).alias("score"))


@query(f"WITH {PHRASE_SQL} SELECT CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind, count(*)::BIGINT AS occurrences, min(phrase) AS name FROM ph GROUP BY 1")
def concept_merge(spark, sf):
    ph = _phrases(spark, sf).withColumn("kind", F.when(F.col("k") == 0, "a").when(F.col("k") == 1, "b").otherwise("c"))
    return ph.groupBy("kind").agg(F.count(F.lit(1)).alias("occurrences"), F.min("phrase").alias("name"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'table' WHEN l_linestatus = 'F' THEN 'rule' WHEN l_returnflag = 'A' THEN 'llm' ELSE 'unknown' END AS source FROM lineitem")
def provenance_categories(spark, sf):
    tokens = F.array(F.when(F.col("l_linestatus") == "F", "Tier1-Rules").otherwise("x"), F.when(F.col("l_returnflag") == "A", "openai GPT").otherwise("y"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.provenance(tokens, F.col("l_returnflag") == "R").alias("source"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'biology' WHEN o_custkey % 3 = 1 THEN 'materials' END AS domain FROM orders")
def paper_domain(spark, sf):
    venue = F.when(F.col("o_custkey") % 3 == 0, "Protein Letters on Alloys").when(F.col("o_custkey") % 3 == 1, "Crystal Growth")
    return table(spark, sf, "orders").select("o_orderkey", N.domain(venue, F.lit("A title")).alias("domain"))


@query(f"WITH {EVIDENCE_SQL} SELECT l_orderkey, l_linenumber, qty::DOUBLE AS value, '%' AS unit, 'percent' AS strategy, 'BLEU' AS metric, 'bleu' AS matched FROM ev")
def measurements(spark, sf):
    # the sentence after the first names the value
    t = F.element_at(F.split("text", r"\. "), 2)
    name, matched = N.metric(t)
    return evidence(spark, sf).withColumn("m", N.measurement(t, name)).select("l_orderkey", "l_linenumber", "m.value", "m.unit", "m.strategy", name.alias("metric"), matched.alias("matched"))


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 'ms' WHEN event_type = 'click' THEN '%' ELSE event_type END AS unit FROM events")
def unit_names(spark, sf):
    raw = F.when(F.col("event_type") == "view", " Milliseconds").when(F.col("event_type") == "click", "percent").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", N.unit(raw).alias("unit"))


@query(
    r"""WITH s AS (SELECT doc_id, length(text) // 2 AS mid, text FROM documents),
f AS (SELECT doc_id, regexp_replace(regexp_replace(substr(text, (greatest(mid - 120, 0) + 1)::BIGINT, (mid + 10 + 120 - greatest(mid - 120, 0))::BIGINT), '\s+', ' ', 'g'), '^ | $', '', 'g') AS f FROM s)
SELECT doc_id, CASE WHEN length(f) <= 240 THEN f ELSE rtrim(left(f, 240)) || '…' END AS snippet FROM f"""
)
def window_snippets(spark, sf):
    at = F.floor(F.length("text") / 2)
    return table(spark, sf, "documents").select("doc_id", N.window_snippet(F.col("text"), at, at + 10).alias("snippet"))


# ---- structure


@query()
def html_tree(spark, sf):
    """Elements of each page in document order; held against the tree of a page by hand in the tests."""
    return D.html_nodes(table(spark, sf, "pages"))


@query()
def html_sections(spark, sf):
    return D.heading_sections(D.html_nodes(table(spark, sf, "pages")))


@query()
def paragraph_sections(spark, sf):
    return D.paragraphs(table(spark, sf, "documents"))


@query(
    r"""WITH d AS (SELECT doc_id, text || ' Loss is defined as in Table 2 [3].' AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[^.!?\s][^.!?]*'))::INTEGER AS sentences, len(regexp_extract_all(t, '\[[^\]]+\]'))::INTEGER AS citations,
  len(regexp_extract_all(lower(t), '\b(?:is|are)\s+defined\s+as\b'))::INTEGER AS definitions, len(regexp_extract_all(lower(t), '\btable\s+[0-9]+'))::INTEGER AS table_refs FROM d WHERE t IS NOT NULL"""
)
def structural_summary(spark, sf):
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.concat("text", F.lit(" Loss is defined as in Table 2 [3].")).alias("text"))
    return D.structural_summary(d)


@query(
    """SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations"""
)
def block_offsets(spark, sf):
    return D.running_offsets(table(spark, sf, "conversations"), "conv_id", ["turn"], F.length("text"), 2).select("conv_id", "turn", "start")


@query(
    """WITH b AS (SELECT conv_id, turn, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations),
o AS (SELECT DISTINCT conv_id, unnest([0, 100, 500, 2500])::BIGINT AS at FROM conversations)
SELECT o.conv_id, o.at, b.turn FROM o ASOF JOIN b ON o.conv_id = b.conv_id AND o.at >= b.start"""
)
def page_of_offset(spark, sf):
    conv = table(spark, sf, "conversations")
    offsets = conv.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(i).cast("long") for i in (0, 100, 500, 2500)])).alias("at"))
    return D.block_of_offsets(offsets, D.running_offsets(conv, "conv_id", ["turn"], F.length("text"), 2), "conv_id", "turn")


# ---- evidence


@query(
    """WITH o AS (SELECT o_orderkey, 'Order ' || o_orderkey || ' was placed by customer ' || o_custkey || '.' AS t FROM orders)
SELECT o_orderkey, 1 AS claim, 7 AS line, 0 AS "start", (length(t) - CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END)::INTEGER AS "end", o_orderkey % 3 <> 0 AS fuzzy FROM o WHERE o_orderkey % 3 <> 2"""
)
def evidence_matches(spark, sf):
    """A third of the quotes stand in the order's sentence, a third end otherwise and are near matches, a third match nothing."""
    t = F.concat(F.lit("Order "), "o_orderkey", F.lit(" was placed by customer "), "o_custkey", F.lit("."))
    o, k = table(spark, sf, "orders").select("o_orderkey", t.alias("sentence")), F.col("o_orderkey") % 3
    quote = F.when(k == 0, F.upper("sentence")).when(k == 1, F.expr("substr(sentence, 1, length(sentence) - 1) || '!'")).otherwise("nothing of the kind was ever said here")
    return C.match_evidence(o.select("o_orderkey", F.lit(1).alias("claim"), quote.alias("quote")), o.select("o_orderkey", F.lit(7).alias("line"), "sentence"), "o_orderkey", "claim", "line")


@query(
    """WITH RECURSIVE m AS (SELECT user_id, event_id, event_id % 3 AS kind, event_type = 'view' AS needs, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f(user_id, n, event_id, antecedent, h0, h1, h2, lead) AS (
  SELECT user_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM (SELECT DISTINCT user_id FROM m)
  UNION ALL
  SELECT user_id, n, event_id, CASE WHEN needs THEN v END, CASE WHEN kind = 0 THEN coalesce(v, h0) ELSE h0 END, CASE WHEN kind = 1 THEN coalesce(v, h1) ELSE h1 END, CASE WHEN kind = 2 THEN coalesce(v, h2) ELSE h2 END,
    coalesce(lead, CASE WHEN v IS NOT NULL THEN kind END)
  FROM (SELECT m.user_id, m.n, m.event_id, m.kind, m.needs, h0, h1, h2, lead,
      CASE WHEN NOT needs THEN m.event_id ELSE coalesce(CASE kind WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END, CASE lead WHEN 0 THEN h0 WHEN 1 THEN h1 WHEN 2 THEN h2 END) END AS v
    FROM f JOIN m ON m.user_id = f.user_id AND m.n = f.n + 1) AS t)
SELECT event_id, antecedent FROM f WHERE n > 0"""
)
def coreference_history(spark, sf):
    m = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("kind"), (F.col("event_type") == "view").alias("needs"))
    return C.resolve_references(m, "user_id", "event_id", "kind", "event_id", "needs").select("event_id", "antecedent")


@query(
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS antecedent FROM events"""
)
def antecedent_look_back(spark, sf):
    return C.look_back(table(spark, sf, "events"), "user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id"))).select("event_id", "antecedent")


@query(
    f"""WITH {EVIDENCE_SQL}, c AS (SELECT l_orderkey, l_linenumber AS "row", 'score ' || l_linenumber || '.' || qty || '% of all' AS cell FROM ev),
a AS (SELECT l_orderkey, l_linenumber, unnest([qty::VARCHAR, qty || '%', qty || ' %']) AS s FROM ev)
SELECT l_orderkey, l_linenumber, 0 AS table_id, min("row")::INTEGER AS "row", 1 AS col FROM a JOIN c USING (l_orderkey) WHERE contains(cell, s) GROUP BY 1, 2"""
)
def table_cell_matches(spark, sf):
    ev = evidence(spark, sf)
    cells = ev.select("l_orderkey", F.lit(0).alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(1).alias("col"), F.concat(F.lit("score "), "l_linenumber", F.lit("."), "qty", F.lit("% of all")).alias("cell"))
    return C.table_matches(ev.select("l_orderkey", "l_linenumber", F.col("qty").cast("double").alias("value")), cells, "l_orderkey", "l_linenumber")


@query("SELECT p_partkey, p_name || '|' || p_brand || '|' || p_size AS aliases FROM part")
def nested_aliases(spark, sf):
    raw = F.to_json(F.struct(F.array("p_name", F.upper("p_name"), "p_brand").alias("a"), F.struct(F.array(F.lit(" "), F.col("p_size").cast("string")).alias("b")).alias("more")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(C.flat_aliases(raw), "|").alias("aliases"))


@query(f"WITH {RESULTS_SQL} SELECT count(*)::BIGINT AS total, count(*) FILTER (verified)::BIGINT AS verified, count(*) FILTER (is_sota)::BIGINT AS sota, count(*) FILTER (conf < 70)::BIGINT AS low FROM res")
def tier_summary(spark, sf):
    return C.tier_counters(results(spark, sf), verified=F.col("verified"), sota=F.col("is_sota"), low=F.col("conf") < 70)


@query(f"WITH {RESULTS_SQL} SELECT paper_id, method_id, dataset_id, sum(conf)::BIGINT AS conf_sum, count(*)::BIGINT AS support FROM res WHERE dataset_id IS NOT NULL GROUP BY ALL")
def triple_pairs(spark, sf):
    return results(spark, sf).filter("dataset_id IS NOT NULL").groupBy("paper_id", "method_id", "dataset_id").agg(F.sum("conf").alias("conf_sum"), F.count(F.lit(1)).alias("support"))


@query("SELECT user_id, arg_min(event_type, event_id) AS warning FROM events GROUP BY user_id, event_type")
def warning_union(spark, sf):
    w = table(spark, sf, "events").withColumn("warning", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type")).otherwise(F.concat("event_type", F.lit(" "))))
    return C.first_spelling(w, ["user_id"], "warning", "event_id").select("user_id", "warning")


@query("SELECT p_brand, arg_min(p_name, (-p_size, p_name)) AS p_name, max(p_size) AS p_size FROM part GROUP BY 1")
def alias_winners(spark, sf):
    return C.best_spelling(table(spark, sf, "part").select("p_brand", "p_name", "p_size"), ["p_brand"], "p_name", "p_size")


@query("SELECT event_type, round(median(value), 6) AS middle FROM events GROUP BY 1")
def median_value(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("middle"))


@query(
    """WITH n AS (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(r_name) FROM region UNION SELECT 'nowhere')
SELECT name, CASE WHEN n_nationkey IS NOT NULL THEN 'nation' WHEN r_regionkey IS NOT NULL THEN 'region' END AS kind, coalesce(n_nationkey, r_regionkey)::VARCHAR AS id FROM n LEFT JOIN nation ON lower(n_name) = name LEFT JOIN region ON lower(r_name) = name"""
)
def entity_by_any_kind(spark, sf):
    nation, region = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), table(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    names = nation.select(F.lower("name").alias("name")).union(region.select(F.lower("name"))).union(spark.range(1).select(F.lit("nowhere"))).distinct()
    return C.first_kind(names, [("nation", nation), ("region", region)])


@query("SELECT doc_id, printf('d%d_%03d', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i)) AS candidate FROM (SELECT doc_id, unnest(range(len(regexp_extract_all(text, '[.!?]+')))) AS i FROM documents)")
def candidate_ids(spark, sf):
    n = F.size(F.regexp_extract_all("text", F.lit("[.!?]+"), F.lit(0)))
    ids = table(spark, sf, "documents").select("doc_id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("i"))
    return ids.select("doc_id", F.format_string("d%d_%03d", "doc_id", "i").alias("candidate"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_name ILIKE '%1%' AND c_mktsegment ILIKE '%build%' AND o_orderstatus = 'F'")
def paper_filter(spark, sf):
    has = lambda c, s: F.contains(F.lower(c), F.lit(s))
    people = table(spark, sf, "customer").filter(has("c_name", "1") & has("c_mktsegment", "build")).select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf, "orders").filter("o_orderstatus = 'F'").join(people, "o_custkey").select("o_orderkey")
