"""The queries of the engine over the driver's tables, and the SQL that states the same.

QUERIES maps a key to (function of (spark, sf_dir), SQL or None).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as X
from quillgraph.operators import extract as E
from quillgraph.operators import graph as K
from quillgraph.operators import insights as I
from quillgraph.operators import resolve as R
from quillgraph.operators import search as V
from quillgraph.operators import segment as G
from quillgraph.operators import tables as S
from quillgraph.plans import evidence_queries, matching_queries, metadata_queries, record_queries, response_queries, section_queries, store_queries, tier_queries, upkeep_queries
from quillgraph.plans.adapt import AS_OF_YEAR, EVIDENCE_SQL, RESULTS_SQL, entities, evidence, results
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table
from quillgraph.sources.store import scratch_folder, written

QUERIES, query = collector()


def _edges(spark, sf, relation=None, min_conf=60):
    return K.weighted_edges(K.edge_instances(results(spark, sf), [relation] if relation else None), AS_OF_YEAR, min_conf)


EDGE_SQL = f"""WITH {RESULTS_SQL},
inst AS (SELECT 'evaluates_on' AS relation, method_id::VARCHAR AS source, dataset_id AS target, * FROM res WHERE dataset_id IS NOT NULL
  UNION ALL SELECT 'reports', method_id::VARCHAR, metric_id, * FROM res WHERE metric_id IS NOT NULL
  UNION ALL SELECT 'proposes', method_id::VARCHAR, task_id, * FROM res WHERE task_id IS NOT NULL),
pp AS (SELECT relation, source, target, paper_id, sum(conf) * 10000 // count(*) AS mean, count(*) AS n, count(*) FILTER (verified) AS v, count(*) FILTER (is_sota) AS s, min(yr) AS a, max(yr) AS b, min(conf) AS lo, max(conf) AS hi FROM inst GROUP BY ALL),
edges AS (SELECT relation, source, target, count(*)::BIGINT AS paper_count, (sum(mean) // count(*))::BIGINT AS mean_conf, sum(n)::BIGINT AS n_results, sum(v)::BIGINT AS n_verified, sum(s)::BIGINT AS n_statements,
  min(a)::INTEGER AS first_year, max(b)::INTEGER AS last_year, min(lo)::BIGINT AS min_conf, max(hi)::BIGINT AS max_conf FROM pp GROUP BY relation, source, target HAVING sum(mean) // count(*) >= 600000),
w AS (SELECT *, (paper_count * mean_conf * (100 + 5 * least(greatest(5 - ({AS_OF_YEAR} - last_year), 0), 5) + least(20, 2 * (last_year - first_year)))
  * (1000 + least(300, 30 * n_results) + 300 * n_verified // n_results + least(100, 50 * n_statements)))::BIGINT::DOUBLE / 1e11 AS weight FROM edges) """


def _edge_query(relation):
    def run(spark, sf):
        return _edges(spark, sf, relation)

    return run


for _r in K.RELATIONS:
    QUERIES[f"graph_edges_{_r}"] = (_edge_query(_r), EDGE_SQL + f"SELECT * FROM w WHERE relation = '{_r}'")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, "evaluates_on").orderBy(F.desc("weight"), "source", "target").limit(500)


# ---- scans, filters, paging, semi and anti joins


@query("SELECT o_orderkey, o_orderpriority AS title, year(o_orderdate)::INTEGER AS yr FROM orders WHERE o_orderpriority ILIKE '%high%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10")
def papers_title_search(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderpriority").ilike("%high%"))
    return S.page(o, [F.desc("o_orderdate"), "o_orderkey"], 50, 10).select("o_orderkey", F.col("o_orderpriority").alias("title"), F.year("o_orderdate").alias("yr"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 7")
def paper_by_id(spark, sf):
    return S.filtered(table(spark, sf, "orders"), o_orderkey=7).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT conv_id, turn, role, length(text)::INTEGER AS n FROM conversations WHERE conv_id = 3")
def sections_reading_order(spark, sf):
    return table(spark, sf, "conversations").filter("conv_id = 3").orderBy(F.col("turn").asc_nulls_last()).select("conv_id", "turn", "role", F.length("text").alias("n"))


@query("SELECT event_id, event_type, json_extract_string(props, '$.k')::INTEGER AS k FROM events WHERE user_id = 8 AND event_type = 'error'")
def evidence_filter(spark, sf):
    e = S.filtered(table(spark, sf, "events"), user_id=8, event_type="error")
    return e.select("event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT DISTINCT l_orderkey AS paper_id FROM lineitem WHERE l_suppkey = 3")
def related_papers(spark, sf):
    return table(spark, sf, "lineitem").filter("l_suppkey = 3").select(F.col("l_orderkey").alias("paper_id")).distinct()


@query("SELECT DISTINCT sha256(text) AS text_hash FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE lang = 'en')")
def missing_hashes(spark, sf):
    h = table(spark, sf, "documents").select(F.sha2("text", 256).alias("text_hash"), "lang")
    return h.join(h.filter("lang = 'en'").select("text_hash"), "text_hash", "left_anti").select("text_hash").distinct()


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def dashboard_totals(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


# ---- graph reads


@query(
    f"""WITH {RESULTS_SQL}, m AS (SELECT paper_id, dataset_id, metric_id, method_id, count(*) AS n, sum(conf) AS s FROM res WHERE dataset_id IS NOT NULL AND metric_id IS NOT NULL GROUP BY ALL)
SELECT a.method_id AS left_id, b.method_id AS right_id, count(DISTINCT paper_id)::BIGINT AS paper_count, sum(a.n * b.n)::BIGINT AS row_pairs,
  (sum(a.s * b.n + b.s * a.n) * 10000 // (2 * sum(a.n * b.n)))::BIGINT AS mean_conf
FROM m a JOIN m b USING (paper_id, dataset_id, metric_id) WHERE a.method_id < b.method_id GROUP BY 1, 2"""
)
def graph_compares(spark, sf):
    return K.compares(results(spark, sf))


OVERVIEW_SQL = EDGE_SQL + """, t AS (SELECT *, CASE relation WHEN 'evaluates_on' THEN 'dataset' WHEN 'reports' THEN 'metric' ELSE 'task' END AS target_type FROM w),
ends AS (SELECT 'method' AS type, source AS node, paper_count FROM t UNION ALL SELECT target_type, target, paper_count FROM t),
nodes AS (SELECT type, node, sum(paper_count)::BIGINT AS papers, count(*)::BIGINT AS degree FROM ends GROUP BY 1, 2 ORDER BY papers DESC, lower(node), type LIMIT 100) """


def _overview(spark, sf):
    """Nodes and edges of the overview. Both are read from one table of edges, which are made once."""
    path = scratch_folder(spark, "overview")
    edges = I.edges_of_results(results(spark, sf), AS_OF_YEAR, f"{path}/results").select("relation", "source", "target", "paper_count", "weight")
    return K.overview(written(edges, f"{path}/edges"))


@query(OVERVIEW_SQL + "SELECT * FROM nodes")
def graph_overview_nodes(spark, sf):
    return _overview(spark, sf)[0]


@query(OVERVIEW_SQL + "SELECT relation, source, target, paper_count, weight FROM t WHERE source IN (SELECT node FROM nodes WHERE type = 'method') AND (target_type, target) IN (SELECT type, node FROM nodes)")
def graph_overview_edges(spark, sf):
    return _overview(spark, sf)[1].select("relation", "source", "target", "paper_count", "weight")


@query(EDGE_SQL.replace("inst AS (", "res2 AS (SELECT * FROM res WHERE paper_id IN (SELECT paper_id FROM res WHERE method_id = 3)),\ninst AS (").replace("* FROM res WHERE dataset", "* FROM res2 WHERE dataset").replace("* FROM res WHERE metric", "* FROM res2 WHERE metric").replace("* FROM res WHERE task", "* FROM res2 WHERE task") + "SELECT relation, source, target, paper_count, weight FROM w")
def graph_neighborhood(spark, sf):
    near = K.neighborhood(results(spark, sf), "method_id", 3)
    return K.weighted_edges(K.edge_instances(near), AS_OF_YEAR).select("relation", "source", "target", "paper_count", "weight")


BOUNDS = """coalesce(max(value_cents) FILTER (verified), max(value_cents)) AS best_cents, coalesce(min(value_cents) FILTER (verified), min(value_cents)) AS worst_cents,
 CASE WHEN count(value_cents) >= 2 AND max(value_cents) > min(value_cents) THEN max(value_cents) - min(value_cents) END AS effect_cents"""


@query(f"WITH {RESULTS_SQL} SELECT method_id, {BOUNDS} FROM res GROUP BY method_id")
def node_best_outcome(spark, sf):
    return K.outcome_bounds(results(spark, sf), ["method_id"])


@query(f"WITH {RESULTS_SQL} SELECT method_id, metric_id, {BOUNDS} FROM res GROUP BY method_id, metric_id")
def edge_effect_size(spark, sf):
    return K.outcome_bounds(results(spark, sf), ["method_id", "metric_id"])


@query(
    f"""WITH {RESULTS_SQL}, b AS (SELECT method_id, dataset_id, metric_id, max(value_cents) AS value_cents, max(value_cents * 2 + is_sota::INTEGER) % 2 AS sota FROM res GROUP BY 1, 2, 3)
SELECT method_id, dataset_id, metric_id, row_number() OVER (PARTITION BY method_id ORDER BY value_cents DESC, sota DESC, dataset_id, metric_id)::INTEGER AS rank, value_cents, sota::INTEGER AS sota
FROM b QUALIFY row_number() OVER (PARTITION BY method_id ORDER BY value_cents DESC, sota DESC, dataset_id, metric_id) <= 5"""
)
def node_best_results_top5(spark, sf):
    return K.best_by_context(results(spark, sf), "method_id", ["dataset_id", "metric_id"])


@query(f"WITH {RESULTS_SQL} SELECT method_id, yr::INTEGER AS yr, count(DISTINCT paper_id)::BIGINT AS papers FROM res GROUP BY 1, 2")
def node_papers_by_year(spark, sf):
    return results(spark, sf).groupBy("method_id", "yr").agg(F.countDistinct("paper_id").alias("papers"))


@query(f"WITH {RESULTS_SQL} SELECT method_id, o_orderpriority AS category, count(DISTINCT paper_id)::BIGINT AS claims FROM res JOIN orders ON o_orderkey = paper_id GROUP BY 1, 2")
def node_claims_by_category(spark, sf):
    claims = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("category"))
    pairs = results(spark, sf).select("method_id", "paper_id").distinct()
    return pairs.join(claims, "paper_id").groupBy("method_id", "category").agg(F.count(F.lit(1)).alias("claims"))


@query(EDGE_SQL + "SELECT relation, source, target, min_conf, max_conf, mean_conf FROM w")
def edge_confidence_stats(spark, sf):
    return _edges(spark, sf).select("relation", "source", "target", "min_conf", "max_conf", "mean_conf")


@query(EDGE_SQL + "SELECT source, relation, target, row_number() OVER (PARTITION BY source ORDER BY weight DESC, relation, target)::INTEGER AS rank FROM w QUALIFY row_number() OVER (PARTITION BY source ORDER BY weight DESC, relation, target) <= 6")
def node_top_links(spark, sf):
    return K.top_links(_edges(spark, sf)).select("source", "relation", "target", "rank")


@query(f"WITH {RESULTS_SQL} SELECT metric_id, dataset_id, max(value_cents) AS value_cents, max(value_cents) FILTER (is_sota) AS sota_cents FROM res GROUP BY 1, 2")
def sota_lookup(spark, sf):
    return results(spark, sf).groupBy("metric_id", "dataset_id").agg(F.max("value_cents").alias("value_cents"), F.max(F.when(F.col("is_sota"), F.col("value_cents"))).alias("sota_cents"))


@query(f"WITH {RESULTS_SQL} SELECT dataset_id, metric_id, sum(value_cents) FILTER (paper_id = 1)::BIGINT AS p1, sum(value_cents) FILTER (paper_id = 2)::BIGINT AS p2, sum(value_cents) FILTER (paper_id = 3)::BIGINT AS p3 FROM res WHERE paper_id IN (1, 2, 3) GROUP BY 1, 2")
def compare_papers(spark, sf):
    r = results(spark, sf).filter(F.col("paper_id").isin(1, 2, 3))
    return r.groupBy("dataset_id", "metric_id").pivot("paper_id", [1, 2, 3]).agg(F.sum("value_cents")).select("dataset_id", "metric_id", *[F.col(str(i)).alias(f"p{i}") for i in (1, 2, 3)])


@query(f"WITH {RESULTS_SQL} SELECT paper_id, dataset_id, metric_id, count(*)::BIGINT AS n FROM res GROUP BY 1, 2, 3 HAVING count(DISTINCT verified) > 1")
def review_conflicts(spark, sf):
    g = results(spark, sf).groupBy("paper_id", "dataset_id", "metric_id").agg(F.count(F.lit(1)).alias("n"), F.min("verified").alias("a"), F.max("verified").alias("b"))
    return g.filter("a <> b").select("paper_id", "dataset_id", "metric_id", "n")


# ---- text scalars and segmentation


@query(r"SELECT doc_id, nullif(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B-\x1F]', '', 'g'), '^\s+|\s+$', '', 'g'), '') AS clean FROM documents")
def sanitize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.sanitize(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, CASE WHEN length(f) <= 400 THEN f ELSE rtrim(left(f, 400)) || '…' END AS snippet FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g') AS f FROM documents)")
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || '-' || p_brand), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part")
def normalize_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.normalized(F.concat_ws("-", "p_name", "p_brand")).alias("norm"))


@query(
    r"""WITH s AS (SELECT doc_id, regexp_extract_all(text, '[^.!?]+[.!?]*') AS p FROM documents),
u AS (SELECT doc_id, i - 1 AS idx, p[i] AS raw, coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0)::INTEGER AS start FROM s, unnest(range(1, len(p) + 1)) AS t(i))
SELECT doc_id, idx::INTEGER AS idx, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS sentence, start FROM u WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''"""
)
def sentences(spark, sf):
    return G.sentences(table(spark, sf, "documents"))


@query("SELECT doc_id, i::INTEGER AS chunk, substr(text, i * 1400 + 1, 1400) AS content FROM documents, unnest(range(0, ((length(text) + 1399) // 1400)::BIGINT)) AS t(i)")
def chunks(spark, sf):
    return G.chunks(table(spark, sf, "documents"))


@query(
    f"""WITH t AS (SELECT doc_id, i AS pos, p[i + 1] AS tok FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS p FROM documents), unnest(range(0, len(p))) AS u(i)),
a AS (SELECT *, tok IN ({', '.join(repr(w) for w in G.STOPWORDS)}) AS stop FROM t),
b AS (SELECT *, sum(stop::INTEGER) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM a),
c AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, island ORDER BY pos) - 1) // 6 AS part FROM b WHERE NOT stop)
SELECT doc_id, min(pos)::INTEGER AS pos, string_agg(tok, ' ' ORDER BY pos) AS phrase FROM c GROUP BY doc_id, island, part"""
)
def phrases(spark, sf):
    return G.phrases(table(spark, sf, "documents"))


@query(
    r"""WITH h AS (SELECT page_id, regexp_extract_all(html, '<h([1-6])>([^<]*)</h[1-6]>') AS p FROM pages)
SELECT page_id, (i - 1)::INTEGER AS ordinal, substr(p[i], 3, 1)::INTEGER AS level, regexp_replace(p[i], '<[^>]*>', '', 'g') AS heading FROM h, unnest(range(1, len(p) + 1)) AS t(i)"""
)
def html_heading_sections(spark, sf):
    return G.html_headings(table(spark, sf, "pages"))


@query("SELECT doc_id, sha1(text) AS section_hash, sha256(text) AS content_hash FROM documents")
def section_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha1("text").alias("section_hash"), F.sha2("text", 256).alias("content_hash"))


@query("SELECT s_suppkey, regexp_replace(regexp_replace(printf('%.4f', s_acctbal), '0+$', ''), '\\.$', '') AS shown FROM supplier")
def format_number(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", X.plain_number(F.col("s_acctbal")).alias("shown"))


@query("SELECT event_id, round(greatest(0.0, least(1.0, coalesce(TRY_CAST(CASE WHEN event_type = 'error' THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE), 0.6))), 6) AS conf FROM events")
def confidence_coercion(spark, sf):
    raw = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", F.round(X.confidence(raw), 6).alias("conf"))


@query("SELECT n_name, CASE WHEN n_name ILIKE '%1%' THEN 'test' END AS split FROM (SELECT CASE WHEN n_name LIKE '%1%' THEN n_name || ' test split' ELSE n_name END AS n_name, n_name AS o FROM nation)")
def split_inference(spark, sf):
    n = table(spark, sf, "nation").select(F.when(F.contains("n_name", F.lit("1")), F.concat("n_name", F.lit(" test split"))).otherwise(F.col("n_name")).alias("n_name"))
    return n.select("n_name", X.split_of(F.col("n_name")).alias("split"))


@query("SELECT c_custkey, regexp_matches(c_mktsegment, '^[A-Z][A-Z0-9-]+$') AS acronym, regexp_matches(c_name, '[0-9]') AS has_digit, len(regexp_extract_all(c_name, '[A-Z]'))::DOUBLE / length(c_name) AS caps FROM customer")
def mention_features(spark, sf):
    a, d, c = (X.mention_features(F.col(n)) for n in ("c_mktsegment", "c_name", "c_name"))
    return table(spark, sf, "customer").select("c_custkey", a[0].alias("acronym"), d[1].alias("has_digit"), c[2].alias("caps"))


# ---- search


def _query_vector(spark, sf):
    """The one vector of a request; without it every score is 0."""
    row = table(spark, sf, "embeddings").filter("vec_id = 0").first()
    return row["embedding"] if row else []


COSINE_SQL = """WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q) """


@query(COSINE_SQL + "SELECT vec_id, score FROM s ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    return V.top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 20)


@query("SELECT doc_id, round((list_contains(t, 'the')::INTEGER + list_contains(t, 'and')::INTEGER + list_contains(t, 'zebra')::INTEGER) / 3.0::DOUBLE, 6) AS share FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)")
def token_overlap(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(X.overlap_share(F.lit("The zebra and the"), F.col("text")), 6).alias("share"))


@query(
    COSINE_SQL
    + """, h AS (SELECT vec_id, score, CASE WHEN vec_id % 2 = 0 THEN 'even vector' ELSE 'odd' END AS snippet FROM s ORDER BY score DESC, vec_id LIMIT 10),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS r, round(score * 0.7::DOUBLE + (CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE * 0.3::DOUBLE, 6) AS blended FROM h)
SELECT vec_id, score, snippet, blended, row_number() OVER (ORDER BY r > 3, CASE WHEN r <= 3 THEN -blended END, r)::INTEGER AS rank FROM r"""
)
def search_partial_rerank(spark, sf):
    hits = V.top_k(table(spark, sf, "embeddings"), _query_vector(spark, sf), 10)
    return V.partial_rerank(hits.withColumn("snippet", F.when(F.col("vec_id") % 2 == 0, "even vector").otherwise("odd")), "even vector")


# ---- extraction and verification


@query(f"WITH {EVIDENCE_SQL} SELECT l_orderkey, l_linenumber, trim(regexp_extract(text, '(?i)we (?:propose|introduce|present) ([A-Za-z][A-Za-z0-9 -]*)', 1)) AS method FROM ev")
def propose_pattern(spark, sf):
    return evidence(spark, sf).select("l_orderkey", "l_linenumber", E.proposed_method(F.col("text")).alias("method"))


@query(f"WITH {EVIDENCE_SQL} SELECT l_orderkey, l_linenumber, 'BLEU' AS metric, qty::DOUBLE AS value, '%' AS unit FROM ev")
def result_pattern(spark, sf):
    metric, value, unit = E.reported_result(F.col("text"))
    return evidence(spark, sf).select("l_orderkey", "l_linenumber", metric.alias("metric"), value.alias("value"), unit.alias("unit"))


@query(f"WITH {EVIDENCE_SQL} SELECT l_orderkey, l_linenumber, qty % 3 = 0 AS accepted, CASE WHEN qty % 3 = 0 THEN '' ELSE 'value_not_in_evidence' END AS reasons FROM ev")
def value_in_evidence(spark, sf):
    claimed = F.when(F.col("qty") % 3 == 0, F.col("qty").cast("double")).otherwise(F.lit(777.0))
    # Model 77 or 777 may name the wrong value: the claim is held against the result's own sentence
    text = F.concat(F.lit("BLEU improves to "), F.col("qty").cast("string"), F.lit("% on the test set."))
    r = E.measurement_reasons(claimed, text)
    return evidence(spark, sf).select("l_orderkey", "l_linenumber", (F.size(r) == 0).alias("accepted"), F.array_join(r, ",").alias("reasons"))


@query(
    """WITH g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS phrase, t FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents)),
p AS (SELECT DISTINCT t[1] || ' ' || t[2] AS phrase FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark) WHERE len(t) >= 2)
SELECT phrase, sum(len(list_filter(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1] = phrase)))::BIGINT AS mentions, count(*)::BIGINT AS sources FROM g JOIN p USING (phrase) GROUP BY phrase"""
)
def lexicon_mentions(spark, sf):
    tok = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    lex = table(spark, sf, "benchmark").select(F.array_join(F.slice(tok, 1, 2), " ").alias("phrase"), F.size(tok).alias("n")).filter("n >= 2")
    return E.lexicon_mentions(table(spark, sf, "documents"), lex, "doc_id", "text")


@query(
    """WITH e AS (SELECT user_id % 50 AS section, event_id * 37 % 5000 AS start, event_id AS ordinal FROM events WHERE event_type = 'error'),
s AS (SELECT DISTINCT user_id % 50 AS section, event_id * 53 % 5000 AS pos FROM events WHERE event_type = 'click')
SELECT section, pos, min(ordinal) AS entity, min(ordinal) AS ordinal FROM s JOIN e USING (section) WHERE abs(start - pos) <= 160 GROUP BY 1, 2"""
)
def near_span_link(spark, sf):
    ev = table(spark, sf, "events").withColumn("section", F.col("user_id") % 50)
    e = ev.filter("event_type = 'error'").select("section", (F.col("event_id") * 37 % 5000).alias("start"), F.col("event_id").alias("ordinal"), F.col("event_id").alias("entity"))
    s = ev.filter("event_type = 'click'").select("section", (F.col("event_id") * 53 % 5000).alias("pos")).distinct()
    return E.near_spans(e, s)


@query(
    """SELECT event_id, CASE WHEN event_type = 'view' THEN last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS antecedent FROM events"""
)
def coref_last_mention(spark, sf):
    m = table(spark, sf, "events").withColumn("pronoun", F.col("event_type") == "view")
    return E.last_mention(m, ["user_id"], "event_id", "event_id", "pronoun").select("event_id", "antecedent")


@query(
    f"""WITH {RESULTS_SQL}, d AS (SELECT DISTINCT paper_id, method_id, conf, verified, is_sota, count(*) OVER (PARTITION BY paper_id, method_id) AS support FROM res)
SELECT paper_id, method_id, conf, verified, is_sota, round(least(1.0::DOUBLE, least(1.0::DOUBLE, least(1.0::DOUBLE, conf / 200.0::DOUBLE + CASE WHEN verified THEN 0.05::DOUBLE ELSE 0 END) + CASE WHEN is_sota THEN 0.04::DOUBLE ELSE 0 END)
  + least(0.09::DOUBLE, (support - 1) * 0.03::DOUBLE)), 6) AS final FROM d"""
)
def confidence_recipe(spark, sf):
    r = results(spark, sf).withColumn("support", F.count(F.lit(1)).over(Window.partitionBy("paper_id", "method_id"))).select("paper_id", "method_id", "conf", "verified", "is_sota", "support").distinct()
    final = E.adjusted_confidence(F.col("conf") / 200.0, F.col("verified"), F.col("is_sota"), F.lit(False), F.col("support"))
    return r.select("paper_id", "method_id", "conf", "verified", "is_sota", F.round(final, 6).alias("final"))


@query("SELECT l_orderkey, l_suppkey, min(l_linenumber)::INTEGER AS first_line, count(*)::BIGINT AS support FROM lineitem GROUP BY 1, 2")
def triple_dedupe(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"), F.count(F.lit(1)).alias("support"))


@query("SELECT o_orderkey, round(greatest(0.5, 0.65 - least(o_custkey % 7, 4) * 0.05)::DOUBLE, 6) AS threshold FROM orders")
def qualitative_relations(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(E.qualitative_threshold(F.col("o_custkey") % 7), 6).alias("threshold"))


@query("SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) > 1 AS shared FROM part")
def shared_surface_flag(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    shared = p.groupBy("p_name").agg((F.count(F.lit(1)) > 1).alias("shared"))
    return p.join(shared, "p_name").select("p_partkey", "p_name", "shared")


# ---- entity resolution


@query("SELECT p_partkey AS a, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS b FROM part QUALIFY a <> b")
def candidate_links(spark, sf):
    return R.links_by_key(entities(spark, sf), R.name_key(F.col("name")))


PAIR_SQL = """WITH n AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ')[1] AS block FROM part),
p AS (SELECT a.name AS left_name, b.name AS right_name FROM n a JOIN n b USING (block) WHERE a.name < b.name),
j AS (SELECT *, jaro_similarity(left_name, right_name) AS j, CASE WHEN left(left_name, 4) = left(right_name, 4) THEN 4 WHEN left(left_name, 3) = left(right_name, 3) THEN 3 WHEN left(left_name, 2) = left(right_name, 2) THEN 2
  WHEN left(left_name, 1) = left(right_name, 1) THEN 1 ELSE 0 END AS pre FROM p),
s AS (SELECT left_name, right_name, round(j + pre * 0.1::DOUBLE * (1 - j), 6) AS score FROM j) """


@query(PAIR_SQL + "SELECT * FROM s WHERE score >= 0.85")
def pair_scores(spark, sf):
    return R.scored_pairs(entities(spark, sf), F.split("name", " ")[0], 0.85)


def _roots(spark, sf):
    """Names linked at 0.93 or above, then entities through their names: pairs are of names, which are few."""
    e = entities(spark, sf)
    first = e.groupBy("name").agg(F.min("id").alias("id"))
    pairs = R.scored_pairs(e, F.split("name", " ")[0], 0.93)
    by_name = pairs.join(first.select(F.col("name").alias("left_name"), F.col("id").alias("a")), "left_name").join(first.select(F.col("name").alias("right_name"), F.col("id").alias("b")), "right_name").select("a", "b")
    return R.components(by_name.unionByName(R.links_by_key(e, F.col("name"))))


COMPONENT_SQL = PAIR_SQL.replace("WITH n", "WITH RECURSIVE n", 1) + """, e AS (SELECT left_name AS a, right_name AS b FROM s WHERE score >= 0.93 UNION SELECT right_name, left_name FROM s WHERE score >= 0.93),
c(name, reach) AS (SELECT DISTINCT p_name, p_name FROM part UNION SELECT c.name, e.b FROM c JOIN e ON c.reach = e.a),
m AS (SELECT c.name, min(p_partkey) AS root FROM c JOIN part ON p_name = c.reach GROUP BY 1) """


@query(COMPONENT_SQL + "SELECT p_partkey AS id, p_name AS name, root AS canonical_id FROM part JOIN m ON p_name = m.name")
def canonical_map(spark, sf):
    return R.canonical(entities(spark, sf), _roots(spark, sf))


@query(COMPONENT_SQL + "SELECT root AS canonical_id, string_agg(name, '|' ORDER BY name) AS aliases FROM m GROUP BY root")
def alias_propagation(spark, sf):
    return canonical_map(spark, sf).groupBy("canonical_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("aliases"))


@query(COMPONENT_SQL + "SELECT count(*)::BIGINT AS before, count(DISTINCT root)::BIGINT AS after, (count(*) - count(DISTINCT root))::BIGINT AS merges FROM part JOIN m ON p_name = m.name")
def merge_report(spark, sf):
    g = canonical_map(spark, sf).agg(F.count(F.lit(1)).alias("before"), F.countDistinct("canonical_id").alias("after"))
    return g.select("before", "after", (F.col("before") - F.col("after")).alias("merges"))


# ---- writes as set operations


@query("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'R' AND (l_suppkey, l_partkey) NOT IN (SELECT l_suppkey, l_partkey FROM lineitem WHERE l_returnflag = 'A')")
def append_results_dedupe(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag")
    return S.append_absent(li.filter("l_returnflag = 'A'"), li.filter("l_returnflag = 'R'"), ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey")


@query("SELECT lower(p_name) AS name, count(*) FILTER (p_partkey < 100) = 0 AS is_new FROM part GROUP BY 1")
def ensure_dimension(spark, sf):
    p = table(spark, sf, "part")
    have = p.filter("p_partkey < 100").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"))
    return S.ensure_dimension(have, p.select(F.col("p_name").alias("name"))).select(F.lower("name").alias("name"), "is_new")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def upsert_latest(spark, sf):
    return S.upsert_latest(table(spark, sf, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.desc("event_id")])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') UNION ALL SELECT l_orderkey, l_linenumber, 0.0 FROM lineitem WHERE l_returnflag = 'N'")
def replace_for_paper(spark, sf):
    li = table(spark, sf, "lineitem")
    new = li.filter("l_returnflag = 'N'").select("l_orderkey", "l_linenumber", F.lit(0.0).alias("l_quantity"))
    return S.replace_for_key(li.select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


QUERIES |= evidence_queries.QUERIES | metadata_queries.QUERIES | section_queries.QUERIES | record_queries.QUERIES | matching_queries.QUERIES | store_queries.QUERIES | upkeep_queries.QUERIES | response_queries.QUERIES | tier_queries.QUERIES


def queries() -> dict:
    return {k: f for k, (f, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}
