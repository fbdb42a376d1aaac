"""Queries for filters, labels, edge and node metadata, merges and payloads, and the SQL that states the same. Merged into the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import labels as L
from quillgraph.functions import names as N
from quillgraph.functions import text as X
from quillgraph.operators import graph as K
from quillgraph.operators import resolve as R
from quillgraph.operators import tables as S
from quillgraph.plans.adapt import AS_OF_YEAR, RESULTS_SQL, results
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table

QUERIES, query = collector()



def n_rows():
    return F.count(F.lit(1))



# ---- labels, terms, aliases, lines

#: Labels of every kind that the predicates tell apart, by number.
LABELS = [
    "the model", "Its", "our", "vol. 3 pp", "[1], (2)", "12 % 4 a", "Accuracy of {n}%", "BLEU", "{n} ms", "we use {p}", "{p} improves", "{p}", "{p}-{n}", "table {n}: {p}", "Figure  {n}", "these results", "{p} or {p}", "two {w}", "Two {w}",
    "see appendix {n}", "{n}.{n}", "", "The  proposed method", "the presented approach", "results", "authors", "proposed", "such work", "their", "the aforementioned {w}", "big model", "in table", "see Section {n}", "their {w}", "AUROC", "Hit@1 {n}",
    "top 5", "Acta Phys. Rev. ({n})", "Proc. {w}", "rmse_{n}", "those {p} report it", "{w} reporting", "{w}/{n}-a", "#{n}; {w}", "<PAD> {p}", "x [SEP] {w}", "attention weights of {w}", "attention map", "attention and attention maps", "Table of contents",
    "Fig {n}b. {p}", "input-Input  layer {n}", "three {w} {w}", "four {n} {w}", "the {w} results", "a {w} that showed {n}",
]


def _labelled(spark, sf, texts=True):
    """Made-up labels by part, and by documents (under negative numbers) their first words."""
    k, kinds = F.col("p_partkey") % len(LABELS), F.array(*[F.lit(x) for x in ("metric", "dataset", " Task ", "method", "")])
    fill = lambda x: F.replace(F.replace(F.replace(F.lit(x), F.lit("{p}"), F.col("p_name")), F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{w}"), F.split("p_name", " ")[0])
    label = F.coalesce(*[F.when(k == i, fill(x)) for i, x in enumerate(LABELS)])
    kind = F.element_at(kinds, (F.floor(F.col("p_partkey") / len(LABELS)) % 5 + 1).cast("int"))
    own = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), label.alias("label"), kind.alias("kind"))
    d = F.col("doc_id")
    words = table(spark, sf, "documents").select((-1 - d).alias("p_partkey"), F.array_join(F.slice(F.split(F.coalesce("text", F.lit("")), " "), 1, 1 + (d % 4).cast("int")), " ").alias("label"), F.element_at(kinds, (d % 5 + 1).cast("int")).alias("kind"))
    return own.unionByName(words) if texts else own


_KINDS = "(['metric', 'dataset', ' Task ', 'method', ''])"
LABEL_SQL = (
    "own AS (SELECT p_partkey::BIGINT AS p_partkey, replace(replace(replace(CASE p_partkey % " + str(len(LABELS)) + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(LABELS))
    + " END, '{p}', p_name), '{n}', p_size::VARCHAR), '{w}', string_split(p_name, ' ')[1]) AS label, " + _KINDS + "[(p_partkey // " + str(len(LABELS)) + ") % 5 + 1] AS kind FROM part),\n"
    "lab AS (SELECT *, lower(label) AS low, regexp_replace(lower(label), '^\\s+|\\s+$', '', 'g') AS bare FROM (FROM own UNION ALL SELECT -1 - doc_id, array_to_string(string_split(coalesce(text, ''), ' ')[1:1 + doc_id % 4], ' '), " + _KINDS + "[doc_id % 5 + 1] FROM documents))"
)
_list = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
#: The rules once more, by lists and words in place of patterns.
INFO_SQL = f""", info AS (SELECT *, trim(regexp_replace(low, '\\s+', ' ', 'g')) AS n FROM lab),
marked AS (SELECT *, n = '' OR list_contains({_list(L.LOW_INFO_TERMS)}, n) OR list_contains({_list(L.LOW_INFO_BASE_TERMS)}, n)
  OR len(list_filter({_list(L.LOW_INFO_PREFIXES)}, lambda p: starts_with(n, p || ' ') AND list_contains({_list(L.LOW_INFO_BASE_TERMS)}, trim(n[len(p) + 1:])))) > 0 AS low_info,
  len(regexp_extract_all(label, '[A-Za-z]')) AS letters, len(regexp_extract_all(label, '[\\p{{L}}\\p{{N}}]')) AS other,
  len(list_filter(string_split(label, ''), lambda c: c <> '' AND contains('!"#$%&''()*+,.:;<=>?@[\\]^`{{|}}~', c))) AS signs FROM info),
good AS (SELECT *, NOT low_info AND letters >= greatest(2, floor(other * 0.35::DOUBLE)) AND letters > signs
  AND len(list_filter(regexp_extract_all(low, '[a-z]+'), lambda x: NOT list_contains({_list(L.CITATION_TOKENS)}, x))) > 0 AS good FROM marked)"""


@query(f"WITH {LABEL_SQL}{INFO_SQL} SELECT p_partkey, low_info, good FROM good")
def label_quality(spark, sf):
    return _labelled(spark, sf).select("p_partkey", L.low_info(F.col("label")).alias("low_info"), L.good_label(F.col("label")).alias("good"))


_VERB_FORMS = [f for v in L.REPORTING_VERBS for f in ((v, v + "d", v + "s", v[:-1] + "ing") if v.endswith("e") else (v, v + "ed", v + "s", v + "ing"))]


@query(
    f"""WITH {LABEL_SQL}{INFO_SQL} SELECT p_partkey, good AND CASE lower(trim(kind)) WHEN 'metric' THEN len(list_filter({_list(L.METRIC_KEYWORDS)}, lambda x: contains(low, x))) > 0
    OR (regexp_matches(label, '[0-9]') AND len(list_filter({_list(L.VALUE_UNITS)}, lambda x: contains(low, x))) > 0)
  WHEN 'method' THEN true WHEN '' THEN true
  ELSE len(list_filter({_list(L.SENTENCE_STARTS)}, lambda p: starts_with(bare, p || ' '))) = 0 AND NOT list_has_any({_list(_VERB_FORMS)}, string_split(regexp_replace(low, '[^a-z0-9_]+', ' ', 'g'), ' ')) END AS fits FROM good"""
)
def label_fits_type(spark, sf):
    return _labelled(spark, sf).select("p_partkey", L.fits_type(F.col("label"), F.col("kind")).alias("fits"))


@query(
    f"""WITH {LABEL_SQL}, w AS (SELECT *, regexp_split_to_array(bare, '\\s+') AS w, regexp_replace(label, '^\\s+|\\s+$', '', 'g') = bare AS small FROM lab)
SELECT p_partkey, bare = '' OR list_contains({_list(L.NOISE_ALIASES)}, bare) OR len(list_filter({_list(L.NOISE_STARTS)}, lambda p: starts_with(bare, p || ' '))) > 0 OR contains(bare, 'appendix')
  OR regexp_matches(bare, '\\btable\\s+[0-9]') OR regexp_matches(bare, '\\bfigure\\s+[0-9]') OR (contains(bare, 'results') AND len(list_filter({_list(L.RESULT_STARTS)}, lambda p: starts_with(bare, p || ' '))) > 0)
  OR contains(bare, ' or ') OR (len(w) <= 3 AND small AND list_contains({_list(L.NUMERALS)}, w[1]) AND len(list_filter(w, lambda x: NOT regexp_full_match(x, '\\p{{L}}+'))) = 0) AS noise FROM w"""
)
def alias_noise(spark, sf):
    return _labelled(spark, sf).select("p_partkey", L.noise_alias(F.col("label")).alias("noise"))


_TITLES = ["Attention in brief", "Supplementary notes", "Introduction"]


@query(
    f"""WITH {LABEL_SQL}, b AS (SELECT p_partkey // 57 AS section, p_partkey, label, bare, lower({_list(_TITLES)}[(p_partkey // 57) % 3 + 1]) AS title FROM lab WHERE p_partkey >= 0),
k AS (SELECT section, p_partkey, label, bare = '' OR len(list_filter({_list(L.SPECIAL_TOKENS)}, lambda x: contains(bare, x))) > 0
    OR regexp_matches(bare, '^(fig|figure|tab|table)\\s+[\\p{{L}}\\p{{N}}_-]') OR regexp_matches(bare, 'input-?input\\s+layer') OR (regexp_matches(label, '[0-9]') AND NOT regexp_matches(label, '\\p{{L}}'))
    OR (regexp_matches(bare, '\\battention\\b.*\\b({"|".join(L.ATTENTION_WORDS)})\\b') AND (title <> 'introduction' OR len(list_filter({_list(L.ATTENTION_SIGNS)}, lambda x: contains(bare, x))) > 0 OR len(string_split(bare, 'attention')) > 2)) AS noise FROM b)
SELECT section::BIGINT AS section, coalesce(string_agg(regexp_replace(label, '^\\s+|\\s+$', '', 'g'), chr(10) ORDER BY p_partkey) FILTER (NOT noise), '') AS body FROM k GROUP BY 1"""
)
def lines_without_noise(spark, sf):
    section = F.floor(F.col("p_partkey") / 57)
    rows = _labelled(spark, sf, texts=False).groupBy(section.alias("section")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "label"))).alias("l"))
    title = F.element_at(F.array(*[F.lit(x) for x in _TITLES]), (F.col("section") % 3 + 1).cast("int"))
    return rows.select("section", L.without_noise_lines(F.array_join(F.transform("l", lambda x: x["label"]), "\n"), title).alias("body"))


@query(
    """WITH t AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN replace(p_name, ' ', '-') WHEN 1 THEN upper(p_name) WHEN 2 THEN 'the  ' || p_name || ' [3, 4]' ELSE 'A ' || p_name END AS t FROM part)
SELECT p_partkey, CASE WHEN f = lower(f) THEN array_to_string(list_transform(string_split(f, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE f END AS shown,
  regexp_replace(trim(regexp_replace(regexp_replace(t, '\\[[0-9, ]+\\]', '', 'g'), '\\s+', ' ', 'g')), '^(the|A) ', '') AS plain
FROM (SELECT *, trim(regexp_replace(replace(t, '-', ' '), '\\s+', ' ', 'g')) AS f FROM t)"""
)
def phrases_shown(spark, sf):
    k, p = F.col("p_partkey") % 4, F.col("p_name")
    t = F.when(k == 0, F.replace(p, F.lit(" "), F.lit("-"))).when(k == 1, F.upper(p)).when(k == 2, F.concat(F.lit("the  "), p, F.lit(" [3, 4]"))).otherwise(F.concat(F.lit("A "), p))
    return table(spark, sf, "part").select("p_partkey", L.display_phrase(t).alias("shown"), L.plain_phrase(t).alias("plain"))


# ---- selections, filters, pages


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#13' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 5")
def concepts_by_name(spark, sf):
    return S.page(S.filtered(table(spark, sf, "part"), p_brand="Brand#13", p_type=None), ["p_name", "p_partkey"], 20, 5).select("p_partkey", "p_name")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_suppkey = 5")
def relations_by_concept(spark, sf):
    return S.filtered(table(spark, sf, "lineitem"), l_suppkey=5, l_partkey=None).select("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {RESULTS_SQL} SELECT 'all' AS papers, count(*)::BIGINT AS n FROM res UNION ALL SELECT 'three', count(*)::BIGINT FROM res WHERE paper_id IN (1, 2, 3)")
def results_of_papers(spark, sf):
    r = results(spark, sf)
    counted = lambda name, ids: K.only_papers(r, ids).agg(n_rows().alias("n")).select(F.lit(name).alias("papers"), "n")
    return counted("all", []).unionByName(counted("three", [1, 2, 3]))


def _instances_sql(where: str) -> str:
    return f"""WITH {RESULTS_SQL}, inst AS (SELECT 'evaluates_on' AS relation, method_id::VARCHAR AS source, dataset_id AS target, * FROM res UNION ALL SELECT 'reports', method_id::VARCHAR, metric_id, * FROM res
  UNION ALL SELECT 'proposes', method_id::VARCHAR, task_id, * FROM res),
pp AS (SELECT relation, source, target, paper_id, sum(conf) * 10000 // count(*) AS mean FROM inst WHERE target IS NOT NULL AND {where} GROUP BY ALL) """


@query(_instances_sql("relation IN ('reports', 'proposes') AND relation <> 'proposes'") + "SELECT relation, source, target, count(*)::BIGINT AS paper_count FROM pp GROUP BY 1, 2, 3 HAVING sum(mean) // count(*) >= 700000")
def edges_of_selection(spark, sf):
    relations = K.selection(" Reports,proposes ", list(K.RELATIONS), list(K.RELATIONS))
    types = K.selection("method,metric", ["method", "dataset", "metric", "task"], ["method", "dataset", "metric", "task"])
    return K.allowed_edges(results(spark, sf), AS_OF_YEAR, relations, types, 70).select("relation", "source", "target", "paper_count")


@query(
    _instances_sql("true")
    + """, yrs AS (SELECT relation, source, target, min(yr) AS a, max(yr) AS b, count(*) AS n, count(*) FILTER (verified) AS v, count(*) FILTER (is_sota) AS s FROM inst WHERE target IS NOT NULL GROUP BY 1, 2, 3),
e AS (SELECT relation, source, target, count(*) AS papers, sum(mean) // count(*) AS m FROM pp GROUP BY 1, 2, 3 HAVING sum(mean) // count(*) >= 600000)
SELECT relation, source, target, (papers * m * (100 + 5 * least(greatest(5 - (2001 - b), 0), 5) + least(20, 2 * (b - a))) * (1000 + least(300, 30 * n) + 300 * v // n + least(100, 50 * s)))::BIGINT::DOUBLE / 1e11 AS weight
FROM e JOIN yrs USING (relation, source, target) ORDER BY weight DESC, relation, source, target LIMIT 500"""
)
def edges_ranked(spark, sf):
    e = K.weighted_edges(K.edge_instances(results(spark, sf)), AS_OF_YEAR)
    return K.ranked_edges(e, K.limit_of(9999, 150, 500)).select("relation", "source", "target", "weight")


# ---- edge and node metadata


@query(
    _instances_sql("true")
    + """, c AS (SELECT relation, source, target, paper_id, dataset_id, metric_id, task_id, count(*) AS n, max(value_cents) AS best FROM inst WHERE relation = 'reports' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY best DESC, paper_id, dataset_id, metric_id, task_id) AS k FROM c)
SELECT relation, source, target, count(DISTINCT paper_id)::BIGINT AS papers, count(*)::BIGINT AS contexts, sum(n)::BIGINT AS results, string_agg(paper_id || ':' || best, ' ' ORDER BY k) FILTER (k <= 12) AS shown FROM r GROUP BY 1, 2, 3"""
)
def edge_contexts(spark, sf):
    return K.edge_metadata(K.edge_instances(results(spark, sf), ["reports"]))


@query(
    f"""WITH {RESULTS_SQL}, r AS (SELECT method_id, dataset_id, value_cents, paper_id, metric_id, task_id, row_number() OVER (PARTITION BY method_id, dataset_id ORDER BY value_cents DESC, paper_id, metric_id, task_id) AS hi,
  row_number() OVER (PARTITION BY method_id, dataset_id ORDER BY value_cents, paper_id, metric_id, task_id) AS lo FROM res)
SELECT method_id, dataset_id, max(value_cents) - min(value_cents) AS effect_cents, max(paper_id) FILTER (hi = 1) AS best_paper_id, max(metric_id) FILTER (hi = 1) AS best_metric_id, max(task_id) FILTER (hi = 1) AS best_task_id,
  max(paper_id) FILTER (lo = 1) AS worst_paper_id, max(metric_id) FILTER (lo = 1) AS worst_metric_id, max(task_id) FILTER (lo = 1) AS worst_task_id FROM r GROUP BY 1, 2 HAVING count(*) >= 2 AND max(value_cents) > min(value_cents)"""
)
def effect_size_contexts(spark, sf):
    return K.effect_sizes(results(spark, sf), ["method_id", "dataset_id"], ["paper_id", "metric_id", "task_id"])


@query(
    """WITH c AS (SELECT DISTINCT l_suppkey AS node, o_orderpriority AS category, o_orderkey AS claim FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY node, category ORDER BY claim) AS k FROM c)
SELECT node, category, count(*)::BIGINT AS claims, string_agg(claim::VARCHAR, ' ' ORDER BY k) FILTER (k <= 5) AS examples FROM r GROUP BY 1, 2"""
)
def claim_examples(spark, sf):
    c = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_suppkey").alias("node"), F.col("o_orderpriority").alias("category"), F.col("o_orderkey").alias("claim")).distinct()
    k = F.row_number().over(S.Window.partitionBy("node", "category").orderBy("claim"))
    shown = F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.col("claim"))))
    return c.withColumn("k", k).groupBy("node", "category").agg(n_rows().alias("claims"), F.array_join(shown.cast("array<string>"), " ").alias("examples"))


@query("SELECT l_suppkey, (-min(struct_pack(a := -l_quantity, b := l_orderkey, c := l_linenumber)).a)::DOUBLE AS confidence, min(struct_pack(a := -l_quantity, b := l_orderkey, c := l_linenumber)).b AS claim FROM lineitem GROUP BY 1")
def best_claim(spark, sf):
    first = F.min(F.struct((-F.col("l_quantity")).alias("q"), "l_orderkey", "l_linenumber")).alias("f")
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(first).select("l_suppkey", (-F.col("f.q")).alias("confidence"), F.col("f.l_orderkey").alias("claim"))


@query(
    """WITH t AS (SELECT o_custkey AS paper_id, l_returnflag AS relation, l_suppkey AS source, l_partkey % 50 AS target, 100 - CAST(round(l_discount * 100) AS BIGINT) AS conf FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT paper_id, relation, source, target, count(*)::BIGINT AS n, (sum(conf) * 10000 // count(*))::BIGINT AS mean_conf FROM t GROUP BY 1, 2, 3, 4"""
)
def triple_pair_means(spark, sf):
    t = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    t = t.select(F.col("o_custkey").alias("paper_id"), F.col("l_returnflag").alias("relation"), F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 50).alias("target"), (F.lit(100) - F.round(F.col("l_discount") * 100).cast("long")).alias("conf"))
    return t.groupBy("paper_id", "relation", "source", "target").agg(n_rows().alias("n"), F.expr("sum(conf) * 10000 div count(*)").alias("mean_conf"))


@query(
    f"""WITH {RESULTS_SQL} SELECT paper_id, method_id, coalesce('', '') || CASE WHEN NOT verified THEN NULL WHEN metric_id = 'R' THEN 'R ' || value_cents || '% on ' || dataset_id WHEN metric_id = 'A' THEN 'Targets ' || task_id ELSE 'Comparison on ' || dataset_id || ' (N)' END AS summary
FROM res"""
)
def edge_summaries(spark, sf):
    relation = F.when(F.col("metric_id") == "R", "reports").when(F.col("metric_id") == "A", "proposes").otherwise("compares")
    said = L.edge_summary(relation, F.col("metric_id"), F.col("value_cents").cast("string"), F.lit("%"), F.col("dataset_id"), F.col("task_id"), F.lit(None).cast("string"), F.col("verified"))
    return results(spark, sf).select("paper_id", "method_id", said.alias("summary"))


@query(f"WITH {RESULTS_SQL} SELECT method_id, string_agg(DISTINCT dataset_id, '|' ORDER BY dataset_id) AS datasets, count(DISTINCT paper_id)::BIGINT AS papers FROM res WHERE dataset_id IS NOT NULL GROUP BY 1")
def node_datasets(spark, sf):
    r = results(spark, sf).filter("dataset_id IS NOT NULL")
    return r.groupBy("method_id").agg(F.array_join(F.array_sort(F.collect_set("dataset_id")), "|").alias("datasets"), F.countDistinct("paper_id").alias("papers"))


# ---- unions and fallbacks


@query(
    """SELECT l_orderkey AS paper_id, 'result' AS kind, l_suppkey AS method_id, l_quantity AS value, NULL::VARCHAR AS relation FROM lineitem
UNION ALL SELECT o_orderkey, 'relation', o_custkey, NULL, o_orderpriority FROM orders"""
)
def results_and_relations(spark, sf):
    a = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.lit("result").alias("kind"), F.col("l_suppkey").alias("method_id"), F.col("l_quantity").alias("value"), F.lit(None).cast("string").alias("relation"))
    b = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit("relation").alias("kind"), F.col("o_custkey").alias("method_id"), F.lit(None).cast("double").alias("value"), F.col("o_orderpriority").alias("relation"))
    return a.unionByName(b)


@query("SELECT p_partkey AS id, p_name AS name, 'fallback' AS origin FROM part UNION ALL SELECT s_suppkey, s_name, 'primary' FROM supplier")
def fallback_when_empty(spark, sf):
    part = lambda origin: table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit(origin).alias("origin"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("primary").alias("origin"))
    return K.else_fallback(part("primary").filter("id < 0"), part("fallback")).unionByName(K.else_fallback(supplier, part("unused")))


@query("SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.n, a.n)::BIGINT AS n, CASE WHEN b.user_id IS NULL THEN 'old' ELSE 'new' END AS version FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) a FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.user_id = b.user_id")
def graph_merge_latest(spark, sf):
    e = table(spark, sf, "events")
    count = lambda d, v: d.groupBy("user_id").agg(n_rows().alias("n")).withColumn("version", F.lit(v))
    return K.latest_of([count(e, "old"), count(e.filter("event_type = 'error'"), "new")], ["user_id"])


@query(
    """WITH s AS (SELECT DISTINCT s_nationkey AS left_key, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey < 5)
SELECT a.left_key AS a, b.left_key AS b, count(*)::BIGINT AS common FROM s a JOIN s b USING (l_partkey) WHERE a.left_key < b.left_key GROUP BY 1, 2"""
)
def shared_papers(spark, sf):
    s = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").filter("s_nationkey < 5"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_partkey", "s_nationkey").distinct()
    return s.select("l_partkey", F.col("s_nationkey").alias("a")).join(s.select("l_partkey", F.col("s_nationkey").alias("b")), "l_partkey").filter("a < b").groupBy("a", "b").agg(n_rows().alias("common"))


# ---- entity resolution


@query(
    """WITH m AS (SELECT p_partkey % 300 AS entity_id, lower(p_type) || p_size AS surface, 2000 + p_partkey % 9 AS year, p_size % 2 = 0 AS acronym, p_size % 3 = 0 AS digit FROM part),
g AS (SELECT surface, entity_id, bool_or(acronym) AS ac, bool_or(digit) AS d, min(year) AS lo, max(year) AS hi FROM m GROUP BY 1, 2), o AS (SELECT surface, count(*) AS owners FROM g GROUP BY 1),
p AS (SELECT a.entity_id AS left_id, b.entity_id AS right_id, 88 + CASE WHEN owners = 2 THEN 5 ELSE 0 END + CASE WHEN a.ac OR b.ac THEN 2 ELSE 0 END + CASE WHEN a.d OR b.d THEN 1 ELSE 0 END
  + CASE WHEN greatest(a.hi, b.hi) - least(a.lo, b.lo) <= 1 THEN 3 WHEN greatest(a.hi, b.hi) - least(a.lo, b.lo) > 5 THEN -5 ELSE 0 END AS c FROM g a JOIN g b USING (surface) JOIN o USING (surface) WHERE a.entity_id < b.entity_id)
SELECT left_id, right_id, max(least(c, 100)) / 100.0::DOUBLE AS score FROM p GROUP BY 1, 2"""
)
def mention_similarity(spark, sf):
    p = F.col("p_size")
    m = table(spark, sf, "part").select((F.col("p_partkey") % 300).alias("entity_id"), F.concat(F.lower("p_type"), p.cast("string")).alias("surface"), (F.lit(2000) + F.col("p_partkey") % 9).alias("year"), (p % 2 == 0).alias("acronym"), (p % 3 == 0).alias("digit"))
    return R.mention_scores(m)


@query("SELECT l_orderkey, l_linenumber, coalesce(m.c, l_partkey) AS method_id FROM lineitem LEFT JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS c FROM part) m ON m.p_partkey = l_partkey")
def results_remapped(spark, sf):
    p = table(spark, sf, "part")
    firsts = p.groupBy("p_name").agg(F.min("p_partkey").alias("canonical_id"))
    mapping = p.join(firsts, "p_name").select(F.col("p_partkey").alias("id"), "canonical_id")
    return R.remapped(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("method_id")), "method_id", mapping)


@query(
    """WITH n AS (SELECT p_partkey, lower(regexp_replace(p_name, '[^A-Za-z ]', '', 'g')) AS k, p_name, p_size, p_brand FROM part),
w AS (SELECT k, p_partkey, p_name, p_size, p_brand, array_to_string(list_transform(string_split(k, ' '), lambda x: CASE WHEN length(x) > 4 AND x LIKE '%s' THEN x[1:length(x) - 1] ELSE x END), ' ') AS concept FROM n)
SELECT concept, count(*)::BIGINT AS occurrences, sum(p_size)::BIGINT AS score, min(p_partkey) AS first_id, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS provenance FROM w GROUP BY 1"""
)
def concepts_merged(spark, sf):
    p = table(spark, sf, "part").withColumn("concept", N.concept_name(F.col("p_name")))
    return p.groupBy("concept").agg(n_rows().alias("occurrences"), F.sum("p_size").alias("score"), F.min("p_partkey").alias("first_id"), F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("provenance"))


@query(
    """WITH c AS (SELECT p_brand AS paper, p_name AS concept, sum(p_size) AS score, count(*) AS n FROM part GROUP BY 1, 2)
SELECT paper, concept, row_number() OVER (PARTITION BY paper ORDER BY 10 * score + 2 * n DESC, lower(concept))::INTEGER AS rank FROM c QUALIFY row_number() OVER (PARTITION BY paper ORDER BY 10 * score + 2 * n DESC, lower(concept)) <= 50"""
)
def concepts_ranked(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_brand").alias("paper"), F.col("p_name").alias("concept")).agg(F.sum("p_size").alias("score"), n_rows().alias("n"))
    rank = F.row_number().over(S.Window.partitionBy("paper").orderBy(F.desc(F.col("score") * 10 + F.col("n") * 2), F.lower("concept")))
    return c.withColumn("rank", rank).filter("rank <= 50").select("paper", "concept", "rank")


@query("SELECT p_name AS name, string_agg(DISTINCT p_brand, '|' ORDER BY p_brand) AS aliases, count(*)::BIGINT AS mentions FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def entity_mentions(spark, sf):
    p = table(spark, sf, "part").join(table(spark, sf, "lineitem").select("l_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return p.groupBy(F.col("p_name").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), "|").alias("aliases"), n_rows().alias("mentions"))


@query("SELECT p_name AS name, count(*)::BIGINT AS n, string_agg(p_partkey::VARCHAR, ' ' ORDER BY p_partkey) FILTER (k <= 3) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part) GROUP BY 1 HAVING count(*) > 1")
def merge_examples(spark, sf):
    k = F.row_number().over(S.Window.partitionBy("p_name").orderBy("p_partkey"))
    shown = F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.col("p_partkey"))))
    return table(spark, sf, "part").withColumn("k", k).groupBy(F.col("p_name").alias("name")).agg(n_rows().alias("n"), F.array_join(shown.cast("array<string>"), " ").alias("examples")).filter("n > 1")


# ---- payloads, spans, contexts


@query(
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'value_missing' WHEN value > 300 THEN 'value_out_of_range' END, CASE WHEN k < 50 THEN 'k_below_50' END], lambda x: x IS NOT NULL), ',') AS issues,
  CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS kind FROM (SELECT *, json_extract_string(props, '$.k')::INTEGER AS k FROM events)"""
)
def payload_issues(spark, sf):
    e = table(spark, sf, "events")
    value = F.when(F.col("event_type") != "error", F.col("value"))
    raw = F.to_json(F.struct(F.col("event_type").alias("kind"), value.alias("value"), F.get_json_object("props", "$.k").cast("int").alias("k")))
    got = e.select("event_id", F.from_json(raw, "kind string, value double, k int").alias("p"))
    issues = F.array(F.when(F.col("p.value").isNull(), "value_missing").when(F.col("p.value") > 300, "value_out_of_range"), F.when(F.col("p.k") < 50, "k_below_50"))
    return got.select("event_id", F.array_join(F.array_compact(issues), ",").alias("issues"), F.when(F.col("p.kind").isin("click", "view"), F.col("p.kind")).otherwise("other").alias("kind"))


@query("SELECT event_id, s_suppkey AS section_id FROM events LEFT JOIN supplier ON s_suppkey = user_id")
def known_sections(spark, sf):
    return table(spark, sf, "events").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("section_id")), F.col("user_id") == F.col("section_id"), "left").select("event_id", "section_id")


@query(
    """WITH s AS (SELECT p_partkey, p_name, p_size - 5 AS a, CASE WHEN p_partkey % 3 = 0 THEN p_size - 9 ELSE p_size + 4 END AS b, string_split(p_name, ' ')[2] AS m FROM part),
c AS (SELECT *, least(greatest(a, 0), length(p_name)) AS x, least(greatest(b, 0), length(p_name)) AS y FROM s)
SELECT p_partkey, CASE WHEN x < y THEN x ELSE instr(p_name, m) - 1 END::INTEGER AS start, CASE WHEN x < y THEN y ELSE instr(p_name, m) - 1 + length(m) END::INTEGER AS "end" FROM c"""
)
def spans_repaired(spark, sf):
    end = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") - 9).otherwise(F.col("p_size") + 4)
    span = L.span_in(F.col("p_name"), F.col("p_size") - 5, end, F.split("p_name", " ")[1])
    return table(spark, sf, "part").select("p_partkey", span.alias("s")).select("p_partkey", "s.start", "s.end")


@query(
    """WITH c AS (SELECT user_id AS section, min(event_id) AS first FROM events WHERE event_type = 'click' GROUP BY 1), g AS (SELECT user_id % 10 AS grp, min(event_id) AS first FROM events GROUP BY 1)
SELECT e.event_id, coalesce(c.first, g.first) AS context FROM events e LEFT JOIN c ON c.section = e.user_id LEFT JOIN g ON g.grp = e.user_id % 10 WHERE e.event_type = 'error'"""
)
def context_lookup(spark, sf):
    e = table(spark, sf, "events").withColumn("grp", F.col("user_id") % 10)
    own = e.filter("event_type = 'click'").groupBy("user_id").agg(F.min("event_id").alias("own"))
    wide = e.groupBy("grp").agg(F.min("event_id").alias("wide"))
    return e.filter("event_type = 'error'").join(own, "user_id", "left").join(wide, "grp", "left").select("event_id", F.coalesce("own", "wide").alias("context"))


@query("SELECT doc_id, t.s AS part, substr(text, t.s * 300 + 1, 300) AS evidence FROM documents, (SELECT unnest([0, 2, 5]) AS s) t WHERE length(text) > t.s * 300")
def spans_to_text(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.array(*[F.lit(i) for i in (0, 2, 5)])).alias("part"))
    return d.filter(F.length("text") > F.col("part") * 300).select("doc_id", "part", F.substring(F.col("text"), F.col("part") * 300 + 1, F.lit(300)).alias("evidence"))


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'error' THEN 1000000 ELSE event_id % 7 END, event_id)::INTEGER AS place FROM events")
def candidate_order(spark, sf):
    section = F.coalesce(F.when(F.col("event_type") != "error", F.col("event_id") % 7), F.lit(1_000_000))
    return table(spark, sf, "events").select("event_id", "user_id", F.row_number().over(S.Window.partitionBy("user_id").orderBy(section, "event_id")).alias("place"))


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_extendedprice, 2), round(l_discount, 2), l_linenumber)::INTEGER AS place FROM lineitem")
def block_reading_order(spark, sf):
    place = F.row_number().over(S.Window.partitionBy("l_orderkey").orderBy(F.round("l_extendedprice", 2), F.round("l_discount", 2), "l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", place.alias("place"))


@query("SELECT p_partkey, to_json(map_from_entries(list_filter([struct_pack(k := 'name', v := CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END), struct_pack(k := 'brand', v := CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_brand END), struct_pack(k := 'type', v := p_type)], lambda x: x.v IS NOT NULL AND x.v <> '')))::VARCHAR AS payload FROM part")
def payload_without_blanks(spark, sf):
    raw = F.create_map(F.lit("name"), F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_name")), F.lit("brand"), F.when(F.col("p_partkey") % 2 != 0, F.col("p_brand")), F.lit("type"), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", F.to_json(F.map_filter(raw, lambda _, v: v.isNotNull() & (v != ""))).alias("payload"))


@query("SELECT vec_id, sha256(vec_id::VARCHAR || '|' || label) AS h, 'method:' || vec_id AS node_id, 'reports:' || vec_id || ':' || label AS edge_id FROM embeddings")
def node_and_edge_ids(spark, sf):
    v, label = F.col("vec_id").cast("string"), F.col("label").cast("string")
    return table(spark, sf, "embeddings").select("vec_id", F.sha2(F.concat_ws("|", v, label), 256).alias("h"), F.concat(F.lit("method:"), v).alias("node_id"), F.concat_ws(":", F.lit("reports"), v, label).alias("edge_id"))


# ---- writes and logs


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1")
def status_of_log(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("status"))


@query("SELECT n_nationkey AS version, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey FROM region)")
def pending_migrations(spark, sf):
    manifest = table(spark, sf, "nation").select(F.col("n_nationkey").alias("version"), F.col("n_name").alias("name"))
    return manifest.join(table(spark, sf, "region").select(F.col("r_regionkey").alias("version")), "version", "left_anti")


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id < 40)")
def vectors_by_hash(spark, sf):
    h = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return h.join(h.filter("doc_id < 40").select("hash").distinct(), "hash", "left_semi").select("doc_id", "hash")


@query("SELECT vec_id, label FROM embeddings WHERE label <> 3 UNION ALL SELECT vec_id + 100000, label FROM embeddings WHERE label = 3 AND vec_id % 2 = 0")
def vectors_replaced(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    return S.replace_for_key(e, e.filter("label = 3 AND vec_id % 2 = 0").withColumn("vec_id", F.col("vec_id") + 100_000), "label")


@query("SELECT date_trunc('month', o_orderdate) AS month, o_orderstatus AS status, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2")
def activity_timeline(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), F.col("o_orderstatus").alias("status")).agg(n_rows().alias("n"))


@query("SELECT p_type AS kind, p_partkey, p_name FROM part WHERE p_name ILIKE '%widget%' AND p_type = 'ECONOMY' ORDER BY p_name, p_partkey LIMIT 20")
def concept_search(spark, sf):
    return S.page(table(spark, sf, "part").filter(F.col("p_name").ilike("%widget%") & (F.col("p_type") == "ECONOMY")), ["p_name", "p_partkey"], K.limit_of(99, 10, 20)).select(F.col("p_type").alias("kind"), "p_partkey", "p_name")


@query(
    f"""WITH {RESULTS_SQL}, p AS (SELECT paper_id, list_sort(list_distinct(list(dataset_id))) AS d FROM res WHERE paper_id IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 40) AND dataset_id IS NOT NULL GROUP BY 1)
SELECT a.paper_id AS a, b.paper_id AS b, array_to_string(list_sort(list_intersect(a.d, b.d)), '|') AS shared, array_to_string(list_filter(a.d, lambda x: NOT list_contains(b.d, x)), '|') AS only_a FROM p a JOIN p b ON a.paper_id < b.paper_id WHERE len(list_intersect(a.d, b.d)) > 0"""
)
def papers_shared_datasets(spark, sf):
    first = table(spark, sf, "orders").select(F.col("o_orderkey").alias("paper_id")).orderBy("paper_id").limit(40)
    r = results(spark, sf).join(F.broadcast(first), "paper_id", "left_semi").filter("dataset_id IS NOT NULL").select("paper_id", "dataset_id").distinct()
    sets = r.groupBy("paper_id").agg(F.collect_set("dataset_id").alias("d"))
    # pairs of papers meet on a dataset that they share
    pairs = r.select(F.col("paper_id").alias("a"), "dataset_id").join(r.select(F.col("paper_id").alias("b"), "dataset_id"), "dataset_id").filter("a < b").select("a", "b").distinct()
    pairs = pairs.join(sets.select(F.col("paper_id").alias("a"), F.col("d").alias("da")), "a").join(sets.select(F.col("paper_id").alias("b"), F.col("d").alias("db")), "b")
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return pairs.select("a", "b", joined(F.array_intersect("da", "db")).alias("shared"), joined(F.array_except("da", "db")).alias("only_a"))


@query(r"SELECT doc_id, left(trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g')), 255) AS title, length(text) - length(ltrim(text, ' ' || chr(10) || chr(9))) AS lead FROM documents")
def titles(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.left(F.trim(F.regexp_replace(F.split(t, "\n")[0], r"\s+", " ")), F.lit(255)).alias("title"), (F.length(t) - F.length(F.regexp_replace(t, r"^[ \n\t]+", ""))).cast("long").alias("lead"))


@query("SELECT doc_id, a AS start, regexp_replace(regexp_replace(substr(text, greatest(a - 80, 0) + 1, least(a + 100, length(text)) - greatest(a - 80, 0)), '\\s+', ' ', 'g'), '^ | $', '', 'g') AS around FROM (SELECT doc_id, text, length(text) // 2 AS a FROM documents)")
def evidence_windows(spark, sf):
    a = F.floor(F.length("text") / 2)
    lo = F.greatest(a - 80, F.lit(0))
    around = X.collapse(F.col("text").substr((lo + 1).cast("int"), (F.least(a + 100, F.length("text")) - lo).cast("int")))
    return table(spark, sf, "documents").select("doc_id", a.alias("start"), around.alias("around"))
