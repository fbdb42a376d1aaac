"""Queries on pairs of entities, places of aliases in raw texts, and quotes in sentences, and the SQL that states the same over all pairs."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from quillgraph.operators import automaton as A
from quillgraph.operators import dependency as P
from quillgraph.operators import fuzzy as Z
from quillgraph.operators import verify as C
from quillgraph.plans.collect import collector
from quillgraph.sources.readers import table
from quillgraph.sources.store import scratch_folder

QUERIES, query = collector()


# ---- pairs of entities


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name, unnest([p_brand, string_split(p_name, ' ')[2]]) AS block FROM part), p AS (SELECT DISTINCT a.name AS l, b.name AS r FROM n a JOIN n b USING (block) WHERE a.name < b.name),
j AS (SELECT *, jaro_similarity(l, r) AS j, list_sum(list_transform([1, 2, 3, 4], lambda k: (left(l, k) = left(r, k) AND length(l) >= k AND length(r) >= k)::INTEGER)) AS pre FROM p)
SELECT l AS left_name, r AS right_name, round(j + pre * 0.1::DOUBLE * (1 - j), 6) AS score FROM j WHERE round(j + pre * 0.1::DOUBLE * (1 - j), 6) >= 0.9"""
)
def similar_names(spark, sf):
    """Names of one brand or one second word that are alike; a name is in several blocks."""
    p = table(spark, sf, "part")
    return Z.similar_names(p.select(F.col("p_name").alias("name"), F.explode(F.array("p_brand", F.split("p_name", " ")[1])).alias("block")), 0.9)


@query(
    """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 40 = 0 THEN 'WMT 2014 English-to-German' WHEN p_partkey % 40 = 1 THEN 'wmt2015 en to  fr' WHEN p_partkey % 40 = 2 THEN 'WMT 2014 en to de (test)' ELSE p_name END AS name, p_partkey % 500 AS v FROM part),
x AS (SELECT id, name, lower(name) AS low, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = v) AS vec, regexp_matches(lower(name), 'wmt\\s*[0-9]{4}\\b.*?(english|en)[-\\s→–—]*to[-\\s→–—]*?(german|de|french|fr)') AS task FROM e),
k AS (SELECT DISTINCT id, 'name ' || lower(name) AS key FROM e UNION SELECT l_partkey, 'paper ' || l_orderkey FROM lineitem),
p AS (SELECT DISTINCT a.id AS left_id, b.id AS right_id FROM k a JOIN k b USING (key) WHERE a.id < b.id),
j AS (SELECT left_id, right_id, l.low = r.low AS same, jaro_similarity(l.low, r.low) AS j, list_sum(list_transform([1, 2, 3, 4], lambda k: (left(l.low, k) = left(r.low, k) AND length(l.low) >= k AND length(r.low) >= k)::INTEGER)) AS pre,
  list_cosine_similarity(l.vec, r.vec) AS c, l.task AND r.task AS task FROM p JOIN x l ON l.id = left_id JOIN x r ON r.id = right_id),
s AS (SELECT *, least(1, greatest(0, 0.6::DOUBLE * coalesce(c, 0) + 0.4::DOUBLE * CASE WHEN same THEN 1 ELSE j + pre * 0.1::DOUBLE * (1 - j) END)) AS base FROM j)
SELECT left_id, right_id, round(CASE WHEN task THEN greatest(base, 0.85::DOUBLE) ELSE base END, 6) AS score FROM s"""
)
def entity_pair_scores(spark, sf):
    """Parts with one name or in one order, by their names' vectors and spelling; names of one shared task count as alike."""
    k, p = F.col("p_partkey") % 40, table(spark, sf, "part")
    name = F.when(k == 0, "WMT 2014 English-to-German").when(k == 1, "wmt2015 en to  fr").when(k == 2, "WMT 2014 en to de (test)").otherwise(F.col("p_name"))
    e = p.select(F.col("p_partkey").alias("id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"), (F.col("p_partkey") % 500).alias("vec"))
    named, vectors = Z.named_entities(e), table(spark, sf, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("vector"))
    by_paper = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("key"))
    return Z.scored_namesakes(named, vectors).unionByName(Z.scored_by_keys(by_paper, named, vectors, scratch_folder(spark, "pairs")))


# ---- aliases in raw texts

#: Names are the first three words of the benchmark's items as they stand; their aliases, every other one in capitals, those and the last two of them.
_LEX_SQL = """lex AS (SELECT item_id, array_to_string(w[1:3], ' ') AS name, unnest([array_to_string(w[1:3], ' '), CASE WHEN item_id % 2 = 0 THEN upper(array_to_string(w[2:3], ' ')) ELSE array_to_string(w[2:3], ' ') END]) AS alias
  FROM (SELECT item_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM benchmark) WHERE len(w) >= 3)"""


def _lexicon(spark, sf):
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    b = table(spark, sf, "benchmark").select("item_id", w.alias("w")).filter(F.size("w") >= 3)
    tail = F.array_join(F.slice("w", 2, 2), " ")
    return b.select("item_id", F.array_join(F.slice("w", 1, 3), " ").alias("name"), F.explode(F.array(F.array_join(F.slice("w", 1, 3), " "), F.when(F.col("item_id") % 2 == 0, F.upper(tail)).otherwise(tail))).alias("alias"))


@query(
    f"""WITH RECURSIVE {_LEX_SQL}, l AS (SELECT DISTINCT name, alias, lower(alias) AS a FROM lex), d AS (SELECT doc_id, text, lower(text) AS t FROM documents WHERE text IS NOT NULL),
m AS (SELECT doc_id, text, t, name, alias, a FROM d JOIN l ON contains(t, a)),
o(doc_id, text, t, name, alias, a, s) AS (SELECT *, strpos(t, a) FROM m UNION ALL SELECT doc_id, text, t, name, alias, a, s + strpos(t[s + 1:], a) FROM o WHERE strpos(t[s + 1:], a) > 0)
SELECT doc_id, name, alias, (s - 1)::INTEGER AS start, (s - 1 + length(a))::INTEGER AS "end", substr(text, s, length(a)) AS mention FROM o
WHERE NOT (s > 1 AND regexp_matches(substr(t, s - 1, 1), '[a-z0-9]')) AND NOT regexp_matches(substr(t, s + length(a), 1), '[a-z0-9]')"""
)
def alias_places(spark, sf):
    return A.alias_places(table(spark, sf, "documents"), _lexicon(spark, sf), "doc_id", "text")


_NORM_SQL = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    f"""WITH {_LEX_SQL}, k AS (SELECT {_NORM_SQL.format('alias')} AS key, min(item_id) AS o, max_by(name, item_id) AS name FROM lex GROUP BY 1),
d AS (SELECT doc_id, {_NORM_SQL.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, name, key FROM d JOIN k ON contains(t, key) AND length(key) >= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(key) DESC, o) = 1"""
)
def longest_alias(spark, sf):
    return A.longest_names(table(spark, sf, "documents"), _lexicon(spark, sf).withColumnRenamed("item_id", "ordinal"), "doc_id", "text")


# ---- quotes in sentences


def _quotes(spark, sf):
    """Of each turn of a conversation its middle, every third with a letter changed, claimed of all turns of the conversation."""
    c = table(spark, sf, "conversations").filter("length(text) >= 30")
    middle = F.substring(F.col("text"), F.lit(6), F.length("text") - 10)
    quote = F.when(F.col("turn") % 3 == 1, F.concat(F.left(middle, F.lit(12)), F.lit("~"), F.substring(middle, F.lit(14), F.length(middle)))).otherwise(F.translate(middle, string.ascii_lowercase, string.ascii_uppercase))
    return c.select("conv_id", F.col("turn").alias("claim"), quote.alias("quote")), table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("sentence"))


_QUOTE_SQL = """c AS (SELECT conv_id, turn AS claim, CASE WHEN turn % 3 = 1 THEN m[:12] || '~' || m[14:] ELSE translate(m, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS quote FROM (SELECT *, text[6:length(text) - 5] AS m FROM conversations WHERE length(text) >= 30)),
p AS (SELECT conv_id, claim, s.turn, lower(trim(quote)) AS q, length(trim(quote)) AS n, lower(s.text) AS s FROM c JOIN conversations s USING (conv_id) WHERE trim(quote) <> '')"""


@query(f"""WITH {_QUOTE_SQL} SELECT conv_id, claim, min(turn) AS turn FROM p WHERE contains(s, q) AND claim % 3 <> 1 GROUP BY 1, 2""")
def quotes_found(spark, sf):
    """Quotes that were not changed are found in the first turn that holds them, but where an earlier one is nearly the same."""
    claims, sentences = _quotes(spark, sf)
    found = C.match_evidence(claims.filter("claim % 3 <> 1"), sentences, "conv_id", "claim", "turn")
    pairs = C.evidence_pairs(claims, sentences, "conv_id", "claim", "turn").filter("at > 0").groupBy("conv_id", "claim").agg(F.min("turn").alias("turn"))
    return pairs.join(found.select("conv_id", "claim"), ["conv_id", "claim"], "left_semi")


@query(
    f"""WITH {_QUOTE_SQL}, k AS (SELECT *, greatest(5, floor(n * 0.6::DOUBLE)::INTEGER) AS k FROM p),
f AS (SELECT *, contains(s, q) AS exact, length(q) >= k AND 2 * least(length(s), length(q)) >= 0.75::DOUBLE * (length(s) + length(q))
  AND len(list_filter(range(0, length(q) - (k + 1) // 2 + 1, (k + 1) // 2), lambda i: contains(s, substr(q, i + 1, (k + 1) // 2)))) > 0 AS near FROM k)
SELECT conv_id, claim, count(*)::BIGINT AS sentences, count(*) FILTER (exact)::BIGINT AS exact, count(*) FILTER (near AND NOT exact)::BIGINT AS aligned FROM f GROUP BY 1, 2"""
)
def quote_candidates(spark, sf):
    claims, sentences = _quotes(spark, sf)
    return C.evidence_candidates(claims, sentences, "conv_id", "claim", "turn")


# ---- dependency patterns

#: What stands for a parser: of each word of a turn a lemma, part of speech, dependency and parent, by its length and place.
_LEMMAS = ["propose", "evaluate", "achieve", "for", "on", "accuracy", "report", "x"]
_POS = ["NOUN", "PROPN", "ADJ", "NOUN", "VERB"]
_DEPS = ["dobj", "nsubj", "prep", "pobj", "nsubj", "attr", "prep"]


#: Turns that a task takes: a turn costs far more than its bytes tell, so parts go by their number.
_TURNS = 1000


def _pick(words, n):
    return F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))


def _tokens(spark, sf):
    c = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    c = c.repartition(c.count() // _TURNS + 1, "doc")

    def token(word, i):
        k = F.length(word) * 3 + i * 5 + (F.col("doc") % 7).cast("int")
        start = F.when(i > 0, F.length(F.call_function("substring_index", F.col("text"), F.lit(" "), i)) + 1).otherwise(0)
        head = F.when(i > 0, F.floor((i - 1) / 3).cast("int"))
        return F.struct(i.alias("i"), start.alias("start"), word.alias("word"), _pick(_LEMMAS, k).alias("lemma"), _pick(_POS, k + i).alias("pos"), _pick(_DEPS, k + 1).alias("dep"), head.alias("head"), (k % 11 == 4).alias("like_num"))

    t = c.select("doc", F.inline(F.transform(F.split("text", " "), token)))
    return t, c


def _pattern_sql():
    one = lambda p: f"('{p.rule}', {list(p.verbs)}, {list(p.noun_deps)}, {list(p.preps)}::VARCHAR[], {list(p.object_deps)}, {str(p.noun_object).lower()})"
    return ", ".join(one(p) for p in P.PATTERNS)


_PHRASE = "regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace({}, '\\[[^\\]]+\\]', ' ', 'g'), '\\s+', ' ', 'g')), '^(the|a|an)\\s+', '', 'i'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"


@query(
    f"""WITH RECURSIVE c AS (SELECT conv_id * 1000 + turn AS doc, text, string_split(text, ' ') AS w FROM conversations),
v AS (SELECT doc, w, unnest(range(1, len(w) + 1)) AS n FROM c), x AS (SELECT doc, (n - 1)::INTEGER AS i, w[n] AS word, coalesce(list_sum(list_transform(w[1:n - 1], lambda y: length(y) + 1)), 0)::INTEGER AS start, length(w[n]) * 3 + (n - 1) * 5 + doc % 7 AS k FROM v),
t AS MATERIALIZED (SELECT doc, i, start, word, start + length(word) AS "end", {_LEMMAS}[k % {len(_LEMMAS)} + 1] AS lemma, {_POS}[(k + i) % {len(_POS)} + 1] AS pos, {_DEPS}[(k + 1) % {len(_DEPS)} + 1] AS dep, CASE WHEN i > 0 THEN (i - 1) // 3 END AS head, k % 11 = 4 AS num FROM x),
up(doc, i, a) AS (SELECT doc, i, i FROM t UNION ALL SELECT up.doc, up.i, t.head FROM up JOIN t ON t.doc = up.doc AND t.i = up.a WHERE t.head IS NOT NULL),
r AS MATERIALIZED (SELECT l.doc, l.a AS i, f.start AS s, e."end" AS e FROM (SELECT doc, a, min(i) AS lo, max(i) AS hi FROM up GROUP BY 1, 2) l JOIN t f ON f.doc = l.doc AND f.i = l.lo JOIN t e ON e.doc = l.doc AND e.i = l.hi),
p(rule, verbs, nd, preps, od, nouns) AS (VALUES {_pattern_sql()}),
m AS (SELECT v.doc, p.rule, v.lemma AS verb, n.i AS noun, o.i AS object FROM p JOIN t v ON list_contains(p.verbs, v.lemma) JOIN t n ON n.doc = v.doc AND n.head = v.i AND list_contains(p.nd, n.dep) AND n.pos IN ('NOUN', 'PROPN')
  LEFT JOIN t q ON q.doc = v.doc AND q.head = v.i AND q.dep = 'prep' AND list_contains(p.preps, q.lemma)
  JOIN t o ON o.doc = v.doc AND o.head = CASE WHEN len(p.preps) = 0 THEN v.i ELSE q.i END AND list_contains(p.od, o.dep) AND (NOT p.nouns OR o.pos IN ('NOUN', 'PROPN'))),
z AS (SELECT doc, string_agg(CASE WHEN trim(word) = '' THEN 's' WHEN num THEN 'n' WHEN list_contains({P.UNIT_TOKENS}, lower(word)) THEN 'u' WHEN lower(word) = 'to' THEN 'o' ELSE 'x' END, '' ORDER BY i) AS numbers,
  string_agg(CASE WHEN pos = 'ADJ' THEN 'a' WHEN pos IN ('NOUN', 'PROPN') THEN 'n' ELSE 'x' END, '' ORDER BY i) AS nouns, list(start ORDER BY i) AS ss, list("end" ORDER BY i) AS es FROM t GROUP BY 1),
k AS (SELECT m.*, z.*, c.text, (SELECT min(t.i) FROM t WHERE t.doc = m.doc AND t.i BETWEEN object - {P.METRIC_REACH} AND object + {P.METRIC_REACH} AND (list_contains({P.METRICS}, t.lemma) OR list_contains({P.METRICS}, lower(t.word)))) AS mi,
  length(rtrim(regexp_extract(numbers[object + 2:], '^([nus]|on)*'), 's')) AS more, a.s AS as_, a.e AS ae, b.s AS bs, b.e AS be FROM m JOIN z ON z.doc = m.doc JOIN c ON c.doc = m.doc JOIN r a ON a.doc = m.doc AND a.i = noun JOIN r b ON b.doc = m.doc AND b.i = object),
g AS (SELECT *, text[as_ + 1:ae] AS subject, CASE WHEN rule = 'REPORTS' THEN text[ss[object + 1] + 1:es[object + 1 + more]] ELSE text[bs + 1:be] END AS own,
  CASE WHEN rule = 'REPORTS' AND mi IS NOT NULL THEN text[ss[mi + 1 - length(regexp_extract(nouns[1:mi], '[an]*$'))] + 1:es[mi + 1 + length(regexp_extract(nouns[mi + 2:], '^n*'))]] END AS metric FROM k),
f AS (SELECT *, coalesce(nullif({_PHRASE.format('subject')}, ''), trim(subject)) AS s, coalesce(nullif({_PHRASE.format('own')}, ''), trim(own)) AS o, coalesce(nullif({_PHRASE.format('metric')}, ''), trim(metric)) AS q FROM g)
SELECT doc, rule, verb, s AS subject, CASE WHEN q IS NULL THEN o ELSE q || ' ' || o END AS object, CASE WHEN q IS NOT NULL THEN 'Metric' WHEN rule = 'PROPOSES' THEN 'Task' WHEN rule = 'EVALUATED_ON' THEN 'Dataset' ELSE 'Concept' END AS object_type,
  CASE WHEN rule <> 'REPORTS' THEN {P.RULE} WHEN q IS NOT NULL THEN {P.WITH_METRIC} ELSE {P.WITHOUT_METRIC} END AS conf FROM f"""
)
def dependency_matches(spark, sf):
    tokens, sentences = _tokens(spark, sf)
    m = P.with_phrases(P.pattern_matches(P.sentence_trees(tokens, "doc")), sentences, "doc")
    return m.select("doc", "rule", "verb", "subject", "object", "object_type", "conf")
