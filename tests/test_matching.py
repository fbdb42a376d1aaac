"""Alike names, places of aliases and near quotes against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.similarity import jaro_winkler_of
from quillgraph.operators import automaton, fuzzy, verify


def names(seed, n):
    r = random.Random(seed)
    out = {"", "a", "b", "ab", "ba", "aé", "éa", "\U0001f600b", "aaaa", "aaab"}
    while len(out) < n:
        base = "".join(r.choice("abcdeé ") for _ in range(r.randrange(1, 16)))
        out.add(base)
        k = r.randrange(len(base))
        out |= {base[:k] + base[k + 1 :], base[:k] + r.choice("abcxyz") + base[k:], base[1:2] + base[:1] + base[2:]}
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.7, 0.85, 0.93])
def test_no_pair_of_alike_names_is_lost(spark, threshold):
    rows = [(n, f"b{i % 3}") for i, n in enumerate(names(5, 300))] + [(n, "b0") for n in names(5, 300)[::4]]
    blocks = {}
    for n, b in rows:
        blocks.setdefault(b, set()).add(n)
    want = {(a, b, round(jaro_winkler_of(a, b), 6)) for own in blocks.values() for a in own for b in own if a and a < b and round(jaro_winkler_of(a, b), 6) >= threshold}
    df = spark.createDataFrame(rows, "name string, block string")
    got = [tuple(r) for r in fuzzy.similar_names(df, threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = sum(len(own) * (len(own) - 1) // 2 for own in blocks.values())
    assert fuzzy.candidate_pairs(df, threshold).count() < pairs * (1 if threshold < 0.8 else 0.6)
    assert fuzzy.similar_names(df.limit(0), threshold).count() == 0


def test_one_block_is_not_one_task(spark):
    """All names in one block: the join is by block, length and character."""
    df = spark.createDataFrame([(n, "one") for n in names(9, 2000)], "name string, block string")
    plan = fuzzy.candidate_pairs(df, 0.9)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and re.search(r"Join \[block#\d+, length#\d+, first#\d+\]|block#\d+.*length#\d+.*first#\d+", plan)
    with pytest.raises(ValueError, match="may be alike"):
        fuzzy.candidate_pairs(df, 0.6)


def test_entity_scores(spark):
    e = spark.createDataFrame(
        [(1, "Alpha Net", [], [1.0, 0.0]), (2, "alpha net", [], [0.0, 1.0]), (3, "beta", ["WMT 2014 English→German"], None), (4, "gamma", ["wmt2016 en-to-fr"], [1.0, 1.0]), (5, "delta WMT 2014", ["en to german"], [1.0, 0.0])],
        "id long, name string, aliases array<string>, vector array<double>",
    )
    keys = spark.createDataFrame([(i, "k") for i in range(1, 6)] + [(1, "m"), (2, "m"), (1, None), (3, None)], "id long, key string")
    pairs = fuzzy.blocked_pairs(keys)
    assert pairs.count() == 10
    by_mentions = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.1)], "left_id long, right_id long, score double")
    got = {(r["left_id"], r["right_id"]): r["score"] for r in fuzzy.scored_entities(pairs, e, by_mentions).collect()}
    assert got[1, 2] == 0.4 and got[1, 3] == 0.9 and got[4, 5] == 0.85 and got[1, 5] == pytest.approx(0.6 + 0.4 * jaro_winkler_of("alpha net", "delta wmt 2014"), abs=1e-6)
    assert got[3, 4] == pytest.approx(0.4 * jaro_winkler_of("beta", "gamma"), abs=1e-6)  # an arrow is no "to"


def brute_places(text, alias):
    """Every place, overlapping ones too."""
    pattern = re.compile(rf"(?<![A-Za-z0-9])(?=({re.escape(alias)})(?![A-Za-z0-9]))", re.IGNORECASE)
    return {(m.start(1), m.end(1), m.group(1)) for m in pattern.finditer(text)}


def test_alias_places_equal_brute_force(spark):
    r = random.Random(3)
    parts = ["a", "ab", "A-b", "b", "é", "É", "字", "c.", "(c)", "İ", "x1", "ı", "ſ", "K", "\U0001f600", "ΣΑΣ", "σας", "the the", "_"]
    texts = [(k, "".join(r.choice(parts) + r.choice(["", " ", " ", "\n", "-"]) for _ in range(r.randrange(40)))) for k in range(150)] + [(900, None), (901, "")]
    aliases = ["a", "AB", "a b", "a-B", "b a", "é", "字", "c.", "(C)", "x1", "\U0001f600", "σασ", "the the", "the the the the", "the the the"]
    lexicon = [(a.upper(), a) for a in aliases] + [("other", "ab"), ("blank", " "), ("none", None)]
    df, lex = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(lexicon, "name string, alias string")
    want = {(i, n, a, *p) for i, t in texts for n, a in lexicon if a and a.strip() for p in brute_places(t or "", a)}
    for part in (1000, 4):  # one automaton and several
        got = [tuple(x) for x in automaton.alias_places(df, lex, "id", "text", part).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert automaton.alias_places(df, lex.limit(0), "id", "text").count() == 0 and automaton.alias_places(df.limit(0), lex, "id", "text").count() == 0


def test_a_dictionary_of_100_000_aliases(spark):
    lex = spark.range(100_000).select(F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("item "), F.col("id").cast("string")).alias("alias"))
    texts = spark.range(2000).select("id", F.concat(F.lit("An ITEM "), (F.col("id") * 7).cast("string"), F.lit(", item "), (F.col("id") + 100_000).cast("string"), F.lit(" and xitem 5.")).alias("text"))
    got = automaton.alias_places(texts, lex, "id", "text", 30_000)
    assert got.count() == 2000 and got.filter(F.col("name") == F.concat(F.lit("n"), (F.col("id") * 7).cast("string"))).count() == 2000


def test_longest_names(spark):
    entries = [("BLEU", "bleu"), ("Score", "BLEU score"), ("en", "en"), ("A", "abc def"), ("B", "def abc"), ("C", "bleu-score")]
    lex = spark.createDataFrame([(i, n, a) for i, (n, a) in enumerate(entries)], "ordinal long, name string, alias string")
    texts = spark.createDataFrame([(1, "a BLEU  score"), (2, "xbleus"), (3, "en"), (4, "def abc def"), (5, None)], "id long, text string")
    for part in (100, 1):
        got = {r["id"]: (r["name"], r["key"]) for r in automaton.longest_names(texts, lex, "id", "text", part).collect()}
        assert got == {1: ("C", "bleu score"), 2: ("BLEU", "bleu"), 4: ("A", "abc def")}  # the last name of a key, and of equally long keys the first


def test_near_quotes_equal_brute_force(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdeißİé") for _ in range(r.randrange(1, 7)))
    sentences = [" ".join(word() for _ in range(r.randrange(1, 14))) for _ in range(120)]
    claims = []
    for k in range(120):
        q = list(sentences[k])
        for _ in range(r.randrange(4)):
            q[r.randrange(len(q))] = r.choice("abcx ")
        claims.append((k % 4, k, r.choice(["", " ", "zz "]) + "".join(q).upper() + r.choice(["", " tail"])))
    claims += [(0, 500, None), (0, 501, "  "), (9, 502, "no paper")]
    rows = [(k % 4, k, t) for k, t in enumerate(sentences)] + [(0, 900, None), (1, 901, "")]
    c, s = spark.createDataFrame(claims, "paper int, claim int, quote string"), spark.createDataFrame(rows, "paper int, line int, sentence string")
    pairs = verify.evidence_pairs(c, s, "paper", "claim", "line").collect()
    tight = 0
    for p in pairs:
        if not p["at"] and verify.near_span(p["sentence"], p["quote"].strip()):
            assert p["near"], (p["sentence"], p["quote"])
            tight += 1
    assert tight > 10 and sum(p["near"] for p in pairs) < len(pairs) / 5
    want = {}
    for p in sorted(pairs, key=lambda p: p["line"]):
        quote = p["quote"].strip()
        span = (p["at"] - 1, p["at"] - 1 + len(quote), False) if p["at"] else (lambda m: m and (m["start"], m["end"], True))(verify.near_span(p["sentence"], quote))
        if span and (p["paper"], p["claim"]) not in want:
            want[p["paper"], p["claim"]] = (p["line"], *span)
    got = {(x["paper"], x["claim"]): (x["line"], x["start"], x["end"], x["fuzzy"]) for x in verify.match_evidence(c, s, "paper", "claim", "line").collect()}
    assert got == want
    count = verify.evidence_candidates(c, s, "paper", "claim", "line").agg(F.sum("sentences"), F.sum("exact"), F.sum("aligned")).first()
    assert tuple(count) == (len(pairs), sum(p["at"] is not None and p["at"] > 0 for p in pairs), sum(p["near"] for p in pairs))


def parsed(doc, rows):
    """(word, lemma, pos, dep, head) rows of a sentence whose words are parted by spaces."""
    at, out = 0, []
    for i, (word, lemma, pos, dep, head) in enumerate(rows):
        out.append((doc, i, at, word, lemma, pos, dep, head, word.replace(".", "").isdigit()))
        at += len(word) + 1
    return out, (doc, " ".join(r[0] for r in rows))


def test_relations_from_trees(spark):
    from quillgraph.operators import dependency

    proposes = [("We", "we", "PRON", "nsubj", 1), ("propose", "Propose", "VERB", "ROOT", 1), ("the", "the", "DET", "det", 3), ("AlphaNet", "alphanet", "PROPN", "dobj", 1), ("[3]", "3", "X", "punct", 3), ("for", "for", "ADP", "prep", 1), ("machine", "machine", "NOUN", "compound", 7), ("translation", "translation", "NOUN", "pobj", 5), (".", ".", "PUNCT", "punct", 1)]
    reports = [("AlphaNet", "alphanet", "PROPN", "nsubj", 1), ("achieves", "achieve", "VERB", "ROOT", None), ("top", "top", "ADJ", "amod", 3), ("BLEU", "bleu", "PROPN", "nmod", 5), ("of", "of", "ADP", "prep", 3), ("28.4", "28.4", "NUM", "dobj", 1), ("to", "to", "PART", "x", 5), ("29", "29", "NUM", "x", 5), ("points", "point", "NOUN", "x", 5), ("now", "now", "ADV", "advmod", 1)]
    plain = [("It", "it", "PRON", "nsubj", 1), ("yields", "yield", "VERB", "ROOT", None), ("7", "7", "NUM", "dobj", 1)]
    other = [("Nets", "net", "NOUN", "nsubj", 1), ("reach", "reach", "VERB", "ROOT", None), ("7", "7", "NUM", "dobj", 1)]
    tested = [("Our", "our", "PRON", "poss", 1), ("model", "model", "NOUN", "nsubjpass", 3), ("was", "be", "AUX", "aux", 3), ("tested", "test", "VERB", "ROOT", 3), ("on", "on", "ADP", "prep", 3), ("COCO", "coco", "PROPN", "pobj", 4)]
    made = [parsed(k, rows) for k, rows in enumerate([proposes, reports, plain, other, tested])]
    tokens = spark.createDataFrame([t for ts, _ in made for t in ts], "doc int, i int, start int, word string, lemma string, pos string, dep string, head int, like_num boolean")
    sentences = spark.createDataFrame([s for _, s in made], "doc int, text string")
    got = {r["doc"]: r for r in dependency.dependency_candidates(tokens, sentences, "doc").collect()}
    told = {k: (r["rule"], r["verb"], r["subject"], r["object"], r["object_type"], r["conf"]) for k, r in got.items()}
    assert told == {
        0: ("PROPOSES", "propose", "AlphaNet", "machine translation", "Task", 72), 1: ("REPORTS", "achieve", "AlphaNet", "top BLEU 28.4 to 29 points", "Metric", 68),
        3: ("REPORTS", "reach", "Nets", "7", "Concept", 64), 4: ("EVALUATED_ON", "test", "Our model", "COCO", "Dataset", 72),
    }
    text = made[1][1][1]
    assert text[got[1]["object_span"]["start"] : got[1]["object_span"]["end"]] == "top BLEU of 28.4 to 29 points"
    assert dependency.dependency_candidates(tokens.limit(0), sentences, "doc").count() == 0


def test_subtrees_in_one_pass(spark):
    """Ranges and children of trees, rings and long chains, in time that grows with the tokens."""
    import random
    import time

    from quillgraph.operators import dependency

    def plain(heads):
        def up(i):
            way = [i]
            while heads[way[-1]] is not None and heads[way[-1]] not in way:
                way.append(heads[way[-1]])
            return way

        ups = [up(i) for i in range(len(heads))]
        under = [[i for i, way in enumerate(ups) if a in way] for a in range(len(heads))]
        return [min(u) for u in under], [max(u) for u in under], [[i for i, h in enumerate(heads) if h == a] for a in range(len(heads))]

    r = random.Random(1)
    for n in [0, 1, 2, 3, 5, 12] * 40:
        heads = [h if (h := r.choice([None, *range(n)])) != i else None for i in range(n)]
        assert dependency.below(heads) == plain(heads)
    n = 3000
    rows = spark.range(n).selectExpr("1 AS doc", "int(id) AS i", "int(id * 2) AS start", "'w' AS word", "'w' AS lemma", "'NOUN' AS pos", "'x' AS dep", "int(if(id = 0, null, id - 1)) AS head", "false AS like_num")
    began = time.time()
    x = dependency.sentence_trees(rows, "doc").first()
    assert x["below"]["left"] == list(range(n)) and set(x["below"]["right"]) == {n - 1} and x["below"]["children"][5] == [6] and time.time() - began < 20


def test_entities_of_one_look_are_scored_once(spark):
    """Pairs of copies are made, each once, but neither names nor vectors are compared again for them."""
    rows = [(i, ["one", "two", None][i % 3], [float(i % 2), 1.0] if i % 5 else None) for i in range(60)]
    e = spark.createDataFrame(rows, "id long, name string, vector array<double>").withColumn("aliases", F.array().cast("array<string>"))
    by_name = e.filter("name IS NOT NULL").select("id", F.concat(F.lit("name "), "name").alias("key"))
    others = spark.createDataFrame([(i, f"p{i % 7}") for i in range(60)] + [(i, "p0") for i in range(0, 60, 10)] + [(1, None)], "id long, key string")
    own = fuzzy.looks(e)
    pairs = fuzzy.blocked_pairs(others, own.select("id", "look").join(by_name, "id", "left"))
    plain = fuzzy.blocked_pairs(by_name.unionByName(others))
    got = sorted(tuple(r) for r in pairs.select("left_id", "right_id").collect())
    assert got == sorted(tuple(r) for r in plain.collect()) and len(got) == len(set(got)) > 500
    scores = fuzzy.look_scores(pairs, own, e)
    assert scores.count() == pairs.select("left_look", "right_look").distinct().count() <= own.select("look").distinct().count() ** 2 == 81
    fast, slow = (sorted(tuple(r) for r in fuzzy.scored_entities(p, e).collect()) for p in (pairs, plain))
    assert fast == slow and len(fast) == len(got)
    want = {(a[0], b[0]): round(0.4 * ((a[1] or "") == (b[1] or "") and a[1] is not None or jaro_winkler_of(a[1] or "", b[1] or "")) + (0.6 if a[2] == b[2] and a[2] else 0.6 * 0.5**0.5 if a[2] and b[2] else 0), 6) for a in rows for b in rows}
    assert all(score == pytest.approx(want[a, b], abs=2e-6) for a, b, score in fast)


def test_namesakes_of_many_cells_equal_pairs_one_by_one(spark, monkeypatch):
    """Any number of cells gives each pair of a name once, with the score that scored_entities() gives it; vectors that are null, zero, of another length or hold nulls count as none."""
    vectors = [(v, [float(v % 5), 0.25 * v, 1.0 - v]) for v in range(12)] + [(12, None), (13, [0.0, 0.0, 0.0]), (14, [1.0]), (15, [1.0, None, 2.0]), (16, [float("nan"), 1.0, 1.0]), (17, [])]
    rows = [(i, ["alpha", "Alpha", "wmt 2014 en to de", "beta", None][i % 5], i * 7 % 19) for i in range(90)] + [(1000, "single", 1)]
    v = spark.createDataFrame(vectors, "vec int, vector array<double>")
    e = spark.createDataFrame(rows, "id long, name string, vec int").select("*", F.array().cast("array<string>").alias("aliases")).join(v, "vec", "left")
    keys = e.select("id", F.lower("name").alias("key"))
    want = sorted(map(tuple, fuzzy.scored_entities(fuzzy.blocked_pairs(keys), e).collect()))
    assert len(want) > 900
    for cell, looks, out in ((4000, 256, 200_000), (7, 2, 5), (1, 1, 1)):
        for name, value in (("CELL", cell), ("_LOOKS", looks), ("_ROWS", out), ("PAIRS", 100)):
            monkeypatch.setattr(fuzzy, name, value)
        got = fuzzy.scored_namesakes(fuzzy.named_entities(e), v)
        assert sorted(map(tuple, got.collect())) == want
    assert fuzzy.scored_namesakes(fuzzy.named_entities(e.limit(0)), v).count() == 0


def test_pairs_of_a_name_are_not_shuffled(spark, tmp_path):
    """One name of very many entities: what is shuffled are entities, not the square of them."""
    e = spark.range(9000).select("id", F.lit("one").alias("name"), F.lit(False).alias("task"), (F.col("id") % 3).alias("vec"))
    v = spark.range(3).select(F.col("id").alias("vec"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    pairs = fuzzy.scored_namesakes(e, v)
    assert pairs.count() == 9000 * 8999 // 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Join") and "left_id" not in plan[plan.index("Join") :]


def test_scores_are_rounded_as_spark_rounds(spark):
    import numpy as np

    x = np.array([[0.1234565, 0.1234575, 0.9999995, 0.0000005], [0.12345649999, 1.0, 0.0, 0.3333335]])
    want = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x.ravel())], "i int, v double").coalesce(1).orderBy("i").select(F.round("v", 6)).collect()]
    assert fuzzy._rounded(x).ravel().tolist() == want
