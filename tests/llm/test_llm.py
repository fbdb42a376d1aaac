"""The numbered operators against libraries, SQL and brute force, and on awkward rows."""

import base64
import glob
import gzip
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import chunk_dedup, exact, license_scan, line_templates, merge_transducer, packing, quality, registry, sentencepiece_codec, shingle_join, token_count, warc

#: Columns that the operators use themselves.
CLASHING = "group digest rep own n row repeats found spans repeat_of new_text text_hash lines masked leaf t1 c1 place_id n_words rejected_by quality_features first id _id _hash _text _salt word bits context task nth header payload sha256".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASHING) for i, t in texts], SCHEMA)


def kept_columns(df):
    """The columns that the operators do not own came through as they were."""
    assert df.columns[: 5 + len(CLASHING)] == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
    return all(r[c] == c for r in df.collect() for c in CLASHING)


def words(seed, n, vocabulary=4000):
    r = random.Random(seed)
    letters = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:04d}")
    return [letters(r.randrange(vocabulary)) for _ in range(n)]


LONG = " ".join(words(1, 30_000))
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, LONG), (6, LONG), (7, "aé 字 \U0001f600 İ \x1c"), (8, "aé  字\n\U0001f600 İ \x1c"), (9, "<|endoftext|> x <|endoftext|>"), (10, "y" * 5000)]


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = registry.queries()[name](spark, sf_dir)
    rel = duck.sql(registry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(map(repr, map(tuple, df.select(cols).collect()))) == sorted(map(repr, rel.select(*cols).fetchall()))


def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def test_token_counts_equal_the_library(spark, corpus):
    tok = byte_bpe()
    got = {(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in token_count.count_tokens(docs_of(spark, corpus + [(10_000 + i, t) for i, t in AWKWARD]), P.path("byte_bpe_50k.json")).collect()}
    want = {(i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in corpus + [(10_000 + i, t) for i, t in AWKWARD]}
    assert got == want


def test_boundaries_on_random_strings_and_blocks(monkeypatch):
    tok, c, r = byte_bpe(), token_count.counter(P.path("byte_bpe_50k.json")), random.Random(3)
    texts = ["".join(r.choice("  \n\tab'srtvelmdLS1 2!?é字٣ \x85\x1c'") for _ in range(r.randint(0, 40))) for _ in range(2000)]
    want = [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    assert c.count(texts).tolist() == want
    monkeypatch.setattr(token_count, "BLOCK", 64)  # many blocks, and texts longer than one
    long = [" ".join(texts[k : k + 50]) for k in range(0, 1000, 50)]
    assert c.count(texts).tolist() == want
    assert c.count(long).tolist() == [len(tok.encode(t, add_special_tokens=False)) for t in long]


def test_merges_give_the_librarys_counts(monkeypatch):
    tok, r = byte_bpe(), random.Random(5)
    m = merge_transducer.MergeTransducer(P.path("byte_bpe_50k.json"))
    split = tok.pre_tokenizer.pre_tokenize_str
    parts = ["the", "ing", "ation", "str", "un", "ss", "aa", "ll", " in"]
    words = ["".join(r.choice("abdeinorst") for _ in range(r.randint(1, 30))) for _ in range(4000)]
    words += [c * n for c in "a-=_*!. 0ё" for n in (1, 2, 3, 5, 8, 17, 64, 65, 129, 200)]
    words += ["".join(chr(r.choice([0x4E00, 0x400, 0xE0, 0x1F600]) + r.randint(0, 60)) for _ in range(r.randint(1, 12))) for _ in range(2000)]
    words += ["".join(r.choice(parts) for _ in range(r.randint(1, 7))) for _ in range(4000)]
    words += list(tok.get_vocab())  # among them the byte-level spellings, which are texts of their own
    words += ["".join(r.choice("abdeinorst") for _ in range(20_000)), ""]
    words = [w for w in words if len(split(w)) <= 1]
    want = [len(e) for e in tok.encode_batch_fast(words, add_special_tokens=False)]
    assert [(w, m.count(w)) for w in words] == list(zip(words, want))
    monkeypatch.setattr(merge_transducer, "MAX_STATES", 50)  # tables begun anew, inside of long pretokens too
    assert [m.count(w) for w in words[:300]] == want[:300]
    long = ["".join(r.choice("abdeinorst") for _ in range(2_000)) for _ in range(3)]
    assert [m.count(w) for w in long] == [len(tok.encode(w, add_special_tokens=False)) for w in long]


def test_merges_out_of_order_are_an_error(tmp_path):
    import json

    file = tmp_path / "t.json"
    file.write_text(json.dumps({"model": {"vocab": {"ab": 0, "abc": 1}, "merges": [["ab", "c"], ["a", "b"]]}}))
    with pytest.raises(ValueError, match="no earlier merge"):
        merge_transducer.MergeTransducer(str(file))


def unigram_model():
    """The model file with its kind set to unigram, whose paths must not beat ours."""
    import sentencepiece

    raw = open(P.path("piece_bpe_32k.model"), "rb").read()

    def varint(i):
        v = s = 0
        while True:
            v |= (raw[i] & 127) << s
            s, i = s + 7, i + 1
            if raw[i - 1] < 128:
                return v, i

    i = 0
    while i < len(raw):
        key, j = varint(i)
        n, j = varint(j)
        if key >> 3 == 2:  # trainer_spec
            k = j
            while k < j + n:
                field, at = varint(k)
                if field == 3 << 3:  # model_type
                    _, end = varint(at)
                    return sentencepiece.SentencePieceProcessor(model_proto=raw[:at] + b"\x01" + raw[end:])
                if field & 7 == 0:
                    _, k = varint(at)
                elif field & 7 == 2:
                    m, k = varint(at)
                    k += m
                else:
                    k = at + (4 if field & 7 == 5 else 8)
        i = j + n
    raise AssertionError


def best_path(c, lib, text):
    """Plain dynamic programming over all cuts of the whole text, with a dictionary for a trie."""
    if not text:
        return []
    t = (" " + text).replace(" ", sentencepiece_codec.MARKER)
    best = [(0.0, [])]
    for e in range(1, len(t) + 1):
        found = []
        for s in range(max(0, e - 48), e):
            i = lib.piece_to_id(t[s:e])
            if i > 2 and not lib.is_byte(i):
                found.append((best[s][0] + lib.get_score(i), -s, [*best[s][1], i]))
        if not any(-s == e - 1 for _, s, _ in found):
            found.append((best[e - 1][0] + c.unknown, 1 - e, [*best[e - 1][1], *(int(c.byte_id[b]) for b in t[e - 1].encode())]))
        top = max(found, key=lambda x: x[:2])
        best.append((top[0], top[2]))
    return best[-1][1]


def test_sentencepiece_equals_brute_force_and_round_trips(spark, corpus):
    c, lib = sentencepiece_codec.codec(P.path("piece_bpe_32k.model")), unigram_model()
    short = [w for _, t in corpus for w in t.split("\n")[0].split(" ")[:10]] + ["a字\U0001f600", "  two  spaces ", "x\ny\tz", "", "yyyyyyyy"]
    score = lambda ids: sum(lib.get_score(int(i)) for i in ids)
    same = 0
    for t, own, theirs in zip(short, c.encode(short), lib.encode(short)):
        assert own.tolist() == best_path(c, lib, t), t
        assert score(own) >= score(theirs)
        same += own.tolist() == theirs
    assert same >= 0.95 * len(short)
    docs = docs_of(spark, corpus + AWKWARD)
    rows = sentencepiece_codec.piece_summary(docs, P.path("piece_bpe_32k.model")).collect()
    assert len(rows) == len(corpus) + len(AWKWARD) and all(r["round_trip"] for r in rows)
    ids = sentencepiece_codec.encode_pieces(docs, P.path("piece_bpe_32k.model"))
    back = sentencepiece_codec.decode_pieces(ids, P.path("piece_bpe_32k.model"))
    assert sorted(map(tuple, back.collect())) == sorted((i, t or "") for i, t in corpus + AWKWARD)


#: A payload that looks like records.
TRICKY = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n"


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, None), (10, "http://c\r\nX: y", ""), (11, "http://d", "é\r\n\r\n" * 3), (12, "http://e", TRICKY), (13, "http://f", LONG * 5)]
    pages = spark.createDataFrame([(*r, "s", "h") for r in rows], "page_id long, url string, html string, sha256 string, header string")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    a = warc.read_warc(spark, f"file://{tmp_path}/a/warc").cache()
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in a.collect()), key=str)
    assert got == sorted([(3, "response", None, b"<p>x</p>")] * 2 + [(5, "revisit", 3, None), (9, "response", None, b""), (10, "revisit", 9, None), (11, "response", None, "é\r\n\r\n".encode() * 3), (12, "response", None, TRICKY.encode()), (13, "response", None, LONG.encode() * 5)], key=str)
    payload_of = {i: (h or "").encode() for i, _, h in rows}
    for r in warc.check_payloads(a).collect():
        data = payload_of[r["page_id"]]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode() and r["payload_bytes"] == len(data)
    # the files by the format's own rules: version, headers, a block of Content-Length bytes, two line ends
    records = 0
    for p in glob.glob(f"{tmp_path}/a/warc/part-*"):
        raw = gzip.open(p).read()
        while raw:
            head, _, raw = raw.partition(b"\r\n\r\n")
            version, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            n = int(fields["Content-Length"])
            assert version == "WARC/1.1" and raw[n : n + 4] == b"\r\n\r\n"
            raw = raw[n + 4 :]
            records += 1
    assert records == len(rows)
    warc.write_archive(pages, f"file://{tmp_path}/m", min_bytes=9)
    assert {r["record_type"] for r in warc.read_warc(spark, f"file://{tmp_path}/m/warc").collect()} == {"response"}
    warc.write_archive(pages.withColumn("page_id", F.concat(F.lit("p/ é>"), "page_id")), f"file://{tmp_path}/t")
    got = {(r["page_id"], r["refers_to"]) for r in warc.read_warc(spark, f"file://{tmp_path}/t/warc", "string").collect()}
    assert ("p/ é>5", "p/ é>3") in got and len(got) == len(rows) - 1
    warc.write_archive(pages.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archive(spark, f"file://{tmp_path}/e").count() == 0


@pytest.mark.parametrize("end", ["\r\n\r\n", "\r\n", "\n", ""])
def test_no_page_is_lost_whatever_its_end(spark, tmp_path, end):
    r = random.Random(11)
    alike = "v" * 300 + end
    rows = [(k, "u", alike if k % 3 == 0 else "x" * r.randrange(400) + f"{k}" + end * r.randrange(1, 3)) for k in range(20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_archive(pages, f"file://{tmp_path}/a")
    got = {(x["page_id"], x["payload_bytes"], x["record_type"], x["refers_to"]) for x in warc.read_archive(spark, f"file://{tmp_path}/a").collect()}
    assert got == {(k, len(t), "revisit" if t == alike and k else "response", 0 if t == alike and k else None) for k, _, t in rows}


def test_records_part_by_their_length():
    record = lambda block, end=b"\r\n\r\n": b"WARC/1.0\r\nWARC-Type: response\r\ncontent-length: %d\r\n\r\n" % len(block) + block + end
    blocks = [b"", b"\r\n\r\n", TRICKY.encode(), b"z" * 300_000]
    plain = b"".join(map(record, blocks))
    for raw in (plain, gzip.compress(plain), b"".join(gzip.compress(record(x)) for x in blocks)):
        assert [b for _, b in warc.records_of(raw)] == blocks
    assert list(warc.records_of(b"")) == []
    for bad in (plain[:-1], plain + b"x", gzip.compress(plain)[:-20], record(b"abc", b"\r\n"), plain.replace(b"content-length", b"content")):
        with pytest.raises(ValueError, match="no whole record"):
            list(warc.records_of(bad))


def test_warc_finds_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    bad = warc.read_warc(spark, f"file://{tmp_path}/a/warc").withColumn("payload", F.lit("abd").cast("binary"))
    with pytest.raises(Exception, match="another digest"):
        warc.check_payloads(bad).collect()
    spark.createDataFrame([(2,)], "records long").write.mode("overwrite").parquet(f"file://{tmp_path}/a/written")
    with pytest.raises(ValueError, match="2 records were written, 1 are"):
        warc.read_archive(spark, f"file://{tmp_path}/a")


def test_license_alignment():
    a, b = "x a b c d y c".split(), "a b q c d".split()
    assert license_scan.align(a, b) == [(1, 0), (2, 1), (3, 3), (4, 4)]
    assert [[3, 1, 2, 5, 4][i] for i in license_scan.increasing([3, 1, 2, 5, 4])] == [1, 2, 4]
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    mit = license_scan.TEMPLATES["MIT"]
    noisy = " ".join(words(2, 300)) + " " + mit.replace("merge,", "fuse,") + " " + " ".join(words(3, 300))
    (hit,) = [h for h in s.scan(noisy) if h[0] == "MIT"]
    assert hit[1] > 0.97 and hit[3] == 300


def test_licenses_behind_prose_are_found_whole():
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    (hit,) = [h for h in s.scan("the cat sat on a mat released under the mit license today") if h[0] == "MIT-line"]
    assert hit == ("MIT-line", 1.0, 5, 6, 10)
    r = random.Random(8)
    for name in ("MIT", "Apache-2.0-notice"):
        n = len(license_scan.words(license_scan.TEMPLATES[name]))
        for _ in range(10):
            prose = [r.choice(["the", "of", "to", "and", *words(r.randrange(999), 6)]) for _ in range(100)]
            (hit,) = [h for h in s.scan(" ".join(prose) + " " + license_scan.TEMPLATES[name] + " " + " ".join(words(9, 100))) if h[0] == name]
            assert hit[1:] == (1.0, n, 100, 99 + n)


def test_every_notice_of_a_text_is_found():
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.8)
    mit = license_scan.TEMPLATES["MIT"]
    n = len(license_scan.words(mit))
    text = " ".join([mit, *words(5, 40), mit.replace("merge,", "fuse,"), *words(6, 30), mit])
    assert [(h[2], h[3]) for h in s.scan(text) if h[0] == "MIT"] == [(n, 0), (n - 1, n + 40), (n, 2 * n + 70)]
    # two words in five put in: a span of 1.4 times the template
    stretched = " ".join(w + (" zz yy" if k % 5 == 4 else "") for k, w in enumerate(license_scan.words(mit)))
    assert [h[2] for h in s.scan(stretched) if h[0] == "MIT"] == [n]
    assert not [h for h in license_scan.Scanner(license_scan.TEMPLATES, 0.8, 0.1).scan(stretched) if h[0] == "MIT"]


def test_scan_equals_all_windows():
    """The best window of all, each aligned without any bound."""
    r = random.Random(12)
    template = [f"w{k % 9}" for k in range(14)]
    s = license_scan.Scanner({"t": " ".join(template)}, 0.6, 0.5)
    width, found = len(template) + len(template) // 2, 0
    for _ in range(300):
        text = [r.choice([*template, "x", "y"]) for _ in range(12)] + [w for w in template if r.random() < 0.8] + [r.choice([*template, "x"]) for _ in range(12)]
        best = max(((len(m), -p) for p in range(len(text)) if text[p] in template and (m := license_scan.align(text[p : p + width], template))), default=(0, 0))
        got = s.best("t", text, s.member["t"][[s.vocabulary.get(w, 0) for w in text]], 0, len(text))
        assert (got[1] if got else 0) == (best[0] if best[0] >= 0.6 * len(template) else 0)
        found += got is not None
    assert found > 100


def test_licenses_on_awkward_rows(spark):
    rows = AWKWARD + [(20, "z " * 10 + "Licensed under the Apache License, Version 2.0.\nlicensed under the apache LICENSE version 2.0")]
    got = license_scan.license_spans(docs_of(spark, rows)).collect()
    assert sorted((r["doc_id"], r["license_id"], r["coverage"], r["first_word"]) for r in got) == [(20, "Apache-2.0-line", 1.0, 10), (20, "Apache-2.0-line", 1.0, 18)]
    assert license_scan.license_spans(docs_of(spark, [])).count() == 0


def test_chunks_cover_and_resist_shifts():
    text = " ".join(words(4, 5000)).encode()
    at = chunk_dedup.chunk_starts(np.frombuffer(text, np.uint8))
    assert at[0] == 0 and (np.diff(at) >= chunk_dedup.LEAST_BYTES).sum() >= len(at) - 2
    moved = b"inserted words here " + text
    again = set((chunk_dedup.chunk_starts(np.frombuffer(moved, np.uint8)) - 20).tolist())
    assert len(again & set(at.tolist())) >= len(at) - 2


def test_repeated_passages_are_cut(spark):
    passages = [" ".join(words(50 + k, 55)) for k in range(40)]
    rows = [(i, " ".join(words(1000 + i, 80)) + " " + passages[i % 40] + " " + " ".join(words(2000 + i, 60))) for i in range(120)]
    rows += [(500 + i, " ".join(words(9000 + i, 300))) for i in range(30)] + [(700 + i, t) for i, t in AWKWARD[:4]]
    assert kept_columns(chunk_dedup.cut_repeats(docs_of(spark, rows)))
    out = {r["doc_id"]: r for r in chunk_dedup.cut_repeats(docs_of(spark, rows), found_col="cut").collect()}
    assert len(out) == len(rows)
    caught = 0
    for i, t in rows:
        r = out[i]
        if i < 40 or i >= 500 or not t:
            assert r["cut"] is None and r["text"] == t
        else:
            caught += r["cut"] is not None
            assert passages[i % 40] not in r["text"] or r["cut"] is None
            assert r["cut"] is None or {j % 40 for j in r["cut"]["repeat_of"]} == {i % 40}
    assert caught >= 78  # of 80
    assert chunk_dedup.cut_repeats(docs_of(spark, [])).count() == 0


def test_passages_little_above_50_words_are_cut(spark):
    passages = [" ".join(words(30_000 + k, 51 + k % 10)) for k in range(200)]
    rows = [(i, " ".join(words(40_000 + i, 60)) + " " + passages[i % 200] + " " + " ".join(words(50_000 + i, 60))) for i in range(400)]
    out = {r["doc_id"]: r for r in chunk_dedup.cut_repeats(docs_of(spark, rows), found_col="cut").collect()}
    shares = []
    for i, t in rows[200:]:
        spans = out[i]["cut"]["spans"] if out[i]["cut"] else []
        for s in spans:  # what is cut stands in the passage
            assert t.encode()[s["start"] : s["end"]].decode().strip() in passages[i % 200]
        shares.append(sum(s["end"] - s["start"] for s in spans) / len(passages[i % 200]))
    assert sum(x > 0 for x in shares) >= 199 and np.mean(shares) > 0.8
    assert all(out[i]["text"] == t for i, t in rows[:200])
    # a text of one period stays once
    beat = " ".join(["one two three four five six seven"] * 60)
    assert chunk_dedup.cut_repeats(docs_of(spark, [(1, beat)])).first()["text"].startswith("one")


def test_repeats_without_spaces_of_any_id_and_on_awkward_rows(spark):
    r = random.Random(77)
    script = lambda k, n: (lambda q: "".join(chr(0x4E00 + q.randrange(5000)) for _ in range(n)))(random.Random(k))
    shared, code = script(1, 600), "".join(r.choice("abcdefghijklmnop0123456789+/") for _ in range(3000))
    rows = [(f"d{i}", script(10 + i, 200) + shared + script(100 + i, 200)) for i in range(6)]
    rows += [(f"e{i}", " ".join(words(400 + i, 40)) + " " + code + " " + " ".join(words(500 + i, 40))) for i in range(2)]
    rows += [(None, " ".join(words(600, 100))), (None, " ".join(words(600, 100))), (None, " ".join(words(601, 90))), ("f", " ".join(words(601, 90)))]
    rows += [(f"g{i}", t) for i, t in AWKWARD] + [("h", "one two"), ("h", LONG + " more")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id string, text string, `repeats` string")
    out = chunk_dedup.cut_repeats(docs, found_col="cut").collect()
    assert len(out) == len(rows)
    by = {x["doc_id"]: x for x in out}
    assert by["d0"]["cut"] is None and by["e0"]["cut"] is None and by["f"]["text"] == " ".join(words(601, 90))
    for i in range(1, 6):
        assert "d0" in by[f"d{i}"]["cut"]["repeat_of"] and len(by[f"d{i}"]["text"]) < 400 + 60
    assert len(by["e1"]["text"]) < len(by["e0"]["text"]) - 2700
    # null ids come after all others; rows that repeat an id and text are all the first
    nulls = sorted(x["text"] for x in out if x["doc_id"] is None)
    assert sum(t == " ".join(words(600, 100)) for t in nulls) == 2 and len(min(nulls, key=len)) < 100
    # two rows of one id and other texts: the second repeats the long text of g5
    assert sorted(len(x["text"]) for x in out if x["doc_id"] == "h")[1] < 1000
    assert sum(x["text"] == LONG for x in out) == 1


def brute_cut(rows, least):
    """Where a text's bytes from a to b stand in a text of a smaller id too: the longest such spans of `least` words or more."""
    words_at = {i: t.split(" ") for i, t in rows}
    seen, spans = set(), {}
    for i in sorted(words_at):
        w = words_at[i]
        grams = [" ".join(w[k : k + least]) for k in range(len(w) - least + 1)]
        spans[i] = {k + j for k, g in enumerate(grams) if g in seen for j in range(least)}
        seen |= set(grams)
    return spans


def test_cut_words_are_repeats_by_brute_force(spark):
    r = random.Random(31)
    shared = [" ".join(words(70_000 + k, r.randrange(30, 120))) for k in range(30)]
    rows = [(i, " ".join(" ".join([" ".join(words(80_000 + 10 * i + k, r.randrange(10, 60))), r.choice(shared)]) for k in range(3))) for i in range(60)]
    out = {x["doc_id"]: x for x in chunk_dedup.cut_repeats(docs_of(spark, rows), found_col="cut").collect()}
    brute, cut, all_words = brute_cut(rows, 12), 0, 0
    for i, t in rows:
        at, own = 0, set()
        for k, w in enumerate(t.split(" ")):
            if out[i]["cut"] and any(s["start"] <= at and at + len(w) <= s["end"] for s in out[i]["cut"]["spans"]):
                own.add(k)
            at += len(w) + 1
        # nothing is cut that does not stand in an earlier text
        assert own <= brute[i]
        cut += len(own & brute[i])
        all_words += len(brute[i])
    assert cut > 0.75 * all_words
    assert chunks_are_kept(rows, {i: out[i]["text"] for i, _ in rows})


def chunks_are_kept(rows, kept):
    """Each chunk that texts have in common still stands in some text."""
    count, left = {}, set()
    for i, t in rows:
        raw = t.encode()
        for a, b in zip(*chunk_dedup.chunk_spans(np.frombuffer(raw, np.uint8))):
            count[raw[a:b]] = count.get(raw[a:b], 0) + 1
    whole = "\0".join(kept.values()).encode()
    return all(c in whole for c, n in count.items() if n > 1)


def test_what_no_other_row_keeps_stays(spark):
    """X, Y, XY, XY: the joint stands in the third text only, which is the first to hold it."""
    rows = []
    for k in range(200):
        x, y = " ".join(words(90_000 + k, 60)), " ".join(words(95_000 + k, 60))
        rows += [(4 * k, x), (4 * k + 1, y), (4 * k + 2, f"{x} {y}"), (4 * k + 3, f"{x} {y}")]
    out = {r["doc_id"]: r["text"] for r in chunk_dedup.cut_repeats(docs_of(spark, rows)).collect()}
    assert chunks_are_kept(rows, out)
    for k in range(200):
        x, y = rows[4 * k][1].split(), rows[4 * k + 1][1].split()
        assert " ".join(x[-3:] + y[:3]) in out[4 * k + 2]
        assert len(out[4 * k + 2].split()) < 60 and len(out[4 * k + 3].split()) < 30


def brute_jaccard(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {(i, find(i), links[i]) for i in ids}


def test_jaccard_classes_equal_brute_force(spark, corpus, monkeypatch):
    base = words(7, 200)
    near = []
    for k in range(60):
        w = list(base)
        for j in random.Random(k).sample(range(200), 3):
            w[j] = f"e{k}"
        near.append((5000 + k, " ".join(w)))
    rows = corpus + near + [(6000, None), (6001, ""), (6002, "one two"), (6003, "one  two"), (6004, LONG), (6005, LONG)]
    want = brute_jaccard(rows)
    monkeypatch.setattr(shingle_join, "LEAF_SETS", 16)  # so that buckets split again and groups are compared in blocks
    monkeypatch.setattr(shingle_join, "BLOCK_SETS", 32)
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in shingle_join.jaccard_classes(docs_of(spark, rows)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in shingle_join.drop_near_copies(docs_of(spark, rows)).collect()}
    assert kept == {c for _, c, _ in want}
    assert kept_columns(shingle_join.drop_near_copies(docs_of(spark, rows)))
    assert shingle_join.jaccard_classes(docs_of(spark, [])).count() == 0
    # ids of another type, and blocks by their shingles
    monkeypatch.setattr(shingle_join, "BLOCK_SHINGLES", 2000)
    named = docs_of(spark, near).withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    got = {(r["doc_id"], r["class_id"], r["n_links"]) for r in shingle_join.jaccard_classes(named).collect()}
    assert got == {(f"n{i}", f"n{c}", n) for i, c, n in brute_jaccard(near)}


def test_near_copies_with_repeated_and_null_ids(spark):
    text = lambda k, end="": " ".join(words(60_000 + k, 100)) + end
    rows = [(1, text(1)), (2, text(1, " more")), (2, text(2)), (3, text(3)), (3, text(3)), (None, text(4)), (None, text(4)), (None, text(4, " more")), (5, text(5)), (None, text(5, " more")), (6, text(6)), (6, text(7)), (7, text(7, " more")), (8, None), (8, None)]
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in shingle_join.drop_near_copies(docs_of(spark, rows)).collect())
    fours = [x for x in kept if x[1].startswith(text(4))]
    assert len(fours) == 1 and fours[0][0] == "None"
    assert [x for x in kept if x not in fours] == sorted([("1", text(1)), ("2", text(2)), ("3", text(3)), ("5", text(5)), ("6", text(6)), ("6", text(7)), ("8", ""), ("8", "")])
    got = [(str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in shingle_join.jaccard_classes(docs_of(spark, rows)).collect()]
    assert sorted(got) == sorted([("1", "1", 1), ("2", "1", 1), ("2", "2", 0), ("3", "3", 1), ("3", "3", 1), *[("None", "None", 2)] * 3, ("5", "5", 1), ("None", "5", 1), ("6", "6", 0), ("6", "6", 1), ("7", "6", 1), ("8", "8", 0), ("8", "8", 0)])


def test_exact_groups_on_awkward_rows(spark):
    import re

    rows = [*AWKWARD, (None, "x"), (None, "x"), (None, "y")] + [(30, LONG + "x"), (31, LONG + "x"), (32, LONG[:-1] + "?"), (33, " one "), (34, " \tone\n")]
    norm = [(i, re.sub("[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    least = lambda ids: None if None in ids else min(ids)
    want = sorted(((i, least([j for j, u in norm if u == t]), sum(u == t for _, u in norm), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=str)
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in exact.exact_groups(docs_of(spark, rows)).collect()), key=str)
    assert got == want
    assert exact.exact_groups(docs_of(spark, [])).count() == 0


def test_line_templates(spark):
    r = random.Random(5)
    prose = lambda k: " ".join(words(k, 12))
    rows = [(i, f"{prose(i)}\nVisited on day {r.randrange(999)} by reader {r.randrange(999)}\n{prose(100 + i)}\nShare this page with {'abcdefghij'[i % 10]} on the network now\n\n{prose(200 + i)}") for i in range(20)]
    copies = [(100 + i, "\n".join(prose(900 + k) for k in range(6))) for i in range(30)]
    odd = [(700 + i, t) for i, t in AWKWARD] + [(800 + i, f"{i} {i + 1} {i * 7}\n{i}") for i in range(20)]  # figures are no template
    # one document's own lines, however alike, recur in no other
    alone = [(900, "\n".join(f"{prose(1000 + i)}\nOrder number {i} shipped to the north gate" for i in range(8)))]
    out = line_templates.drop_recurring_lines(docs_of(spark, rows + copies + odd + alone), n_col="dropped")
    assert kept_columns(out)
    out = {x["doc_id"]: x for x in out.collect()}
    for i, t in rows:
        assert out[i]["dropped"] == 2 and out[i]["text"] == "\n".join(x for x in t.split("\n") if not x.startswith(("Visited", "Share")))
    for i, t in copies + odd + alone:
        assert out[i]["dropped"] == 0 and out[i]["text"] == t
    assert line_templates.drop_recurring_lines(docs_of(spark, [])).count() == 0
    line = F.lit("on 3 May 12 17")
    assert spark.range(1).select(line_templates.masked(line), line_templates.masked(line, 0.8)).first()[:] == ("on 3 May 12 17", "on <*> May <*> <*>")


def test_a_leaf_has_several_templates(spark):
    """Three families and a fixed line that have token count and leading tokens in common."""
    prose = lambda k: " ".join(words(k, 15))
    name = lambda k: words(k, 1)[0]
    line = lambda i: [f"Please read the guide of {name(i)} on page nine", f"Please read the {name(2000 + i)} that our office sent out", f"Please read the news from {name(4000 + i)} every second day", "Please read the small print below before you sign"][i % 4]
    rows = [(i, f"{prose(10_000 + i)}\n{line(i)}\n{prose(20_000 + i)}") for i in range(48)]
    out = {x["doc_id"]: x for x in line_templates.drop_recurring_lines(docs_of(spark, rows), n_col="dropped").collect()}
    for i, t in rows:
        assert out[i]["dropped"] == 1 and out[i]["text"] == "\n".join([t.split("\n")[0], t.split("\n")[2]]), line(i)


def test_lines_recur_by_documents(spark):
    """Paragraphs parted by blank lines, a footer of three lines at the text's end, and groups of copies and near copies that hold the same footer."""
    prose = lambda k: " ".join(words(k, 30))
    footer = ["Copies of this letter go to all readers", "Write to the office for back issues", "Printed in the old town by friends"]
    page = lambda k: [prose(k), prose(5000 + k), prose(10_000 + k), *footer]
    rows = [(i, "\n\n".join(page(i)) if i % 2 else "\n".join(page(i))) for i in range(40)]
    copies = [(100 + i, "\n\n".join(page(77))) for i in range(200)]
    near = [(400 + i, "\n\n".join(x + (f" {prose(20_000 + i)[:8]}" if k == i % 6 else "") for k, x in enumerate([prose(900 + k) for k in range(6)]))) for i in range(15)]
    out = {x["doc_id"]: x for x in line_templates.drop_recurring_lines(docs_of(spark, rows + copies + near), n_col="dropped").collect()}
    for i, t in rows + copies:
        assert out[i]["dropped"] == 3 and [x for x in t.split("\n") if x not in footer] == out[i]["text"].split("\n"), i
    for i, t in near:
        assert out[i]["dropped"] == 0 and out[i]["text"] == t
    assert line_templates.drop_recurring_lines(docs_of(spark, [])).count() == 0
    import corpus_pipeline

    kept = corpus_pipeline.line_dedup(spark, docs_of(spark, rows), "").collect()
    assert not any(x in r["text"] for r in kept for x in footer)


def test_no_template_of_a_leaf_is_left_over(spark):
    """Twelve families of one leaf, all with the same fifth and without the same last two tokens: three rounds have no head for most of them."""
    name = lambda k: words(k, 1)[0]
    line = lambda i: f"Please read the {name(i)} about {' '.join(words(700 + i % 12, 5))} {name(3000 + i)}"
    rows = [(i, f"{' '.join(words(10_000 + i, 15))}\n{line(i)}\n{' '.join(words(20_000 + i, 15))}") for i in range(120)]
    some = {x["doc_id"]: x["dropped"] for x in line_templates.drop_recurring_lines(docs_of(spark, rows), n_col="dropped").collect()}
    assert 0 in some.values()
    import corpus_pipeline

    for x in corpus_pipeline.line_dedup(spark, docs_of(spark, rows), "").collect():
        assert x["text"] == "\n".join([dict(rows)[x["doc_id"]].split("\n")[0], dict(rows)[x["doc_id"]].split("\n")[2]])


@pytest.mark.parametrize("pays", [0, 8])
@pytest.mark.parametrize("similarity,min_same", [(0.75, 4), (0.5, 4), (0.2, 1)])
def test_all_clusters_by_brute_force(spark, monkeypatch, pays, similarity, min_same):
    r = random.Random(11)
    lines = {" ".join(["a b c", *(r.choice("xyz") for _ in range(k))]) for k in (0, 1, 2, 3, 4, 5, 6, 9) for _ in range(60)}
    rows = [(k, *r.sample(range(10**6), 2), t, r.choice([1, 1, 1, 2, 9])) for t in sorted(lines) for k in [t.count(" ") + 1]]
    want, heads = {}, []
    for leaf, t1, t2, t, n in sorted(rows, key=lambda x: (x[4], x[1], x[2]), reverse=True):
        same = lambda h: sum(a == b for a, b in zip(t.split(), h[3].split()))
        near = [h for h in heads if h[0] == leaf and same(h) >= max(min_same, similarity * leaf)]
        want[leaf, t1, t2] = near[0][1:3] if near else (t1, t2)
        heads += [] if near else [(leaf, t1, t2, t)]
    monkeypatch.setattr(line_templates, "PAYS", pays)
    texts = spark.createDataFrame(rows, "leaf long, t1 long, t2 long, masked string, n long")
    found = {(x["leaf"], x["t1"], x["t2"]): (x["c1"], x["c2"]) for x in line_templates._all_clusters(texts, 3, similarity, min_same).collect()}
    assert {k: found.get(k, k[1:]) for k in want} == want and found.keys() <= want.keys()
    assert len(want) > len(heads) > 5


def test_lines_are_written_without_their_words(spark, tmp_path, monkeypatch):
    """Scratch tables hold hashes of lines, and words of templates that share a leaf only."""
    rows = [(i, "\n".join([" ".join(words(50 * i + k, 200)) for k in range(20)] + [f"Share this page with {words(90_000 + i, 1)[0]} on the network now"])) for i in range(100)]
    written, scratch = [], line_templates.materialize

    def measured(df, name, stays=False):
        out = scratch(df, name, stays)
        written.append(sum(os.path.getsize(x.removeprefix("file://")) for x in out.inputFiles()))
        return out

    monkeypatch.setattr(line_templates, "materialize", measured)
    docs_of(spark, rows).write.parquet(f"{tmp_path}/docs.parquet")
    out = line_templates.drop_recurring_lines(spark.read.parquet(f"{tmp_path}/docs.parquet"), n_col="dropped").collect()
    assert {(x["doc_id"], x["text"], x["dropped"]) for x in out} == {(i, t.rpartition("\n")[0], 1) for i, t in rows}
    assert 3 * sum(written) < sum(len(t) for _, t in rows)


def test_quality_on_awkward_rows(spark):
    good = " ".join(words(11, 120))
    rows = AWKWARD + [(None, good), (40, good), (41, " ".join(["same old words"] * 40)), (42, good.upper()), (43, good.replace(" ", "### "))]
    got = {x["doc_id"]: x["verdict"] for x in quality.judge(docs_of(spark, rows), verdict_col="verdict").collect()}
    assert got[40] is None and got[None] is None and got[1] == got[2] == got[4] == "short" and got[41] == "repeats" and got[42] == "capitals" and got[43] == "symbols"
    kept = quality.quality_rules(docs_of(spark, rows))
    assert kept_columns(kept) and kept.columns == docs_of(spark, rows).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 5, 6, 6, 40]
    with pytest.raises(ValueError, match="rejected_by"):
        quality.judge(docs_of(spark, rows))
    assert quality.quality_rules(docs_of(spark, [])).count() == 0


def test_rules_go_by_rejection_per_cost_and_stop(spark):
    rule = lambda name, test=lambda t, n: F.lit(False): quality.Rule(name, test)
    known = [(rule("dear"), 2.0, 0.5), (rule("cheap"), 0.1, 0.2), (rule("idle"), 0.1, 0.0), (rule("fast"), 0.0, 0.1), (rule("even"), 1.0, 0.25)]
    measured = [{"rule": r, "seconds": s, "rejected": x} for r, s, x in known]
    assert [r.name for r in quality.by_rejection_per_cost(measured)] == ["fast", "cheap", "dear", "even", "idle"]
    # a rule behind one that rejects is not evaluated
    docs = docs_of(spark, [(1, "bad text"), (2, "good text")])
    raises = lambda t, n: F.when(t == "bad text", F.raise_error(F.lit("evaluated")).cast("boolean")).otherwise(False)
    ordered = [rule("first", lambda t, n: t == "bad text"), rule("second", raises)]
    assert [(r["row"]["doc_id"], r["rejected_by"]) for r in quality._judged(docs, ordered, "text").orderBy("row.doc_id").collect()] == [(1, "first"), (2, None)]
    with pytest.raises(Exception, match="evaluated"):
        quality._judged(docs, ordered[::-1], "text").collect()
    # costs are taken rule by rule: the windows of three words cost more than the count of words
    cost = {x["rule"].name: x["seconds"] for x in quality.measure(docs_of(spark, [(i, " ".join(words(i, 2000))) for i in range(200)]))}
    assert cost["repeats"] > 2 * cost["short"]


def test_packing_pieces_tile_documents_and_sequences(spark, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows = corpus + [(10_000 + i, t) for i, t in AWKWARD if i != 6]
    got = packing.step_groups(packing.pack_tokens(docs_of(spark, rows).repartition(3), P.path("word_bpe_49k.json"), buffer_tokens=50_000), step_windows=2).toPandas()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = got[got.doc_id == i].sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()][:-1] and own.length.sum() == len(ids) and (own.doc_tokens == len(ids)).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()][:-1]
        n = int(seq.length.sum())
        assert n <= 4096 and n & (n - 1) == 0 and (seq.context == n).all()
    # step groups: equal token counts over all tasks, but for each tier's last
    groups = got.groupby(["context", "step_group"]).length.sum()
    for context, own in groups.groupby(level=0):
        sizes = own.sort_index().tolist()
        assert set(sizes[:-1]) <= {2 * 4096} and 0 < sizes[-1] <= 2 * 4096, context
    # few short windows: those that end a task
    assert got[got.context < 512].sequence_id.nunique() <= 9 * 3
    twice = packing.pack_tokens(docs_of(spark, [(6, LONG), (6, LONG), (None, "a"), (None, None)]), P.path("word_bpe_49k.json")).toPandas()
    n = len(tok.encode(LONG, add_special_tokens=False).ids) + 1
    assert twice[twice.doc_id == 6].length.sum() == 2 * n and (twice[twice.doc_id == 6].doc_tokens == n).all()
    assert packing.pack_tokens(docs_of(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_pipeline_stages_keep_the_columns(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 4096").count() == 0 and out.count() > 0


def planted():
    """A small corpus with what each stage looks for, and the text that each document should come to."""
    prose = lambda k, n=120: " ".join(words(k, n))
    passage, footer = " ".join(words(777, 60)), ["Printed in the old town by friends", "Write to the office for back issues"]
    rows, want = [], {}
    for i in range(12):  # a footer in all
        rows.append((i, "\n".join([prose(100 + i), *footer])))
        want[i] = prose(100 + i)
    rows += [(20, None), (21, "too short"), (22, " ".join(["same old words"] * 40))]  # rejected
    rows += [(30, prose(300)), (31, prose(300)), (32, prose(300) + " more")]  # one group
    want[30] = prose(300)
    rows += [(40 + i, prose(400 + i) + " " + passage + " " + prose(500 + i)) for i in range(3)]  # a passage in three
    want[40] = rows[-3][1]
    return rows, want, passage


def test_pipeline_decisions_take_effect(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rows, want, passage = planted()
    docs_of(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs, after = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(r["n_chars"] == len(r["text"]) for r in docs.collect()) and kept_columns(docs)
    every = dict(rows)
    assert after["quality_rules"] == {i: t for i, t in every.items() if i not in (20, 21, 22)}
    assert after["line_dedup"] == {i: want[i] if i < 12 else t for i, t in after["quality_rules"].items()}
    assert after["near_copies"] == {i: t for i, t in after["line_dedup"].items() if i not in (31, 32)}
    last = after["substring_dedup"]
    assert {i: t for i, t in last.items() if i not in (41, 42)} == want
    for i in (41, 42):
        left = set(every[i].split()) & set(last[i].split())
        assert len(last[i].split()) < 255 and set(words(400 + i - 40, 120)) - left == set() and passage not in last[i]
    # the packed ids are those of the last texts, twice alike
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    total = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in last.items()}
    for _ in range(2):
        packed = corpus_pipeline.run(spark, f"file://{tmp_path}").groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
        assert {r["doc_id"]: r["n"] for r in packed} == total


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    docs_of(spark, [*AWKWARD, (None, None), (None, LONG[:3000])]).write.parquet(f"file://{tmp_path}/a/documents.parquet")
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, f"file://{tmp_path}/a").collect()}
    assert ids == {5, None}  # the long text, once, and the text of the null id
    docs_of(spark, []).write.parquet(f"file://{tmp_path}/b/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/b").count() == 0
