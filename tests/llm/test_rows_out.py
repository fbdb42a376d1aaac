"""Huffman files, importance resampling and whitening against the library, SQL and brute force, and on awkward rows."""

import heapq
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import huffman_ids, importance, whitening

WORDS = P.path("word_bpe_49k.json")
LONG = " ".join(random.Random(1).choice("alpha beta gamma delta naïve 字 42".split()) for _ in range(40_000))
AWKWARD = [(4, None), (2, ""), (2, "two of one id"), (9, " \n\t "), (7, "one"), (1, LONG), (1, LONG), (None, "no id"), (3, "aé 字 \U0001f600 İ \x1c <|endoftext|>"), (12, "y" * 70_000), (5, None)]


def docs_of(spark, rows):
    """Two more columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", "p") for i, t in rows], "doc_id long, text string, key string, part string").repartition(3)


def library(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ---- Huffman files


def huffman_total(counts):
    """Bits of all symbols by Huffman's algorithm, without a limit."""
    heap, total = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_code_lengths_are_least_and_limited():
    r = np.random.default_rng(2)
    for n in (2, 3, 17, 1000):
        counts = np.sort((r.pareto(1, n) * 10).astype(np.int64) + 1)
        bits = huffman_ids.code_lengths(counts, 40)
        assert (counts * bits).sum() == huffman_total(counts.tolist()) and (0.5**bits).sum() == 1
        short = huffman_ids.code_lengths(counts, math.ceil(math.log2(n)) + 1)
        assert short.max() <= math.ceil(math.log2(n)) + 1 and (0.5**short).sum() == 1
    # all limited codes of five symbols
    counts = np.array([1, 1, 2, 30, 100])
    all_codes = [c for c in np.ndindex(3, 3, 3, 3, 3) if sum(0.5 ** (x + 1) for x in c) <= 1]
    assert (counts * huffman_ids.code_lengths(counts, 3)).sum() == min((counts * (np.array(c) + 1)).sum() for c in all_codes)
    assert huffman_ids.code_lengths(np.array([5])).tolist() == [1] and len(huffman_ids.code_lengths(np.array([], np.int64))) == 0
    with pytest.raises(ValueError):
        huffman_ids.code_lengths(np.ones(5), 2)


def test_codes_are_canonical_and_round_trip():
    r = np.random.default_rng(4)
    ids = np.sort(r.choice(49_000, 3000, replace=False))
    bits = huffman_ids.code_lengths((1 / np.arange(1, 3001) * 1e7).astype(np.int64) + 1, 14)
    book = huffman_ids.Codebook(ids, bits)
    order = sorted(range(3000), key=lambda k: (bits[k], ids[k]))
    code, last = 0, int(bits[order[0]])
    for k in order:  # the plain rule of canonical codes
        code <<= int(bits[k]) - last
        last = int(bits[k])
        assert book.code[ids[k]] == code << (64 - last)
        code += 1
    for n in (1, 63, 64, 65, 5000):
        text = r.choice(ids, n)
        payload, checkpoints = book.encode(text)
        plain = "".join(f"{int(book.code[i]):064b}"[: int(book.bits[i])] for i in text)
        assert payload == int(plain.ljust(-(-len(plain) // 8) * 8, "0"), 2).to_bytes(-(-len(plain) // 8), "big")
        assert (book.decode(payload, checkpoints, n) == text).all()


def test_checksums_carry_on():
    r = random.Random(6)
    for n in (0, 1, 5, 4000):
        a, b = r.randbytes(300), r.randbytes(n)
        assert zlib.crc32(a + b) == huffman_ids.carried(zlib.crc32(a), n) ^ zlib.crc32(b)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("block", [64, 1000, 1 << 16])
def test_documents_come_back_from_the_files(spark, tmp_path, block):
    path = f"file://{tmp_path}/ids"
    huffman_ids.write_tokens(docs_of(spark, AWKWARD), path, WORDS, block_tokens=block)
    got = [tuple(r) for r in huffman_ids.read_documents(spark, path).orderBy("start").collect()]
    want = in_order([(i, len(library(t)), crc(library(t))) for i, t in AWKWARD])
    assert [g[0] for g in got] == [w[0] for w in want]
    assert sorted((g[0] or 0, g[2], g[3]) for g in got) == sorted((w[0] or 0, *w[1:]) for w in want)
    assert [g[1] for g in got] == [sum(g[2] for g in got[:k]) for k in range(len(got))]
    # the ids themselves, in the order of the files, and any range of them
    pieces = huffman_ids.read_pieces(spark, path, with_ids=True).orderBy("part", "at").collect()
    ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces])
    by_id = {}
    for i, t in AWKWARD:
        by_id.setdefault(i, []).append(library(t))
    for i, start, n, _ in got:
        assert ids[start : start + n].tolist() in by_id[i]
    for a, n in ((0, 1), (70, 500), (len(ids) - 3, 3), (0, len(ids))):
        runs = sorted(huffman_ids.read_range(spark, path, a, n).collect())
        assert [x for r in runs for x in r["ids"]] == ids[a : a + n].tolist()


def test_files_of_empty_tables_and_other_ids(spark, tmp_path):
    huffman_ids.write_tokens(docs_of(spark, []), f"file://{tmp_path}/none", WORDS)
    assert huffman_ids.read_documents(spark, f"file://{tmp_path}/none").count() == 0
    named = docs_of(spark, AWKWARD).withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    huffman_ids.write_tokens(named, f"file://{tmp_path}/named", WORDS)
    assert huffman_ids.read_documents(spark, f"file://{tmp_path}/named").count() == len(AWKWARD)


def test_damage_is_found(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    huffman_ids.write_tokens(docs_of(spark, AWKWARD), path, WORDS)
    blocks = spark.read.parquet(f"{path}/blocks").withColumn("payload", F.expr("overlay(payload PLACING X'FF00' FROM 9)"))
    blocks.write.parquet(f"file://{tmp_path}/bad/blocks")
    spark.read.parquet(f"{path}/codebook").write.parquet(f"file://{tmp_path}/bad/codebook")
    with pytest.raises(Exception, match="is damaged"):
        huffman_ids.read_documents(spark, f"file://{tmp_path}/bad").collect()


def test_huffman_query_equals_the_library(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    want, at = [], 0
    for i, t in rows:
        ids = library(t)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(tuple(r) for r in huffman_ids.op11_huffman_ids(spark, sf_dir).collect()) == want


# ---- importance resampling


def brute_features(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[k : k + j]) for j in range(1, n + 1) for k in range(len(w) - j + 1)]


def brute_weights(docs, target, n=2, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for f in brute_features(x, n)[1]:
                counts[bucket(f)] += 1
    big_s, big_t = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)]
    out = []
    for i, x in docs:
        words, f = brute_features(x, n)
        out.append((i, words, len(f), sum(gain[bucket(y)] for y in f) // len(f) if f else 0))
    return out


TARGET = ["alpha beta gamma", None, "The quick brown fox; naïve 字 fox", "42 alpha"]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_weights_equal_brute_force_over_chunks(spark, monkeypatch, n):
    monkeypatch.setattr(importance, "CHUNK_BYTES", 50)
    cut = importance.whole_and_chunks
    monkeypatch.setattr(importance, "whole_and_chunks", lambda docs, n, **names: cut(docs, n, 50, **names))
    rows = [*AWKWARD, *[(100 + k, LONG[k * 997 : k * 997 + 40 * k]) for k in range(20)], (200, "fox " + " " * 300 + "Fox." + "!" * 200 + "fox"), (201, " " * 500)]
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id int, text string")
    got = [tuple(r) for r in importance.importance_weights(docs_of(spark, rows), target, n).collect()]
    assert sorted(got, key=repr) == sorted(brute_weights(rows, TARGET, n), key=repr)


def test_chunks_own_each_start_once():
    text = re.sub(rb"[^a-z0-9\x80-\xff]", b" ", LONG.encode())
    for size in (1, 7, 1000):
        own = [importance.feature_buckets(a, b, 3, 1 << 31)[1] for a, b in importance.chunks_of(text[:20_000], size, 3)]
        assert sorted(np.concatenate(own)) == sorted(importance.feature_buckets(text[:20_000], b"", 3, 1 << 31)[1])


def test_drawn_documents(spark):
    rows = [(k // 2, 30 if k % 5 else 3, 50, -(k % 7)) for k in range(400)] + [(None, 30, 50, 1), (None, None, None, 0)]
    weighted = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long")
    out = importance.resample(weighted, percent=30).collect()
    assert len(out) == len(rows) and all(r["rank"] is None for r in out if (r["n_words"] or 0) < 20)
    able = sorted((r for r in out if (r["n_words"] or 0) >= 20), key=lambda r: (-r["score"], r["doc_id"] is not None, r["doc_id"] or 0))
    drawn = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, len(able) * 30 // 100 + 1))
    assert [(r["score"], r["doc_id"]) for r in drawn] == [(r["score"], r["doc_id"]) for r in able[: len(drawn)]]
    assert importance.resample(weighted.limit(0)).count() == 0


def test_weights_of_empty_tables(spark):
    target = spark.createDataFrame([(k, t) for k, t in enumerate(TARGET)], "item_id int, text string")
    assert importance.importance_weights(docs_of(spark, []), target).count() == 0
    got = [tuple(r) for r in importance.importance_weights(docs_of(spark, AWKWARD), target.limit(0)).collect()]
    assert sorted(got, key=repr) == sorted(brute_weights(AWKWARD, []), key=repr)


# ---- whitening


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, x string").repartition(5)


def brute_whitening(rows, most=4):
    """By the covariance's eigenvectors."""
    kept = [(i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    kept = [(i, x) for i, x in kept if len(x) == max(len(y) for _, y in kept)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return {(i, k + 1, n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))): ((x - sums / n) @ v[:, k] / math.sqrt(e[k]), e[k] / e.sum()) for i, x in kept for k in range(most)}


def random_vectors(seed, n, d=12):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * np.geomspace(8, 0.2, d) + 3
    return [(k, [float(c) for c in row]) for k, row in enumerate(x @ np.linalg.qr(r.normal(size=(d, d)))[0])]


def held_against_brute(got, want):
    assert {tuple(r)[:4] for r in got} == set(want)
    sign = {}
    for r in got:
        z, share = want[tuple(r)[:4]]
        if abs(z) > 1e-3:
            s = sign.setdefault(r["component"], math.copysign(1, z * r["whitened"]))
            assert r["whitened"] == pytest.approx(s * z, rel=1e-7, abs=1e-9)
        assert r["explained"] == pytest.approx(share, rel=1e-9)


def test_whitening_equals_the_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "AT_A_TIME", 2)  # so that a task merges too
    rows = random_vectors(3, 700)
    rows += [(1000 + k, rows[5][1]) for k in range(300)] + [(2000, None), (2001, [1.0] * 11 + [None]), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, []), (2005, [1.0] * 3), (7, rows[7][1])]
    model, error = whitening.fit(vectors_of(spark, rows))
    assert model.n == 700 and error < 1e-9
    held_against_brute(whitening.whiten(vectors_of(spark, rows), model).distinct().collect(), brute_whitening(rows))
    assert whitening.whiten(vectors_of(spark, rows), model).count() == 4 * 1001


def test_whitening_query_equals_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = whitening.op13_embedding_whitening(spark, sf_dir).collect()
    held_against_brute([r[:6] and whitening_row(r) for r in got], brute_whitening(rows))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def whitening_row(r):
    from pyspark.sql import Row

    return Row(**{c: r[c] for c in ("vec_id", "component", "n", "deviation", "whitened", "explained")})


def test_merging_keeps_all_dimensions():
    x = np.random.default_rng(8).integers(-900, 900, (500, 20))
    whole = whitening.Summary.of(x)
    for at in ([1, 2, 3, 30], [250], list(range(10, 500, 10))):
        out = None
        for part in np.split(x, at):
            own = whitening.Summary.of(part)
            out = own if out is None else out.merge(own)
        assert out.n == 500 and (out.sums == whole.sums).all()
        assert np.allclose(out.singular, whole.singular, rtol=1e-12) and np.allclose(np.abs(np.sum(out.vectors * whole.vectors, 1)), 1)


def test_whitening_without_variance_and_without_rows(spark):
    two = vectors_of(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 5.0]), (3, [1.0, 2.0, 5.0])])
    model, error = whitening.fit(two)
    got = {(r["vec_id"], r["component"]): r for r in whitening.whiten(two, model).collect()}
    assert len(got) == 9 and error < 1e-12
    assert sorted(abs(got[i, 1]["whitened"]) for i in (1, 2, 3)) == pytest.approx([1, 1, 1]) and all(got[i, k]["whitened"] is None for i in (1, 2, 3) for k in (2, 3))
    assert got[1, 1]["explained"] == pytest.approx(1) and got[1, 2]["n"] == 2 and got[1, 1]["deviation"] == 512**2
    one = vectors_of(spark, [(1, [1.0, 2.0])])
    assert {r["whitened"] for r in whitening.whiten(one, whitening.fit(one)[0]).collect()} == {None}
    assert whitening.fit(vectors_of(spark, [])) is None and whitening.fit(vectors_of(spark, [(1, None), (2, [])])) is None
    huge = vectors_of(spark, [(1, [3e15, 0.0]), (2, [0.0, 1.0])])
    model, _ = whitening.fit(vectors_of(spark, [(1, [1e7, 0.0]), (2, [0.0, 1.0])]))
    assert sum(r["deviation"] > 1 << 60 for r in whitening.whiten(vectors_of(spark, [(1, [1e7, 0.0])]), model).collect()) == 2
    with pytest.raises(Exception, match="exact|int64|large"):
        whitening.whiten(huge, model).collect()
    with pytest.raises(Exception, match="no exact whole number"):
        whitening.fit(vectors_of(spark, [(1, [3e30, 0.0])]))
