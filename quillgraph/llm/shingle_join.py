"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles. Documents with equal sets are one class of copies, known by its
representative. Representatives are embedded as WIDTH minhash coordinates (a coordinate shared is a sampled token
shared). In each run the sets of a bucket are split on coordinates that the bucket's path draws: one always, a second with
chance 1/0.8 - 1, so that a pair at the threshold is expected to go on together in one child. Buckets of at most LEAF_SETS sets are
compared by brute force; larger ones split again, to DEPTH levels; what is larger still is compared in square blocks, exactly. RUNS
follows from TARGET_RECALL.

Leaves give chains of likely neighbours (one row for each set, never all pairs); their connected components are the groups
in which the sets themselves are compared exactly, again in square blocks of some BLOCK_SETS sets and BLOCK_SHINGLES shingles. There each
document's links are counted, copies with their number, and no pair is written.

Defined results: a null text or one without a word has no shingle, no link and is a class of its own; a text of one to four
words is one shingle; a very long text is one set, whole, and makes its group's blocks smaller; repeated rows are copies of each other; ids may have any type that can be
ordered, may repeat and may be null (each row is judged by its own text); an empty table gives no rows; other columns, of whatever name, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, materialize, read_table, release_memory, row_columns, scratch_scope, slices, text_of, thin, whole_row

WORDS = 5
THRESHOLD = 0.8
WIDTH = 48
LEAF_SETS = 1024
BLOCK_SETS = 256
BLOCK_SHINGLES = 400_000
DEPTH = 4
TARGET_RECALL = 0.999
#: Least share of equal coordinates for a pair to be compared exactly: four deviations below the threshold.
LIKELY = 0.57
SEED = 20240101


def _survival(depth: int) -> float:
    """Least chance that a pair at the threshold stays together down to depth in one run (a branching process of mean one)."""
    second = 1 / THRESHOLD - 1
    alive = 1.0
    for _ in range(depth):
        one = THRESHOLD * alive
        alive = (1 - second) * one + second * (1 - (1 - one) ** 2)
    return alive


#: Runs until a pair at the threshold is met with the target recall, were every bucket split to the full depth.
RUNS = math.ceil(math.log(1 - TARGET_RECALL) / math.log(1 - _survival(DEPTH)))

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = 0x9E3779B97F4A7C15
_powers = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        step = _BASE if name == "up" else pow(_BASE, -1, 1 << 64)
        full = np.full(max(n, 1 << 16), step, _U)
        full[0] = 1
        _powers[name] = np.cumprod(full)
    return _powers[name]


def _release() -> None:
    """Drops powers for a text longer than a slice, so that one such text does not stay in the worker's memory."""
    for name, held in _powers.items():
        if len(held) > 2 * AT_A_TIME:
            _powers[name] = held[:AT_A_TIME].copy()


def shingles(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts, and how many each text has (repeats included)."""
    joined = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(joined, np.uint8)
    inside = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
    start, end = edge[::2], edge[1::2]
    sums = np.concatenate([[_U(0)], np.cumsum((raw.astype(_U) + _U(1)) * _power("up", len(raw))[: len(raw)])])
    word = _mix((sums[end] - sums[start]) * _power("down", len(raw))[start] + (end - start).astype(_U))
    stops = np.cumsum([len(t) + 1 for t in texts])
    first = np.searchsorted(start, np.concatenate([[0], stops[:-1]]))
    n_words = np.diff(np.append(first, len(start)))
    if len(word) < words:
        word = np.concatenate([word, np.zeros(words, _U)])
    rolled = np.zeros(max(1, len(word) - words + 1), _U)
    with np.errstate(over="ignore"):
        for k in range(words):
            rolled = rolled * _U(0xD6E8FEB86659FD93) + word[k : k + len(rolled)]
    rolled = _mix(rolled)
    counts = np.where(n_words >= words, n_words - words + 1, (n_words > 0).astype(np.int64))
    out = np.empty(int(counts.sum()), _U)
    at = np.concatenate([[0], np.cumsum(counts)])
    long = np.flatnonzero(n_words >= words)
    place = np.repeat(first[long] - at[:-1][long], counts[long])
    if len(long):
        slots = np.repeat(at[:-1][long], counts[long]) + (np.arange(int(counts[long].sum())) - np.repeat(np.cumsum(counts[long]) - counts[long], counts[long]))
        out[slots] = rolled[slots + place]
    for i in np.flatnonzero((n_words > 0) & (n_words < words)).tolist():
        h = int(n_words[i])
        for k in range(int(n_words[i])):
            h = (h * 0xD6E8FEB86659FD93 + int(word[first[i] + k])) % (1 << 64)
        out[at[i]] = _mix(np.array([h], _U))[0]
    return out, counts


#: Bytes of text that are hashed at a time; bounds what numpy holds (some 30 bytes for each) and the powers that a worker keeps.
AT_A_TIME = 1 << 20


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for a, b in slices([len(t) for t in texts], AT_A_TIME):
        values, counts = shingles(texts[a:b], words)
        out += [np.unique(x) for x in np.split(values, np.cumsum(counts)[:-1])]
    return out


def _coordinates() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | _U(1), rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64)


def sketch(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """WIDTH minhash coordinates of 32 bits for each set; of an empty set the largest value. Repeats change nothing."""
    mult, add = _coordinates()
    out = np.full((len(counts), WIDTH), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for k in range(WIDTH):
            out[full, k] = np.minimum.reduceat(((values * mult[k] + add[k]) >> _U(32)).astype(np.uint32), starts)
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, set_a and set_b (a name of 128 bits for the set), size and sketch of each document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).cast("binary").alias("text"))

    def run(batches):
        for whole in batches:
            for a, b in slices(pa.compute.binary_length(whole.column("text")).to_pylist(), AT_A_TIME):
                batch = whole.slice(a, b - a)
                sets = shingle_sets(batch.column("text").to_pylist())
                counts = np.array([len(s) for s in sets], np.int64)
                values = np.concatenate(sets)
                names = [np.zeros(len(sets), _U), np.zeros(len(sets), _U)]
                full = np.flatnonzero(counts)
                if len(full):
                    at = (np.cumsum(counts) - counts)[full]
                    for name, salt in zip(names, (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F))):
                        name[full] = np.add.reduceat(_mix(values ^ salt), at)
                drawn = sketch(values, counts)
                _release()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(x.view(np.int64)) for x in names), pa.array(counts), pa.array([x.tobytes() for x in drawn], pa.binary())],
                    ["doc_id", "text_hash", "set_a", "set_b", "size", "sketch"],
                )
        release_memory()

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text_hash bigint, set_a bigint, set_b bigint, size bigint, sketch binary")


def _children(path: np.ndarray, drawn: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and paths of the children that each set goes to: the path, not the set, draws the coordinates."""
    with np.errstate(over="ignore"):
        draw = _mix(path + _U(level + 1) * _U(_BASE))
        again = _mix(draw)
    rows, paths = [], []
    one = (draw % _U(WIDTH)).astype(np.int64)
    two = (one + 1 + (again % _U(WIDTH - 1)).astype(np.int64)) % WIDTH  # another coordinate
    chosen = np.flatnonzero((again >> _U(32)).astype(np.float64) / 2**32 < 1 / THRESHOLD - 1)
    for index, which in ((np.arange(len(path)), one), (chosen, two[chosen])):
        value = drawn[index, which].astype(_U)
        with np.errstate(over="ignore"):
            paths.append(_mix(path[index] ^ _mix(value + (which.astype(_U) << _U(40)) + _U(level + 1))))
        rows.append(index)
    return np.concatenate(rows), np.concatenate(paths)


def _split(buckets: DataFrame, level: int) -> DataFrame:
    """(path, rep, sketch) one level down; at level 0 the rows are sets, each of which begins all runs."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                rep, raw = batch.column("rep"), batch.column("sketch")
                drawn = np.frombuffer(b"".join(raw.to_pylist()), np.uint32).reshape(-1, WIDTH)
                if level == 0:
                    roots = _mix(np.arange(1, RUNS + 1, dtype=_U) * _U(SEED))
                    source, path = np.repeat(np.arange(len(drawn)), RUNS), np.tile(roots, len(drawn))
                else:
                    source, path = np.arange(len(drawn)), batch.column("path").to_numpy().view(_U)
                rows, paths = _children(path, drawn[source], level)
                taken = pa.array(source[rows])
                yield pa.RecordBatch.from_arrays([pa.array(paths.view(np.int64)), rep.take(taken), raw.take(taken)], ["path", "rep", "sketch"])

    return buckets.mapInArrow(run, "path bigint, rep bigint, sketch binary")


def _chains(n: int, alike: np.ndarray) -> np.ndarray:
    """The smallest member of each row's connected component; alike is a boolean matrix."""
    label = np.arange(n)
    alike = alike | np.eye(n, dtype=bool)
    while True:
        new = np.where(alike, label[None, :], n).min(axis=1)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    same = np.zeros((len(a), len(b)), np.int16)
    for k in range(WIDTH):
        same += a[:, k][:, None] == b[:, k][None, :]
    return same >= LIKELY * WIDTH


def _blocks(df: DataFrame, n_col: str, id_col: str, per_block: int) -> DataFrame:
    """Rows of each group dealt to all pairs of its blocks, so that any two rows of a group meet in one block pair at least; a group of up to per_block rows is one."""
    n = F.greatest(F.lit(1), F.ceil(F.col(n_col) / per_block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(id_col), F.lit("block")), n).cast("int")
    return df.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).drop("other")


def _leaf_edges(leaves: DataFrame) -> DataFrame:
    """(a, b): for each set of a leaf that has likely neighbours there, the smallest of their chain."""

    def edges(rep: np.ndarray, drawn: np.ndarray, sizes: np.ndarray):
        """rep and drawn: whole leaves in a row, of the given sizes."""
        at = np.cumsum(sizes) - sizes
        two = at[sizes == 2]  # most leaves; these in one step
        met = (drawn[two] == drawn[two + 1]).sum(axis=1) >= LIKELY * WIDTH
        pair = np.sort(np.stack([rep[two[met]], rep[two[met] + 1]]), axis=0)
        a, b = [pair[1]], [pair[0]]
        for start, n in zip(at[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            own = np.argsort(rep[start : start + n], kind="stable") + start
            label = _chains(n, _likely(drawn[own], drawn[own]))
            linked = label != np.arange(n)
            a.append(rep[own[linked]])
            b.append(rep[own[label[linked]]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        held = None  # the last leaf of a batch may go on in the next
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("path", "b1", "b2")], axis=1)
            rep = batch.column("rep").to_numpy().astype(np.int64)
            drawn = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint32).reshape(-1, WIDTH)
            if held:
                key, rep, drawn = (np.concatenate(x) for x in zip(held, (key, rep, drawn)))
            if not len(rep):
                continue
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            if len(first) > 1:
                yield edges(rep[: first[-1]], drawn[: first[-1]], np.diff(first))
            held = key[first[-1] :], rep[first[-1] :], drawn[first[-1] :]
        if held:
            yield edges(held[1], held[2], np.array([len(held[1])]))

    key = ["path", "b1", "b2"]
    dealt = leaves.select(*key, "rep", "sketch").repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of the edges (a, b), by rounds of smallest neighbours with
    pointer jumps. Each round counts map-side and joins on nodes, where hot ones are split; no component is collected."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialize(both.filter("a <> b").distinct(), "components-edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "components-start")
    while True:
        seen = both.join(label, both["b"] == label["node"]).groupBy("a").agg(F.min("root").alias("m"))
        new = label.join(seen, label["node"] == seen["a"]).select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = label.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = materialize(new.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")), "components-round")
        moved = new.filter("old <> root").limit(1).count()
        label = new.select("node", "root")
        if not moved:
            return label


def candidate_groups(sets: DataFrame) -> DataFrame:
    """(node, root) of the representatives that chosen paths link; sets has rep and sketch."""
    edges, buckets = [], sets
    for level in range(DEPTH):
        split = _split(buckets, level)
        rows = materialize(split, f"paths-{level}") if level else split
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sizes = materialize(sizes, f"path-sizes-{level}")
        met = thin(rows, sizes, ["path"]).join(sizes, "path")
        last = level == DEPTH - 1
        met = materialize(met.select("path", "rep", "n", "sketch"), f"paths-met-{level}")
        small = met if last else met.filter(F.col("n") <= LEAF_SETS)
        edges.append(materialize(_leaf_edges(_blocks(small, "n", "rep", LEAF_SETS)).distinct(), f"path-edges-{level}"))
        if last:
            break
        buckets = met.filter(F.col("n") > LEAF_SETS).select("path", "rep", "sketch")
        if buckets.isEmpty():
            break
    out = edges[0]
    for more in edges[1:]:
        out = out.unionByName(more)
    return components(out)


def _compare(rows: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, near): for each block pair, the documents that each set links to there and the smallest set of its chain."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep").reset_index(drop=True)
        rep, own, weight = pdf["rep"].to_numpy(), pdf["own"].to_numpy(), pdf["copies"].to_numpy().astype(np.float64)
        one_block = pdf["b1"].iat[0] == pdf["b2"].iat[0]
        sets = shingle_sets(pdf["text"].tolist())
        size = np.array([len(s) for s in sets], np.float32)
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
        # only shingles of two sets or more count in an intersection
        often = np.bincount(place, minlength=len(values)) > 1
        rank = np.cumsum(often) - 1
        keep = often[place]
        row, col = row[keep], rank[place[keep]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, int(often.sum()), 4096):
            lo, hi = np.searchsorted(col, [a, a + 4096])
            bits = np.zeros((len(sets), 4096), np.float32)
            bits[row[lo:hi], col[lo:hi] - a] = 1
            common += bits @ bits.T
        alike = (common >= np.float32(threshold) * (size[:, None] + size[None, :] - common) - np.float32(1e-3)) & (common > 0)
        np.fill_diagonal(alike, False)
        if not one_block:
            alike &= own[:, None] != own[None, :]
        label = _chains(len(sets), alike)
        return pd.DataFrame({"rep": rep, "links": (alike @ weight).astype(np.int64), "near": rep[label]})

    return rows.groupBy("root", "b1", "b2").applyInPandas(run, "rep bigint, links bigint, near bigint")


def _classes(docs: DataFrame, id_col: str, text_col: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The sketches of docs, and for each distinct set (set_a, set_b, size) its links and the first row of its class: first, a struct of no_id, doc_id and text_hash."""
    byte_batches(docs.sparkSession)
    base = materialize(sketches(docs, id_col, text_col), "shingle-sketches")
    key = ["set_a", "set_b", "size"]
    full = base.filter("size > 0").withColumn("first", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    # a set is known by a number of its own, as ids may repeat or be null; written, so that it stays the same
    reps = full.groupBy(*key).agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("copies"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "shingle-reps")
    # one row of each class of copies has the sketch: equal sets have equal sketches, so any will do
    named = reps.select("rep", *(F.col(k).alias(f"_{k}") for k in key), F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"))
    same = [F.col(k) == F.col(f"_{k}") for k in key] + [F.col("doc_id").eqNullSafe(F.col("_id")), F.col("text_hash") == F.col("_hash")]
    sets = full.join(named, same).dropDuplicates(["rep"]).select("rep", "sketch")
    groups = candidate_groups(materialize(sets, "shingle-sets"))
    members = groups.join(reps.select(F.col("rep").alias("node"), "copies", "size", F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash")), "node")
    per_block = BLOCK_SETS // 2
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / per_block), F.ceil(F.sum("size") * 2 / BLOCK_SHINGLES))
    sizes = members.groupBy("root").agg((blocks * per_block).cast("long").alias("n"))
    wanted = materialize(members.join(sizes, "root").select(F.col("node").alias("rep"), "root", "n", "copies", "_id", "_hash"), "shingle-wanted")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).cast("binary").alias("text"))
    texts = thin(texts, wanted.select(F.col("_id").alias("doc_id"), F.col("_hash").alias("text_hash")), ["doc_id", "text_hash"])
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).dropDuplicates(["rep"]).drop("doc_id", "text_hash", "_id", "_hash")
    found = materialize(_compare(_blocks(texts, "n", "rep", per_block), threshold), "shingle-links")
    linked = components(found.filter("rep <> near").select(F.col("rep").alias("a"), F.col("near").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links")).join(linked, F.col("rep") == F.col("node"), "left").select("rep", "links", F.coalesce("root", "rep").alias("class"))
    # classes by set: all copies of a representative have its class
    own = reps.join(links, "rep", "left").select(*key, "first", F.coalesce("class", "rep").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")).filter("links > 0")
    own = materialize(own, "shingle-own")
    firsts = own.groupBy("class").agg(F.min("first").alias("first"))
    return base, materialize(own.drop("first").join(firsts, "class").select(*key, "links", "first"), "shingle-classes")


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each of docs: doc_id, class_id (smallest id of its connected class; null if none has one), n_links (documents at or above the threshold)."""
    base, classes = _classes(docs, id_col, text_col, threshold)
    out = base.join(classes, ["set_a", "set_b", "size"], "left")
    return out.select("doc_id", F.when(F.col("links").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class: of its smallest id, and of that id's texts the one with the smallest hash; null ids come last."""
    with scratch_scope(docs.sparkSession):
        base, classes = _classes(docs, id_col, text_col, threshold)
        rows = base.select("doc_id", "text_hash", "set_a", "set_b", "size").join(classes, ["set_a", "set_b", "size"])
        first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
        marks = rows.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n"))
        marks = materialize(marks.filter("not first or n > 1"), "shingle-marks", stays=True)
    own = docs.select(whole_row(docs), docs[id_col].alias("id"), text_of(docs[text_col]).alias("text"))
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    gone, twice = marks.filter("not first"), marks.filter("first")
    kept = own.join(gone, on, "left_anti")
    if not twice.isEmpty():
        # rows that repeat the id and text of a class's first row: one of them stays
        again = kept.join(twice, on, "left_semi").dropDuplicates(["id", "text"])
        kept = kept.join(twice, on, "left_anti").unionByName(again)
    return kept.select(*row_columns(docs))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
