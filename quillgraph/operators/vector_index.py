"""An inverted file over vectors: every row lies in the list of its nearest centre, a query reads the lists of the centres nearest to it.

Centres are fitted on a sample of at most SAMPLE rows (those of the smallest hashes), which alone goes through the driver; the same sample tells how many lists a query must
read for the wanted recall. Every row is indexed. A list is stored in blocks of at most BLOCK rows: ids, residuals from the centre in bytes, and the vectors. Rows are dealt
by ranges of (list, hash), so a list of any size is many blocks in many tasks. A search sends blocks of queries to the blocks of their lists, finds the best by their codes,
scores these exactly and keeps k for each query and block; Spark cuts these to k before it shuffles them.

Vectors that are null, of another length, zero or hold null or non-finite entries are in no list and, as queries, have no hits. Similarity is cosine; ties go to the smaller id.
Ids are longs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000
BLOCK = 4096
QUERIES = 256
FORM = "list int, n int, ids binary, codes binary, scales binary, vectors binary"


def usable(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """id and v: the vectors that can be compared, as doubles."""
    v = F.col(vec_col).cast("array<double>")
    fine = (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.coalesce(fine, F.lit(False)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _matrix(column, size: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return unit(np.asarray(flat.flatten(), np.float64).reshape(-1, size)) if len(flat) else np.zeros((0, size))


class Centres:
    """Unit centres of the lists, and the number of lists that a query reads."""

    def __init__(self, points: np.ndarray, probes: int):
        self.points, self.probes = points, probes

    @classmethod
    def fit(cls, vectors: DataFrame, size: int, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.97, k: int = 10, sample: int = SAMPLE, rounds: int = 10) -> Centres:
        rows = usable(vectors, id_col, vec_col, size)
        picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
        x = unit(np.array([r["v"] for r in picked], np.float64).reshape(-1, size))
        n = max(1, int(np.sqrt(len(x))))
        centres = x[:: max(1, len(x) // n)][:n] if len(x) else np.eye(1, size)
        for _ in range(rounds if len(x) else 0):
            near = np.argmax(x @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            full = np.bincount(near, minlength=len(centres)) > 0
            centres = np.where(full[:, None], unit(sums), centres)
        return cls(centres, cls._probes(x, centres, recall, k))

    @staticmethod
    def _probes(x: np.ndarray, centres: np.ndarray, recall: float, k: int) -> int:
        """The fewest lists that hold the wanted share of the nearest neighbours of some rows of the sample."""
        if len(x) < 2:
            return len(centres)
        asked = x[:: max(1, len(x) // 500)]
        score = asked @ x.T
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x))]
        place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # of each list in the order of a query
        wanted = np.take_along_axis(place, np.argmax(x @ centres.T, axis=1)[near], axis=1)
        found = [(wanted < p).mean() for p in range(1, len(centres) + 1)]
        return 1 + next(i for i, share in enumerate(found) if share >= recall or i == len(found) - 1)


def build(vectors: DataFrame, centres: Centres, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The blocks of all lists (columns of FORM); write them and read them back to search."""
    points = centres.points
    size = points.shape[1]

    def assign(batches):
        for b in batches:
            x = _matrix(b.column("v"), size)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(np.argmax(x @ points.T, axis=1).astype(np.int32) if len(x) else [], pa.int32())], ["id", "v", "list"])

    def block(number: int, ids: list, rows: list):
        i, x = np.concatenate(ids), np.concatenate(rows)
        rest = x - points[number]
        scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
        codes = np.round(rest / scale[:, None]).astype(np.int8)
        return pa.RecordBatch.from_pylist([{"list": number, "n": len(i), "ids": i.astype("<i8").tobytes(), "codes": codes.tobytes(), "scales": scale.astype("<f8").tobytes(), "vectors": x.astype("<f8").tobytes()}], _arrow_form())

    def pack(batches):
        number, ids, rows, held = -1, [], [], 0
        for b in batches:
            lists, i, x = b.column("list").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("v"), size)
            at = 0
            while at < len(lists):
                if held and (lists[at] != number or held == BLOCK):
                    yield block(number, ids, rows)
                    ids, rows, held = [], [], 0
                number = int(lists[at])
                to = min(int(np.searchsorted(lists, number, "right")), at + BLOCK - held)
                ids.append(i[at:to])
                rows.append(x[at:to])
                held, at = held + to - at, to
        if held:
            yield block(number, ids, rows)

    parted = usable(vectors, id_col, vec_col, size).mapInArrow(assign, "id long, v array<double>, list int")
    return parted.repartitionByRange("list", F.xxhash64("id")).sortWithinPartitions("list").mapInArrow(pack, FORM)


def _arrow_form() -> pa.Schema:
    return pa.schema([("list", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("scales", pa.binary()), ("vectors", pa.binary())])


def search(index: DataFrame, queries: DataFrame, centres: Centres, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", refine: int = 8) -> DataFrame:
    """query_id, id, score (6 places) and rank of the k rows found nearest to each query; of a block, refine * k rows are scored exactly."""
    points, probes = centres.points, min(centres.probes, len(centres.points))
    size = points.shape[1]
    form = pa.schema([("list", pa.int32()), ("asked", pa.binary()), ("q", pa.binary())])

    def route(batches):
        for b in batches:
            q, x = b.column("id").to_numpy(), _matrix(b.column("v"), size)
            if not len(q):
                continue
            score = x @ points.T
            lists = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
            whose, flat = np.repeat(np.arange(len(q)), probes), lists.ravel()
            order = np.argsort(flat, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(flat[order])) + 1):
                for s in range(0, len(part), QUERIES):
                    rows = whose[part[s : s + QUERIES]]
                    yield pa.RecordBatch.from_pylist([{"list": int(flat[part[0]]), "asked": q[rows].astype("<i8").tobytes(), "q": x[rows].astype("<f8").tobytes()}], form)

    def scan(batches):
        for b in batches:
            for r in b.to_pylist():
                ids, asked = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["asked"], "<i8")
                q, x = np.frombuffer(r["q"], "<f8").reshape(-1, size), np.frombuffer(r["vectors"], "<f8").reshape(-1, size)
                codes = np.frombuffer(r["codes"], np.int8).reshape(-1, size)
                rough = q @ codes.T.astype(np.float64) * np.frombuffer(r["scales"], "<f8") + (q @ points[r["list"]])[:, None]
                take = min(len(ids), refine * k)
                best = np.argpartition(-rough, take - 1, axis=1)[:, :take]
                exact = np.round(np.einsum("qd,qtd->qt", q, x[best]), 6)
                first = np.lexsort((ids[best], -exact), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked, first.shape[1])), pa.array(np.take_along_axis(ids[best], first, axis=1).ravel()), pa.array(np.take_along_axis(exact, first, axis=1).ravel())], ["query_id", "id", "score"]
                )

    routed = usable(queries, id_col, vec_col, size).mapInArrow(route, "list int, asked binary, q binary")
    hits = index.join(routed, "list").mapInArrow(scan, "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
