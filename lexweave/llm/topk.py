"""Exact top-k inner-product search by pivot-table elimination.

Every vector's distances to the pivots are computed once.  For a query q and a
vector x, the largest difference of their pivot distances is a lower bound L
of their distance, so (|x|^2 + |q|^2 - L^2) / 2 is an upper bound of their
inner product.  Candidates are evaluated in order of that bound until the k-th
best score found passes the next bound, which is when the result is exact.

Queries and vectors travel as blocks: a query block meets every candidate
block of a stripe, keeps its k best of the stripe, and stripes are merged.
Bounds are computed for a whole block of queries at once; candidates of a
block are taken in the order of their best bound, some at a time, for the
queries whose bound they still pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.runtime import arrow_map, stored_map

PIVOTS = 128
#: Vectors of the sample from which pivots are taken, farthest first.
PIVOT_SAMPLE = 2000
#: Candidates, and queries, of a block; candidates that are evaluated at once.
BLOCK, QUERY_BLOCK, STEP = 1024, 512, 256
#: Queries whose bounds are computed at once, in the processor's cache.
TILE = 64
_FOUND = "query_id long, vec_id long, score long, met long, evaluated long, share long"


def _scaled(column: pa.Array, scale: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows, integer vectors) of the rows whose components are all finite."""
    rows, out = [], []
    for k, value in enumerate(column):
        if not value.is_valid or value.values.null_count:
            continue
        x = np.floor(scale * value.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if len(x) and np.isfinite(x).all():
            rows.append(k)
            out.append(x)
    return np.array(rows, np.int64), out


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Written ``(id, vector binary, size int)``: floor(scale * x) as doubles."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows, found = _scaled(batch.column(1), scale)
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int32())], names=["id", "vector", "size"])

    return stored_map(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), run, f"id {kind}, vector binary, size int", "vectors").frame


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other, farthest first."""
    if not len(sample):
        return sample
    chosen = [int(np.square(sample - sample.mean(axis=0)).sum(axis=1).argmax())]
    away = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        away = np.minimum(away, np.square(sample - sample[chosen[-1]]).sum(axis=1))
        chosen.append(int(away.argmax()))
    return sample[chosen]


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    out = np.zeros((len(values), width))
    for k, value in enumerate(values):
        x = np.frombuffer(value)
        out[k, : len(x)] = x
    return out


def _pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.square(rows).sum(axis=1)[:, None] + np.square(pivots).sum(axis=1) - 2 * rows @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _blocks(rows: DataFrame, pivots: np.ndarray, width: int, size: int, name: str) -> DataFrame:
    """Written blocks of up to ``size`` vectors, by nearest pivot, with their
    table.  ``{name}_block`` is unique: the task's number and one of its own."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # PIVOTS vectors

    def run(batches):
        ids, values, number = [], [], TaskContext.get().partitionId() << 32

        def flush():
            matrix = _matrix(values, width)
            table = _pivot_distances(matrix, shared.value)
            order = table.argmin(axis=1).argsort(kind="stable") if table.shape[1] else np.arange(len(matrix))
            content = [np.array(ids, np.int64)[order], matrix[order], table[order].astype(np.float32)]
            return pa.record_batch([pa.array([number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in content)], names=[f"{name}_block", f"{name}_ids", f"{name}_rows", f"{name}_table"])

        for batch in batches:
            for ident, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(ident)
                values.append(value)
                if len(ids) == size:
                    yield flush()
                    ids, values, number = [], [], number + 1
        if ids:
            yield flush()

    return stored_map(rows.select("id", "vector"), run, f"{name}_block long, {name}_ids binary, {name}_rows binary, {name}_table binary", f"{name}-blocks").frame


class _Best:
    """The k best (score, id) of each query of a block, so far, and how many
    candidates each met and evaluated."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.scores = [np.zeros(0) for _ in ids]
        self.found = [np.zeros(0, np.int64) for _ in ids]
        self.floors = np.full(len(ids), -np.inf)
        self.met, self.evaluated = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)

    def add(self, j: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[j], scores)), np.concatenate((self.found[j], ids))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[j], self.found[j] = scores[order], ids[order]
        if len(order) == self.k:
            self.floors[j] = scores[order[-1]]

    def batch(self, share: int) -> pa.RecordBatch:
        sizes = [len(x) for x in self.found]
        each = lambda x: pa.array(np.repeat(x, sizes))
        return pa.record_batch([each(self.ids), pa.array(np.concatenate(self.found)), pa.array(np.concatenate(self.scores).astype(np.int64)), each(self.met), each(self.evaluated), pa.array(np.full(sum(sizes), share))], names=[x.split()[0] for x in _FOUND.split(", ")])


def _bounds(squares: np.ndarray, table: np.ndarray, query_squares: np.ndarray, query_table: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products, (queries, candidates)."""
    columns = np.ascontiguousarray(table.T)
    apart = np.zeros((len(query_table), len(table)), np.float32)
    difference = np.empty((TILE, len(table)), np.float32)
    for a in range(0, len(apart), TILE):
        part = apart[a : a + TILE]
        own = difference[: len(part)]
        for p, column in enumerate(columns):
            np.subtract(query_table[a : a + TILE, p, None], column[None, :], out=own)
            np.abs(own, out=own)
            np.maximum(part, own, out=part)
    both = query_squares[:, None] + squares[None, :]
    # Distances are held as floats of 24 bits: the slack covers their rounding.
    apart = np.maximum(apart.astype(np.float64) - 4e-7 * np.sqrt(2 * both) - 1e-3, 0)
    return (both - np.square(apart)) / 2 + 1e-9 * both


def search_block(best: _Best, queries: np.ndarray, query_table: np.ndarray, ids: np.ndarray, rows: np.ndarray, table: np.ndarray, step: int = STEP) -> None:
    """Adds a candidate block's part to ``best``."""
    bounds = _bounds(np.square(rows).sum(axis=1), table, np.square(queries).sum(axis=1), query_table)
    bounds[best.ids[:, None] == ids[None, :]] = -np.inf  # no query is its own candidate
    best.met += np.isfinite(bounds).sum(axis=1)
    order = np.argsort(-bounds.max(axis=0), kind="stable")
    for k in range(0, len(order), step):
        part = order[k : k + step]
        live = (bounds[:, part] >= best.floors[:, None]) & np.isfinite(bounds[:, part])
        if not live.any():
            # A floor only rises: if no query passes the best of what is left, it ends here.
            if not (bounds[:, order[k:]] >= best.floors[:, None]).any():
                break
            continue
        asked = np.flatnonzero(live.any(axis=1))
        scores = queries[asked] @ rows[part].T
        best.evaluated += live.sum(axis=1)
        good = live[asked] & (scores >= best.floors[asked, None])
        for n in np.flatnonzero(good.any(axis=1)).tolist():
            best.add(int(asked[n]), scores[n, good[n]], ids[part[good[n]]])


def _search(width: int, k: int):
    def run(batches):
        current, best, queries, table = None, None, None, None
        share = TaskContext.get().partitionId() << 32
        for batch in batches:
            for n in range(batch.num_rows):  # a row is large
                block, ids, rows, q_table, c_ids, c_rows, c_table = (column[n].as_py() for column in batch.columns)
                if block != current:
                    if best is not None:
                        yield best.batch(share)
                        share += 1
                    current, best = block, _Best(np.frombuffer(ids, np.int64), k)
                    queries = np.frombuffer(rows).reshape(len(best.ids), width)
                    table = np.frombuffer(q_table, np.float32).reshape(len(best.ids), -1)
                other = np.frombuffer(c_ids, np.int64)
                search_block(best, queries, table, other, np.frombuffer(c_rows).reshape(len(other), width), np.frombuffer(c_table, np.float32).reshape(len(other), -1))
        if best is not None:
            yield best.batch(share)

    return run


def _found(vectors: DataFrame, is_query, id_col: str, vector_col: str, k: int, scale: float, pivots: int) -> DataFrame:
    """``(query_id, vec_id, score, met, evaluated, share)``: the k best of a
    query in each share of the candidates, the share's counts on each row."""
    spark = vectors.sparkSession
    if vectors.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer column")
    rows = integer_vectors(vectors.where(F.col(id_col).isNotNull()).withColumn(id_col, F.col(id_col).cast("long")), id_col, vector_col, scale)
    width, total = rows.agg(F.max("size"), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], _FOUND)
    share = min(1.0, PIVOT_SAMPLE / total)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).orderBy(F.xxhash64("id"), "vector").limit(PIVOT_SAMPLE).collect()
    chosen = choose_pivots(_matrix([bytes(r.vector) for r in drawn], width), pivots)
    if not len(chosen):
        chosen = np.zeros((1, width))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = _blocks(rows.repartition(max(1, min(parts, -(-total // BLOCK)))), chosen, width, BLOCK, "c")
    asked = rows.where(is_query).dropDuplicates(["id"])
    queries = _blocks(asked.repartition(max(1, min(parts, -(-total // (20 * QUERY_BLOCK))))), chosen, width, QUERY_BLOCK, "q")
    # A stripe is dealt consecutive blocks of different tasks in turn, and
    # there are several stripes for a task, so that tasks have equal shares.
    stripes = max(1, min(2 * parts, -(-total // BLOCK)))
    place = F.shiftright("c_block", 32) + F.col("c_block").bitwiseAND(F.lit((1 << 32) - 1)) * max(1, min(parts, -(-total // BLOCK)))
    striped = candidates.withColumn("stripe", F.pmod(place, F.lit(stripes)))
    spread = queries.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).withColumn("stripe", F.col("stripe").cast("long"))
    # Blocks of copies are small files, but whole again in memory, and queries
    # come once for each stripe: neither side is broadcast.
    pairs = spread.hint("merge").join(striped, "stripe").select("q_block", "q_ids", "q_rows", "q_table", "c_ids", "c_rows", "c_table")
    return arrow_map(pairs, _search(width, k), _FOUND)


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, pivots: int = PIVOTS) -> DataFrame:
    """``(query_id, rank int, vec_id, score long)``: each query's k best.

    ``is_query`` is a column on the id, called ``id``.  Components become
    floor(scale * x); a query's own id is no candidate; ties go to the smaller
    id; ranks start at 1; fewer candidates give fewer rows.

    * ids are integers of up to 64 bits, other kinds are refused;
    * null vectors, empty ones and those with null or non-finite components
      take no part, nor do null ids; vectors of different lengths are compared
      as if the shorter ended in zeros;
    * repeated rows are candidates of their own and rank one after the other;
      a repeated query is answered once; other columns are ignored, whatever
      their names; an empty table gives an empty result.
    * scores must be within 2**53, where doubles hold integers exactly.
    """
    found = _found(vectors, is_query, id_col, vector_col, k, scale, pivots)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: float = 64.0, pivots: int = PIVOTS) -> tuple[int, int]:
    """(candidates evaluated, candidates met) over all queries: what the bounds
    leave of the work."""
    each = _found(vectors, is_query, id_col, vector_col, k, scale, pivots)
    counts = each.groupBy("query_id", "share").agg(F.max("met").alias("met"), F.max("evaluated").alias("evaluated"))
    return tuple(counts.agg(F.sum("evaluated"), F.sum("met")).first())
