"""Exact top-k by inner product with vector-approximation files.

Rows are dealt into shards, and each shard is two files. The approximation has a byte for each component: its cell
in a uniform grid over the shard's range. The other has the exact vectors. Blocks of queries scan approximations only:
cells bound every score from both sides, and the kth best lower bound of all shards is a floor for each query. Shards in which no row can
reach a query's floor are done with. Of the others the exact vectors are read in the order of their upper bounds, and
reading stops once the next bound is below the kth score or the floor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

#: Most vectors have one length, so the list of shards is dealt so many times.
SALTS = 64


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(low, step, cells) of whole vectors: each component lies from low + step * cell to low + step * (cell + 1) - 1."""
    low = vectors.min(0)
    reach = (vectors.max(0).view(np.uint64) - low.view(np.uint64)) // np.uint64(256)  # unsigned, so that no difference is too large
    step = reach + np.uint64(1)
    return low, step, ((vectors.view(np.uint64) - low.view(np.uint64)) // step).astype(np.uint8)


class Approximation:
    """One shard's cells, and bounds of scores from them."""

    def __init__(self, low: np.ndarray, step: np.ndarray, cells: np.ndarray):
        self.low, self.step, self.cells = low.astype(float), step.astype(float), cells

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds, (queries, rows): one product with the cells, and what a cell's width adds on either side."""
        q = queries.astype(float)
        base = (q * self.step) @ self.cells.T.astype(float) + (q @ self.low)[:, None]
        width = self.step - 1
        below, above = np.minimum(q, 0) @ width, np.maximum(q, 0) @ width
        # sums of whole floats are exact below 2^53; beyond, the bounds give way by what rounding can lose
        size = np.abs(q) @ (np.abs(self.low) + 256 * self.step)
        lost = np.where(size < 2.0**52, 0.0, size * 2.0**-40)
        return base + (below - lost)[:, None], base + (above + lost)[:, None]


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, or -inf where there are fewer."""
    short = k - scores.shape[1]
    if short > 0:
        scores = np.concatenate([scores, np.full((len(scores), short), -np.inf)], 1)
    return -np.partition(-scores, k - 1, 1)[:, :k] if scores.shape[1] > k else scores


def read_best(
    approximation: Approximation, ids: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, floor: float, k: int,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, exact vectors read) of a query's k best rows of the shard but its own, ties to the smaller id; rows below the floor may be
    missing.
    """
    upper = approximation.bounds(query[None, :])[1][0]
    order = np.flatnonzero((ids != own) & (upper >= floor))
    order = order[np.argsort(-upper[order], kind="stable")]
    found, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
    # a bound that equals the kth score may hide a tie of a smaller id, so only lower ones end the search
    while at < len(order) and (len(scores) < k or upper[order[at]] >= scores[-1]):
        part = order[at : at + step]
        found, scores = np.concatenate([found, ids[part]]), np.concatenate([scores, vectors[part] @ query])
        best = np.lexsort((found, -scores))[:k]
        found, scores = found[best], scores[best]
        at, step = at + len(part), 2 * step
    return found, scores, at


def _usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, v) with v = floor(scale * x); vectors null or with null or non-finite components take no part, nor rows without an id."""
    x = F.col(vector_col)
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    ints = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("bigint"))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(fit).select(F.col(id_col).cast("bigint").alias("id"), ints.alias("v"))


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Rows in blocks of at most ``most`` and of one length: (block, width, ids, vectors, low, step, cells), as bytes of 64-bit numbers, and
    cells of 8 bits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        part, n = TaskContext.get().partitionId() << 32, 0

        def block(width: int) -> pd.DataFrame:
            nonlocal n
            ids, vectors = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            n += 1
            files = [x.tobytes() for x in (ids, vectors, *quantised(vectors))]
            return pd.DataFrame({"block": [part + n - 1], "width": [width]} | {k: [x] for k, x in zip(("ids", "vectors", "low", "step", "cells"), files, strict=True)})

        for b in batches:
            sizes = b["v"].map(len).to_numpy()
            for width in np.unique(sizes).tolist():
                own = b[sizes == width]
                ids, vectors = own["id"].to_numpy(np.int64), np.stack(own["v"].to_list()).astype(np.int64)
                while len(ids):
                    room = most - sum(len(x) for x, _ in held.get(width, []))
                    held.setdefault(width, []).append((ids[:room], vectors[:room]))
                    ids, vectors = ids[room:], vectors[room:]
                    if sum(len(x) for x, _ in held[width]) >= most:
                        yield block(width)
        for width in list(held):
            yield block(width)

    return rows.mapInPandas(run, "block bigint, width int, ids binary, vectors binary, low binary, step binary, cells binary")


def _approximation(r) -> Approximation:
    return Approximation(np.frombuffer(r.low, "<i8"), np.frombuffer(r.step, "<u8"), np.frombuffer(r.cells, np.uint8).reshape(-1, r.width))


def _scanned(met: DataFrame, k: int) -> DataFrame:
    """(q_block, block, lower, upper) for each block of queries and shard: the k best lower bounds of each query, and its best upper one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, shard = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.block != last:
                    shard, last = _approximation(r), r.block
                own, ids = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.ids, "<i8")
                lower, upper = shard.bounds(np.frombuffer(r.q_vectors, "<i8").reshape(-1, r.width))
                itself = own[:, None] == ids[None, :]
                lower[itself] = upper[itself] = -np.inf
                yield pd.DataFrame({"q_block": [r.q_block], "block": [r.block], "lower": [best_of(lower, k).tobytes()], "upper": [upper.max(1).tobytes()]})

    return met.mapInPandas(run, "q_block bigint, block bigint, lower binary, upper binary")


def _floors(scanned: DataFrame, k: int) -> DataFrame:
    """(q_block, floor): each query's kth best lower bound. Shards are merged in salted groups first, so no task gets all of them."""

    def merge(b: pd.DataFrame) -> pd.DataFrame:
        top = None
        for x in b["lower"]:
            x = np.frombuffer(x).reshape(-1, k)
            top = x if top is None else best_of(np.concatenate([top, x], 1), k)
        return pd.DataFrame({"q_block": [b["q_block"].iloc[0]], "lower": [top.tobytes()]})

    def last(b: pd.DataFrame) -> pd.DataFrame:
        top = np.frombuffer(merge(b)["lower"].iloc[0]).reshape(-1, k)
        return pd.DataFrame({"q_block": [b["q_block"].iloc[0]], "floor": [top.min(1).tobytes()]})

    salted = scanned.select("q_block", "lower", F.pmod(F.xxhash64("block"), F.lit(SALTS)).alias("salt"))
    merged = salted.groupBy("q_block", "salt").applyInPandas(merge, "q_block bigint, lower binary")
    return merged.groupBy("q_block").applyInPandas(last, "q_block bigint, floor binary")


def _open(scanned: DataFrame, floors: DataFrame) -> DataFrame:
    """(q_block, block, live, floor) where a row of the shard can still reach the floor of the queries ``live``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                upper, floor = np.frombuffer(r.upper), np.frombuffer(r.floor)
                live = np.flatnonzero((upper >= floor) & (upper > -np.inf))
                if len(live):
                    yield pd.DataFrame({"q_block": [r.q_block], "block": [r.block], "live": [live.astype(np.int32).tobytes()], "floor": [floor[live].tobytes()]})

    return scanned.join(floors, "q_block").select("q_block", "block", "upper", "floor").mapInPandas(run, "q_block bigint, block bigint, live binary, floor binary")


def search(vectors: DataFrame, queries: DataFrame, k: int, scale: int, shard_rows: int, query_rows: int, id_col: str, vector_col: str) -> DataFrame:
    """(q_block, place, block, query_id, vec_id, score, read): the best rows of each shard that is open for a query, and how many exact vectors
    it read there.
    """
    shards = materialize(_packed(_usable(vectors, id_col, vector_col, scale), shard_rows), "shards")
    asked = materialize(_packed(_usable(queries, id_col, vector_col, scale), query_rows).select("block", "width", "ids", "vectors"), "asked")
    q = asked.select("width", F.pmod("block", F.lit(SALTS)).alias("salt"), F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    listed = shards.select("block", "width").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    files = shards.select("block", "width", "ids", "low", "step", "cells")
    scanned = materialize(_scanned(q.join(listed, ["width", "salt"]).drop("width", "salt").join(files, "block"), k), "scanned")
    opened = materialize(_open(scanned, _floors(scanned, k)), "open")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, shard = None, None
        for b in batches:
            for r in b.itertuples(index=False):
                if r.block != last:
                    shard, last = _approximation(r), r.block
                    ids, exact = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vectors, "<i8").reshape(-1, r.width)
                own, q_vectors = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_vectors, "<i8").reshape(-1, r.width)
                live, floor = np.frombuffer(r.live, np.int32), np.frombuffer(r.floor)
                found = [read_best(shard, ids, exact, q_vectors[i], own[i], floor[n], k) for n, i in enumerate(live.tolist())]
                size = [len(x) for x, _, _ in found]
                place = np.repeat(live, size).astype(np.int64)
                yield pd.DataFrame({"q_block": r.q_block, "place": place, "block": r.block, "query_id": own[place], "vec_id": np.concatenate([x for x, _, _ in found]), "score": np.concatenate([s for _, s, _ in found]), "read": np.repeat([n for _, _, n in found], size)})

    met = opened.join(q.select("q_block", "q_ids", "q_vectors"), "q_block").join(shards, "block")
    return met.mapInPandas(run, "q_block bigint, place bigint, block bigint, query_id bigint, vec_id bigint, score bigint, read bigint")


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, scale: int = 256, shard_rows: int = 4096, query_rows: int = 256, id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best rows of vectors other than its own, or all if fewer.

    The score is the inner product of floor(scale * x), and ties go to the smaller id. Vectors that are
    null, empty, or hold null or non-finite components take no part, on either side, nor do rows
    without an id; only vectors of one length are compared. A repeated row competes once for each time
    it stands, and a repeated query row is answered each time. Empty tables give no rows, and other columns are not read.

    Blocks of queries meet every shard's approximation on the shard's number, and an open shard hands on k rows for
    each query. The queries are a stated share of the rows, so this grows with queries times shards.
    """
    local = search(vectors, queries, k, scale, shard_rows, query_rows, id_col, vector_col)
    order = Window.partitionBy("q_block", "place").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
