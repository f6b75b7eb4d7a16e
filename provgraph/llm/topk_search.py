"""Exact top-k inner-product search by no-random-access aggregation.

Every dimension of a part of the vectors is a list of (value, row), sorted, and read in sequence from the
end that a query's weight favours; queries share the reading. A slab of all lists is a matrix of the
entries read, zero elsewhere, and its product with many queries' weights adds to their bounds at once. A
row's lower bound starts from the far ends of all lists and rises by what each entry read adds; its upper
bound puts the lists' frontiers for the entries not read yet. The k-th best lower bound, or the k-th best
score of the parts before if that is higher, is the bar. Once rows of which nothing was read stay below it,
only rows whose upper bound reaches the bar are candidates; a query stops when few are left, and their
final scores are resolved.

Rows and queries are dealt into blocks of set size; each pair of blocks is one group of one shuffle. A block's
parts are read one after the other, each as long as all before it, so that most lists start with a bar;
a query's best of all blocks are merged by rank. Nothing is broadcast or gathered. Every query meets
every row, so the work grows with the square of the table.

Defined results: vectors null, empty or holding null or non-finite components, and rows without a
vec_id, take no part; vectors meet those of equal length only; a query's own rows are those with its
vec_id; repeated rows count, and a repeated query row gets rows of its own; components beyond 64-bit
integers after scaling saturate, and scores beyond them wrap; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table, written

TOP, EVERY, SCALE = 20, 20, 64
ROW_BLOCK, QUERY_BLOCK, TOGETHER = 16_384, 16_384, 128
#: Where blocks are few, queries are dealt into smaller ones, of LEAST at least, for so many pairs of blocks.
LEAST, PAIRED = 1024, 8
#: A block's parts double PARTS times, from FIRST rows at least.
PARTS, FIRST = 5, 256
#: Numbers in a part's slabs that are held for further queries; candidates resolved at once, on average.
KEPT, PAIRS = 2**25, 32_768
#: Shares of the lists after which bounds are compared: the ends of the slabs.
SLABS = (1 / 64, 1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 5 / 8, 3 / 4, 13 / 16, 7 / 8, 15 / 16, 1)
#: A query stops reading once this many vectors for each of its k can still qualify.
FEW = 8

FOUND = "query_row long, query_id long, vec_id long, score long"


def quantised(vector: str = "embedding", scale: int = SCALE) -> Column:
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * scale))


def usable(vector: str = "embedding") -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(F.col(vector).cast("array<double>"), finite)


class Lists:
    """The sorted lists of a part of the vectors (whole numbers)."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        self.order = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.read = 0  # entries read for queries, and in resolving scores
        self.slabs: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def between(self, a: int, b: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The entries at places a to b from the lists' tops, then from their bottoms: by row what they differ from the
        far ends, else 0; and which entries are read by then."""
        if (a, b, kind) not in self.slabs:
            if 4 * self.x.size * (len(self.slabs) + 1) > KEPT:
                self.slabs.clear()
            n, values, dims = self.n, self.values, self.x.shape[1]
            gain, seen = np.zeros((n, 2 * dims), dtype=kind), np.zeros((n, 2 * dims), dtype=kind)
            for at, places, column, end in ((slice(n - b, n - a), slice(n - b, n), np.arange(dims), 0), (slice(a, b), slice(b), np.arange(dims, 2 * dims), -1)):
                gain[self.order[at], column] = values[at].astype(kind) - values[end].astype(kind)
                seen[self.order[places], column] = 1
            self.slabs[a, b, kind] = gain.T, seen.T
        return self.slabs[a, b, kind]

    def nearest(self, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, bars: np.ndarray | None = None) -> list[np.ndarray]:
        """For each of the queries the rows that can be among its k best, all of these included.

        bars: scores that k rows of other lists reach; rows that stay below are left out.
        """
        x, n, values = self.x, self.n, self.values
        found: list[np.ndarray] = [np.arange(n)] * len(q)
        largest = 4.0 * furthest(x) * furthest(q) * x.shape[1]
        if n <= k or largest >= 2.0**62:  # scores that may wrap have no bounds
            return found
        kind, slack = (np.float32, 0.0) if largest < 2**24 else (np.float64, 0.0 if largest < 2**53 else 1e-9 * largest)
        far = np.concatenate([values[0], values[-1]]).astype(kind)
        open_ = np.arange(len(q))
        weight = np.concatenate([np.maximum(q, 0), np.minimum(q, 0)], axis=1).astype(kind)
        base = weight @ far  # the bound of a row of which nothing was read
        bar = np.full(len(q), -np.inf, dtype=kind) if bars is None else bars.astype(kind)
        lower = np.repeat(base[:, None], n, axis=1)
        lower[q_ids[:, None] == ids] = -np.inf
        a = 0
        for b in dict.fromkeys(max(1, int(n * share)) for share in SLABS):
            more = weight * (np.concatenate([values[n - b], values[b - 1]]).astype(kind) - far)  # what an entry not read may still add
            unseen = base + more.sum(1)
            if b < n and np.isfinite(bar).any() and not (unseen < bar - slack).any():
                continue  # no query can stop by its bar here: this slab is read together with the next
            gain, seen = self.between(a, b, kind)
            lower += weight @ gain
            self.read += (b - a) * np.count_nonzero(weight)
            a = b
            # the bar is no higher than the best lower bound: where that won't do, it needn't be known
            ready = np.flatnonzero(unseen < np.maximum(bar, lower.max(axis=1)) - slack) if b < n else np.arange(len(open_))
            own = lower if len(ready) == len(open_) else lower[ready]
            raised = np.count_nonzero(own > bar[ready, None], axis=1) >= k
            if raised.any():
                bar[ready[raised]] = np.partition(own[raised], n - k, axis=1)[:, n - k]
            if b < n:
                over = unseen[ready] < bar[ready] - slack
                ready, own = (ready, own) if over.all() else (ready[over], own[over])
            if not len(ready):
                continue
            if b < n:
                upper = more[ready] @ seen
                np.subtract(own, upper, out=upper)
                able = upper >= (bar - slack - (unseen - base))[ready, None]
            else:
                able = own >= bar[:, None] - slack
            few = np.flatnonzero(np.count_nonzero(able, axis=1) <= FEW * k) if b < n else np.arange(len(ready))
            for j in few:
                found[open_[ready[j]]] = row = np.flatnonzero(able[j])
                self.read += len(row) * x.shape[1]
            if len(few):
                stay = np.ones(len(open_), dtype=bool)
                stay[ready[few]] = False
                open_, weight, base, bar, lower = open_[stay], weight[stay], base[stay], bar[stay], lower[stay]
                if not len(open_):
                    break
        return found


def furthest(x: np.ndarray) -> float:
    return max(float(x.max(initial=0)), -float(x.min(initial=0)))


def leaders(at: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, row, score) each query's k best, best first, ties to the smaller id."""
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[kept], row[kept], score[kept]


def top_of_block(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's k best rows, ties to the smaller id. x, q: whole numbers.

    The rows are read in parts, each as long as all before it; the k-th best score so far is the next part's bar.
    """
    held = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    ends = [len(x) >> i for i in range(PARTS, 0, -1) if len(x) >> i >= FIRST] + [len(x)]
    for start, end in zip([0, *ends], ends, strict=False):
        lists, own, out = Lists(x[start:end]), ids[start:end], [held]
        bars = np.full(len(q), -np.inf)
        last = np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) == k - 1
        bars[held[0][last]] = held[2][last]
        for first in range(0, len(q), TOGETHER):
            some = slice(first, first + TOGETHER)
            found = lists.nearest(own, q[some], q_ids[some], k, bars[some])
            for piece in np.array_split(np.arange(len(found)), min(len(found), 1 + sum(map(len, found)) // PAIRS)):
                row = np.concatenate([found[i] for i in piece])
                at = first + np.repeat(piece, [len(found[i]) for i in piece])
                other = own[row] != q_ids[at]
                at, row = at[other], row[other]
                score = np.einsum("ij,ij->i", lists.x[row], q[at])
                good = score >= bars[at]
                at, row, score = leaders(at[good], row[good], score[good], own, k)
                out.append((at, start + row, score))
        held = leaders(*(np.concatenate(z) for z in zip(*out, strict=True)), ids, k)
    return held


def search(vectors: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """vectors, queries (vec_id long, v ARRAY<LONG>): each query's k best rows, as query_id, rank, vec_id, score."""
    rows = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.monotonically_increasing_id().alias("row"))
    asked = written(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dim"), F.monotonically_increasing_id().alias("query_row")), "queries")
    n_queries, row_blocks = asked.count(), max(1, -(-rows.count() // ROW_BLOCK))
    query_blocks = max(1, -(-n_queries // QUERY_BLOCK), min(-(-n_queries // LEAST), -(-PAIRED // row_blocks)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", F.pmod(F.xxhash64("row"), F.lit(row_blocks)).cast("int")).withColumn("qb", each(query_blocks)).drop("row")
    right = asked.withColumn("qb", F.pmod(F.xxhash64("query_row"), F.lit(query_blocks)).cast("int")).withColumn("rb", each(row_blocks))

    def best(some: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(ask):
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        ids = some["vec_id"].to_numpy()
        a, row, score = top_of_block(np.stack(some["v"].to_list()), ids, np.stack(ask["q"].to_list()), ask["query_id"].to_numpy(), k)
        return pd.DataFrame({"query_row": ask["query_row"].to_numpy()[a], "query_id": ask["query_id"].to_numpy()[a], "vec_id": ids[row], "score": score})

    keys = ["dim", "qb", "rb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")).alias("rank")
    return found.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op2_nra_topk(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long"), quantised().alias("v"))
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 20
"""
