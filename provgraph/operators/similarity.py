"""Session fingerprints and their cosine similarity (FPR)."""

from __future__ import annotations

from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rows of a block's part; products that a task holds at a time, and those of them that are summed anew at a time.
PART, ENTRIES, STEP = 8192, 1_000_000, 4096

# The contract's counts of tracks by role and of processors by family, and the counts that are compared.
ROLES = {"n_vocal_tracks": "Vocal", "n_drum_tracks": "Drums", "n_bass_tracks": "Bass", "n_guitar_tracks": "Guitar", "n_keys_tracks": "Keys", "n_bus_tracks": "Bus"}
FAMILIES = {"n_ambience_fx": "Ambience", "n_dynamics_fx": "Dynamics", "n_eq_fx": "EQ"}
COMPARED = ("n_tracks", "n_vocal_tracks", "n_drum_tracks", "n_bass_tracks", "n_fx", "n_ambience_fx", "n_dynamics_fx", "n_eq_fx", "n_routes", "avg_fx_per_track")


def fingerprint(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(bundle_id, 13 counts): tracks and tracks by role, processors and processors by family, sends and routes, processors a track to three places."""
    track, fx = F.col("entity_type") == "TRACK", F.col("entity_type") == "PROCESSOR"
    counts = {"n_tracks": track, **{c: track & (F.col("role") == r) for c, r in ROLES.items()}, "n_fx": fx, **{c: fx & (F.col("family") == f) for c, f in FAMILIES.items()}}
    e = entities.groupBy("bundle_id").agg(*(F.count_if(when).alias(c) for c, when in counts.items()))
    r = relationships.groupBy("bundle_id").agg(F.count_if(F.col("rel_type").isin("CHANNEL_SENDS_TO", "CHANNEL_ROUTES_TO")).alias("n_routes"))
    out = e.join(r, "bundle_id", "left").fillna(0, ["n_routes"])
    return out.withColumn("avg_fx_per_track", F.when(F.col("n_tracks") > 0, F.bround(F.col("n_fx") / F.col("n_tracks"), 3)).otherwise(0.0))


def structure() -> Column:
    """The compared counts of a fingerprint as a vector for cosine."""
    return F.array(*(F.col(c).cast("double") for c in COMPARED))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [0, 1], four places; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / norm)), 4)).otherwise(0.0)


def _known(rows: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors as a matrix, their norms and sizes. A null is all zeros, with which everything has similarity 0; so is what a shorter one lacks."""
    vectors, sizes = np.zeros((len(rows), size)), np.zeros(len(rows), dtype=np.int64)
    for i, v in enumerate(rows["vector"]):
        if v is not None:
            vectors[i, : len(v)], sizes[i] = v, len(v)
    with np.errstate(all="ignore"):
        return vectors, np.sqrt(_sums(vectors * vectors)), sizes


def _sums(products: np.ndarray) -> np.ndarray:
    """Each row's sum, taken entry by entry as cosine does."""
    return np.add.accumulate(products, axis=1)[:, -1]


def _cosines(a: tuple, b: tuple) -> np.ndarray:
    """cosine of each row of a with each of b in ten-thousandths, as whole numbers.

    A product of matrices is right to far less than 1e-6 of these; where that leaves the rounding open, the sum is taken anew.
    """
    with np.errstate(all="ignore"):
        norm = a[1][:, None] * b[1][None, :]
        share = a[0] @ b[0].T
        share /= norm
        share[np.isnan(share)] = 1.0  # to Spark the largest number
        np.clip(share, 0.0, 1.0, out=share)
        share[~(norm > 0) & ~np.isnan(norm)] = 0.0
        share[a[2][:, None] != b[2][None, :]] = 0.0
        share *= 10_000
        out = np.rint(share)
        share -= np.floor(share)
        i, j = np.nonzero(np.abs(share - 0.5) < 1e-6)
        for at in range(0, len(i), STEP):
            x, y = i[at : at + STEP], j[at : at + STEP]
            exact = np.clip(_sums(a[0][x] * b[0][y]) / (a[1][x] * b[1][y]), 0.0, 1.0)
            out[x, y] = [int(Decimal(repr(v)).scaleb(4).to_integral_value(ROUND_HALF_EVEN)) for v in exact.tolist()]
    return out.astype(np.int64)


def _best(k: int):
    def best(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        """Of each row of a the k rows of b that are most similar, equal ones by id."""
        found = [pd.DataFrame({"id": a["id"][:0], "other": b["id"][:0], "similarity": np.zeros(0)})]
        size = max([1, *(len(v) for df in (a, b) for v in df["vector"] if v is not None)])
        b = b.sort_values("id", ignore_index=True)
        known, n = _known(b, size), len(b)
        step = max(1, ENTRIES // max(1, n))
        for at in range(0, len(a) if n else 0, step):
            some = a.iloc[at : at + step]
            # one number for both orders: the similarity, then how many ids are larger
            order = _cosines(_known(some, size), known) * n + (n - 1 - np.arange(n))
            if key[1] == key[2]:
                order[some["id"].to_numpy()[:, None] == b["id"].to_numpy()[None, :]] = -1
            top = np.argpartition(-order, k - 1, axis=1)[:, :k] if k < n else np.tile(np.arange(n), (len(some), 1))
            held = np.take_along_axis(order, top, axis=1).ravel()
            found.append(pd.DataFrame({"id": some["id"].repeat(top.shape[1]).to_numpy(), "other": b["id"].to_numpy()[top.ravel()], "similarity": held // n / 10_000})[held >= 0])
        return pd.concat(found, ignore_index=True)

    return best


def nearest(rows: DataFrame, block: str, k: int = 5) -> DataFrame:
    """rows (id, vector, a blocking column): each one's k most similar in its block, of equally similar ones those with the smaller ids.

    Every pair of a block is compared, as cosine does. A block is cut into parts of about PART rows, and every two parts meet in a task,
    which holds the products of a few rows at a time and returns k rows a query: memory is bounded by a part, time by the pairs.
    A vector that is null or holds a null, and one of another size, has similarity 0.
    """
    spark = rows.sparkSession
    whole = F.when(~F.exists("vector", lambda x: x.isNull()), F.col("vector"))
    rows = rows.where(F.col(block).isNotNull() & F.col("id").isNotNull())
    sizes = rows.groupBy(block).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_parts"))
    dealt = rows.select(block, "id", whole.alias("vector")).join(sizes, block).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    key, tasks = ["_block", "_a", "_b"], max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    same = [F.col(block).alias("_block"), F.col("id").alias("id"), F.col("vector").alias("vector")]
    side = lambda own, other: dealt.select(*same, F.col("_part").alias(own), every.alias(other)).repartition(tasks, *key).groupBy(*key)
    kind = rows.schema["id"].dataType.simpleString()
    met = side("_a", "_b").cogroup(side("_b", "_a")).applyInPandas(_best(k), f"id {kind}, other {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "other", "similarity")
