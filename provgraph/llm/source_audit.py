"""How far a language's sources diverge in their words, by bitmaps of term ids for each count.

A language's kept terms get ids in the order of their frequency, so that a 64-bit word of ids holds terms
of like counts. For each group (lang, source) and each count that occurs there, a word holds the ids of the
terms with that count. Two groups' joint cells (terms with count c here and d there) are the AND of two
words, counted by popcount and multiplied by the divergence f of the two probabilities. Terms that only
one of the groups has, or neither, aren't stored: their number is the complement, so that

    sum = cells (f(c,d) - f(c,0) - f(0,d) + f(0,0)) + levels c (f(c,0) - f(0,0)) + levels d (f(0,d) - f(0,0)) + V f(0,0)

Words are dealt into chunks of CHUNK ids, sources into tiles of TILE, and a pair of tiles in a chunk is one
group of one shuffle: its rows are bounded, whatever a language's or a source's share of the corpus is.
Counts are summed in the tasks that read texts, before they are shuffled. All arithmetic is exact: whole
numbers of 64 bits, of 128 where a product may leave them.

Defined results: a null text, lang or source is an empty one; a text without terms counts for its group,
which has a row for each other source of its language; a lone source has no pairs; repeated rows count
as often as they stand; a language without kept terms has pairs of value 0 and no terms; ties go to the smaller
item by its UTF-8; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_rows, scope, table, written

LEAST_DOCS, TOP = 10, 10
#: Scale of probabilities, and what is added to each count.
SCALE, PRIOR = 1_000_000_000, 2
#: Term ids of a chunk, sources of a tile, different terms that a task counts before it hands them on.
CHUNK, TILE, HELD = 4096, 128, 400_000

#: Signs that end a term become blanks, A to Z small letters; bytes of other letters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def partial_counts(docs: DataFrame) -> DataFrame:
    """docs (lang, source, text) to (lang, source, term, n, docs): occurrences and documents, summed within each task."""

    def rows(held: dict) -> pd.DataFrame:
        parts = [(lang, source, t.decode("utf-8", "surrogatepass"), n, docs_[t]) for (lang, source), (counts, docs_) in held.items() for t, n in counts.items()]
        return pd.DataFrame(parts, columns=["lang", "source", "term", "n", "docs"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                counts, docs_ = held.setdefault((lang, source), (Counter(), Counter()))
                before, terms = len(counts), terms_of(text)
                counts.update(terms)
                docs_.update(set(terms))
                size += len(counts) - before
                if size > HELD:
                    yield rows(held)
                    held.clear()
                    size = 0
        if held:
            yield rows(held)

    return docs.mapInPandas(work, "lang string, source string, term string, n long, docs long")


def whole(n: Column | str) -> Column:
    return F.col(n).cast("decimal(38,0)") if isinstance(n, str) else n.cast("decimal(38,0)")


def probability(count: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE (count + PRIOR) / (total + PRIOR kept)), exactly."""
    return F.expr(f"1L + CAST((CAST({count} AS DECIMAL(19,0)) + {PRIOR}) * {SCALE} div (CAST({total} AS DECIMAL(19,0)) + {PRIOR} * CAST({kept} AS DECIMAL(19,0))) AS BIGINT)")


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)) of whole numbers up to SCALE + 1."""
    return (p - q) ** 2 // (p + q)


def counted(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """groups (lang, source, total, v, zero_p), terms (lang, term, id, n, docs), counts (lang, source, id, term, n, p), langs (lang, v, total)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(text("lang"), text("source"), text("text"))
    with arrow_rows(docs.sparkSession, 1000):
        parts = written(partial_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    kept = parts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    # ids are dense within a partition of the range by frequency; where a partition ends, so does a chunk
    ordered = kept.repartitionByRange("lang", F.desc("n"), "term").sortWithinPartitions("lang", F.desc("n"), "term")
    terms = written(ordered.select("lang", "term", F.monotonically_increasing_id().alias("id"), "n", "docs"), "terms")
    every = rows.select("lang", "source").distinct()
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("total"))
    langs = written(every.select("lang").distinct().join(langs, "lang", "left").na.fill(0, ["v", "total"]), "langs")
    mine = written(parts.join(terms.select("lang", "term", "id"), ["lang", "term"]).select("lang", "source", "id", "term", "n"), "kept")
    totals = mine.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]).join(langs.select("lang", "v"), "lang")
    groups = groups.withColumn("zero_p", F.when(F.col("v") > 0, probability("0", "total", "v")).otherwise(F.lit(1).cast("long")))
    groups = written(groups, "groups")
    counts = mine.join(groups.select("lang", "source", "total", "v"), ["lang", "source"])
    return groups, terms, written(counts.select("lang", "source", "id", "term", "n", probability("n", "total", "v").alias("p")), "levels"), langs


def bitmaps(counts: DataFrame) -> DataFrame:
    """(lang, source, word, p, bits): for each probability, so each count, of a group the terms of a word that have it."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("id") % 64).cast("int"))
    return counts.groupBy("lang", "source", F.shiftright("id", 6).alias("word"), "p").agg(F.bit_or(bit).alias("bits"))


def tile_sums(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums over a chunk for all pairs of groups of a pair of tiles.

    rows: source, tile, word, p, bits, and for each source a row without bits, whose p is that of a term it
    doesn't have and whose word the number of terms of the chunk.
    """
    marks = rows[rows["bits"] == 0].sort_values(["tile", "source"], kind="stable")
    names, zero, tile = marks["source"].to_numpy(), marks["p"].to_numpy(np.int64), marks["tile"].to_numpy()
    terms = int(marks["word"].iloc[0])
    words = rows[rows["bits"] != 0]
    place = pd.Series(np.arange(len(names)), index=names)
    words = words.assign(at=place.reindex(words["source"]).to_numpy(np.int64)).sort_values(["word", "at", "p"], kind="stable")
    at, word, p, bits = (words[c].to_numpy(np.int64) for c in ("at", "word", "p", "bits"))
    number = np.bitwise_count(bits.view(np.uint64)).astype(np.int64)
    of_word, start = np.unique(word, return_index=True)
    end = np.append(start[1:], len(word))
    same = len(np.unique(tile)) < 2
    first, second = np.arange(len(names)), np.arange(len(names)) if same else np.flatnonzero(tile == tile[-1])
    out = []
    for g in first[: len(first) if same else int((tile == tile[0]).sum())]:
        mine = np.flatnonzero(at == g)
        span = np.searchsorted(of_word, word[mine])
        n = end[span] - start[span]
        left = np.repeat(mine, n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[span], n)
        here = (at[right] > g) if same else (tile[at[right]] == tile[-1])
        left, right = left[here], right[here]
        joint = np.bitwise_count((bits[left] & bits[right]).view(np.uint64)).astype(np.int64)
        some = joint > 0
        left, right, joint = left[some], right[some], joint[some]
        total = np.zeros(len(names), dtype=np.int64)
        c, d, c0, d0 = p[left], p[right], zero[g], zero[at[right]]
        np.add.at(total, at[right], joint * (divergence(c, d) - divergence(c, d0) - divergence(c0, d) + divergence(c0, d0)))
        # the groups' own levels against terms that the other lacks: each level's complement
        np.add.at(total, at, number * (divergence(c0, p) - divergence(c0, zero[at])))
        other = second[second > g] if same else second
        levels, count = np.unique(p[mine], return_inverse=True)
        size = np.bincount(count, weights=number[mine], minlength=len(levels)).astype(np.int64)
        none = divergence(zero[g], zero[other])
        own = (size[:, None] * (divergence(levels[:, None], zero[other][None, :]) - none)).sum(axis=0)
        out.append(pd.DataFrame({"a": names[g], "b": names[other], "value": total[other] + own + terms * none}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "value": []})


def pair_values(groups: DataFrame, terms: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of a language's sources."""
    chunk = F.floor(F.col("id") / CHUNK).cast("long")
    chunks = terms.groupBy("lang", chunk.alias("chunk")).agg(F.count(F.lit(1)).alias("terms"))
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))
    marks = groups.join(chunks, "lang", "left").select("lang", "source", F.coalesce("chunk", F.lit(0)).alias("chunk"), F.coalesce("terms", F.lit(0)).alias("word"), F.col("zero_p").alias("p"), F.lit(0).cast("long").alias("bits"))
    words = bitmaps(counts).select("lang", "source", F.shiftright("word", 6).alias("chunk"), "word", "p", "bits")
    rows = marks.union(words).join(F.broadcast(tiles) if tiles.limit(10_001).count() <= 10_000 else tiles, "lang")
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("lang", "chunk", F.least("tile", "other").alias("t0"), F.greatest("tile", "other").alias("t1"), "source", "tile", "word", "p", "bits")

    def work(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        both = key[2] == key[3] or part["tile"].nunique() == 2  # a tile may be empty
        out = tile_sums(part) if both else pd.DataFrame({"a": [], "b": [], "value": []})
        return out.assign(lang=key[0])[["lang", "a", "b", "value"]]

    sums = rows.groupBy("lang", "chunk", "t0", "t1").applyInPandas(work, "lang string, a string, b string, value long")
    sums = written(sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))


def term_values(terms: DataFrame, counts: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a group uses more than its language."""
    q = terms.join(langs.select("lang", "v", "total"), "lang").select("lang", "id", probability("n", "total", "v").alias("q"))
    rows = counts.join(q, ["lang", "id"]).where("p > q")
    return rows.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    with scope(docs.sparkSession):
        groups, terms, counts, langs = counted(docs)
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
        pairs = ranked(pair_values(groups, terms, counts)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
        best = ranked(term_values(terms, counts, langs)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
        return written(pairs.union(best), "audit", result=True)


def op12_bitmap_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP12_SQL = """
WITH docs AS (SELECT row_number() OVER () AS uid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT uid, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT uid) >= 10),
langs AS (SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang),
own AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
totals AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS total FROM own GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
p AS (
    SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
           1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
           1 + (1000000000::HUGEINT * (k.n + 2)) // (l.total + 2 * l.v) AS q
    FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang
    LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
    LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
pairs AS (
    SELECT g.lang, g.source, h.source AS item, coalesce(s.value, 0) AS value
    FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
               FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3) s
      ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
parts AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
