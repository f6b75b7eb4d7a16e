"""N-gram Jaccard join by T-occurrence search: which texts share so many shingles that they are one class.

A text is a set of five-word shingles. Two sets of n and m shingles link when they share at least
T(n, m) = ceil(threshold (n + m) / (1 + threshold)). All sets have one order of shingles, rare ones first. As
in DivideSkip, a set's lists (a list: the sets that have a shingle) are divided: those of its rarest
shingles, some more than n - ceil(threshold n), are the short ones, the other L the long ones. Sets that
link share at least T - L of their short lists, whatever the order is. A query's short lists are merged by
a heap that skips what can't occur often enough; what occurs often enough is looked up in the long lists
by binary search: a set stands in a shingle's list if the shingle stands in the sorted set. So long lists
are never built, and a shingle that half of all texts share costs nothing but its lookup.

The order is set by how often shingles occur, by a mergeable summary of frequent items over all sets;
what it doesn't hold counts as rare. Texts of the same words are one set. The sets of lists of more than
LONG sets are first compared with the few hubs of these lists, the sets that most of them have: their
number grows with the rows, however long a list is, and links most of what belongs together. Then all that is left is searched: lists whose sets are all in one component can't add anything; in the
others, every set queries the sets of larger components, in chunks of CHUNK sets, so that a component of
any size is only read, and no pair of sets of one component is ever formed.

Defined results: a null text and one without words have no shingles and link with nothing; a text of one
to four words is one shingle; copies and repeated rows are one class; without a doc_id a row takes part,
and its class is known by the smallest doc_id that isn't null; other columns are ignored; an empty
table gives no rows. A shingle is known by 64 bits.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType
from pyspark.sql.window import Window

from .common import arrow_rows, components, leading, scope, sized, table, written

SHINGLE = 5
#: Similarity, as a fraction of whole numbers.
PART, OF = 4, 5
#: Shingles that a set shares for each further list that must be met.
STEP = 32
#: Shingles whose frequency is known to the order.
COMMON = 262_144
#: Sets that make a list long for a first look, hubs that they are then compared with, sets of a chunk.
LONG, HUBS, CHUNK = 256, 4, 65_536
#: Bytes of text handled together in a task, texts that a task remembers to have seen; bits of a set's parity.
SLICE, SEEN, PARITY = 250_000, 50_000, 1024

U = np.uint64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
#: A number for each byte, and an odd one whose powers weigh places (fixed by the seed).
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.int64).view(U)
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def normal(text: str | None) -> bytes:
    """The words of a text, small letters A to Z, one blank between."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split())


def least_shared(n: np.ndarray | int, m: np.ndarray | int):
    """T(n, m)"""
    return -((-PART * (n + m)) // (PART + OF))


def short(n: np.ndarray | int):
    """How many of a set's lists are short ones: with one more, sets that link could miss each other."""
    least = -(-PART * n // OF)
    return np.minimum(n, n - least + 1 + least // STEP)


def need(n: np.ndarray | int, m: np.ndarray | int):
    """How many short lists two sets that link share: T - L, the longer rest being L long lists."""
    return np.maximum(1, least_shared(n, m) - np.maximum(n - short(n), m - short(m)))


class Powers:
    """Powers of an odd number, as many as asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.found = base, np.ones(1, dtype=U)

    def __getitem__(self, n: int) -> np.ndarray:
        if len(self.found) < n:
            more = np.full(max(n, 2 * len(self.found)), self.base, dtype=U)
            more[0] = U(1)
            self.found = np.cumprod(more, dtype=U)
        return self.found[:n]


_UP, _DOWN = Powers(_BASE), Powers(_INVERSE)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each normal text's distinct shingles, sorted."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if len(data) <= 1:
        return [np.zeros(0, dtype=U) for _ in texts]
    weighed = np.append(U(0), np.cumsum(_BYTES[data] * _UP[len(data)], dtype=U))
    end = np.flatnonzero(data == 32)
    start = np.append(0, end[:-1] + 1)
    some = end > start
    start, end = start[some], end[some]
    words = mix((weighed[end] - weighed[start]) * _DOWN[len(data)][start] + (end - start).astype(U))
    size = np.array([len(t) for t in texts], dtype=np.int64)
    edge = np.append(0, np.cumsum(size + 1))
    cut = np.searchsorted(start, edge)
    left = np.repeat(cut[1:], np.diff(cut)) - np.arange(len(words))  # words from here to the text's end
    h = np.zeros(len(words), dtype=U)
    for k in range(SHINGLE):
        later = np.append(words[k:], np.zeros(min(k, len(words)), dtype=U))[: len(words)]
        h = mix(h * U(3) + np.where(left > k, later, U(0)) + U(k + 1))
    out = []
    for a, b in zip(cut, cut[1:], strict=False):
        out.append(np.unique(h[a : max(a + 1, b - SHINGLE + 1)]) if b > a else np.zeros(0, dtype=U))
    return out


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Frequent:
    """A mergeable summary: every shingle that occurs in more than a COMMON-th of what was added is in it, with a lower bound of its count."""

    def __init__(self):
        self.keys, self.counts, self.fresh, self.n = np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64), [], 0

    def add(self, sets: list[np.ndarray]) -> None:
        self.fresh += sets
        self.n += sum(map(len, sets))
        if self.n > 8 * COMMON:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *self.fresh])
        counts = np.append(self.counts, np.ones(len(keys) - len(self.keys), dtype=np.int64))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else order
        keys, counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts
        if len(keys) > COMMON:
            counts = counts - np.partition(counts, len(counts) - COMMON - 1)[len(counts) - COMMON - 1]
            keys, counts = keys[counts > 0], counts[counts > 0]
        self.keys, self.counts, self.fresh, self.n = keys, counts, [], 0


def parity(h: np.ndarray) -> np.ndarray:
    """PARITY bits, each whether an odd number of shingles falls on it: sets differ in as many shingles at least as bits."""
    odd = np.bincount((h % U(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def first_seen(keys: list[bytes | None], seen: dict[bytes, int]) -> list[int]:
    """Where keys stand that aren't among the seen ones, which they are from now on."""
    new = []
    for i, k in enumerate(keys):
        if k is not None and k not in seen:
            seen[k] = 0
            new.append(i)
    return new


def sets_of(docs: DataFrame) -> DataFrame:
    """docs (uid, doc_id, text) to (uid, doc_id, key, n, shingles, parity), and a row of each task's frequent shingles, whose uid is null and whose parity their counts.

    key is null for a text without words; a text of the same words as one before in its task has no shingles of its own.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frequent, seen = Frequent(), {}
        for batch in batches:
            words = [normal(t) for t in batch["text"]]
            keys = [hashlib.md5(w).digest() if w else None for w in words]
            if len(seen) > SEEN:
                seen.clear()
            new = first_seen(keys, seen)
            found: dict[int, tuple] = {}
            texts = [words[i] for i in new]
            for a, b in slices(texts):
                sets = shingle_sets(texts[a:b])
                frequent.add(sets)
                for i, x in zip(new[a:b], sets, strict=True):
                    seen[keys[i]] = len(x)
                    found[i] = (len(x), x.tobytes(), parity(x))
            out = [found.get(i) or (seen[k] if k is not None else 0, None, None) for i, k in enumerate(keys)]
            yield batch[["uid", "doc_id"]].assign(key=keys).join(pd.DataFrame(out, columns=["n", "shingles", "parity"]))
        frequent.merge()
        several = frequent.counts > 1
        yield pd.DataFrame({"uid": pd.array([None], dtype="Int64"), "doc_id": [None], "key": [None], "n": [0], "shingles": [frequent.keys[several].tobytes()], "parity": [frequent.counts[several]]})

    return docs.mapInPandas(work, "uid long, doc_id string, key binary, n long, shingles binary, parity array<long>")


def common_shingles(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The COMMON shingles with the largest counts in all tasks' summaries, sorted, and their counts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for keys, counts in zip(batch["shingles"], batch["parity"], strict=True):
                yield pd.DataFrame({"shingle": np.frombuffer(keys, dtype=np.int64), "f": counts})

    counts = sets.where("uid is null").select("shingles", "parity").mapInPandas(work, "shingle long, f long").groupBy("shingle").agg(F.sum("f").alias("f"))
    top = leading(counts, "f", COMMON).orderBy(F.desc("f"), "shingle").limit(COMMON).toPandas()
    top = top.assign(shingle=top["shingle"].to_numpy(np.int64).view(U)).sort_values("shingle")
    return top["shingle"].to_numpy(U), top["f"].to_numpy(np.int64)


def postings(nodes: DataFrame, common: np.ndarray, count: np.ndarray) -> DataFrame:
    """nodes (node, shingles) to (token, node): the entries of short lists."""
    known = nodes.sparkSession.sparkContext.broadcast((common, count))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = known.value
        for batch in batches:
            parts = []
            for s in batch["shingles"]:
                h = np.frombuffer(s, dtype=U)
                k = int(short(len(h)))
                if len(keys) and len(h):
                    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                    f = np.where(keys[at] == h, counts[at], 0)
                    rare = h[f == 0]
                    # unknown ones come first, in the order of their hashes
                    h = rare if len(rare) >= k else h[np.lexsort((h, f))]
                parts.append(h[:k])
            size = np.array([len(x) for x in parts], dtype=np.int64)
            yield pd.DataFrame({"token": (np.concatenate(parts) if parts else np.zeros(0, dtype=U)).view(np.int64), "node": batch["node"].to_numpy().repeat(size)})

    return nodes.select("node", "shingles").mapInPandas(work, "token long, node long")


def fitting(n: str, m: str):
    """Whether the sizes allow a link."""
    return (OF * F.col(n) >= PART * F.col(m)) & (OF * F.col(m) >= PART * F.col(n))


@F.pandas_udf(BooleanType())
def linked(sa: pd.Series, sb: pd.Series) -> pd.Series:
    """Whether two sorted sets share enough: the smaller one's shingles are searched in the larger one."""
    out = []
    for a, b in zip(sa, sb, strict=True):
        a, b = np.frombuffer(a, dtype=U), np.frombuffer(b, dtype=U)
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        out.append(int((b[at] == a).sum()) >= least_shared(len(a), len(b)))
    return pd.Series(out, dtype=bool)


def verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) among pairs; sizes and parities are compared before any set is moved."""
    near = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}"))
    near = near.join(side("a"), "a").join(side("b"), "b")
    bits = sum((F.bit_count(F.get("pa", F.lit(i)).bitwiseXOR(F.get("pb", F.lit(i)))) for i in range(1, PARITY // 64)), F.bit_count(F.get("pa", F.lit(0)).bitwiseXOR(F.get("pb", F.lit(0)))))
    # sets that link differ in (n + m) - 2 T shingles at most
    near = near.where(fitting("na", "nb") & ((PART + OF) * bits <= (OF - PART) * (F.col("na") + F.col("nb")))).select("a", "b")
    near = sized(written(near, "near"))
    # where pairs are few, only sets that they name are moved
    shingles = lambda x: nodes.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")).join(near, x)
    with arrow_rows(pairs.sparkSession, 200):
        return written(shingles("a").join(shingles("b"), ["a", "b"]).where(linked("sa", "sb")).select("a", "b"), "links")


def still_open(lists: DataFrame, nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    """lists (token, node) to (token, node, n, root): the entries of lists whose sets aren't in one component."""
    known = nodes.select("node", "n")
    known = known.withColumn("root", F.col("node")) if roots is None else known.join(sized(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = written(lists.join(known, "node"), "rooted")
    mixed = at.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    return written(at.join(sized(written(mixed, "mixed")), "token", "left_semi").select("token", "node", "n", "root"), "open")


def hubs(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """entries (token, node) to (a, b): the sets of long lists, each with those HUBS sets of its lists that are in most long lists."""
    size = written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > LONG), "long")
    rows = written(entries.join(sized(size), "token").select("token", "node").join(nodes.select("node", "n"), "node"), "long-entries")
    degree = written(rows.groupBy("node").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    order = Window.partitionBy("token").orderBy(F.desc("degree"), "b")
    top = rows.select("token", F.col("node").alias("b"), F.col("n").alias("m")).join(degree.withColumnRenamed("node", "b"), "b")
    top = written(top.withColumn("place", F.row_number().over(order)).where(F.col("place") <= HUBS).drop("place"), "hubs")
    pairs = rows.join(sized(top), "token").where((F.col("node") != F.col("b")) & fitting("n", "m"))
    return pairs.select(F.col("node").alias("a"), "b").distinct()


def best(pairs: DataFrame, score: str) -> DataFrame:
    """(a, b): of each a's partners the one with the highest score."""
    return pairs.groupBy("a").agg(F.max_by("b", F.struct(score, "b")).alias("b"))


def t_occurrence(lists: list[list[int]], least: int) -> dict[int, int]:
    """What stands in at least so many of the sorted lists, and in how many: a heap of the lists' heads, skipping as MergeSkip does."""
    heads = [(x[0], i, 0) for i, x in enumerate(lists) if x]
    heapq.heapify(heads)
    found: dict[int, int] = {}
    while len(heads) >= least:
        top, popped = heads[0][0], []
        while heads and heads[0][0] == top:
            popped.append(heapq.heappop(heads))
        if len(popped) >= least:
            found[top] = len(popped)
            onward = top + 1
        else:
            # of what is below the head that would then be on top, nothing occurs often enough
            while heads and len(popped) < least - 1:
                popped.append(heapq.heappop(heads))
            if not heads:
                break
            onward = heads[0][0]
        for _, i, at in popped:
            at = bisect_left(lists[i], onward, at)
            if at < len(lists[i]):
                heapq.heappush(heads, (lists[i][at], i, at))
    return found


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """As t_occurrence: the longest lists are set aside, the others merged with what is then still needed, and what they give is probed in the long ones."""
    lists = sorted(lists, key=len)
    aside = min(3 * least // 4, len(lists) - 1)
    merged, probed = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = {}
    for x, count in t_occurrence(merged, least - aside).items():
        for other in probed:
            at = bisect_left(other, x)
            count += at < len(other) and other[at] == x
        if count >= least:
            found[x] = count
    return found


def searched(entries: DataFrame) -> DataFrame:
    """(a, b, hits): pairs of sets of different components that share enough short lists to be looked up in the long ones."""
    whole = entries.select("node", "root").distinct().groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    rows = written(entries.join(sized(written(whole, "sizes")), "root"), "ranked")
    chunks = max(1, -(-rows.select("node").distinct().count() // CHUNK))
    chunk = F.pmod(F.xxhash64("node"), F.lit(chunks))
    lists = rows.groupBy("token", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("node", "n", "size", "root"))).alias("list"), F.max(F.struct("size", "root")).alias("top"))
    asked = rows.select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("size").alias("own_size"), F.col("root").alias("own_root")).join(lists, "token")
    asked = asked.where(F.struct(F.col("own_size").alias("size"), F.col("own_root").alias("root")) < F.col("top"))
    larger = lambda x: (x["size"] > F.col("own_size")) | ((x["size"] == F.col("own_size")) & (x["root"] > F.col("own_root")))
    fits = lambda x: (OF * x["n"] >= PART * F.col("na")) & (OF * F.col("na") >= PART * x["n"])
    asked = asked.select("a", "chunk", "na", F.transform(F.filter("list", lambda x: larger(x) & fits(x)), lambda x: F.struct(x["node"].alias("node"), x["n"].alias("n"))).alias("list")).where(F.size("list") > 0)

    def merge(key: tuple[int, int, int], lists: list[np.ndarray], sizes: dict[int, int]) -> list[tuple[int, int, int]]:
        a, _, n = key
        enough = {m: int(need(n, m)) for m in set(sizes.values())}
        found = divide_skip([x.tolist() for x in lists], min(enough.values()))
        return [(a, b, k) for b, k in found.items() if k >= enough[sizes[b]]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lists, sizes = None, [], {}

        def batch_of(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["a", "b", "hits"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("a", "chunk", "na")), strict=True))
            column = batch.column("list")
            cut = column.offsets.to_numpy() - column.offsets[0].as_py()
            node, size = (x.to_numpy(zero_copy_only=False) for x in column.flatten().flatten())
            out = []
            for i, here in enumerate(keys):
                if here != key:
                    out += merge(key, lists, sizes) if lists else []
                    key, lists, sizes = here, [], {}
                part = slice(cut[i], cut[i + 1])
                lists.append(node[part])
                sizes.update(zip(node[part].tolist(), size[part].tolist(), strict=True))
            yield batch_of(out)
        if lists:
            yield batch_of(merge(key, lists, sizes))

    with arrow_rows(entries.sparkSession, 256):
        return written(asked.repartition("a", "chunk").sortWithinPartitions("a", "chunk").mapInArrow(work, "a long, b long, hits long"), "candidates")


def overlap_classes(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """uid, doc_id, n_shingles, component_id: one row for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    own = docs.select((F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scope(spark):
        with arrow_rows(spark, 300):
            sets = written(sets_of(own), "sets")
        # a set is known by the first row that has it; other tasks may have made it, too
        made = sets.where("uid is not null and shingles is not null")
        reps = written(made.groupBy("key").agg(F.min("uid").alias("node")), "reps")
        nodes = made.withColumnRenamed("uid", "node")
        with arrow_rows(spark, 500):
            entries = postings(nodes, *common_shingles(sets))
            shared = entries.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("token")
            lists = written(entries.join(sized(written(shared, "shared")), "token", "left_semi"), "entries")
        # what another task made of the same words has the same entries
        again = written(made.select(F.col("uid").alias("node"), "key").join(reps.withColumnRenamed("node", "rep"), "key").where("node <> rep").select("node"), "again")
        lists = written(lists.join(sized(again), "node", "left_anti"), "lists")
        links, roots = None, None

        def add(pairs: DataFrame) -> bool:
            """Verifies pairs; whether they held links."""
            nonlocal links, roots
            found = verified(pairs, nodes)
            if found.isEmpty():
                return False
            links = found if links is None else written(links.union(found), "all-links")
            roots = components(spark, links)
            return True

        add(hubs(lists, nodes))
        pairs = searched(still_open(lists, nodes, roots))
        # most pairs of a class need no look once each set's best partner was looked at
        if add(best(pairs, "hits")):
            at = lambda x: sized(roots).select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
            pairs = pairs.join(at("a"), "a", "left").join(at("b"), "b", "left")
            pairs = pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        add(pairs.select("a", "b"))
        rows = sets.where("uid is not null").select("uid", "doc_id", "key", "n").join(reps, "key", "left")
        rows = rows.withColumn("root", F.col("node")) if roots is None else rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = written(rows.select("uid", F.col("doc_id").cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), "root"), "classed", result=True)
        least = written(rows.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")), "least", result=True)
    out = rows.join(least, "root", "left")
    return out.select("uid", "doc_id", "n_shingles", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def op11_divide_skip(spark, sf_dir):
    return overlap_classes(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("uid")


OP11_SQL = """
WITH RECURSIVE rows AS (
    SELECT row_number() OVER () AS uid, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (
    SELECT uid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM rows),
sized AS (SELECT uid, doc_id, len(g) AS n, unnest(g) AS s FROM grams),
hits AS (
    SELECT a.uid AS a, b.uid AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS i
    FROM sized a JOIN sized b ON a.s = b.s AND a.uid <> b.uid AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM hits WHERE 100 * i >= 80 * (n + m - i)),
reach AS (SELECT uid, uid AS other FROM rows UNION SELECT r.uid, l.b FROM reach r JOIN links l ON r.other = l.a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM grams g JOIN reach r ON r.uid = g.uid JOIN rows o ON o.uid = r.other GROUP BY g.uid, g.doc_id, len(g.g)
"""
