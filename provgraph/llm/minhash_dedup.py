"""Near-duplicate groups by BagMinHash: weighted MinHash of five-word shingles, banded and verified.

A shingle that occurs w times in a text has weight w. Each shingle carries a Poisson process over
(time, weight): on the shells (0, 1], (1, 2], (2, 4], (4, 8], ... of the weight axis independent
processes of the shell's width as rate, their points with a component and a whole-numbered weight
drawn from hashes. A point counts for a text if its weight is at most the shingle's there; a
component's value is the first such point. Two texts agree in a component with exactly their weighted
Jaccard similarity, and a text costs about one hash for each shingle and m log m further points.

Texts with equal shingle multisets are one node. Nodes that share a band are candidates; a link is a
pair whose multiset overlap, counted exactly, is at least the threshold; classes are connected
components. Inside a bucket every node is first compared with one of its nodes; then only nodes still
in different components are compared: all of them in small buckets, neighbours in a random order in
large ones. What large buckets leave unconnected is joined exactly by rare shingles: two multisets
this similar share one of each one's few rarest elements (prefix filtering), so that texts which only
share a template never meet. No candidate is dropped, and pairs already connected are never made.

Defined results: a null or wordless text has no shingles and is a class of its own; a text of one to
four words is one shingle; repeated rows and copies fall into one class, the smallest doc_id (nulls
last) stays; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .common import arrow_rows, components, fresh, leading, own_columns, scope, sized, table, written

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 5
#: Nodes up to which all pairs of a bucket's components are compared at once.
SMALL = 16
#: Nodes of a large bucket that are put in order together.
STRETCH = 256
#: Nodes of an element that meet in one task.
DEALT = 4096
#: Rounds of comparisons of neighbours before all pairs, elements of a node that are known to each of its rows.
FOLDS, LEADERS = 2, 16
#: Multisets up to which their sizes and parities are broadcast, some ten megabytes.
SMALL_BAGS = 50_000
#: Characters handled together in a task, words that a task remembers.
SLICE, MEMO = 500_000, 200_000
#: Nodes that element frequencies are counted on, elements whose frequency is known: they set an order only.
SAMPLE, COMMON = 2000, 100_000
#: Bits of a multiset's parity, a multiple of 64.
PARITY = 1024

WORD = re.compile(r"\w+")
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def minus_log(u: np.ndarray) -> np.ndarray:
    """-ln(u) by sums and products alone, so that every machine gets the same bits."""
    m, e = np.frexp(u)
    s = (m - 0.7071067811865476) / (m + 0.7071067811865476)
    q = s * s
    return -(2 * s * (1 + q * (1 / 3 + q * (1 / 5 + q * (1 / 7 + q / 9)))) + (e - 0.5) * 0.6931471805599453)


class Shingler:
    def __init__(self):
        self.memo: dict[str, int] = {}

    def bags(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, shingle, weight) of all texts, by text and shingle."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo, found = self.memo, [WORD.findall((t or "").lower()) for t in texts]
        for w in {w for words in found for w in words if w not in memo}:
            memo[w] = xxhash.xxh3_64_intdigest(w)
        n = np.array([len(x) for x in found], dtype=np.int64)
        words = np.fromiter((memo[w] for x in found for w in x), dtype=U, count=int(n.sum()))
        text = np.repeat(np.arange(len(n)), n)
        left = np.repeat(np.cumsum(n), n) - np.arange(len(words))  # words from here to the text's end
        h = np.zeros(len(words), dtype=U)
        for k in range(SHINGLE):
            nxt = np.append(words[k:], np.zeros(min(k, len(words)), dtype=U))[: len(words)]
            h = mix(h * U(3) + np.where(left > k, nxt, U(0)) + U(k + 1))
        keep = (left >= SHINGLE) | ((n[text] < SHINGLE) & (left == n[text]))
        text, h = text[keep], h[keep]
        order = np.lexsort((h, text))
        text, h = text[order], h[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else order
        return text[first], h[first], np.diff(np.append(first, len(h)))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n_texts: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(n_texts, m) first points; inf for texts without shingles."""
    shells = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    row = np.repeat(np.arange(len(text)), shells)
    shell = np.arange(len(row)) - np.repeat(np.cumsum(shells) - shells, shells)
    low = np.where(shell > 0, 1 << np.maximum(shell - 1, 0), 0)
    width = np.where(shell > 0, low, 1)
    owner, top = text[row], weight[row]
    seed = mix(shingle[row] ^ mix(shell.astype(U) + U(0x9E3779B97F4A7C15)))
    total = np.bincount(text, weights=weight, minlength=n_texts)
    out = np.full(n_texts * m, np.inf)
    horizon = m * np.log(m) / np.maximum(total, 1)

    def draw(at, i):
        r = mix(seed[at] + (i * U(0x9E3779B97F4A7C15)))
        return minus_log(((r >> U(11)).astype(float) + 0.5) / 2.0**53) / width[at]

    left = np.arange(len(row))
    count, time = np.ones(len(row), dtype=U), None
    time = draw(left, count)
    while len(left):
        due = np.flatnonzero(time <= horizon[owner[left]])
        while len(due):
            at = left[due]
            r = mix(mix(seed[at] ^ U(0xD6E8FEB86659FD93)) + count[due])
            fits = low[at] + ((r >> U(32)).astype(np.int64) * width[at] >> 32) < top[at]
            np.minimum.at(out, (owner[at] * m + ((r & U(0xFFFFFFFF)) % U(m)).astype(np.int64))[fits], time[due][fits])
            count[due] += U(1)
            time[due] += draw(at, count[due])
            due = due[time[due] <= horizon[owner[at]]]
        # a text is done when each component has a point before the horizon
        wanting = np.isinf(out.reshape(n_texts, m)).any(axis=1) & (total > 0)
        horizon[wanting] += 0.7 * m / total[wanting]
        stay = wanting[owner[left]]
        left, count, time = left[stay], count[stay], time[stay]
    return out.reshape(n_texts, m)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(n_texts, BANDS) signed hashes of each band's values."""
    values = signature.view(U).reshape(len(signature), BANDS, ROWS)
    h = np.zeros(values.shape[:2], dtype=U)
    for k in range(ROWS):
        h = mix(h * U(3) + values[:, :, k])
    return h.view(np.int64)


def slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars > SLICE:
            yield at, i + 1
            at, chars = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def sign(rows: DataFrame) -> DataFrame:
    """rows (uid, doc_id, tk, text) to (uid, doc_id, tk, bag, n, bands); bag: a digest of the multiset, null without shingles."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            texts, bags, sizes, bands = list(batch["text"]), [], [], []
            for a, b in slices(texts):
                text, shingle, weight = shingler.bags(texts[a:b])
                n = np.bincount(text, weights=weight, minlength=b - a).astype(np.int64)
                sums = [np.zeros(b - a, dtype=U) for _ in range(2)]
                for k in range(2):
                    np.add.at(sums[k], text, mix(mix(shingle + U(k)) + weight.astype(U)))
                pair = np.stack(sums, axis=1)
                keys = band_keys(signatures(text, shingle, weight, b - a))
                bags += [x.tobytes() if some else None for x, some in zip(pair, n, strict=True)]
                bands += [x if some else None for x, some in zip(keys, n, strict=True)]
                sizes += n.tolist()
            yield pd.DataFrame({"uid": batch["uid"], "doc_id": batch["doc_id"], "tk": batch["tk"], "bag": bags, "n": sizes, "bands": bands})

    return rows.mapInPandas(work, "uid long, doc_id string, tk binary, bag binary, n long, bands array<long>")


def multiset_elements(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash for every occurrence of every shingle."""
    nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    return mix(np.repeat(h, w) + nth.astype(U))


def parity(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """PARITY bits, each whether an odd number of elements falls on it: two sets differ in as many elements at least as bits."""
    odd = np.bincount((multiset_elements(h, w) % U(PARITY)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def may_reach(threshold: float, n: str, m: str, x: str, y: str) -> Column:
    """Whether sizes and parities allow the similarity: the sets may differ in (n + m)(1 - t) / (1 + t) elements at most."""
    bits = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(1, PARITY // 64)), F.bit_count(F.get(x, F.lit(0)).bitwiseXOR(F.get(y, F.lit(0)))))
    return (F.least(n, m) >= threshold * F.greatest(n, m)) & (bits <= (F.col(n) + F.col(m)) * ((1 - threshold) / (1 + threshold)) + 1e-9)


def shingle_table(texts: DataFrame) -> DataFrame:
    """(node, tk, text) to (node, n, shingles, weights, parity): sorted 64-bit hashes, 32-bit weights."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            texts, out = list(batch["text"]), []
            for a, b in slices(texts):
                text, shingle, weight = shingler.bags(texts[a:b])
                cut = np.searchsorted(text, np.arange(b - a + 1))
                out += [(int(weight[x:y].sum()), shingle[x:y].tobytes(), weight[x:y].astype("<u4").tobytes(), parity(shingle[x:y], weight[x:y])) for x, y in zip(cut, cut[1:], strict=False)]
            yield pd.DataFrame({"node": batch["node"]}).join(pd.DataFrame(out, columns=["n", "shingles", "weights", "parity"]))

    return texts.mapInPandas(work, "node long, n long, shingles binary, weights binary, parity array<long>")


@F.pandas_udf(DoubleType())
def overlap(sa: pd.Series, wa: pd.Series, sb: pd.Series, wb: pd.Series) -> pd.Series:
    """Weighted Jaccard similarity of two multisets."""
    out = []
    for a, x, b, y in zip(sa, wa, sb, wb, strict=True):
        a, b = np.frombuffer(a, dtype=U), np.frombuffer(b, dtype=U)
        x, y = np.frombuffer(x, dtype="<u4").astype(np.int64), np.frombuffer(y, dtype="<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        both = int(np.minimum(x, y[at])[b[at] == a].sum())
        out.append(both / (int(x.sum()) + int(y.sum()) - both))
    return pd.Series(out, dtype=float)


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among distinct pairs of nodes; sizes and parities are compared before any multiset is moved."""
    size = sized(bags.select("node", "n", "parity"), SMALL_BAGS)
    near = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    near = near.join(size.withColumnsRenamed({"node": "a", "n": "na", "parity": "pa"}), "a").join(size.withColumnsRenamed({"node": "b", "n": "nb", "parity": "pb"}), "b")
    near = near.where(may_reach(threshold, "na", "nb", "pa", "pb")).select("a", "b")
    near = near.join(bags.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("weights").alias("wa")), "a")
    near = near.join(bags.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("weights").alias("wb")), "b")
    with arrow_rows(pairs.sparkSession, 200):
        return written(near.withColumn("s", overlap("sa", "wa", "sb", "wb")).where(F.col("s") >= threshold - 1e-12).select("a", "b"), "verified")


def ranked(shingles: bytes, weights: bytes, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A multiset's elements (a shingle's every occurrence is one), rarest first; what isn't in common is rarest."""
    e = multiset_elements(np.frombuffer(shingles, dtype=U), np.frombuffer(weights, dtype="<u4").astype(np.int64)).view(np.int64)
    if not len(common):
        return np.sort(e)
    at = np.minimum(np.searchsorted(common, e), len(common) - 1)
    return e[np.lexsort((e, np.where(common[at] == e, count[at], 0)))]


def element_rows(bags: DataFrame, common: np.ndarray, count: np.ndarray, share: float) -> DataFrame:
    """bags (node, n, shingles, weights) to (node, n, element, pos), for each the rarest n - ceil(share n) + 1 in order."""
    table_ = bags.sparkSession.sparkContext.broadcast((common, count))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [ranked(s, w, *table_.value)[: int(n) - int(np.ceil(n * share - 1e-9)) + 1] for s, w, n in zip(batch["shingles"], batch["weights"], batch["n"], strict=True)]
            size = np.array([len(x) for x in parts], dtype=np.int64)
            out = batch[["node", "n"]].loc[batch.index.repeat(size)].reset_index(drop=True)
            pos = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
            yield out.assign(element=np.concatenate(parts) if parts else [], pos=pos.astype(np.int32))

    return bags.select("node", "n", "shingles", "weights").mapInPandas(work, "node long, n long, element long, pos int")


def rare_elements(nodes: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """(node, n, element, pos): each node's rarest elements, by prefix filtering.

    Of n elements the rarest n - ceil(threshold n) + 1 are enough: were none of them shared, fewer than
    threshold n would be. Any order of elements common to all nodes gives every pair; the one used
    counts elements over about SAMPLE nodes and knows the COMMON most frequent.
    """
    own = bags.join(nodes.select("node"), "node")
    share = min(1.0, SAMPLE / max(1, nodes.count()))
    drawn = own.where(F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < F.lit(share * 1_000_003))
    none = np.zeros(0, dtype=np.int64)
    with arrow_rows(nodes.sparkSession, 500):
        seen = written(element_rows(drawn, none, none, 0.0).groupBy("element").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "seen")
        top = leading(seen, "f", COMMON).orderBy(F.desc("f"), "element").limit(COMMON).collect()
        top.sort(key=lambda r: r["element"])
        common, count = (np.array([r[c] for r in top], dtype=np.int64) for c in ("element", "f"))
        return written(element_rows(own, common, count, threshold), "prefixes")


def still_mixed(first: DataFrame, roots: DataFrame) -> DataFrame:
    """first with each node's root, only elements whose nodes aren't in one component yet."""
    at = written(first.join(sized(roots), "node", "left").withColumn("root", F.coalesce("root", "node")), "at")
    mixed = at.groupBy("element").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("element")
    return written(at.join(sized(written(mixed, "mixed")), "element", "left_semi"), "mixed-prefixes")


def neighbours(rows: DataFrame, key: list[str], size: str, turn: int) -> DataFrame:
    """Pairs (a, b) of different roots that stand next to each other in a random order of a key's nodes, cut into stretches."""
    stretch = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col(size) / STRETCH).cast("long"))
    order = Window.partitionBy(*key, stretch).orderBy(F.xxhash64("node", key[0], F.lit(turn)))
    near = rows.withColumn("b", F.lag("node").over(order)).withColumn("other", F.lag("root").over(order))
    return near.where("b is not null and root <> other").select(F.col("node").alias("a"), "b")


def rare_pairs(mixed: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """mixed (node, n, element, pos, root) to pairs (a, b) of different roots that share a rare element.

    A pair is formed where its first shared element lets it reach the threshold: behind places i and j
    at most 1 + min(n - i, m - j) - 1 elements are shared. Each row also knows its node's first LEADERS
    elements that several components have; where two nodes share an earlier one of these, the pair is
    formed there and not again. A frequent element's nodes are dealt into salts of about DEALT nodes, the
    other side going to each, so that no task forms all its pairs.
    """
    lead = mixed.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("pos", "element"))), 1, LEADERS).alias("lead"))
    lead = lead.join(bags.select("node", "parity"), "node")
    size = written(mixed.groupBy("element").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > DEALT), "hot")
    rows = mixed.join(written(lead, "lead"), "node").join(sized(size), "element", "left")
    salts = F.coalesce(F.ceil(F.col("size") / DEALT), F.lit(1)).cast("int")
    left = rows.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int")).drop("size")
    right = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    right = right.select("element", "salt", *(F.col(x).alias(y) for x, y in (("node", "b"), ("root", "other"), ("n", "m"), ("pos", "j"), ("parity", "q"), ("lead", "lead2"))))
    reach = 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("j")) - 1 >= (F.col("n") + F.col("m")) * (threshold / (1 + threshold)) - 1e-9
    before = lambda xs, at: F.transform(F.filter(xs, lambda x: x["pos"] < at), lambda x: x["element"])
    again = F.arrays_overlap(before(F.col("lead"), F.col("pos")), before(F.col("lead2"), F.col("j")))
    near = (F.col("root") < F.col("other")) & reach & may_reach(threshold, "n", "m", "parity", "q") & ~again
    return left.join(right, ["element", "salt"]).where(near).select(F.col("node").alias("a"), "b")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, uid: str | None = None) -> DataFrame:
    """One row per input row: uid, doc_id, class_id (the doc_id that stays), class_size, kept."""
    with scope(docs.sparkSession):
        rows, groups = class_rows(docs, threshold, uid)
    out = rows.join(groups, "root", "left")
    return out.select("uid", "doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("f.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce(F.col("uid") == F.col("f.uid"), F.lit(True)).alias("kept"))


def class_rows(docs: DataFrame, threshold: float, uid: str | None) -> tuple[DataFrame, DataFrame]:
    """(uid, doc_id, root) of every row, root null without shingles, and (root, f, class_size) of every class."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select((F.col(uid) if uid else F.monotonically_increasing_id()).alias("uid"), F.col("doc_id").cast("string").alias("doc_id"), F.unhex(F.md5(text)).alias("tk"), text.alias("text"))
    with arrow_rows(spark, 2000):
        signed = written(sign(keyed), "signed")
    # one node for each distinct multiset, and a text that has it
    nodes = signed.where("bag is not null").groupBy("bag").agg(F.min_by(F.struct("tk", "n", "bands"), "uid").alias("x"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "bag", "x.tk", "x.n", "x.bands"), "nodes")

    spread = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first")).where("size > 1")
    members = written(spread.join(written(buckets, "buckets"), ["band", "key"]), "members")

    wanted = members.select("node").distinct().join(nodes.select("node", "tk"), "node")
    texts = keyed.select("tk", "text").join(wanted, "tk").dropDuplicates(["node"])
    with arrow_rows(spark, 1000):
        bags = written(shingle_table(texts), "bags")

    links = verified(members.select(F.col("node").alias("a"), F.col("first").alias("b")), bags, threshold)
    roots = components(spark, links)

    def add(pairs: DataFrame) -> bool:
        """Verifies pairs; whether they held new links."""
        nonlocal links, roots
        new = verified(pairs, bags, threshold)
        if new.isEmpty():
            return False
        links = written(links.union(new).distinct(), "links")
        roots = components(spark, links)
        return True

    def still_open() -> DataFrame:
        at = members.join(sized(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = at.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band", "key")
        return written(at.join(sized(written(mixed, "mixed")), ["band", "key"], "left_semi"), "open")

    open_ = still_open()
    small = open_.where(F.col("size") <= SMALL)
    across = small.join(small.select("band", "key", F.col("node").alias("b"), F.col("root").alias("other")), ["band", "key"])
    add(neighbours(open_, ["band", "key"], "size", 0).union(across.where("root < other").select(F.col("node").alias("a"), "b")))
    left = written(still_open().where(F.col("size") > SMALL).select("node").distinct(), "left")
    if not left.isEmpty():
        first = rare_elements(left, bags, threshold)
        # rounds of few comparisons join most of what belongs together, before what is left is compared in full
        for turn in range(1, FOLDS + 1):
            mixed = still_mixed(first, roots)
            count = mixed.groupBy("element").agg(F.count(F.lit(1)).alias("size"))
            if not add(neighbours(mixed.join(count, "element"), ["element"], "size", turn)):
                break
        add(rare_pairs(still_mixed(first, roots), bags, threshold))

    rows = signed.select("uid", F.col("doc_id").cast("long").alias("doc_id"), "bag").join(nodes.select("bag", "node"), "bag", "left")
    rows = rows.join(sized(roots), "node", "left").select("uid", "doc_id", F.coalesce("root", "node").alias("root"))
    rows = written(rows, "rows", result=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "uid"))
    return rows, written(rows.where("root is not null").groupBy("root").agg(first.alias("f"), F.count(F.lit(1)).alias("class_size")), "groups", result=True)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns of docs."""
    uid = fresh("uid", docs)
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    kept = near_classes(rows, threshold, uid).where("kept").select(F.col("uid").alias(uid))
    return rows.join(kept, uid, "left_semi").select(*own_columns(docs))


def op5_bagminhash(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents")).drop("uid")
