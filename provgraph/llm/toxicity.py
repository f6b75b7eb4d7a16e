"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-case words and their beginnings, as 64-bit hashes, and the class of its
length. Beside a weight, each term has a vector; the inner products of the vectors of a text's terms
are the pairwise interactions that additive weights miss.

Which terms the model holds is decided by counts of labelled texts, made and added up in Spark; the
machine is then fitted on a bounded sample of labelled rows reduced to those terms, and broadcast.
Scoring reads every whole text once.

Bounds: POSITIVES and NEGATIVES labelled rows (in expectation, drawn by a hash of the id), TERMS terms, FREQUENT
of them for their frequency alone.

Defined results: null and empty texts get the score of a text without terms; rows without a label or
an id are scored but not learnt from; repeated rows are each scored; an id with several labels counts
as toxic if one says so; without both labels in the sample the score is the toxic share (0 if none);
other columns are never read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, leading, own_columns, table, written

POSITIVES, NEGATIVES, TERMS = 4000, 8000, 4096
FACTORS, STEPS, RATE, DECAY = 8, 200, 0.05, 5e-4
#: Labelled texts that a term must occur in, and the root of the likelihood ratio from which it counts by itself; the most
#: frequent terms are held whatever the labels say of each alone, for they may matter in a pair.
SUPPORT, SURE, FREQUENT = 4, 3.5, 32
#: The decay of these unsure terms, which have a vector only.
UNSURE = 0.02
BEGINNINGS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3
LENGTHS = 24

WORD = re.compile(r"[^\W_]+")
#: Words that a task remembers.
MEMO = 200_000


def terms(word: str) -> list[int]:
    """Hashes of a word and of its beginnings."""
    found = [xxhash.xxh3_64_intdigest(f"w {word}")]
    return found + [xxhash.xxh3_64_intdigest(f"b {word[:n]}") for n in BEGINNINGS if n <= len(word)]


def words(text: str | None) -> Counter:
    return Counter(WORD.findall((text or "").lower()))


def length_class(counts: Counter) -> int:
    return min(LENGTHS - 1, counts.total().bit_length())


@dataclass
class Machine:
    """terms: sorted hashes; the weights and vectors of LENGTHS length classes follow those of the terms."""

    terms: np.ndarray
    bias: float
    weight: np.ndarray
    vector: np.ndarray

    def known(self) -> dict[int, int]:
        return {int(t): i for i, t in enumerate(self.terms)}

    def scores(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """rows: start of each text's terms, terms, values; each text has at least its length class."""
        return 1 / (1 + np.exp(-np.clip(margin(rows, self.bias, self.weight, self.vector)[0], -30, 30)))


def margin(rows, bias, weight, vector):
    start, term, value = rows
    part = vector[term] * value[:, None]
    total = np.add.reduceat(part, start)
    squares = np.add.reduceat((part * part).sum(1), start)
    return bias + np.add.reduceat(weight[term] * value, start) + 0.5 * ((total * total).sum(1) - squares), total


def features(texts, known: dict[int, int], memo: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, term, value = [], [], []
    for text in texts:
        counts = words(text)
        if len(memo) > MEMO:
            memo.clear()
        seen: Counter = Counter()
        for w, n in counts.items():
            hit = memo.get(w)
            if hit is None:
                hit = memo[w] = tuple(known[t] for t in terms(w) if t in known)
            for t in hit:
                seen[t] += n
        start.append(len(term))
        term += [*seen, len(known) + length_class(counts)]
        value += [*np.log2(1 + np.array([*seen.values()], dtype=float)), 1.0]
    return np.array(start, dtype=np.int64), np.array(term, dtype=np.int64), np.array(value)


def fit(rows, label: np.ndarray, importance: np.ndarray, held: np.ndarray, sure: np.ndarray, seed: int = 7) -> Machine:
    """Logistic loss with decay, by Adam over the whole sample; deterministic. Terms not sure have no weight, only pairs."""
    start, term, value = rows
    size = len(held) + LENGTHS
    rate = float((label * importance).sum() / importance.sum())
    bias = float(np.log(rate / (1 - rate)))
    weight, vector = np.zeros(size), np.random.default_rng(seed).normal(0, 0.02, (size, FACTORS))
    text = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(term))))
    importance = importance / importance.sum()
    params, first, second = [weight, vector], [0.0, 0.0], [0.0, 0.0]
    decay = DECAY, np.where(sure, DECAY, UNSURE)[:, None]
    order = np.argsort(term, kind="stable")
    firsts = np.flatnonzero(np.append(True, np.diff(term[order]) > 0)) if len(order) else order
    present = term[order][firsts]
    for step in range(1, STEPS + 1):
        m, total = margin(rows, bias, weight, vector)
        g = importance * (1 / (1 + np.exp(-np.clip(m, -30, 30))) - label)
        gv = (g[text] * value)[order]
        slopes = [np.zeros_like(weight), np.zeros_like(vector)]
        slopes[0][present] = np.add.reduceat(gv, firsts)
        slopes[1][present] = np.add.reduceat(gv[:, None] * (total[text] - vector[term] * value[:, None])[order], firsts)
        slopes[0][~sure] = 0
        bias -= 0.5 * g.sum()
        for i, p in enumerate(params):
            slope = slopes[i] + decay[i] * p
            first[i] = 0.9 * first[i] + 0.1 * slope
            second[i] = 0.99 * second[i] + 0.01 * slope * slope
            p -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)
    return Machine(held, bias, weight, vector)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float, float]:
    """(text, toxic) of at most POSITIVES and NEGATIVES labelled rows that aren't held out; how many rows each stands for."""
    marked = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {k: min(1.0, most / max(1, n.get(k, 0))) for k, most in ((True, POSITIVES), (False, NEGATIVES))}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = marked.where(draw < F.when(F.col("toxic"), share[True]).otherwise(share[False]))
    # about POSITIVES + NEGATIVES rows of 9 bytes: a broadcast of proven size
    rows = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id", "text"])
    return written(rows.select("text", "toxic"), "sample"), 1 / share[True], 1 / share[False]


def choose_terms(rows: DataFrame, most: int = TERMS) -> DataFrame:
    """(term, sure): signed hashes of the terms whose counts tell the labels apart best, and of the most frequent ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both: Counter = Counter()
        toxic: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch["text"], batch["toxic"], strict=True):
                found = {t for w in words(text) for t in terms(w)}
                both.update(found)
                if y:
                    toxic.update(found)
        keys = np.fromiter(both.keys(), dtype=np.uint64, count=len(both)).view(np.int64)
        yield pd.DataFrame({"term": keys, "n": np.fromiter(both.values(), np.int64, len(both)), "p": [toxic[t] for t in both]})

    n = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("toxic").alias("p"))
    found = rows.mapInPandas(count, "term long, n long, p long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    # one row on the other side
    found = found.where(F.col("n") >= SUPPORT).crossJoin(F.broadcast(n.select(F.col("n").alias("all"), F.col("p").alias("pos"))))
    cell = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * F.col("all") / (row * column))).otherwise(0.0)
    # how far the labels of the texts that have the term are from all labels; texts without it say more of lengths than of it
    told = cell(F.col("p"), F.col("n"), F.col("pos")) + cell(F.col("n") - F.col("p"), F.col("n"), F.col("all") - F.col("pos"))
    found = written(found.select("term", "n", F.sqrt(2 * F.greatest(told, F.lit(0.0))).alias("z")), "terms", result=True)
    often = min(FREQUENT, most // 2)
    best = leading(found.where(F.col("z") >= SURE), "z", most - often).orderBy(F.desc("z"), "term").limit(most - often).select("term", F.lit(True).alias("sure"))
    common = leading(found, "n", often).orderBy(F.desc("n"), "term").limit(often).select("term", F.lit(False).alias("sure"))
    return best.union(common).groupBy("term").agg(F.max("sure").alias("sure"))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    rows, per_positive, per_negative = sample(docs, labels)
    picked = sorted((r["term"] % 2**64, r["sure"]) for r in choose_terms(rows).collect())
    chosen, sure = [t for t, _ in picked], np.array([x for _, x in picked] + [True] * LENGTHS)
    known = {t: i for i, t in enumerate(chosen)}

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            start, term, value = features(batch["text"], known, memo)
            ends = np.append(start[1:], len(term))
            yield pd.DataFrame({"toxic": batch["toxic"].astype(bool), "term": [term[a:b] for a, b in zip(start, ends, strict=True)], "value": [value[a:b] for a, b in zip(start, ends, strict=True)]})

    got = rows.mapInPandas(reduce, "toxic boolean, term array<long>, value array<double>").collect()
    got.sort(key=lambda r: (r["toxic"], r["term"], r["value"]))
    label = np.array([float(r["toxic"]) for r in got])
    held = np.array(chosen, dtype=np.uint64)
    if not len(label) or label.min() == label.max():
        rate = np.clip(label.mean() if len(label) else 0.0, 1e-6, 1 - 1e-6)
        return Machine(held, float(np.log(rate / (1 - rate))), np.zeros(len(held) + LENGTHS), np.zeros((len(held) + LENGTHS, FACTORS)))
    term = np.concatenate([r["term"] for r in got]).astype(np.int64)
    value = np.concatenate([r["value"] for r in got])
    start = np.cumsum([0, *(len(r["term"]) for r in got[:-1])])
    return fit((start, term, value), label, np.where(label > 0, per_positive, per_negative), held, sure)


def scored(docs: DataFrame, machine: Machine, to: str = "score") -> DataFrame:
    """docs with one more column, the score of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known, memo = model.value.known(), {}
        for texts in batches:
            yield pd.Series(model.value.scores(features(texts, known, memo)) if len(texts) else [], dtype=float)

    return docs.withColumn(to, score(F.col("text").cast("string")))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is below the threshold, learnt from the labels of those rows."""
    to = fresh("score", docs)
    return scored(docs, learn(docs, labels), to).where(F.col(to) < threshold).select(*own_columns(docs))


def op3_toxicity_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
