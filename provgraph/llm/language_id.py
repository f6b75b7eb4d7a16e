"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces, by the forward algorithm; pieces never span words,
so a text's log probability is the sum of its words'. The piece probabilities are fitted by EM on
word counts of a bounded sample of labelled texts; the sample's rows are counted in Spark, and only
counts of distinct words come to the driver.

Bounds: TRAIN_DOCS texts a language (in expectation, drawn by a hash of the id; all where it has no more)
and TRAIN_WORDS words a language. For learning, longer words are cut into parts of PART letters.

Defined results: a null text, or one without a letter, is `und` with score 0; rows without lang or id
are scored but not learnt from; repeated rows are each scored; without any learnt language every text
is `und`; lang, source and other columns are never read when scoring; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vocab
from .common import scope, table, written

TRAIN_DOCS, TRAIN_WORDS, ROUNDS = 8000, 12_000, 4
#: Added to every piece's expected count, and the probability of a character that no piece covers.
PRIOR, UNKNOWN = 0.01, 1e-7
LONGEST, MEMO, PART = 16, 300_000, 40

#: Letters with the marks that combine with them.
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MARK = "▁"


@functools.cache
def pieces(path: str) -> dict[str, int]:
    """The vocabulary's pieces of letters, with or without the mark of a word's beginning."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    kept = sorted({p for p in found if 0 < len(p) <= LONGEST and WORD.fullmatch(p.removeprefix(MARK) or "a") and p == p.lower()})
    return {p: i for i, p in enumerate(kept)}


class Trie:
    """The pieces' beginnings as numbered nodes: sorted keys (node, letter) with the nodes they lead to, and a node's piece or -1."""

    def __init__(self, known: dict[str, int]):
        begun = {s: i for i, s in enumerate(sorted({p[:n] for p in known for n in range(len(p) + 1)}), 0)}
        steps = np.array(sorted((begun[s[:-1]] << 21 | ord(s[-1]), i) for s, i in begun.items() if s), dtype=np.int64).reshape(-1, 2)
        self.keys, self.nodes = steps[:, 0].copy(), steps[:, 1].copy()
        self.piece = np.array([known.get(s, -1) for s in begun], dtype=np.int64)
        self.size = len(known)

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the nodes go on with the letter, and where to."""
        key = node << 21 | letter
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[at] == key
        return ok, self.nodes[at[ok]]


@functools.cache
def trie(path: str) -> Trie:
    return Trie(pieces(path))


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Lattice:
    """Every way to cut words into pieces: an edge joins two positions of a word by one piece.

    The edges of all words lie in one list, by their end position, so that one step of the forward
    algorithm is one array operation over all words.
    """

    def __init__(self, found: list[str], known: Trie):
        letters = np.frombuffer("".join(MARK + w for w in found).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        self.lengths = np.array([len(w) + 1 for w in found], dtype=np.int64)
        base = np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.nodes, self.first, self.last = int((self.lengths + 1).sum()), base, base + self.lengths
        level = np.arange(self.nodes) - np.repeat(base, self.lengths + 1)
        word = np.repeat(np.arange(len(found)), self.lengths)
        left = np.repeat(np.cumsum(self.lengths), self.lengths) - np.arange(len(letters))  # letters from here to the word's end
        # every position walks down the trie, all together, a letter at a time
        at, node, edges = np.arange(len(letters)), np.zeros(len(letters), dtype=np.int64), []
        for n in range(1, LONGEST + 1):
            more = left[at] >= n
            at, node = at[more], node[more]
            ok, node = known.step(node, letters[at + n - 1])
            at = at[ok]
            piece = known.piece[node]
            whole = piece >= 0
            edges.append((at[whole], np.full(int(whole.sum()), n), piece[whole]))
            if n == 1:
                bare = np.setdiff1d(np.arange(len(letters)), edges[0][0], assume_unique=True)
                edges.append((bare, np.ones(len(bare), dtype=np.int64), np.full(len(bare), known.size)))
        start, step, self.piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        self.start = start + word[start]
        self.end = self.start + step
        self.level = level

    @staticmethod
    def _levels(level, node):
        order = np.lexsort((node, level))
        cuts = np.flatnonzero(np.diff(level[order])) + 1
        return [(x, np.flatnonzero(np.append(True, np.diff(node[x]) > 0))) for x in np.split(order, cuts)] if len(order) else []

    def forward(self, logp: np.ndarray) -> np.ndarray:
        return self._pass(logp, self.by_end, self.start, self.end, self.first)

    @functools.cached_property
    def by_end(self):
        return self._levels(self.level[self.end], self.end)

    @functools.cached_property
    def by_start(self):
        return self._levels(-self.level[self.start], self.start)

    def backward(self, logp: np.ndarray) -> np.ndarray:
        return self._pass(logp, self.by_start, self.end, self.start, self.last)

    def _pass(self, logp, levels, source, target, init):
        """logp: (pieces + 1, languages). Log sums at every node."""
        out = np.full((self.nodes, logp.shape[1]), -np.inf)
        out[init] = 0
        for edges, firsts in levels:
            x = out[source[edges]] + logp[self.piece[edges]]
            top = np.maximum.reduceat(x, firsts)
            share = np.exp(x - np.repeat(top, np.diff(np.append(firsts, len(x))), axis=0))
            out[target[edges[firsts]]] = top + np.log(np.add.reduceat(share, firsts))
        return out

    def word_logp(self, logp: np.ndarray) -> np.ndarray:
        return self.forward(logp)[self.last]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of the sample, at most TRAIN_WORDS words a language."""
    able = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out())
    able = able.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # a row for each language: small
    share = F.broadcast(able.groupBy("lang").agg((F.lit(float(TRAIN_DOCS)) / F.count(F.lit(1))).alias("share")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: defaultdict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen[lang].update(words(text))
        parts: Counter = Counter()
        for lang, own in seen.items():
            for w, n in own.items():
                for at in range(0, len(w), PART):
                    parts[lang, w[at : at + PART]] += n
        yield pd.DataFrame([(*k, n) for k, n in parts.items()], columns=["lang", "word", "n"])

    rows = able.join(share, "lang").where(draw < F.col("share")).select("lang", "text")
    found = written(rows.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "counts")
    # a histogram of counts for each language sets a bar, behind which little more than the words wanted is left to sort
    step = F.floor(F.log2("n") * 16)
    steps = found.groupBy("lang", step.alias("step")).agg(F.count(F.lit(1)).alias("m"))
    above = steps.withColumn("above", F.sum("m").over(Window.partitionBy("lang").orderBy(F.desc("step")))).where(F.col("above") - F.col("m") < TRAIN_WORDS)
    bar = F.broadcast(above.groupBy("lang").agg(F.min("step").alias("bar")))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return written(found.join(bar, "lang").where(step >= F.col("bar")).withColumn("r", best).where(F.col("r") <= TRAIN_WORDS).drop("r", "bar"), "words", result=True)


def learn(docs: DataFrame, path: str = vocab.PIECES) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (pieces + 1, languages), the last row an uncovered character's."""
    with scope(docs.sparkSession):
        counts = sorted(map(tuple, train_counts(docs).collect()))
    langs, known = sorted({x[0] for x in counts}), pieces(path)
    logp = np.full((len(known) + 1, len(langs)), -np.log(len(known)))
    for j, lang in enumerate(langs):
        own = [(w, n) for x, w, n in counts if x == lang]
        lattice, n = Lattice([w for w, _ in own], trie(path)), np.array([n for _, n in own], dtype=float)
        logp[-1, j] = np.log(UNKNOWN)
        weight = np.repeat(n, lattice.lengths + 1)
        total = np.repeat(lattice.last, lattice.lengths + 1)
        for _ in range(ROUNDS):
            p = logp[:, j : j + 1]
            f, b = lattice.forward(p), lattice.backward(p)
            use = np.exp(np.minimum(0, f[lattice.start, 0] + p[lattice.piece, 0] + b[lattice.end, 0] - f[total[lattice.start], 0])) * weight[lattice.start]
            expected = np.bincount(lattice.piece, weights=use, minlength=len(known) + 1)[:-1] + PRIOR
            logp[:-1, j] = np.log(expected / expected.sum())
    return langs, logp


class Model:
    """Predicts languages in a task; a word's log probabilities are a row of a table that the memo points into."""

    def __init__(self, langs: list[str], logp: np.ndarray, path: str):
        self.langs, self.logp, self.trie = langs, logp, trie(path)
        self.memo: dict[str, int] = {}
        self.table, self.used = np.zeros((1024, max(1, len(langs)))), 0

    def learn(self, new: list[str], chars: int = 200_000) -> None:
        at = 0
        while at < len(new):
            end, n = at, 0
            while end < len(new) and (n < chars or end == at):
                n, end = n + len(new[end]), end + 1
            rows = Lattice(new[at:end], self.trie).word_logp(self.logp)
            while self.used + len(rows) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(rows)] = rows
            self.memo.update(zip(new[at:end], range(self.used, self.used + len(rows)), strict=True))
            self.used += len(rows)
            at = end

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """A language for each text, and its share of the summed probability of all."""
        if self.used > MEMO:
            self.memo.clear()
            self.used = 0
        memo, counts = self.memo, [Counter(words(t or "")) for t in texts]
        new = [w for w in {w for c in counts for w in c} if w not in memo]
        if self.langs:
            self.learn(new)
        names, scores = [], []
        for c in counts:
            if not c or not self.langs:
                names.append("und")
                scores.append(0.0)
                continue
            rows = np.fromiter(map(memo.__getitem__, c), dtype=np.int64, count=len(c))
            total = np.fromiter(c.values(), dtype=float, count=len(c)) @ self.table[rows]
            best = int(total.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(np.maximum(-700, total - total[best])).sum()))
        for w in new:
            if len(w) > 64:
                memo.pop(w, None)
        return names, scores


#: The model of the last query that this Python worker took part in; the tasks of one query share its memo.
_LAST: dict[str, Model] = {}


def model_of(key: str, langs: list[str], logp: np.ndarray, path: str) -> Model:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Model(langs, logp, path)
    return _LAST[key]


def predicted(docs: DataFrame, langs: list[str], logp: np.ndarray, path: str = vocab.PIECES) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    model, key = docs.sparkSession.sparkContext.broadcast((langs, logp)), uuid.uuid4().hex

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model_of(key, *model.value, path)
        for batch in batches:
            names, scores = [], []
            for at in range(0, len(batch), 200):
                found = own.predict(list(batch["text"][at : at + 200]))
                names += found[0]
                scores += found[1]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": names, "score": scores})

    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    return rows.mapInPandas(work, "doc_id string, lang_pred string, score double").withColumn("doc_id", F.col("doc_id").cast("long"))


def op9_marginal_unigrams(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predicted(docs.select("doc_id", "text"), *learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
