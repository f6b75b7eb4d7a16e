"""Byte-level BPE encoding and decoding with a lexicon of frequent words.

The corpus' most frequent words, as the vocabulary's pattern splits them, are compiled into
a minimal acyclic transducer: words share prefixes and suffixes, every arc carries how many smaller
words it skips, and the sum along a word's path is its number, which leads to its ids. Tasks map the
compiled file into memory and walk all of a batch's distinct words through it at once, byte by byte.
A word that is not in the lexicon is split by the vocabulary's pattern and merged exactly, lowest rank
first. Ids equal the tokenizers library's; decoding joins the ids' bytes.

Counting is a map-side count and one shuffle of (run, count); only the most frequent runs, bounded by
their number, pass through the driver, and the compiled lexicon is broadcast.

Defined results: a null text counts as empty (no ids); repeated rows and null or repeated doc_ids are
kept row by row; other columns are ignored; an empty table gives no rows and an empty lexicon.
"""

from __future__ import annotations

import functools
import heapq
import json
import mmap
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import leading, table, written

#: Frequent runs that the lexicon is made of, and the most bytes of one.
RUNS, RUN_BYTES = 32_768, 24

#: White space that isn't a single space or line end inside a plain text.
IRREGULAR = ("  ", " \n", "\n ", "\n\n", "\t", "\r")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary file: exact splitting, merging and decoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        ids = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.first = [ids[letters[b]] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.first_ids = np.array(self.first, dtype=np.int64)
        codes = np.array([(a << 20) | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(codes)
        self.pair_codes = codes[order]
        self.pair_ranks, self.pair_ids = np.array([*self.merges.values()], dtype=np.int64)[order].T
        self.bytes = [b""] * (1 + max([*ids.values(), *self.added.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.added.items():
            self.bytes[i] = token.encode()
        self.pattern = regex.compile(vocab.public_tokenizers.PATTERN)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.splitter = vocab.library(path).pre_tokenizer

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word of any length: the pair of lowest rank is joined first, the leftmost of equals."""
        ids, merges = [self.first[b] for b in word], self.merges
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merges[a, b][1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in merges:
                    heapq.heappush(heap, (merges[p][0], x, *p))
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids, as bytes, of many short words: all are merged at once, one pair of each word in a round."""
        none = np.int64(1) << 31
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ids = self.first_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_ids = [], []
        while len(ids):
            code = (ids[:-1] << 20) | ids[1:]
            at = np.minimum(np.searchsorted(self.pair_codes, code), len(self.pair_codes) - 1)
            rank = np.append(np.where((self.pair_codes[at] == code) & (word[1:] == word[:-1]), self.pair_ranks[at], none), none)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat((rank << 31) | np.arange(len(ids)), starts)
            merging = (best >> 31) < none
            spot = best[merging] & (none - 1)
            ids[spot] = self.pair_ids[at[spot]]
            stay = np.repeat(merging, np.diff(np.append(starts, len(ids))))
            done_word.append(word[~stay])
            done_ids.append(ids[~stay])
            stay[spot + 1] = False
            ids, word = ids[stay], word[stay]
        if not done_word:
            return [b""] * len(words)
        word, ids = np.concatenate(done_word), np.concatenate(done_ids)
        block = vocab.as_bytes(ids[np.argsort(word, kind="stable")])
        ends = (4 * np.cumsum(np.bincount(word, minlength=len(words)))).tolist()
        return [block[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def split(self, text: str) -> list[str]:
        """The words of a text, by the vocabulary's pattern."""
        if vocab.PLAIN.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)] if text else []

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def runs(text: str) -> list[str] | None:
    """Runs between spaces, each with the space before it, and line ends; None where white space is irregular.

    No word of the pattern spans two runs, so runs can be split, counted and encoded one by one.
    """
    if text[:1] in (" ", "\n", "") or text[-1] in " \n" or any(x in text for x in IRREGULAR) or not vocab.PLAIN.fullmatch(text):
        return None
    out: list[str] = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        head, *rest = line.split(" ")
        out.append(head)
        out += [f" {x}" for x in rest]
    return out


def frequent_runs(docs: DataFrame, most: int = RUNS, longest: int = RUN_BYTES) -> DataFrame:
    """(run, n): the most frequent runs between spaces or line ends over all whole texts; a run must occur twice; ties go to the smaller run."""
    found = docs.select(F.explode(F.split(F.col("text").cast("string"), "[ \n]")).alias("run"))
    found = found.where(F.octet_length("run").between(1, longest)).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    found = leading(written(found.where("n > 1"), "runs"), "n", most)
    return found.orderBy(F.desc("n"), "run").limit(most)


def compiled(frequent: list[str], path: str) -> bytes:
    """The transducer of the words in frequent runs, each with a space before it, as one block of bytes.

    Words come in order, so a state is final in form once the next word leaves it; a state equal to an
    earlier one (same end mark, same arcs) is replaced by it, which shares suffixes.
    """
    book = vocabulary(path)
    known = sorted({w.encode() for run in frequent if not book.specials.search(run) for w in book.split(f" {run}")})
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[tuple] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(final)
            final.append(node[0])
            arcs.append(key[1])
        return register[key]

    path_nodes: list[list] = [[False, []]]  # open states along the last word: end mark, arcs
    last = b""
    for word in known:
        same = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        while len(path_nodes) > same + 1:
            node = path_nodes.pop()
            path_nodes[-1][1].append((last[len(path_nodes) - 1], settle(node)))
        path_nodes += [[False, []] for _ in word[same:]]
        path_nodes[-1][0] = True
        last = word
    while len(path_nodes) > 1:
        node = path_nodes.pop()
        path_nodes[-1][1].append((last[len(path_nodes) - 1], settle(node)))
    root = settle(path_nodes[0])

    below = [0] * len(final)  # words that can be read from a state; arcs lead to states with smaller numbers
    keys, targets, skips = [], [], []
    for state, (end, out) in enumerate(zip(final, arcs, strict=True)):
        n = int(end)
        for byte, target in out:
            keys.append(state * 256 + byte)
            targets.append(target)
            skips.append(n)
            n += below[target]
        below[state] = n
    ids = book.merge_all(known)
    ends = np.cumsum([0, *map(len, ids)], dtype="<u4")
    parts = [np.array(x, dtype="<u4").tobytes() for x in (keys, targets, skips, final, ends)] + [b"".join(ids)]
    return np.array([root, *map(len, parts)], dtype="<u4").tobytes() + b"".join(parts)


class Lexicon:
    """A compiled transducer, mapped from a file without a name."""

    def __init__(self, block: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            self.map = mmap.mmap(f.fileno(), len(block), access=mmap.ACCESS_READ)
        self.root, *sizes = np.frombuffer(self.map, "<u4", 7).tolist()
        at, parts = 28, []
        for n in sizes:
            parts.append((at, n))
            at += n
        self.keys, self.targets, self.skips, self.final, self.ends = (np.frombuffer(self.map, "<u4", n // 4, a) for a, n in parts[:5])
        self.ids_at = parts[5][0]

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word, None for those it doesn't hold."""
        if not len(self.keys) or not words:
            return [None] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        start = np.cumsum(sizes) - sizes
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        state, number = np.full(len(words), self.root, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        live = np.flatnonzero((sizes > 0) & (sizes <= 255))
        held = np.zeros(len(words), dtype=bool)
        step = 0
        while len(live):
            key = state[live] * 256 + letters[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key.astype("<u4")), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state[live] = self.targets[arc]
            number[live] += self.skips[arc]
            step += 1
            over = sizes[live] == step
            held[live[over]] = self.final[state[live[over]]] == 1
            live = live[~over]
        a, b = self.ends[np.where(held, number, 0)].tolist(), self.ends[np.where(held, number + 1, 0)].tolist()
        return [self.map[self.ids_at + x : self.ids_at + y] if h else None for h, x, y in zip(held.tolist(), a, b, strict=True)]


@functools.lru_cache(maxsize=2)
def lexicon(block: bytes) -> Lexicon:
    return Lexicon(block)


class Encoder:
    """Encodes texts through the lexicon; keeps a bounded memo of what it has looked up or merged."""

    def __init__(self, path: str, block: bytes):
        self.book, self.lexicon, self.memo = vocabulary(path), lexicon(block), {}

    def learn(self, new: list[str]) -> None:
        """Adds runs, and the words in them, to the memo: from the lexicon, else by merging."""
        memo, split = self.memo, [self.book.split(run) for run in new]
        words = [w for w in dict.fromkeys(w for found in split for w in found) if w not in memo]
        raw = [w.encode() for w in words]
        ids = self.lexicon.find(raw)
        unseen = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(unseen, self.book.merge_all([raw[i] if len(raw[i]) <= 64 else b"" for i in unseen]), strict=True):
            ids[i] = x if len(raw[i]) <= 64 else vocab.as_bytes(self.book.merge(raw[i]))
        memo.update(zip(words, ids, strict=True))
        memo.update((run, b"".join([memo[w] for w in found])) for run, found in zip(new, split, strict=True))

    def parts(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without special tokens."""
        if len(self.memo) > vocab.MEMO:
            self.memo.clear()
        memo, split = self.memo, [runs(t) for t in texts]
        split = [self.book.split(t) if found is None else found for t, found in zip(texts, split, strict=True)]
        self.learn([w for w in {w for found in split for w in found} if w not in memo])
        out = [b"".join([memo[w] for w in found]) for found in split]
        for w in {w for found in split for w in found if len(w) > 64}:
            memo.pop(w, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers; a special token's string becomes its id."""
        book, flat = self.book, []
        counts = []
        for t in texts:
            cut, at = [], 0
            for m in book.specials.finditer(t):
                cut.append((t[at : m.start()], m[0]))
                at = m.end()
            cut.append((t[at:], None))
            flat += cut
            counts.append(len(cut))
        ids = iter(self.parts([t for t, _ in flat]))
        marks = iter([b"" if m is None else vocab.as_bytes([book.added[m]]) for _, m in flat])
        return [b"".join([next(ids) + next(marks) for _ in range(n)]) for n in counts]


def slices(texts: list[str], most: int = 2_000_000) -> Iterator[list[str]]:
    """Texts in turn, about most characters at a time."""
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t)
        if chars > most:
            yield held
            held, chars = [], 0
    if held:
        yield held


def encode(docs: DataFrame, path: str = vocab.BYTE_BPE, most: int = RUNS, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): every whole text's ids, as little-endian unsigned 32-bit integers; decoded: and the text they stand for."""
    spark = docs.sparkSession
    block = spark.sparkContext.broadcast(compiled([r["run"] for r in frequent_runs(docs, most).collect()], path))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, block.value)
        for batch in batches:
            at = 0
            for some in slices([t or "" for t in batch["text"]]):
                out = pd.DataFrame({"doc_id": batch["doc_id"].iloc[at : at + len(some)].to_numpy(), "ids": encoder.encode(some)})
                at += len(some)
                yield out.assign(text=[encoder.book.decode(x).decode("utf-8", "replace") for x in out["ids"]]) if decoded else out

    schema = "doc_id string, ids binary" + ", text string" * decoded
    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInPandas(work, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


def decode(encoded: DataFrame, path: str = vocab.BYTE_BPE, to: str = "text") -> DataFrame:
    """encoded with one more column, the text that its ids stand for."""

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        book = vocabulary(path)
        return ids.map(lambda x: book.decode(bytes(x)).decode("utf-8", "replace"))

    return encoded.withColumn(to, text("ids"))


def op6_lexicon_bpe(spark, sf_dir):
    out = encode(table(spark, sf_dir, "documents"), decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
