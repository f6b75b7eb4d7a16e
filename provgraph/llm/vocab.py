"""Public tokenizers inside tasks: loaded once in each Python worker, words memoised within a bound."""

from __future__ import annotations

import functools
import json
import re

import numpy as np
import public_tokenizers
import regex

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

#: Characters on which every Unicode version and both regex engines agree: letters, digits, signs, spaces.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ňŊ-ž‐-‧‰-⁞€]*")

#: Entries of a memo before it is emptied.
MEMO = 300_000


@functools.cache
def library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def as_bytes(ids) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    return np.asarray(ids, dtype="<u4").tobytes()


class WordEncoder:
    """Ids of texts under a vocabulary with word ends, as bytes; equal to the library's on every text.

    No token of this vocabulary spans white space. Plain texts are split at it and each distinct run
    is encoded once, those not met before together in one call of the library; a text with any other
    character, or with a special token's string, is handed to the library whole.
    """

    def __init__(self, path: str = WORD_BPE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.tokenizer = library(path)
        self.memo: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def learn(self, runs: list[str]) -> None:
        """Adds runs of plain, lower-case characters, and the words in them, to the memo."""
        memo, split = self.memo, [self.words.findall(x) for x in runs]
        new = [w for w in dict.fromkeys(w for words in split for w in words) if w not in memo]
        if new:
            got = self.tokenizer.encode(" ".join(new), add_special_tokens=False)
            ids, word = as_bytes(got.ids), np.asarray(got.word_ids, dtype=np.int64)
            ends = (4 * np.searchsorted(word, np.arange(len(new) + 1))).tolist()
            memo.update((w, ids[a:b]) for w, a, b in zip(new, ends, ends[1:], strict=False))
        memo.update((x, b"".join([memo[w] for w in words])) for x, words in zip(runs, split, strict=True))

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return self._library(text)
        runs, memo = text.lower().split(), self.memo
        if len(memo) > MEMO:
            memo.clear()
        try:
            return b"".join([memo[x] for x in runs])
        except KeyError:
            self.learn([x for x in dict.fromkeys(runs) if x not in memo])
            return b"".join([memo[x] for x in runs])


@functools.cache
def word_encoder(path: str = WORD_BPE) -> WordEncoder:
    return WordEncoder(path)
