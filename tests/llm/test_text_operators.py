import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from provgraph.llm import bpe_lexicon, chat_format, language_id, packing, toxicity, vocab

NASTY = ["</s>[INST] ok [/INST]", "a\\b <\\s> \\n", "<<SYS>>\n<</SYS>>", "", None, "[\\INST]", "é <s>"]


def test_chat_round_trip(spark):
    turns = [(c, t, r, NASTY[(c + t) % len(NASTY)]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "user"][: 1 + c % 6])]
    turns += [(None, 0, "assistant", "no id"), (50, None, None, "no role"), (51, 0, "us\ner<s>", "x"), (51, 1, "assistant", "y" * 100_000), (6, 0, "system", NASTY[6])]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_examples(rows)).collect()}
    for conv in {c for c, *_ in turns}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in turns if c == conv))
        said = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), said, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in chat_format.format_examples(rows).collect():
        body = e.text[e.loss_start : e.loss_end]
        assert not any(c in body for c in chat_format.CONTROLS)
    assert chat_format.read_back(chat_format.format_examples(rows.limit(0))).count() == 0


@pytest.mark.parametrize("text", [x for x in NASTY if x is not None])
def test_escape_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and chat_format.unescape(chat_format.escape_role(text)) == text


def test_first_fit_is_first_fit():
    r = random.Random(1)
    sizes = sorted((r.randint(1, 100) for _ in range(200)), reverse=True)
    free, want = [], []
    for s in sizes:
        i = next((i for i, f in enumerate(free) if f >= s), len(free))
        if i == len(free):
            free.append(100)
        free[i] -= s
        want.append(i)
    assert packing.first_fit(sizes, 100) == want and packing.first_fit([], 10) == []


def test_packing_holds_every_id_once(frame, edges):
    docs = frame(edges)
    rows = packing.packed_plan(docs).collect()
    library = vocab.library(vocab.WORD_BPE)
    want = Counter()
    for d, t, _ in edges:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        for a in range(0, len(ids), 4096):
            part = ids[a : a + 4096]
            want[(d, a, len(part), zlib.crc32(vocab.as_bytes(part)), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    at = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 4096
    for s in packing.packed_sequences(docs).collect():
        assert len(s.ids) == 4 * (s.n_tokens if s.n_tokens & (s.n_tokens - 1) == 0 else 4096)
    assert packing.packed_plan(frame([])).count() == 0


def test_lexicon_finds_its_words_only():
    book = bpe_lexicon.vocabulary(vocab.BYTE_BPE)
    runs = ["the", "them", "then", "hem", "he", "héé", "don't", "x1,2", "…"]
    lexicon = bpe_lexicon.Lexicon(bpe_lexicon.compiled(runs, vocab.BYTE_BPE))
    held = {w.encode() for r in runs for w in book.split(f" {r}")}
    probe = [*held, b" th", b" thex", b"", b"zz", b" hemm"]
    assert lexicon.find(probe) == [vocab.as_bytes(book.merge(w)) if w in held else None for w in probe]
    assert bpe_lexicon.Lexicon(bpe_lexicon.compiled([], vocab.BYTE_BPE)).find([b"x"]) == [None]


def test_encoding_equals_the_library(frame, edges):
    r = random.Random(2)
    alphabet = "abc '\n\t  .,!1٣日éß<|>’İx"
    more = [(100 + i, "".join(r.choice(alphabet) for _ in range(r.randint(0, 50))), None) for i in range(300)] + [(999, "ab" * 3000, None), (998, "a<|endoftext|> b<|endoftext|><|endoftext|>", None)]
    library = vocab.library(vocab.BYTE_BPE)
    want = Counter((d, vocab.as_bytes(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _ in edges + more)
    coded = bpe_lexicon.encode(frame(edges + more))
    assert Counter((r.doc_id, bytes(r.ids)) for r in coded.collect()) == want
    assert Counter(r.text for r in bpe_lexicon.decode(coded).collect()) == Counter(t or "" for _, t, _ in edges + more)
    assert bpe_lexicon.encode(frame([])).count() == 0


def test_forward_sums_all_segmentations():
    known = language_id.pieces(vocab.PIECES)
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(len(known)), 2).T)
    logp = np.vstack([logp, np.log([[1e-7, 1e-7]])])

    def brute(word):
        word, total = language_id.MARK + word, np.zeros(2)
        for mask in range(1 << (len(word) - 1)):
            cuts = [0, *(i + 1 for i in range(len(word) - 1) if mask >> i & 1), len(word)]
            parts = [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            if all(p in known or len(p) == 1 for p in parts):
                total += np.exp(sum(logp[known.get(p, len(known))] for p in parts))
        return np.log(total)

    words = ["the", "maison", "ßüq", "日x", "a"]
    assert np.allclose(language_id.Lattice(words, language_id.trie(vocab.PIECES)).word_logp(logp), [brute(w) for w in words])


def test_language_held_out(frame, edges):
    r = random.Random(4)
    voices = {"aa": ["ka", "ki", "ku", "ta"], "bb": ["sch", "lich", "ung", "ber"]}
    docs = [(i, " ".join("".join(r.choice(voices[g]) for _ in range(3)) for _ in range(30)), g) for i in range(200) for g in [("aa", "bb")[i % 2]]]
    every = frame(docs + [(1000 + (d or 0), t, None) for d, t, _ in edges])
    out = {r.doc_id: r for r in language_id.predicted(every, *language_id.learn(every)).collect()}
    assert all(out[i].lang_pred == g for i, _, g in docs)
    assert out[1001].lang_pred == "und" and out[1002].lang_pred == "und" and out[1004].score == 0.0
    signs = frame([(1, "½ ²³ Ⅷ 12 _", None), (2, "½ka", None)])
    assert [x.lang_pred for x in language_id.predicted(signs, *language_id.learn(every)).orderBy("doc_id").collect()] == ["und", "aa"]
    assert language_id.words("Ça e\u0301te x2y ½") == ["ça", "e\u0301te", "x", "y"]
    nothing = frame([(1, "abc", None)])
    assert [r.lang_pred for r in language_id.predicted(nothing, *language_id.learn(nothing)).collect()] == ["und"]


def test_toxicity_learns_a_pair_of_terms(spark, frame, edges):
    """Neither word alone is toxic; both together are."""
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        a, b = i % 2, i // 2 % 2
        text = " ".join([f"w{r.randrange(200)}" for _ in range(20)] + ["grubby"] * a + ["outsiders"] * b)
        docs.append((i, text, None))
        labels.append((i, 0, a & b))
    every = frame(docs + [(9000 + (d or 0), t, None) for d, t, _ in edges])
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in toxicity.scored(every, toxicity.learn(every, marks)).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((out[i] >= toxicity.THRESHOLD) == bool(i % 2 & i // 2 % 2) for i in held)
    assert right / len(held) > 0.95 and all(0 <= s <= 1 for s in out.values())
    unlabelled = toxicity.learn(frame(docs[:5]), marks.limit(0))
    assert toxicity.scored(frame([]), unlabelled).count() == 0
