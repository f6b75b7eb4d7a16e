import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from provgraph.llm import minhash_dedup, suffix_dedup, topk_search


def passages(seed=3, n=80):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "été", "the", "of", "and", "x", "yz"]
    para = lambda k: " ".join(r.choice(words) + str(r.randint(0, 99)) for _ in range(k))
    shared = [para(40) for _ in range(4)]
    docs = [(i, " ".join(r.choice([para(r.randint(1, 60)), r.choice(shared), r.choice(shared)[r.randint(0, 60) :]]) for _ in range(r.randint(1, 5)))) for i in range(n)]
    return [*docs, (200, docs[3][1]), (201, docs[3][1]), (202, None), (203, ""), (204, "ab" * 400), (205, "short"), (206, docs[7][1][5:]), (None, docs[9][1])]


def brute_repeats(docs, length, keep):
    texts = [(suffix_dedup.LAST if d is None else d, (t or "").encode(), d) for d, t in docs]
    order = sorted(texts, key=lambda x: (x[0], hashlib.md5(x[1]).digest()))
    count, first, out = Counter(), {}, []
    for i, (_, b, _) in enumerate(order):
        for p in range(len(b) - length + 1):
            count[b[p : p + length]] += 1
            first.setdefault(b[p : p + length], (i, p))
    for i, (_, b, d) in enumerate(order):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if count[w] > 1 and (keep == "none" or first[w] != (i, p)):
                gone[p : p + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("hot", "bits"), [(16_384, 64), (3, 64), (16_384, 1)])
def test_repeats_equal_brute_force(frame, monkeypatch, keep, hot, bits):
    """Also with buckets taken for large, and with content hashes that clash everywhere: bytes decide."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = passages()
    got = suffix_dedup.without_repeats(frame(docs), keep=keep, bits=bits).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_repeats(docs, 200, keep)


def test_long_texts_are_read_in_parts(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    docs = passages(5, 25)
    got = suffix_dedup.without_repeats(frame(docs)).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=str) == brute_repeats(docs, 200, "none")


def test_previous_factors_equal_definition():
    rows = np.frombuffer(b"".join(bytes(random.Random(i).choices(b"ab", k=6)) for i in range(60)), dtype=np.uint8).reshape(-1, 6)
    shared = lambda a, b: next((i for i in range(6) if a[i] != b[i]), 6)
    want = [max((shared(rows[i], rows[j]) for j in range(i)), default=0) for i in range(len(rows))]
    assert suffix_dedup.previous_factors(*suffix_dedup.suffix_array(rows)).tolist() == want


def test_keep_first_returns_documents(frame, edges):
    docs = frame(edges)
    out = suffix_dedup.keep_first(docs)
    assert out.columns == docs.columns and out.count() == len(edges)
    assert suffix_dedup.keep_first(frame([])).count() == 0


def bag(text):
    w = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


@pytest.mark.parametrize("small", [16, 1])
def test_near_classes_equal_brute_force(frame, edges, monkeypatch, small):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    r = random.Random(8)
    base = [[f"w{r.randrange(500)}" for _ in range(r.randint(20, 150))] for _ in range(12)]
    docs = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"v{r.randrange(500)}"
        docs.append((i, " ".join(w)))
    docs += [(300, "a b c d e f " * 50), (301, "a b c d e f " * 45), (302, "a b c d e f " * 10)] + [(400 + i, t) for i, (_, t, _) in enumerate(edges)]
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = {d: bag(t) for d, t in docs}
    for a, b in itertools.combinations(sorted(bags), 2):
        both = sum((bags[a] & bags[b]).values())
        if both and both >= 0.8 * (bags[a].total() + bags[b].total() - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = minhash_dedup.near_classes(frame(docs)).collect()
    assert {r.doc_id: r.class_id for r in got} == {d: find(d) for d in bags}
    assert sum(r.kept for r in got) == len({find(d) for d in bags})
    assert minhash_dedup.near_classes(frame([])).count() == 0
    out = minhash_dedup.keep_one(frame(edges))
    assert out.columns == frame(edges).columns and out.count() == len(edges) - 2


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    a = {int(k): int(rng.integers(1, 9)) for k in rng.integers(0, 2**62, 60)}
    b = {k: v if rng.random() < 0.6 else int(rng.integers(1, 9)) for k, v in list(a.items())[8:]} | {5: 4}
    union = set(a) | set(b)
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in union) / sum(max(a.get(k, 0), b.get(k, 0)) for k in union)
    keys = np.array([*a, *b], dtype=np.uint64)
    s = minhash_dedup.signatures(np.repeat([0, 1], [len(a), len(b)]), keys, np.array([*a.values(), *b.values()]), 2, m=5000)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


@pytest.mark.parametrize("blocks", [(16_384, 2048), (64, 8)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk_search, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", blocks[1])
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-20, 20, 6) / 64]) for i in range(300)]
    rows += [(300, rows[7][1]), (301, None), (302, []), (303, [1.0, None]), (304, [float("nan")] * 6), (None, rows[1][1]), (305, [1.0, 2.0]), (320, [3.0, 1.0]), (20, rows[9][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    able = df.where(topk_search.usable() & df.vec_id.isNotNull()).select("vec_id", topk_search.quantised().alias("v"))
    got = topk_search.search(able, able.where("vec_id % 20 = 0"), 5).collect()
    use = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for q, a in use:
        if q % 20 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in use if i != q and len(b) == len(a)))[:5]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk_search.search(able.limit(0), able).count() == 0


def test_lists_are_read_in_part():
    """Vectors with a few heavy dimensions: the bounds end the reading early; the result is that of all entries."""
    rng = np.random.default_rng(3)
    x = np.floor(rng.standard_normal((2000, 16)) * 64 * 0.5 ** np.arange(16)).astype(np.int64)
    ids, q = np.arange(2000), x[:2000:20]
    lists = topk_search.Lists(x)
    found = lists.nearest(ids, q, ids[::20], 5)
    assert lists.read < 0.5 * q.size * len(x)
    for i, row in enumerate(found):
        best = sorted((-int(s), j) for j, s in enumerate(x @ q[i]) if j != 20 * i)[:5]
        assert {j for _, j in best} <= set(row.tolist())
