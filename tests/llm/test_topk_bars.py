import numpy as np
import pytest

from provgraph.llm import topk_search


def brute(x, ids, q, q_ids, k):
    """(query, id, score) of the k best, in 64-bit integers."""
    with np.errstate(over="ignore"):
        scores = q @ x.T
    return [(i, int(ids[j]), int(scores[i, j])) for i in range(len(q)) for j in [j for j in np.lexsort((ids, -scores[i])) if ids[j] != q_ids[i]][:k]]


def test_later_parts_start_with_a_bar(monkeypatch):
    """Even vectors without heavy dimensions aren't read as deep as lists that start without a bar."""
    made = []

    class Noted(topk_search.Lists):
        def __init__(self, x):
            super().__init__(x)
            made.append(self)

    monkeypatch.setattr(topk_search, "Lists", Noted)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((16_384, 64))
    x = np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.int64)
    ids = np.arange(len(x))
    q, q_ids = x[::256], ids[::256]
    at, row, score = topk_search.top_of_block(x, ids, q, q_ids, 20)
    assert sum(lists.read for lists in made) < 0.8 * len(x) * q.size
    assert list(zip(at.tolist(), ids[row].tolist(), score.tolist(), strict=True)) == brute(x, ids, q, q_ids, 20)


@pytest.mark.parametrize("size", [3, 2**14, 2**27, 2**40])
@pytest.mark.parametrize("order", ["worst", "best"])
def test_ties_repeats_and_wrapping_scores_over_parts(monkeypatch, size, order):
    """Small values tie, in parts and across; large ones leave single, then double precision; the largest wrap."""
    for name, value in (("FIRST", 8), ("TOGETHER", 7), ("PAIRS", 64), ("KEPT", 10_000)):
        monkeypatch.setattr(topk_search, name, value, raising=False)
    rng = np.random.default_rng(size % 97)
    x = rng.integers(-size, size + 1, (600, 4))
    x[::5] = x[0]
    x = x[np.argsort(x[:, 0] if order == "worst" else -x[:, 0], kind="stable")]
    ids = rng.integers(0, 500, 600)
    q, q_ids = np.abs(x[:40]), ids[:40]
    at, row, score = topk_search.top_of_block(x, ids, q, q_ids, 9)
    assert list(zip(at.tolist(), ids[row].tolist(), score.tolist(), strict=True)) == brute(x, ids, q, q_ids, 9)


def test_slabs_read_in_single_precision_are_not_used_for_double(monkeypatch):
    monkeypatch.setattr(topk_search, "TOGETHER", 7)
    monkeypatch.setattr(topk_search, "FEW", 0)
    rng = np.random.default_rng(2)
    x, ids = 2**27 + rng.integers(0, 40, (600, 16)), np.arange(600)
    q, q_ids = x[:14].copy(), ids[:14]
    q[:7] = 0
    at, row, score = topk_search.top_of_block(x, ids, q, q_ids, 9)
    assert list(zip(at.tolist(), ids[row].tolist(), score.tolist(), strict=True)) == brute(x, ids, q, q_ids, 9)
