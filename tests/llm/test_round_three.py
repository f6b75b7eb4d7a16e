"""Shingle join, source audit and whitening against brute force, and on odd tables."""

import itertools
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from provgraph.llm import overlap_join, queries, source_audit, whitening

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(docs):
    """(n_shingles, component) of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, j in itertools.combinations(range(len(docs)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            old, new = label[i], label[j]
            label = [new if x == old else x for x in label]
    ids = {}
    for (d, _), x in zip(docs, label, strict=True):
        ids.setdefault(x, []).append(d)
    least = {x: min((d for d in v if d is not None), default=None) for x, v in ids.items()}
    return [(d, len(s), least[x]) for (d, _), s, x in zip(docs, sets, label, strict=True)]


def varied(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return words


@pytest.fixture
def odd(edges):
    rng = random.Random(3)
    docs = [(d, t) for d, t, *_ in edges if not t or len(t) < 10_000]
    vocabulary = [f"v{i}" for i in range(400)]
    common = rng.choices(vocabulary, k=60)
    for n in (1, 3, 5, 6, 9, 10, 40, 90, 300):
        base = rng.choices(vocabulary, k=n)
        for k in range(7):
            docs.append((1000 + 100 * n + k, ["  ", "\n", " \t"][k % 3].join(varied(rng, base, k * n // 90))))
    for k in range(40):  # a passage shared by texts that don't link
        docs.append((9000 + k, " ".join(rng.choices(vocabulary, k=rng.randrange(12, 70)) + common)))
    for k in range(60):  # a chain: each links with the next one
        docs.append((7000 + k, " ".join(f"chain{i}" for i in range(3 * k, 3 * k + 60))))
    return docs + [(7000, docs[-1][1]), (None, docs[20][1])]


@pytest.mark.parametrize("long", [256, 3])
def test_shingle_join_equals_brute_force(frame, odd, monkeypatch, long):
    monkeypatch.setattr(overlap_join, "LONG", long)
    got = overlap_join.overlap_classes(frame(odd))
    want = Counter(classes(odd))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == want


def test_shingle_join_search_alone_equals_brute_force(frame, odd, monkeypatch):
    """Without hubs every link comes from the merged lists."""
    monkeypatch.setattr(overlap_join, "LONG", 10**9)
    monkeypatch.setattr(overlap_join, "CHUNK", 16)
    monkeypatch.setattr(overlap_join, "STEP", 8)
    monkeypatch.setattr(overlap_join, "COMMON", 64)
    monkeypatch.setattr(overlap_join, "SLICE", 2000)
    got = overlap_join.overlap_classes(frame(odd))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.select("doc_id", "n_shingles", "component_id").collect()) == Counter(classes(odd))


def test_shingle_join_empty(frame):
    assert overlap_join.overlap_classes(frame([])).collect() == []
    got = overlap_join.overlap_classes(frame([(4, None), (5, " \n")])).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in sorted(got, key=lambda r: r.doc_id)] == [(4, 0, 4), (5, 0, 5)]


def test_shared_passage_makes_no_candidates(frame, monkeypatch):
    """A passage of all texts is in long lists only: what is compared grows with the texts, not with their pairs."""
    found = []
    real = overlap_join.searched

    def counted(entries):
        found.append((out := real(entries)).count())
        return out

    monkeypatch.setattr(overlap_join, "searched", counted)
    passage = " ".join(f"p{i}" for i in range(80))
    n = 200
    got = overlap_join.overlap_classes(frame([(k, passage + " " + " ".join(f"t{k}x{i}" for i in range(40))) for k in range(n)]))
    assert got.where("component_id = doc_id").count() == n and sum(found) <= n


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_merge_skip_equals_counting(least):
    rng = random.Random(least)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(0, 20))) for _ in range(rng.randrange(1, 8))]
        count = Counter(itertools.chain(*lists))
        want = {k: v for k, v in count.items() if v >= least}
        assert overlap_join.t_occurrence(lists, least) == want and overlap_join.divide_skip(lists, least) == want


def test_short_lists_suffice():
    """Sets that link share need(n, m) of their short lists, in any order."""
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(1, 120)
        m = rng.randrange(max(1, -(-4 * n // 5)), 5 * n // 4 + 1)
        both = int(overlap_join.least_shared(n, m))
        if both > min(n, m):
            continue
        order = list(range(n + m - both))
        rng.shuffle(order)
        a, b = set(order[:n]), set(order[n - both :])
        head = lambda x: set(sorted(x)[: int(overlap_join.short(len(x)))])
        assert len(a & b) == both and len(head(a) & head(b)) >= overlap_join.need(n, m)


def test_frequent_shingles_are_bounded_and_found(monkeypatch):
    monkeypatch.setattr(overlap_join, "COMMON", 50)
    rng, kept = np.random.default_rng(1), overlap_join.Frequent()
    for k in range(300):
        kept.add([np.unique(np.append(rng.integers(100, 10**9, 20), [7] * (k % 2))).astype(np.uint64)])
    kept.merge()
    assert len(kept.keys) <= 50 and 7 in kept.keys.tolist()


def audit_rows(docs):
    docs = [((lang or ""), (source or ""), [t.decode() for t in source_audit.terms_of(text)]) for lang, source, text in docs]
    out = []
    for lang in {x[0] for x in docs}:
        mine = [x for x in docs if x[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = sorted(t for t, n in df.items() if n >= 10)
        count = {s: Counter(t for _, x, ts in mine if x == s for t in ts if df[t] >= 10) for s in {x[1] for x in mine}}
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in count:
            pairs = [(x, sum(f(p(count[s], t), p(count[x], t)) for t in kept)) for x in count if x != s]
            terms = [(t, f(p(count[s], t), p(whole, t))) for t in kept if count[s][t] and p(count[s], t) > p(whole, t)]
            for part, rows, most in (("pair", pairs, None), ("term", terms, 10)):
                rows = sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most]
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(rows, 1)]
    return out


@pytest.mark.parametrize(("chunk", "tile"), [(4096, 128), (64, 2)])
def test_audit_equals_brute_force(spark, monkeypatch, chunk, tile):
    monkeypatch.setattr(source_audit, "TILE", tile)
    monkeypatch.setattr(source_audit, "HELD", 50)
    rng = random.Random(5)
    terms = ["Aä", "zz", "日本", "É", "é", *(f"t{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(90))]
    docs = [(None if k % 9 == 0 else "en" if k % 3 else "de", rng.choice(["a", "b", "c", "ä", None, "Z"]), rng.choice([None, ""]) if k % 17 == 0 else "1, ".join(rng.choices(terms, weights=range(1, len(terms) + 1), k=30))) for k in range(300)]
    docs += [("fr", "a", "few words"), ("fr", "b", "1 2 3"), ("it", "only", "one")]
    df = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], "lang string, source string, text string, n long, term string, p int")
    got = source_audit.audit(df)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == sorted(audit_rows(docs))


def test_audit_empty(spark):
    assert source_audit.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_whitening_equals_eigendecomposition(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 12)) * np.array([5, 4, 3, 2.5, *[1] * 8])
    rows = [(i, [float(c) for c in v], "a", 1) for i, v in enumerate(x)] + [(7, [float(c) for c in x[0]], "b", 2)] * 300
    rows += [(None, [float(c) for c in x[1]], "c", 1), (600, None, "d", 1), (601, [1.0, None] + [0.0] * 10, "e", 1), (602, [float("nan")] * 12, "f", 1), (603, [float("inf")] * 12, "f", 1), (604, [], "g", 1), (605, [1.0, 2.0], "h", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, x string, n int")
    got = whitening.whitened(df).toPandas()
    v = np.floor(256 * x).astype(np.int64)
    fit = np.unique(v, axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    assert len(got) == 4 * 801 and set(got["n"]) == {len(fit)} and set(got["component"]) == {1, 2, 3, 4}
    assert got["identity_error"].max() < 1e-10
    for k in range(4):
        part = got[(got["component"] == k + 1) & got["vec_id"].lt(500) & got["vec_id"].ne(7)].sort_values("vec_id")
        ids = part["vec_id"].astype(int).to_numpy()
        want = (v[ids] - fit.mean(axis=0)) @ u[:, k] / np.sqrt(e[k])
        sign = np.sign(want[0] * part["whitened"].iloc[0])
        assert np.allclose(part["whitened"], sign * want, atol=1e-9)
        assert np.allclose(part["explained"], e[k] / e.sum(), rtol=1e-12)
        s = fit.sum(axis=0)
        assert part["deviation"].tolist() == [int(((len(fit) * r - s) ** 2).sum()) for r in v[ids]]


def test_whitening_of_few_vectors(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whitened(make([])).collect() == []
    assert whitening.whitened(make([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    got = whitening.whitened(make([(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in got) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


@pytest.mark.parametrize("d", [1, 2, 5, 17, 60, 150])
def test_jacobi_davidson_reaches_double_precision(d):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    values = np.sort(rng.random(d))[::-1] * 7
    a = (q * values) @ q.T
    e, u = whitening.jacobi_davidson(lambda z: a @ z, d, min(4, d))
    assert np.allclose(e, values[:4], rtol=0, atol=1e-13)
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-13
    assert np.abs(a @ u - u * e).max() < 1e-12


@needs_data
@pytest.mark.parametrize("name", ["op11_divide_skip", "op12_bitmap_divergence"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.queries()[name](spark, SF)
    result = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(str(got.select(*names).first().__class__(**dict(zip(names, r, strict=True)))) for r in result.fetchall())


@needs_data
def test_whitening_query(spark):
    got = queries.queries()["op13_jacobi_davidson"](spark, SF).toPandas()
    assert len(got) and got["identity_error"].max() < 1e-4
