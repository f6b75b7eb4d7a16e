import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from provgraph.llm import exact_dedup, line_dedup


def brute_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    first, size = {}, {}
    for i in order:
        first.setdefault(norm[i], rows[i][0])
        size[norm[i]] = size.get(norm[i], 0) + 1
    return sorted(str((d, first[n], size[n], hashlib.sha256(n.encode()).hexdigest())) for (d, *_), n in zip(rows, norm, strict=True))


def test_groups_equal_brute_force(frame, edges):
    got = exact_dedup.dedup_groups(frame(edges)).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute_groups(edges)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})


def test_chunks_concatenate(spark, edges):
    rows = spark.createDataFrame([(t or "",) for _, t, _ in edges], "t string").select("t", exact_dedup.cut(F.col("t"), 16, 64).alias("c")).collect()
    assert all("".join(r.c) == r.t and all(len(c) <= 70 for c in r.c) for r in rows)


def test_fingerprint_clash_is_told_apart(spark):
    cuts = spark.createDataFrame([(1, bytearray(b"a")), (1, bytearray(b"b")), (1, bytearray(b"a"))], "h long, d binary")
    assert sorted((bytes(r.d), r["rank"], r.copies) for r in exact_dedup.chunk_store(cuts).collect()) == [(b"a", 1, 2), (b"b", 2, 1)]


def test_drop_copies_keeps_columns(frame, edges):
    docs = frame(edges)
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and out.count() == len({n for _, _, _, n in map(eval, brute_groups(edges))})


def test_empty_tables(frame):
    assert exact_dedup.dedup_groups(frame([])).count() == 0
    assert line_dedup.line_classes(frame([])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def variants(seed, n=120):
    r, letters = random.Random(seed), "abcdé "
    base = ["".join(r.choice(letters) for _ in range(r.randint(24, 50))) for _ in range(10)]
    out = []
    for _ in range(n):
        x = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            p = r.randrange(len(x))
            x[p : p + r.randint(0, 1)] = r.choice([[], [r.choice(letters)]])
        out.append("".join(x))
    short = ["".join(r.choice("ab ") for _ in range(r.randint(0, 9))) for _ in range(40)]
    short += ["".join(r.choice("ab") for _ in range(r.randint(7, 18))) for _ in range(60)]
    return [*out, *short, "short", "shorr", ""]


@pytest.mark.parametrize("hot", [64, 2])
def test_line_links_equal_brute_force(frame, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    lines = variants(3)
    docs = [(i, "\n".join(lines[i::20])) for i in range(20)] + [(90, None), (91, ""), (None, lines[3])]
    want = {}
    distinct = sorted({x for _, t in docs if t is not None for x in t.split("\n")})
    for a in distinct:
        near = [b for b in distinct if b != a and distance(a, b) <= min(2, min(len(a), len(b)) // 8)]
        want[hashlib.md5(a.encode()).hexdigest()] = (sum(t.split("\n").count(a) for _, t in docs if t is not None), len(near))
    got = line_dedup.line_classes(frame(docs)).collect()
    assert {r.line_md5: (r.copies, r.n_links) for r in got} == want
    assert sum(r.kept for r in got) == len({(r.class_doc_id, r.class_line_no) for r in got})


def test_unrelated_short_lines_stay_apart(frame):
    r = random.Random(8)
    lines = sorted({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(1700)})[:1600]
    got = line_dedup.line_classes(frame([(i, x) for i, x in enumerate([*lines, *lines[:10]])]))
    assert got.where("class_size = 1 and n_links = 0 and kept").count() == 1600


def test_drop_lines(frame):
    a, b = "the quick brown fox jumps over it", "the quick brown fox jumps over if"
    docs = frame([(1, f"{a}\nkeep me, for I am a longer line"), (2, f"{b}\nx\n{a}"), (3, None)])
    out = {r.doc_id: r.text for r in line_dedup.drop_lines(docs).collect()}
    assert out == {1: f"{a}\nkeep me, for I am a longer line", 2: "x", 3: None}


def test_very_long_line_and_clashing_columns(frame):
    long = "lorem ipsum " * 20_000
    docs = frame([(1, long + "a"), (2, long + "b"), (3, "x" * 2_000)])
    got = {r.doc_id: r for r in line_dedup.line_classes(docs.withColumns({"h1": F.lit(1), "line": F.lit("z"), "node.a": F.lit(0)})).collect()}
    assert [got[d].n_links for d in (1, 2, 3)] == [1, 1, 0] and got[2].class_doc_id == 1 and not got[2].kept
    out = line_dedup.drop_lines(docs.withColumn("a.b", F.lit(1)))
    assert out.columns == [*docs.columns, "a.b"] and {r.doc_id: r.text for r in out.collect()}[2] == ""
