import random
import zlib
from collections import Counter

import corpus_pipeline
import pytest

from provgraph.llm import vocab
from provgraph.llm.common import written

from .test_searches import bag, brute_repeats


def corpus():
    """Clean prose with exact copies, near copies, shared passages, and toxic texts."""
    r = random.Random(11)
    word = lambda: "".join(r.choice(["ka", "to", "mi", "re", "su", "lo"]) for _ in range(r.randint(1, 3)))
    para = lambda n: " ".join(word() for _ in range(n))
    docs = [para(r.randint(40, 120)) for _ in range(160)]
    shared = para(70)
    docs += [f"{para(60)} {shared} {para(60)}" for _ in range(6)]
    docs += [docs[i].replace(" ", "  ", 2) for i in range(5)]
    docs += [" ".join([*(w := docs[i].split())[:-1], "other"]) for i in range(10, 20)]
    toxic = [f"{para(30)} gruesome fool {para(5)} gruesome {para(20)} fool" for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)] + [(1000 + i, t, "en", "s", len(t)) for i, t in enumerate(toxic)] + [(2000, None, None, None, None), (2001, "", "en", "s", 0)]
    return rows, [(i, 0, 0) for i in range(160)] + [(1000 + i, 0, 1) for i in range(60)]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    rows, labels = corpus()
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


@pytest.fixture(scope="module")
def stages(spark, root):
    docs, out = spark.read.parquet(f"{root}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, root), name)
        out[name] = (before, docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_return_documents(stages):
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns


def test_toxic_documents_go_and_clean_ones_stay(stages):
    left = texts(stages["toxicity"][1])
    assert not [d for d in left if 1000 <= d < 2000] and all(d in left for d in [*range(181), 2000, 2001])


def test_one_of_each_group_of_copies_stays(stages):
    before, after = map(texts, stages["exact_dedup"])
    first = {}
    for d in sorted(before):
        first.setdefault(" ".join((before[d] or "").split(" ")).replace("  ", " "), d)
    assert set(after) == set(first.values())


def test_one_of_each_near_class_stays(stages):
    before, after = map(texts, stages["near_dedup"])
    root = {d: d for d in before}
    bags = {d: bag(t) for d, t in before.items()}
    for a in sorted(bags):
        for b in sorted(bags):
            if a < b and (o := sum((bags[a] & bags[b]).values())) and o >= 0.8 * (bags[a].total() + bags[b].total() - o):
                root[b] = root[a]
    assert set(after) == set(root.values()) and len(after) < len(before)


def test_later_copies_of_passages_go(stages):
    before, after = map(texts, stages["suffix_dedup"])
    want = {d: kept.decode() for d, _, _, _, kept in brute_repeats(list(before.items()), 200, "first")}
    assert {d: t or "" for d, t in after.items()} == want and sum(map(len, want.values())) < sum(len(t or "") for t in before.values())
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in stages["suffix_dedup"][1].collect())


def test_pieces_hold_every_id(stages):
    before, after = stages["packing"]
    library, want = vocab.library(vocab.WORD_BPE), Counter()
    for d, t in texts(before).items():
        ids = vocab.as_bytes(library.encode(t or "", add_special_tokens=False).ids + [2])
        want.update((d, a // 4, zlib.crc32(ids[a : a + 16384])) for a in range(0, len(ids), 16384))
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in after.collect()) == want


def test_run_equals_its_stages(spark, root, stages):
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    want = Counter(map(tuple, stages["packing"][1].select(*columns).collect()))
    assert Counter(map(tuple, corpus_pipeline.run(spark, root).select(*columns).collect())) == want


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (2, None), (2, None), (3, "word " * 60_000), (3, "word " * 60_000), (4, "x")]])
def test_odd_tables_pass_all_stages(spark, rows, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, uid long, `a.b` string, tk binary, kept boolean"
    spark.createDataFrame([(d, t, None, None, None if t is None else len(t), 1, "x", None, True) for d, t in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    assert {r.doc_id for r in docs.collect()} == ({1, 3, 4} if rows else set())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == ({1, 3, 4} if rows else set())
