"""Removal of repeated passages of at least LENGTH bytes by suffix order and longest previous factors.

Equal windows of LENGTH bytes select the same anchor: the smallest hash among the K-byte strings in
them. Consecutive windows with one anchor form a segment, so all places where a window occurs are
segments in one anchor's bucket, and buckets of one row need no further look. In a bucket, segments of
equal content form a class, which an aggregate proves: the smallest and the largest of the bytes under
one hash are the same, or the hash is split by its bytes. All windows of a class of two places repeat.
Of each class one place goes on: segments that match only in part meet in tasks, where their windows
are the suffixes, sorted by their bytes into a sparse suffix array; next smaller positions on both
sides of that order give the longest previous factors, and, of the mirrored positions, the longest next
ones. A window repeats if one of its factors is as long as itself. Buckets of more than HOT classes, as
at the edge of a passage that very many documents hold, are grouped by windows instead: a count of
digests leaves the few that may repeat, which are then grouped by their bytes, so that no task ever
gathers a bucket whose size grows with the input and bytes decide at every size.

keep="none" removes every place of a repeated window, keep="first" all places but the first, in the
order of doc_id (nulls last), then of the text's digest, then of the position.

Defined results: a null text is empty and nothing is removed from it; copies of a text repeat each
other (rows alike in doc_id and text are, under keep="first", one document and kept alike); a text
shorter than LENGTH bytes is never cut; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import fresh, own_columns, scope, sized, table, written

LENGTH, K = 200, 64
#: Classes of a bucket up to which it is handled whole in one task (of at most 2 * LENGTH bytes each), classes dealt to a task.
HOT, DEALT = 8192, 2048
#: Bytes handled together in a task.
SLICE = 250_000

U = np.uint64
STEP = 0x9E3779B97F4A7C15
LAST = 2**63 - 1

SEGMENTS = "tk binary, d long, lo long, hi long, anchor long, content long"
CUTS = "anchor long, tk binary, d long, lo long, many boolean, bytes binary"


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTERS = mix(np.arange(1, 257, dtype=U) * U(STEP))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, U(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def segments(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: text number, first and last window, anchor's hash, content's hash."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    up, down = powers(STEP, n), powers(pow(STEP, -1, 2**64), n)
    sums = np.append(U(0), np.cumsum(LETTERS[data] * up[:-1]))
    h = mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    # the smallest hash of each run of w, its place in the low bits: running minima of blocks from both sides
    w, low = length - k + 1, U((1 << 28) - 1)
    key = np.append((h & ~low) | np.arange(len(h), dtype=U), np.full(-len(h) % w, U(2**64 - 1))).reshape(-1, w)
    left = np.minimum.accumulate(key, axis=1).ravel()
    right = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    at = (np.minimum(right[:windows], left[w - 1 : w - 1 + windows]) & low).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    p = np.flatnonzero(np.arange(windows) + length <= ends[text[:windows]])
    at, text = at[p], text[p]
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1]))) if len(p) else p
    lo, hi = p[first], p[np.append(first[1:] - 1, len(p) - 1)] if len(p) else p
    return text[first], lo, hi, h[at[first]].view(np.int64), mix((sums[hi + length] - sums[lo]) * down[lo]).view(np.int64)


def text_slices(offsets: np.ndarray, length: int, most: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, end text, first byte, end byte); a text above most bytes comes in parts that share length - 1 bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        if j == i + 1 and offsets[j] - offsets[i] > most:
            for a in range(int(offsets[i]), int(offsets[j]) - length + 1, most):
                yield i, j, a, min(int(offsets[j]), a + most + length - 1)
        else:
            yield i, j, int(offsets[i]), int(offsets[j])
        i = j


def segment_table(keyed: DataFrame, length: int = LENGTH, k: int = K, bits: int = 64) -> DataFrame:
    """keyed (tk, d, bytes) to one row for each segment, positions counted from the text's start; bits: of the content's hash."""
    most, mask = SLICE, np.int64(-1 if bits == 64 else (1 << bits) - 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("bytes")
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
            block = column.buffers()[2]
            data = np.frombuffer(block, dtype=np.uint8) if block is not None else np.zeros(0, dtype=np.uint8)
            for i, j, a, b in text_slices(offsets, length, most):
                text, lo, hi, anchor, content = segments(data[a:b], np.minimum(offsets[i + 1 : j + 1], b) - a, length, k)
                start = np.maximum(offsets[i:j], a)[text] - a - np.maximum(0, a - offsets[i:j])[text]
                whole = pa.array(text + i)
                columns = [batch.column("tk").take(whole), batch.column("d").take(whole), *(pa.array(x) for x in (lo - start, hi - start, anchor, content & mask))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in SEGMENTS.split(", ")])

    return keyed.mapInArrow(work, SEGMENTS)


def suffix_array(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equally long byte strings without zero bytes, in position order: their sorted order, and the length each shares with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    shared = np.zeros(len(order), dtype=np.int64)
    for a in range(1, len(order), 4096):
        differ = rows[order[a : a + 4096]] != rows[order[a - 1 : a - 1 + len(order[a : a + 4096])]]
        shared[a : a + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, shared


def previous_factors(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Longest previous factor of every position: what it shares with the next smaller positions before and after it in suffix order."""
    best = np.zeros(len(order), dtype=np.int64)
    for direction in (1, -1):
        stack: list[tuple[int, int]] = []  # positions still open, and what each shares with the one below it
        for i in range(len(order)) if direction == 1 else range(len(order) - 1, -1, -1):
            here = int(order[i])
            near = int(shared[i]) if direction == 1 else (int(shared[i + 1]) if i + 1 < len(order) else 0)
            while stack and stack[-1][0] > here:
                near = min(near, stack.pop()[1])
            if stack and near > best[here]:
                best[here] = near
            stack.append((here, near))
    return best


def runs(sorted_places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of consecutive numbers."""
    cut = np.flatnonzero(np.diff(sorted_places) > 1)
    return sorted_places[np.append(0, cut + 1)], sorted_places[np.append(cut, len(sorted_places) - 1)]


def match_group(rows: pd.DataFrame, length: int, first_stays: bool) -> pd.DataFrame:
    """Rows of CUTS, whole buckets, to the spans (tk, start, end) that repeat."""
    rows = rows.sort_values(["d", "tk", "lo"]).reset_index(drop=True)
    sizes = np.array([len(b) for b in rows["bytes"]], dtype=np.int64)
    data = np.frombuffer(b"".join(rows["bytes"]), dtype=np.uint8)
    base = np.cumsum(sizes) - sizes
    count = sizes - length + 1
    seg = np.repeat(np.arange(len(rows)), count)
    place = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    start = base[seg] + place
    up, down = powers(STEP, len(data)), powers(pow(STEP, -1, 2**64), len(data))
    sums = np.append(U(0), np.cumsum(LETTERS[data] * up[:-1]))
    h = mix((sums[start + length] - sums[start]) * down[start])
    # only windows whose hash occurs twice are sorted as suffixes; the bytes decide
    order = np.argsort(h, kind="stable")
    twin = np.append(False, h[order][1:] == h[order][:-1])
    twin = np.sort(order[twin | np.append(twin[1:], False)])
    if not len(twin):
        return pd.DataFrame({"tk": [], "start": [], "end": []})
    # a letter more than each byte, for numpy's strings drop zero bytes at the end; UTF-8 has no byte 255
    windows = np.lib.stride_tricks.sliding_window_view(data + np.uint8(1), length)[start[twin]]
    order, shared = suffix_array(windows)
    factor = previous_factors(order, shared)
    if not first_stays:  # an occurrence behind counts as well: the factors of the positions in reverse
        factor = np.maximum(factor, previous_factors(len(order) - 1 - order, shared)[::-1])
    found = twin[factor >= length]
    if not len(found):
        return pd.DataFrame({"tk": [], "start": [], "end": []})
    # places of one segment are consecutive; a gap between segments keeps their runs apart
    a, b = runs(found + seg[found])
    owner = seg[np.searchsorted(np.arange(len(seg)) + seg, a)]
    shift = np.cumsum(count) - count + np.arange(len(rows))
    lo = rows["lo"].to_numpy()[owner]
    return pd.DataFrame({"tk": rows["tk"].to_numpy()[owner], "start": lo + a - shift[owner], "end": lo + b - shift[owner] + length})


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("tk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), text.cast("binary").alias("bytes"))


PLACE = ["anchor", "content"]


def with_bytes(hits: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """hits with the bytes of their windows."""
    part = F.substring("bytes", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int") + length)
    return hits.join(texts, "tk").select(*PLACE, "tk", "d", "lo", part.alias("bytes"))


def classes_of(hits: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, content, places, first, bytes, alike): segments of one hash; alike: whether their bytes are the same."""
    grouped = with_bytes(hits, texts, length).groupBy(*PLACE)
    found = grouped.agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("d", "tk", "lo")).alias("first"), F.min("bytes").alias("bytes"), F.max("bytes").alias("last"))
    return written(found.select(*PLACE, "places", "first", "bytes", (F.col("bytes") == F.col("last")).alias("alike")), "classes")


def told_apart(hits: DataFrame, texts: DataFrame, clash: DataFrame, length: int, turn: int) -> DataFrame:
    """hits with new hashes for segments that share one although their bytes differ."""
    clash = clash.select(*PLACE)
    rows = written(with_bytes(hits.join(clash, PLACE, "left_semi"), texts, length), "clashes")
    rank = F.row_number().over(Window.partitionBy(*PLACE).orderBy("bytes"))
    named = rows.select(*PLACE, "bytes").distinct().withColumn("to", F.xxhash64("content", rank, F.lit(turn)))
    new = rows.join(named, [*PLACE, "bytes"]).select(*PLACE, "tk", "lo", "to")
    out = hits.join(new, [*PLACE, "tk", "lo"], "left").withColumn("content", F.coalesce("to", "content")).drop("to")
    return written(out, "hits")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = K, keep: str = "none", bits: int = 64) -> DataFrame:
    """(tk, start, end): bytes of the text with MD5 digest tk that repeat elsewhere in it or in other texts; spans don't overlap."""
    first_stays = keep == "first"
    keyed = keyed_texts(docs)
    with scope(docs.sparkSession):
        with scope(docs.sparkSession):
            # written, so that the texts are cut once; only the anchors are read to find those of several places
            cut = written(segment_table(keyed.where(F.octet_length("bytes") >= length), length, k, bits), "segments")
            # copies of one text make several places too, and are told apart below
            full = cut.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.xxhash64("anchor").alias("key"))
            # joined by a hash of the anchor, so that the aggregation below deals its rows anew and a hot anchor's can be split here
            hits = cut.withColumn("key", F.xxhash64("anchor")).join(full, "key").groupBy(*PLACE, "tk", "lo").agg(F.min("d").alias("d"), F.min("hi").alias("hi"))
            hits = written(hits, "hits", result=True)
        texts = keyed.join(hits.select("tk").distinct(), "tk", "left_semi").select("tk", "bytes").dropDuplicates(["tk"])
        classes, turn = classes_of(hits, texts, length), 0
        while not (clash := classes.where("not alike")).isEmpty():
            turn += 1
            hits = told_apart(hits, texts, clash, length, turn)
            classes = classes_of(hits, texts, length)
        buckets = written(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "buckets")

        many = hits.join(classes.where("places > 1").select(*PLACE, "first"), PLACE)
        if first_stays:
            many = many.where(~((F.col("tk") == F.col("first.tk")) & (F.col("lo") == F.col("first.lo"))))
        spans = many.select("tk", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"))

        # classes that may match in part: one place of each, with its bytes
        cuts = written(classes.join(buckets, "anchor").select("anchor", "classes", "first.*", (F.col("places") > 1).alias("many"), "bytes"), "cuts")
        cold = cuts.where(F.col("classes") <= HOT).drop("classes")
        groups = max(1, -(-cold.count() // DEALT))
        group = F.pmod(F.xxhash64("anchor"), F.lit(groups))
        matched = cold.withColumn("g", group).groupBy("g").applyInPandas(lambda rows: match_group(rows, length, first_stays), "tk binary, start long, end long")
        hot = hot_spans(cuts.where(F.col("classes") > HOT), length, first_stays)
        return written(merged_spans(spans.unionByName(matched).unionByName(hot)), "spans", result=True)


def merged_spans(spans: DataFrame) -> DataFrame:
    """Maximal runs of covered bytes."""
    order = Window.partitionBy("tk").orderBy("start")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = spans.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
    return begins.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("tk", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def hot_spans(cuts: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """As match_group, for buckets of any size: windows whose digests repeat, then grouped by their bytes."""

    def windows(whole: bool):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 500):
                    out = []
                    for tk, d, lo, b in batch.iloc[at : at + 500][["tk", "d", "lo", "bytes"]].itertuples(index=False):
                        for i in range(len(b) - length + 1):
                            part = b[i : i + length]
                            out.append((xxhash.xxh3_64_intdigest(part) - 2**63, *((tk, d, lo + i, part) if whole else ())))
                    yield pd.DataFrame(out, columns=["w", "tk", "d", "p", "bytes"] if whole else ["w"])

        return cuts.select("tk", "d", "lo", "bytes").mapInPandas(work, "w long, tk binary, d long, p long, bytes binary" if whole else "w long")

    digests = written(windows(False).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w"), "digests")
    rows = written(windows(True).join(sized(digests), "w"), "windows")
    seen = rows.groupBy("bytes").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "tk", "p")).alias("first")).where("n > 1")
    rows = rows.join(written(seen, "seen"), "bytes")
    if first_stays:
        rows = rows.where(~((F.col("tk") == F.col("first.tk")) & (F.col("p") == F.col("first.p"))))
    return rows.select("tk", F.col("p").alias("start"), (F.col("p") + length).alias("end"))


CUT = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", BinaryType())])


def between_letters(b: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs, each narrowed so that it starts and ends between UTF-8 letters."""
    out = []
    for x, y in gone:
        while x < y and b[x] & 0xC0 == 0x80:
            x += 1
        while x < y < len(b) and b[y] & 0xC0 == 0x80:
            y -= 1
        if x < y:
            out.append((x, y))
    return out


def without_repeats(docs: DataFrame, length: int = LENGTH, k: int = K, keep: str = "none", letters: bool = False, bits: int = 64) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept, the bytes that stay, in place of columns of these names; letters: no letter is cut in two."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key, at = fresh("tk", docs), fresh("d", docs)
    with scope(docs.sparkSession):
        spans = repeated_spans(docs, length, k, keep, bits)
        by_text = spans.groupBy("tk").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
        copies = keyed_texts(docs).select("tk", F.octet_length("bytes").alias("n"), "d").where(F.col("n") >= length)
        copies = copies.groupBy("tk").agg(F.count(F.lit(1)).alias("copies"), F.min("d").alias("first")).where("copies > 1")
        facts = by_text.join(copies, "tk", "full_outer").select(F.col("tk").alias(key), F.struct("spans", "copies", "first").alias("found"))
        facts = written(facts, "facts", result=True)

    @F.pandas_udf(CUT)
    def cut(bytes_: pd.Series, spans: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out = []
        for b, s, w in zip(bytes_, spans, whole, strict=True):
            gone = [(0, len(b))] if w else [(x["start"], x["end"]) for x in s] if s is not None else []
            if letters:
                gone = between_letters(b, gone)
            edges = [0, *(x for pair in gone for x in pair), len(b)]
            out.append((sum(y - x for x, y in gone), len(gone), b"".join(b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    # only what docs holds is shuffled, a text once
    found, done = fresh("found", docs), fresh("cut", docs)
    rows = docs.select(*own_columns(docs), F.unhex(F.md5(text)).alias(key), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias(at))
    rows = rows.join(facts.withColumnRenamed("found", found), key, "left")
    gone = F.col(f"{found}.copies") > 1
    if keep == "first":
        gone = gone & (F.col(at) > F.col(f"{found}.first"))
    out = rows.withColumn(done, cut(text.cast("binary"), F.col(f"{found}.spans"), F.coalesce(gone, F.lit(False))))
    results = {"n_bytes": F.octet_length(text).cast("long"), **{c: F.col(f"{done}.{c}") for c in ("n_removed", "n_spans", "kept")}}
    stay = [c for c, name in zip(own_columns(docs), docs.columns, strict=True) if name.lower() not in results]
    return out.select(*stay, *(x.alias(c) for c, x in results.items()))


def keep_first(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the later copies of repeated passages cut from text; the columns stay the same."""
    names = [fresh(f"c{i}_", docs) for i in range(len(docs.columns))]
    plain = docs.select(*(c.alias("text" if o == "text" else "doc_id" if o == "doc_id" else n) for c, o, n in zip(own_columns(docs), docs.columns, names, strict=True)))
    out = without_repeats(plain, length, keep="first", letters=True)
    cut = F.when(F.col("text").isNotNull(), F.col("kept").cast("string")).cast(docs.schema["text"].dataType)
    return out.select(*((cut if o == "text" else F.col("doc_id" if o == "doc_id" else n)).alias(o) for o, n in zip(docs.columns, names, strict=True)))


def op7_lpf_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
