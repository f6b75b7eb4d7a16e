"""Packing by first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

A document's ids, closed by one end id, are cut at multiples of the sequence length; a piece is one
row. A piece as long as a sequence is one. The others, at most one of each document, are counted and
dealt at random into groups of about GROUP pieces, each packed alone: the work is one shuffle of small
rows, and groups never grow with the input, however long documents are or however many rows share an
id. The sequence length is the only padded length but for powers of two.

Defined results: a null text counts as empty and gives a piece that holds the end id only; null or
repeated doc_ids are kept row by row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vocab
from .common import table, written

LENGTH = 4096
END_ID = 2
#: Pieces dealt to a group; the padding of a group's last bins is spread over them.
GROUP = 2048

PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
PACKED = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, ids binary, sequence_id long, offset long"


def pieces(docs: DataFrame, length: int = LENGTH, path: str = vocab.WORD_BPE, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """One row for each piece of at most length ids; ids as little-endian unsigned 32-bit integers, null without keep_ids."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end, step = vocab.word_encoder(path), vocab.as_bytes([end_id]), 4 * length
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    out.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4, part if keep_ids else None))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def first_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size, taken in the given order: the first that still has room.

    The tree's leaves are the bins' free space and every inner node is its children's maximum, so the
    first bin with room is found, and the tree mended, in a logarithmic number of steps.
    """
    leaves = 1 << max(0, len(sizes) - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins = []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins.append(at - leaves)
        tree[at] -= size
        at //= 2
        while at:
            best = max(tree[2 * at], tree[2 * at + 1])
            if tree[at] == best:
                break
            tree[at] = best
            at //= 2
    return bins


def pack_group(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Rows with columns g (group), row and length, to sequences numbered within the group."""
    rows = rows.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    rows["sequence_id"] = 2 * (rows["g"].astype("int64") * 2**31 + first_fit(rows["length"].tolist(), length))
    rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
    return rows.drop(columns=["g", "row"])


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP, seed: int = 0) -> DataFrame:
    """The pieces with a sequence and an offset each; group: how many pieces a random group holds, about."""
    rows = written(cut.withColumn("row", F.monotonically_increasing_id()), "pieces", result=True)
    full, rest = rows.where(F.col("length") >= length), rows.where(F.col("length") < length)
    groups = max(1, -(-rest.count() // group))
    dealt = rest.withColumn("g", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(groups)))
    packed = dealt.groupBy("g").applyInPandas(lambda pdf: pack_group(pdf, length), PACKED)
    alone = full.withColumn("sequence_id", 2 * F.col("row") + 1).withColumn("offset", F.lit(0).cast("long")).drop("row")
    return packed.unionByName(alone).withColumn("doc_id", F.col("doc_id").cast("long"))


def packed_plan(docs: DataFrame) -> DataFrame:
    """Where each piece lies, without its ids: only lengths and checksums are shuffled."""
    return pack(pieces(docs, keep_ids=False)).drop("ids")


def packed_sequences(docs: DataFrame, length: int = LENGTH, pad_id: int = 0) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, starts, offsets, ids): the sequences themselves, padded."""
    rows = pack(pieces(docs, length), length)
    order = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids")))
    one = rows.groupBy("sequence_id").agg(order.alias("p"), F.sum("length").alias("n_tokens"))
    full = F.concat(F.array_join(F.transform("p.ids", F.hex), ""))
    room = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(length - F.col("n_tokens"))
    pad = F.repeat(F.lit(pad_id.to_bytes(4, "little").hex().upper()), room.cast("int"))
    return one.select("sequence_id", "n_tokens", F.col("p.doc_id").alias("doc_ids"), F.col("p.start").alias("starts"), F.col("p.offset").alias("offsets"), F.unhex(F.concat(full, pad)).alias("ids"))


def op4_ffd_packing(spark, sf_dir):
    return packed_plan(table(spark, sf_dir, "documents"))
