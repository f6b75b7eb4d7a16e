"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text, its white space normalised, is cut where its content says so; a chunk becomes an identifier
that its SHA-256 verifies; texts are equal when their ordered identifier lists are. Only identifiers
are shuffled, never texts.

Defined results: a null text counts as empty, empty texts equal one another; a null doc_id sorts
last among a group's ids; of repeated rows with one doc_id a single row stays; other columns of the
input are neither read nor needed; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, own_columns, scope, table, written

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def cut(text: Column, least: int = 256, most: int = 4096, edge: str = "[aeinst] [a-d]") -> Column:
    """Chunks of least to most code points that end where edge matches; they concatenate to text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{least},{most}}}?(?:{edge})|.{{1,{most}}}"), F.lit(0))


def recipes(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """(uid, doc_id, text_sha256, chunks ARRAY<STRUCT<h, d>>): a fingerprint and a digest for each chunk."""
    row = F.col(uid) if uid else F.monotonically_increasing_id()
    rows = docs.select(row.alias("uid"), "doc_id", normalised().alias("_t"))
    digest = lambda c: F.struct(F.xxhash64(c).alias("h"), F.unhex(F.sha2(c, 256)).alias("d"))
    return rows.select("uid", "doc_id", F.sha2("_t", 256).alias("text_sha256"), F.transform(cut(F.col("_t")), digest).alias("chunks"))


def chunk_store(cuts: DataFrame) -> DataFrame:
    """(h, d, rank, copies): distinct chunk contents. Contents that share a fingerprint get ranks 1, 2, ..."""
    distinct = cuts.groupBy("h", "d").agg(F.count(F.lit(1)).alias("copies"))
    return distinct.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("d")))


def identifier_lists(recipe: DataFrame) -> DataFrame:
    """(uid, ids): each recipe's ordered list of verified identifiers (h, rank)."""
    cuts = recipe.select("uid", F.posexplode("chunks").alias("pos", "c")).select("uid", "pos", "c.h", "c.d")
    clashes = chunk_store(cuts).where("rank > 1").select("h", "d", "rank")
    named = cuts.join(clashes, ["h", "d"], "left").select("uid", F.struct("pos", "h", F.coalesce("rank", F.lit(1)).alias("rank")).alias("c"))
    ids = F.transform(F.sort_array(F.collect_list("c")), lambda c: F.struct(c["h"].alias("h"), c["rank"].alias("rank")))
    return named.groupBy("uid").agg(ids.alias("ids"))


def dedup_groups(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """One row per input row: uid, doc_id, keep_id, group_size, kept, text_sha256. uid: a column that tells rows apart."""
    with scope(docs.sparkSession):
        recipe = written(recipes(docs, uid), "recipes")
        lists = identifier_lists(recipe)
        rows = recipe.select("uid", "doc_id", "text_sha256").join(lists, "uid", "left")
        none = F.array().cast(lists.schema["ids"].dataType)
        rows = written(rows.withColumn("ids", F.coalesce("ids", none)), "lists", result=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "uid"))
    # written, so that the join below has exchanges of its own and a hot group's rows can be split
    groups = written(rows.groupBy("ids").agg(first.alias("f"), F.count(F.lit(1)).alias("group_size")), "groups", result=True)
    out = rows.join(groups, "ids")
    return out.select("uid", "doc_id", F.col("f.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("f.uid")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all columns of docs."""
    uid = fresh("uid", docs)
    rows = written(docs.withColumn(uid, F.monotonically_increasing_id()), "documents")
    kept = dedup_groups(rows, uid).where("kept").select(F.col("uid").alias(uid))
    return rows.join(kept, uid, "left_semi").select(*own_columns(docs))


def op8_chunk_dedup(spark, sf_dir):
    return dedup_groups(table(spark, sf_dir, "documents")).drop("uid")


OP8_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n
"""
