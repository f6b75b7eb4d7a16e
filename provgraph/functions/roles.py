"""Roles from names (ROL): ordered keyword vocabularies, matched as runs of whole tokens.

A vocabulary is a table (role, priority, keyword), small by nature and checked to be; names come as a
column, so one broadcast join serves any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import equal, tokens

#: Rows of a vocabulary up to which it is broadcast.
SMALL = 10_000


def holds_run(words: Column, run: Column) -> Column:
    """Whether the tokens of run stand next to each other in words, each up to a plural s."""
    last = F.size(words) - F.size(run)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.exists(starts, lambda s: F.forall(F.zip_with(F.slice(words, s + 1, F.size(run)), run, lambda a, b: equal(a, b)), lambda ok: ok))


def keyword_roles(names: DataFrame, vocabulary: DataFrame, name: str = "name") -> DataFrame:
    """names with the role of the first keyword by priority (then the longer, then the smaller one), the keyword, and a confidence.

    Unmatched names are Unknown at 0.2; a keyword of several tokens is surer than one of a single token.
    """
    words = vocabulary.select("role", "priority", "keyword", tokens(F.col("keyword")).alias("_run"))
    words = F.broadcast(words) if vocabulary.count() <= SMALL else words
    own = names.select(name).distinct().withColumn("_words", tokens(F.col(name)))
    # a first token in common makes the join an equality join
    firsts = own.withColumn("_t", F.explode(F.array_distinct(F.flatten(F.transform("_words", lambda t: F.array(t, F.regexp_replace(t, "s$", "")))))))
    heads = words.withColumn("_t", F.explode(F.array_distinct(F.array(F.get("_run", F.lit(0)), F.regexp_replace(F.get("_run", F.lit(0)), "s$", "")))))
    hits = firsts.join(heads, "_t").where(holds_run(F.col("_words"), F.col("_run")))
    best = hits.groupBy(name).agg(F.min_by(F.struct("role", "keyword", F.size("_run").alias("size")), F.struct("priority", -F.size("_run"), "keyword")).alias("best"))
    out = names.join(best, name, "left")
    confidence = F.when(F.col("best").isNull(), 0.2).when(F.col("best.size") > 1, 0.85).otherwise(0.75)
    return out.select(*names.columns, F.coalesce("best.role", F.lit("Unknown")).alias("role"), F.col("best.keyword").alias("keyword"), confidence.alias("confidence"))


def processor_family(name: Column, chain: list[tuple[str, str]], known: Column | None = None) -> Column:
    """The family by an authoritative lookup if it has one, else by the first substring of the chain, else Other."""
    low = F.lower(name)
    return F.coalesce(*([known] if known is not None else []), *(F.when(low.contains(part), family) for part, family in chain), F.lit("Other"))


def name_trie(stock: DataFrame) -> DataFrame:
    """stock (entry, role, place) to the edges of a trie over tokens: prefix, token, child, and entry, role, place where child is a whole entry.

    Of entries with the same tokens the first by place counts. A role may be null: such an entry says that its name has none.
    """
    words = stock.select("entry", F.col("role").alias("role"), "place", tokens(F.col("entry")).alias("w")).where(F.size("w") > 0)
    upto = lambda n: F.array_join(F.slice("w", F.lit(1), n), " ")
    edges = words.select(F.explode(F.transform("w", lambda t, i: F.struct(upto(i).alias("prefix"), t.alias("token"), upto(i + 1).alias("child")))).alias("e")).select("e.*").distinct()
    ends = words.groupBy(F.array_join("w", " ").alias("child")).agg(F.min_by(F.struct("entry", "role", "place"), F.struct("place", "entry")).alias("end"))
    return edges.join(ends, "child", "left")


def stock_matches(names: DataFrame, stock: DataFrame, name: str = "name") -> DataFrame:
    """names with entry, stock_role, start and length of the longest stock name among their tokens; null where there is none.

    Every start of every distinct name walks the trie, a level a join, until nothing goes on; a longer entry
    shadows what it contains, also where it has no role. Of equally long ones the first by place counts, then the first start.
    """
    trie = name_trie(stock)
    levels = trie.agg(F.max(F.size(F.split("child", " ")))).first()[0] or 0
    trie = F.broadcast(trie) if trie.count() <= SMALL else trie
    found = names.select(name).distinct().withColumn("w", tokens(F.col(name))).where(F.size("w") > 0)
    none = F.lit(None).cast("struct<entry:string,role:string,place:bigint,length:int>")
    walk = found.select(name, "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1)).alias("start")).withColumn("prefix", F.lit("")).withColumn("best", none)
    for n in range(levels):
        step = trie.select("prefix", "token", "child", F.col("end.entry").alias("entry"), F.col("end.role").alias("role"), F.col("end.place").cast("bigint").alias("place"))
        walk = walk.withColumn("token", F.get("w", F.col("start") + n)).join(step, ["prefix", "token"], "left")
        here = F.when(F.col("entry").isNotNull(), F.struct("entry", "role", "place", F.lit(n + 1).alias("length")))
        walk = walk.select(name, "w", "start", F.col("child").alias("prefix"), F.coalesce(here, "best").alias("best")).where("prefix is not null or best is not null")
    longest = walk.where("best is not null").groupBy(name).agg(F.min_by(F.struct("best", "start"), F.struct(-F.col("best.length"), F.col("best.place"), F.col("start"))).alias("x"))
    return names.join(longest, name, "left").select(*names.columns, F.col("x.best.entry").alias("entry"), F.col("x.best.role").alias("stock_role"), F.col("x.start").alias("start"), F.col("x.best.length").alias("length"))
