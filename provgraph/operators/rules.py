"""Recommendation rules (RUL): each is a function from tables to rows (bundle_id, rule_id, severity, confidence, subject)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities in the order of the report.
SEVERITIES = ("warning", "suggestion", "info")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    find: Callable[[dict[str, DataFrame]], DataFrame]
    requires: tuple[str, ...] = ()


def finding(rows: DataFrame, severity: str, confidence: float, subject: Column) -> DataFrame:
    return rows.select("bundle_id", F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), subject.cast("string").alias("subject"))


# The contract's families of ambience processors, and name parts of de-essers and limiters.
AMBIENCE = ("Ambience",)
DEESSERS = ("de-esser", "deesser", "de esser", "sibilance")
LIMITERS = ("limiter", "maximizer", "brickwall")

# Bounds of the rules on long chains and on faders.
DENSE_CHAIN, LEVEL_SPREAD_DB = 6, 12.0

#: Roles of channels that no regular track has.
SHARED_ROLES = ("effect_return", "main_output")


def _processed(t: dict[str, DataFrame]) -> DataFrame:
    """(bundle_id, channel, family, name): a channel with each of its processors, the name in small letters."""
    runs = t["relationships"].where("rel_type = 'CHANNEL_PROCESSED_BY'").select("bundle_id", F.col("source").alias("channel"), F.col("target").alias("x"))
    processors = t["entities"].where("entity_type = 'PROCESSOR'").select("bundle_id", F.col("id").alias("x"), "family", F.lower("name").alias("name"))
    return runs.join(processors, ["bundle_id", "x"]).drop("x")


def _channels(t: dict[str, DataFrame], role: str) -> DataFrame:
    """(bundle_id, id, channel): tracks of a role with their channels."""
    used = t["relationships"].where("rel_type = 'TRACK_USES_CHANNEL'").select("bundle_id", F.col("source").alias("id"), F.col("target").alias("channel"))
    return t["entities"].where((F.col("entity_type") == "TRACK") & (F.col("role") == role)).select("bundle_id", "id").join(used, ["bundle_id", "id"])


def _ends(t: dict[str, DataFrame], end: str) -> DataFrame:
    """(bundle_id, channel): channels at one end of a send or route."""
    return t["relationships"].where("rel_type in ('CHANNEL_SENDS_TO', 'CHANNEL_ROUTES_TO')").select("bundle_id", F.col(end).alias("channel")).distinct()


def _named(parts: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, (F.col("name").contains(part) for part in parts))


def shared_ambience(t: dict[str, DataFrame]) -> DataFrame:
    """Two or more regular channels carry ambience processors, and two or more of them feed nothing; subject: how many those are."""
    shared = t["entities"].where(F.col("role").isin(*SHARED_ROLES)).select("bundle_id", F.col("id").alias("channel"))
    carriers = _processed(t).where(F.col("family").isin(*AMBIENCE)).select("bundle_id", "channel").distinct().join(shared, ["bundle_id", "channel"], "left_anti")
    counts = carriers.join(_ends(t, "source"), ["bundle_id", "channel"], "left_anti").groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"))
    return finding(counts.where("n >= 2"), "suggestion", 0.7, F.col("n"))


def unused_returns(t: dict[str, DataFrame]) -> DataFrame:
    """Returns and channels of bus tracks that carry processors though nothing feeds them; a row for each."""
    buses = t["entities"].where("role = 'effect_return'").select("bundle_id", F.col("id").alias("channel")).unionByName(_channels(t, "submix").drop("id"))
    busy = _processed(t).select("bundle_id", "channel")
    unused = buses.distinct().join(busy, ["bundle_id", "channel"], "left_semi").join(_ends(t, "target"), ["bundle_id", "channel"], "left_anti")
    return finding(unused, "info", 0.8, F.col("channel"))


def vocal_corrective_chain(t: dict[str, DataFrame]) -> DataFrame:
    """Vocal tracks whose channel has processors, none of which is named like a de-esser."""
    chains = _processed(t).groupBy("bundle_id", "channel").agg(F.coalesce(F.bool_or(_named(DEESSERS)), F.lit(False)).alias("has"))
    return finding(_channels(t, "vocal_source").join(chains.where("not has"), ["bundle_id", "channel"]), "suggestion", 0.55, F.col("id"))


def dense_chain(t: dict[str, DataFrame]) -> DataFrame:
    """Channels with more than DENSE_CHAIN processors."""
    rows = t["relationships"].where("rel_type = 'CHANNEL_PROCESSED_BY'").groupBy("bundle_id", "source").agg(F.count(F.lit(1)).alias("n"))
    return finding(rows.where(F.col("n") > DENSE_CHAIN), "info", 0.6, F.col("source"))


def level_imbalance(t: dict[str, DataFrame]) -> DataFrame:
    """Faders (bundle_id, id, volume_db) of two regular tracks lie further apart than LEVEL_SPREAD_DB; subject: the loudest, ties to the smaller id."""
    known = t["faders"].where("volume_db is not null").groupBy("bundle_id")
    rows = known.agg((F.max("volume_db") - F.min("volume_db")).alias("spread"), F.min_by("id", F.struct(-F.col("volume_db"), "id")).alias("id"))
    return finding(rows.where(F.col("spread") > LEVEL_SPREAD_DB), "suggestion", 0.5, F.col("id"))


def master_limiter_context(t: dict[str, DataFrame]) -> DataFrame:
    """Masters with a limiter in snapshots that loudness (bundle_id) doesn't name as measured."""
    masters = t["entities"].where("role = 'main_output'").select("bundle_id", F.col("id").alias("channel"))
    limited = masters.join(_processed(t).where(_named(LIMITERS)).select("bundle_id", "channel"), ["bundle_id", "channel"], "left_semi")
    return finding(limited.join(t["loudness"].select("bundle_id"), "bundle_id", "left_anti"), "info", 0.6, F.col("channel"))


#: Rules on entities and relationships alone, and those that read faders or loudness besides. The fields they require are the contract's.
DEFAULT = (
    Rule("core.shared_ambience", shared_ambience, ("plugin_chain", "bus_routing")),
    Rule("core.unused_returns", unused_returns, ("plugin_chain", "bus_routing")),
    Rule("core.vocal_corrective_chain", vocal_corrective_chain, ("plugin_chain",)),
    Rule("core.dense_chain", dense_chain, ("plugin_chain",)),
)
MIXER = (Rule("core.level_imbalance", level_imbalance, ("mixer_state",)), Rule("core.master_limiter_context", master_limiter_context, ("plugin_chain",)))


def run(rules: tuple[Rule, ...], tables: dict[str, DataFrame], hidden: DataFrame | None = None) -> DataFrame:
    """All findings; where a snapshot hides a field that a rule needs (hidden: bundle_id, field), one info row stands for the rule."""
    parts = []
    for rule in rules:
        rows = rule.find(tables).withColumn("rule_id", F.lit(rule.rule_id))
        if hidden is not None and rule.requires:
            blocked = hidden.where(F.col("field").isin(*rule.requires)).select("bundle_id").distinct()
            skipped = finding(blocked, "info", 1.0, F.lit("skipped")).withColumn("rule_id", F.lit(rule.rule_id))
            rows = rows.join(blocked, "bundle_id", "left_anti").unionByName(skipped)
        parts.append(rows)
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return reduce(DataFrame.unionByName, parts).withColumn("severity_rank", rank.cast("int"))
