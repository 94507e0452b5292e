"""Attributes as known at event time: sharded as-of merge with carry-in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut


DAY = 86_400_000_000


def attach_as_of(
    events: DataFrame, versions: DataFrame, *, entity: str, event_time: str, version_entity: str, version_time: str, rank: Column, payload: str, shard_days: int = 92, hot_rows: int = 250_000,
) -> DataFrame:
    """Add to each event the greatest version (by `rank`) of its entity with version_time strictly earlier.

    `rank` is an orderable column of versions (a struct for several criteria) and becomes column `payload`,
    NULL where there is none. Every entity is cut into time shards of shard_days before anything is shuffled:
    rows are distributed by (entity, shard), never by the entity alone. Each shard gets one carry-in row, the
    greatest version of all earlier shards, found from one pre-aggregated row an (entity, shard): an entity has
    at most as many as the calendar has shards. So shards merge independently and the result doesn't depend
    on the cuts. A shard with more than hot_rows events is dealt out further: its events by their own hash,
    its versions and carry-in to all parts; the list of such shards holds at most one row for every hot_rows
    events. Events without entity or time get NULL; versions without them are never known. All columns of
    events but one called `payload` are kept; repeated events stay repeated.
    """
    base = [c for c in events.columns if c != payload]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shard = F.floor(F.col("_u") / F.lit(shard_days * DAY))
    key = ["_e", "_shard"]
    e = events.filter(F.col(entity).isNotNull() & F.col(event_time).isNotNull()).select(F.col(entity).alias("_e"), micros(event_time).alias("_u"), F.struct(*base).alias("_row")).withColumn("_shard", shard)
    v = versions.filter(F.col(version_entity).isNotNull() & F.col(version_time).isNotNull()).select(F.col(version_entity).alias("_e"), micros(version_time).alias("_u"), rank.alias("_r")).withColumn("_shard", shard)
    # per shard: its events and its greatest version; what came before is the running maximum over an entity's shards
    per_shard = e.select(*key, F.lit(1).alias("_n"), F.lit(None).cast(v.schema["_r"].dataType).alias("_r")).unionByName(v.select(*key, F.lit(0).alias("_n"), "_r")).groupBy(*key).agg(F.sum("_n").alias("_n"), F.max("_r").alias("_m"))
    before = W.partitionBy("_e").orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    known = cut(per_shard.withColumn("_r", F.max("_m").over(before)).select(*key, "_n", "_r"))
    hot = known.filter(F.col("_n") > hot_rows).select(*key, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_parts"))
    carry = known.filter("_r is not null and _n > 0").select(*key, F.lit(None).cast("long").alias("_u"), "_r")
    sides = v.select(*key, "_u", "_r").unionByName(carry).withColumn("_row", F.lit(None).cast(e.schema["_row"].dataType))
    e = e.withColumn("_r", F.lit(None).cast(v.schema["_r"].dataType))
    if hot.isEmpty():
        by = key
    else:
        by = [*key, "_part"]
        e = e.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64("_row"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
        sides = sides.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    merged = e.select(*by, "_u", "_r", "_row").unionByName(sides.select(*by, "_u", "_r", "_row"))
    # at equal times events come first, so that only strictly earlier versions are seen; carry-in rows have no time and lead
    in_time = W.partitionBy(*by).orderBy(F.asc_nulls_first("_u"), F.col("_row").isNull()).rowsBetween(W.unboundedPreceding, W.currentRow)
    done = merged.withColumn("_known", F.max("_r").over(in_time)).filter("_row is not null").select("_row.*", F.col("_known").alias(payload))
    lost = events.filter(F.col(entity).isNull() | F.col(event_time).isNull()).select(*base)
    return done.unionByName(lost, allowMissingColumns=True)


def account_knowledge(accounts: DataFrame, selections: DataFrame, macro: DataFrame, shard_days: int = 92, hot_rows: int = 250_000) -> DataFrame:
    """Each monthly_account key with the macro vintage and lambda selection known at its decision.

    Repeated rows count once; of differing rows with one key the one with the greatest decision counts.
    vintage_month is '' and selection_id -1 where nothing was known, also for a NULL decision_at.
    """
    keys = ["run_id", "holding_month", "strategy_id"]
    a = accounts.groupBy(*keys).agg(F.max(F.struct("decision_at", "signal_series")).alias("x")).select(*keys, "x.*")
    releases = macro.filter("series is not null").groupBy("series", "vintage_month").agg(F.min("assumed_available_at").alias("at"))
    s = selections.filter("selection_end_at is not null").groupBy("run_id", "selection_id").agg(F.max("selection_end_at").alias("at"))
    a = attach_as_of(a, releases, entity="signal_series", event_time="decision_at", version_entity="series", version_time="at", rank=F.col("vintage_month"), payload="known_vintage", shard_days=shard_days, hot_rows=hot_rows)
    a = attach_as_of(a, s, entity="run_id", event_time="decision_at", version_entity="run_id", version_time="at", rank=F.struct("at", "selection_id"), payload="known_selection", shard_days=shard_days, hot_rows=hot_rows)
    return a.select(*keys, "decision_at", "signal_series", F.coalesce("known_vintage", F.lit("")).alias("vintage_month"), F.coalesce("known_selection.selection_id", F.lit(-1)).cast("long").alias("selection_id"))
