"""The registry of sources: load, filters, statistics, and health from a log of fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rules import formats
from ..rules import news as rules
from ..storage import small

#: Failures in a row after which a source is inactive.
MOST_FAILURES = 5


def load(rows: DataFrame) -> DataFrame:
    """Rows of a rule file with defaults for what they leave out."""
    base = F.lit(0.5)
    for tier, value in rules.TIER_TRUST.items():
        base = F.when(F.col("tier") == tier, value).otherwise(base)
    out = rows.withColumn("tier", F.coalesce("tier", F.lit("tier2")))
    return out.withColumns(
        {"ingestion_type": F.coalesce("ingestion_type", F.lit("rss")), "credibility_base_score": F.coalesce("credibility_base_score", base * 100), "is_active": F.coalesce("is_active", F.col("tier") != "blacklist")}
    )


def select(sources: DataFrame, tier: str | None = None, ingestion_type: str | None = None, category: str | None = None, locale: str | None = None, active: bool = True, verified: bool = False) -> DataFrame:
    out = sources.where("is_active") if active else sources
    if verified:
        out = out.where(F.col("tier").isin("whitelist", "tier1"))
    for name, value in (("tier", tier), ("ingestion_type", ingestion_type)):
        out = out.where(F.col(name) == value) if value else out
    for name, value in (("supported_categories", category), ("supported_locales", locale)):
        out = out.where(F.array_contains(name, value)) if value else out
    return out.orderBy(F.desc("credibility_base_score"), "source_id")


def stats(sources: DataFrame) -> DataFrame:
    """Counts of all and of active sources, by tier, by ingestion type, and together."""
    return sources.groupingSets([["tier"], ["ingestion_type"], []], "tier", "ingestion_type").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))


def health(log: DataFrame, most: int = MOST_FAILURES, reactivations: DataFrame | None = None) -> DataFrame:
    """log(source_id, ts, ok, ord) to failures in a row at the end of the log, and whether the source is still active.

    `most` failures in a row make a source inactive, and no later success revives it: only a row of reactivations(source_id, ts, ord) does, which
    also sets its failures back to none. So the longest run of failures after the last reactivation decides. All are aggregates and runs by
    day, so that a source with most of the log is no hot task."""
    place, log = F.struct("ts", "ord"), log.select("source_id", "ts", "ok", "ord")
    own = log.groupBy("source_id").agg(F.count("*").alias("fetches"), F.count_if(~F.col("ok")).alias("failures"))
    since = log
    if reactivations is not None:
        back = reactivations.groupBy("source_id").agg(F.max(place).alias("back"))
        since = log.join(back, "source_id", "left").where(F.col("back").isNull() | (place > F.col("back"))).drop("back")
    last = since.where("ok").groupBy("source_id").agg(F.max(place).alias("success"))
    tail = since.join(last, "source_id", "left").where(~F.col("ok") & (F.col("success").isNull() | (place > F.col("success")))).groupBy("source_id").agg(F.count("*").alias("failure_count"))
    worst = longest_failures(since).select("source_id", F.col("longest").alias("worst"))
    out = own.join(last.select("source_id", F.col("success.ts").alias("last_success")), "source_id", "left").join(tail, "source_id", "left").join(worst, "source_id", "left")
    out = out.withColumn("failure_count", F.coalesce("failure_count", F.lit(0)))
    return out.withColumn("is_active", F.coalesce("worst", F.lit(0)) < most).drop("worst")


def reactivated(sources: DataFrame, ids: Column) -> DataFrame:
    """Sources of the given ids become active with no failures, but never blacklisted ones."""
    hit = ids & (F.col("tier") != "blacklist")
    return sources.withColumns({"is_active": F.col("is_active") | hit, "failure_count": F.when(hit, 0).otherwise(F.col("failure_count"))})


def usage(log: DataFrame, unit: str = "hour") -> DataFrame:
    """Requests per source and minute, hour or day."""
    return log.groupBy("source_id", F.date_trunc(unit, "ts").alias("slot")).agg(F.count("*").alias("requests"))


def over_limit(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Slots in which a source made more requests than limits(source_id, per_minute, per_hour, per_day) allow.

    Limits have a row for each source, so they join by its id, and are broadcast only where they are small."""
    out = None
    for unit, name in (("minute", "per_minute"), ("hour", "per_hour"), ("day", "per_day")):
        allowed = limits.select(F.col("source_id").alias("_source"), F.col(name).alias("allowed"))
        part = usage(log, unit).join(allowed, F.col("source_id").eqNullSafe(F.col("_source"))).drop("_source").where("requests > allowed").withColumn("unit", F.lit(unit))
        out = part if out is None else out.unionByName(part)
    return out


def longest_failures(log: DataFrame) -> DataFrame:
    """(source_id, longest): the longest run of failures in order of time.

    Runs are found within each day of a source, then days are put together from their first, last and longest runs, so that a
    source with most of the log is spread over its days."""
    day = F.to_date("ts")
    w = Window.partitionBy("source_id", "day").orderBy("ts", "ord")
    rows = log.withColumn("day", day).withColumn("run", F.sum(F.col("ok").cast("int")).over(w))
    runs = rows.groupBy("source_id", "day", "run").agg(F.count_if(~F.col("ok")).alias("n"))
    days = runs.groupBy("source_id", "day").agg(F.max("run").alias("successes"), F.max("n").alias("longest"), F.max_by("n", F.col("run")).alias("last"), F.max(F.when(F.col("run") == 0, F.col("n"))).alias("first"))
    # a day without success is one run that goes on; a block of days ends with a day that has a success
    by_day = Window.partitionBy("source_id").orderBy("day")
    before = by_day.rowsBetween(Window.unboundedPreceding, -1)
    block = days.withColumn("block", F.coalesce(F.sum((F.col("successes") > 0).cast("int")).over(before), F.lit(0)))
    carried = F.sum(F.when(F.col("successes") > 0, F.coalesce("first", F.lit(0))).otherwise(F.col("longest")))
    joined = block.groupBy("source_id", "block").agg(carried.alias("over"), F.max(F.when(F.col("successes") > 0, F.col("last"))).alias("tail"), F.max("longest").alias("within"))
    next_ = joined.withColumn("over", F.col("over") + F.coalesce(F.lag("tail").over(Window.partitionBy("source_id").orderBy("block")), F.lit(0)))
    out = next_.groupBy("source_id").agg(F.max(F.greatest("over", "within")).alias("longest"))
    return out.where("longest > 0")


def outlet(url: Column, names: dict[str, str] = formats.DOMAIN_NAMES) -> Column:
    """The name of the outlet of an address, its domain if that is not known; fixed names without an address or domain."""
    domain = F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)
    known = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))
    return F.when(F.coalesce(url, F.lit("")) == "", "네이버 뉴스").when(domain == "", "Unknown").otherwise(F.coalesce(known[domain], domain))


def inferred_tier(name: Column, first: tuple[str, ...] = formats.FIRST_TIER, second: tuple[str, ...] = formats.SECOND_TIER) -> Column:
    return F.when(name.isin(*first), "tier1").when(name.isin(*second), "tier2").otherwise("tier3")


def known_tier(name: Column, tiers: dict[str, str] = formats.KNOWN_TIERS) -> Column:
    return F.coalesce(F.create_map(*(F.lit(v) for pair in tiers.items() for v in pair))[name], F.lit("tier2"))


def with_source(news: DataFrame, sources: DataFrame) -> DataFrame:
    """news with tier and credibility_base_score of its source where the registry has it; else source_tier stays and the score is null."""
    own = sources.select("source_id", F.col("tier").alias("_tier"), "credibility_base_score")
    out = news.join(small(own), "source_id", "left")
    return out.withColumn("source_tier", F.coalesce("_tier", "source_tier")).drop("_tier")
