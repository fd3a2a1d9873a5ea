"""Ranking of articles for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import news as rules
from ..storage import materialized, small
from . import scoring


def candidates(queries: DataFrame, news: DataFrame) -> DataFrame:
    """Articles in the date range of each query (undated ones pass) that hold no excluded keyword; one row per query and article.

    Queries are dealt to the days of their range that have articles, and to the undated ones, so days are the key of the join; times are compared within it.
    The queries are broadcast only if they are counted to be small."""
    ends = news.agg(F.to_date(F.min("published_at")).alias("low"), F.to_date(F.max("published_at")).alias("high")).first()
    undated = F.lit("0001-01-01").cast("date")
    days = F.array(undated)
    if ends.low is not None:
        start, end = F.greatest(F.to_date("date_from"), F.lit(ends.low)), F.least(F.to_date("date_to"), F.lit(ends.high))
        days = F.concat(days, F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>")))
    dealt = queries.withColumn("_day", F.explode(days))
    dated = F.col("published_at").isNull() | ((F.col("date_from").isNull() | (F.col("published_at") >= F.col("date_from"))) & (F.col("date_to").isNull() | (F.col("published_at") <= F.col("date_to"))))
    text = F.lower(F.concat_ws(" ", "title", "body"))
    banned = F.coalesce("exclude_keywords", F.array().cast("array<string>"))
    clean = (F.size(banned) == 0) | ~x.let(text, lambda t: F.exists(banned, lambda k: t.contains(F.lower(k))))
    return news.withColumn("_day", F.coalesce(F.to_date("published_at"), undated)).join(small(dealt, 500), "_day").where(dated & clean).drop("_day")


def final_score(preset: Column) -> Column:
    """0 to 100 by the weights of the preset: popularity, relevance, quality, credibility; equal weights for others."""
    parts = ("popularity_score", "relevance_score", "quality_score", "credibility_score")

    def total(weights: tuple[float, ...]) -> Column:
        out = F.lit(0.0)
        for name, w in zip(parts, weights):
            out = out + F.col(name) * w
        return out

    out = total((0.25,) * 4)
    for name, weights in rules.PRESETS.items():
        out = F.when(preset == name, total(weights)).otherwise(out)
    return F.round(F.round(out * 100, 6), 1)  # a sum that is a tie but for its last bits rounds as a tie


def policy(scored: DataFrame, integrity: float = 0.5, spam: float = 0.7, doubtful: float = 0.6) -> DataFrame:
    """Drops low integrity and spam; flags doubtful credibility."""
    kept = scored.where((F.col("integrity_score") >= integrity) & (F.col("spam_score") <= spam))
    return kept.withColumn("policy_flags", F.array_compact(F.array(F.when(F.col("credibility_score") < doubtful, "suspicious_credibility"))))


def order_of(preset: Column) -> list[Column]:
    latest = F.when(preset == "latest", F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0)))
    return [latest.desc(), F.when(preset != "latest", F.col("final_score")).desc(), F.col("ord").asc()]


def ranked(scored: DataFrame, most_per_source: int = 3, salts: int = 32) -> DataFrame:
    """Sorts each query's rows, keeps the first few of a source, and numbers those within offset and limit.

    With group_by the limit holds for each day or source of a query. If a query's rows all have one source_id, source_name tells sources apart.
    A query or source may hold most of the rows, so what can be among the first is found in salted parts before the ranks are made: the first
    few of a source in each part, and the first `offset + limit` of a group in each part. Every rank is that of the whole."""
    sets = scored.groupBy("query_id").agg(F.count("*").alias("_rows"), F.min("source_id").alias("_low"), F.max("source_id").alias("_high"))
    rows = scored.join(small(materialized(sets, "query-sets")), "query_id")
    key = F.when((F.col("_low") == F.col("_high")) & (F.col("_rows") > 1), F.col("source_name")).otherwise(F.col("source_id"))
    group = F.when(F.col("group_by") == "day", F.date_format("published_at", "yyyy-MM-dd")).when(F.col("group_by") == "source", F.col("source_id")).otherwise("")
    rows = rows.withColumns({"_key": F.coalesce(key, F.lit("")), "group_key": F.coalesce(group, F.lit("")), "_salt": F.pmod(F.xxhash64("id"), F.lit(salts))})
    order = order_of(F.col("preset"))

    def first(df: DataFrame, by: list[str], most: int) -> DataFrame:
        """The first rows of each group: of each salted part, then of the whole; a literal bound, which Spark cuts to before it shuffles."""
        for keys in ([*by, "_salt"], by):
            df = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
        return df

    most = scored.agg(F.max(F.col("offset") + F.col("limit"))).first()[0] or 0
    diverse = first(rows.where("diversity"), ["query_id", "_key"], most_per_source).unionByName(rows.where("not coalesce(diversity, false)"))
    out = first(diverse, ["query_id", "group_key"], most)
    out = out.withColumn("rank_position", F.row_number().over(Window.partitionBy("query_id", "group_key").orderBy(*order)))
    kept = out.where((F.col("rank_position") > F.col("offset")) & (F.col("rank_position") <= F.col("offset") + F.col("limit")))
    return kept.drop("_rows", "_low", "_high", "_key", "_salt")


def score_articles(news: DataFrame, r: rules.Rules = rules.KOREAN, registry: DataFrame | None = None) -> DataFrame:
    """What does not depend on the query: integrity, trust, evidence, sensationalism, quality."""
    return scoring.with_quality(scoring.with_integrity(news, r), r, registry)


def rank(queries: DataFrame, news: DataFrame, as_of: Column, r: rules.Rules = rules.KOREAN, registry: DataFrame | None = None) -> DataFrame:
    """The whole job: candidates, scores, policy, order, diversity, limits."""
    news = materialized(news, "news")
    scored = score_articles(news, r, registry)
    crossed = scored.join(scoring.cross_counts(news), "id", "left")
    crossed = crossed.withColumn("credibility_score", scoring.credibility(F.col("trust"), F.coalesce("cross_count", F.lit(0))))
    crossed = materialized(crossed, "scored-articles")
    rows = candidates(queries.join(small(scoring.expanded_terms(queries, r)), "query_id", "left"), crossed)
    relevance = F.when(F.coalesce(F.size("keywords"), F.lit(0)) > 0, scoring.keyword_relevance()).otherwise(scoring.plain_relevance())
    # what needs the text is computed once, and candidates are written without it
    rows = materialized(rows.withColumn("relevance_score", relevance).drop("body", "terms"), "candidates")
    rows = scoring.with_popularity(rows, ["query_id"], as_of)
    return ranked(materialized(policy(rows.withColumn("final_score", final_score(F.col("preset")))), "scored-candidates"))


def source_score(keywords: list[str], newsworthy: tuple[str, ...] = rules.NEWSWORTHY_TITLES) -> Column:
    """Points of an article as a source: keywords in title and lead, newsworthy words, quality, credibility and length."""
    title, lead = F.lower("title"), F.lower(F.substring(F.coalesce("body", F.lit("")), 1, 300))
    low = [k.lower() for k in keywords]
    score = 50 * x.count_contained(title, low) + 10 * x.count_contained(lead, low) + F.when(x.contains_any(title, newsworthy), 30).otherwise(0)
    return score + 10 * F.col("quality_score") + 10 * F.col("credibility_score") + F.least(F.length(F.coalesce("body", F.lit(""))) / 100, F.lit(10.0))


def best_source(news: DataFrame, topic: str, keywords: list[str], newsworthy: tuple[str, ...] = rules.NEWSWORTHY_TITLES, score: Column | None = None) -> DataFrame:
    """One article per topic, by its points as a source; the first of equals. score is a column that has these points, where news has no bodies any more."""
    score = source_score(keywords, newsworthy) if score is None else score
    best = F.max_by(F.struct("id", F.round(score, 3).alias("score")), F.struct(F.round(score, 6), -F.col("ord")))
    return news.groupBy(topic).agg(best.alias("best")).select(topic, "best.id", "best.score")
