"""Quality assurance of result tables: checks on rankings, issue histograms, run summaries and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import small

#: Points that an issue costs.
PENALTY = {"CRITICAL": 30, "HIGH": 15, "MEDIUM": 5, "LOW": 2}


def search_checks(results: DataFrame) -> DataFrame:
    """One row per query of results(query_id, group_key, rank_position, id, source_id, final_score, relevance_score): metrics, issues, score and passed.

    Where results carry published_at, date_from and date_to, date_match is the share that lies in its query's range."""
    order = Window.partitionBy("query_id", "group_key").orderBy("rank_position")
    rows = results.withColumn("rises", F.coalesce(F.lead("final_score").over(order) > F.col("final_score"), F.lit(False)))
    inside = F.lit(None).cast("int")
    if {"published_at", "date_from", "date_to"} <= set(results.columns):
        at, low, high = (F.col(c) for c in ("published_at", "date_from", "date_to"))
        inside = F.coalesce(at.isNotNull() & (low.isNull() | (at >= low)) & (high.isNull() | (at <= high)), F.lit(False)).cast("int")
    m = rows.groupBy("query_id").agg(
        F.count("*").alias("n"), F.round(F.avg("final_score"), 3).alias("mean_score"), F.min("final_score").alias("least"), F.max("final_score").alias("most"),
        F.count_if(F.col("relevance_score") >= 0.3).alias("relevant"), F.countDistinct("source_id").alias("sources"), F.countDistinct("id").alias("ids"), F.count_if("rises").alias("rises"),
        F.round(F.avg(inside), 3).alias("date_match"),
    )
    issue = lambda cond, severity, check: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check")))
    issues = F.array_compact(
        F.array(
            issue(F.col("n") < 3, "HIGH", "few_results"), issue(F.col("ids") < F.col("n"), "CRITICAL", "repeated_results"), issue(F.col("mean_score") < 30, "MEDIUM", "low_scores"),
            issue(F.col("relevant") < 0.5 * F.col("n"), "HIGH", "irrelevant"), issue(F.col("sources") < 0.3 * F.col("n"), "MEDIUM", "few_sources"), issue(F.col("rises") > 0, "LOW", "order"),
            issue((F.col("most") - F.col("least") < 1) & (F.col("n") > 5), "LOW", "flat_scores"),
        )
    )
    points = F.create_map(*(F.lit(v) for pair in PENALTY.items() for v in pair))
    cost = F.aggregate("issues", F.lit(0), lambda a, i: a + points[i.severity])
    out = m.withColumn("issues", issues).withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - cost)))
    return out.withColumn("passed", (F.col("score") >= 50) & ~F.exists("issues", lambda i: i.severity == "CRITICAL"))


def validated(tests: DataFrame, results: DataFrame) -> DataFrame:
    """One row per search test of tests(query_id, preset, limit, date, raw_count, terms): metrics of its results, issues (severity, check), score and passed.

    results(query_id, group_key, rank_position, final_score, title, body, source_name, published_at, popularity_score, credibility_score, url). terms are
    the lower-cased words of the query with their synonyms. A test without results fails with the score 0; points are taken off by severity, and some given for good
    scores, relevance and diversity."""
    held = results.join(small(tests.select("query_id", "date", "terms")), "query_id")
    order = Window.partitionBy("query_id", "group_key").orderBy("rank_position")
    text = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit(" "), F.lower(F.coalesce("body", F.lit(""))))
    days = F.floor((F.unix_micros("published_at") - F.unix_micros("date")) / 86_400_000_000)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    held = held.withColumns({"_rises": F.coalesce(F.lead("final_score").over(order) > F.col("final_score"), F.lit(False)), "_hit": F.exists("terms", lambda t: text.contains(t)), "_near": F.coalesce(F.abs(days) <= 3, F.lit(False))})
    ratio = lambda c: F.round(c / F.count("*"), 2)
    m = held.groupBy("query_id").agg(
        F.count("*").alias("n"), F.round(F.avg("final_score"), 1).alias("avg_score"), F.round(F.min("final_score"), 1).alias("min_score"), F.round(F.max("final_score"), 1).alias("max_score"),
        F.round(F.max("final_score") - F.min("final_score"), 1).alias("score_range"), ratio(F.count_if("_hit")).alias("relevance_ratio"), F.countDistinct(F.coalesce("source_name", F.lit(""))).alias("unique_sources"),
        ratio(F.countDistinct(F.coalesce("source_name", F.lit("")))).alias("diversity_ratio"), ratio(F.count_if("_near")).alias("date_match_ratio"), F.avg("popularity_score").alias("_popularity"),
        F.avg("credibility_score").alias("_credibility"), F.count_if(empty("title") | empty("body")).alias("_empty"), F.count_if(empty("url")).alias("_unlinked"), F.count_if("_rises").alias("_rises"),
    )
    rows = tests.join(m, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    some, latest = F.col("n") > 0, F.col("preset") == "latest"
    low, middle = F.when(latest, 20).otherwise(30), F.when(latest, 35).otherwise(50)
    issue = lambda cond, severity, check: F.when(cond, F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check")))
    issues = F.array_compact(
        F.array(
            issue(F.col("raw_count") == 0, "CRITICAL", "collection_empty"), issue((F.col("raw_count") > 0) & ~some, "HIGH", "pipeline_empty"),
            issue(some & (F.col("n") < F.col("limit")) & (F.col("raw_count") >= F.col("limit")), "MEDIUM", "insufficient_results"), issue(F.col("avg_score") < low, "HIGH", "low_avg_score"),
            issue((F.col("avg_score") >= low) & (F.col("avg_score") < middle), "MEDIUM", "mediocre_avg_score"), issue((F.col("relevance_ratio") < 0.3) & (F.size("terms") > 0), "HIGH", "low_relevance"),
            issue((F.col("n") >= 3) & (F.col("unique_sources") == 1), "MEDIUM", "no_diversity"), issue(F.col("date_match_ratio") < 0.5, "MEDIUM", "date_mismatch"),
            issue((F.col("preset") == "trending") & (F.col("_popularity") < 0.1), "LOW", "low_trending_popularity"), issue((F.col("preset") == "credible") & (F.col("_credibility") < 0.5), "MEDIUM", "low_credibility_in_credible_preset"),
            issue(F.col("_empty") > 0, "HIGH", "empty_content"), issue(F.col("_unlinked") > 0, "LOW", "missing_url"), issue(~latest & (F.col("_rises") > 0), "CRITICAL", "score_ordering"),
        )
    )
    points = F.create_map(*(F.lit(v) for pair in PENALTY.items() for v in pair))
    score = F.greatest(F.lit(0), 100 - F.aggregate("issues", F.lit(0), lambda a, i: a + points[i.severity]))
    for good, more in ((F.col("avg_score") >= 60, 10), (F.col("relevance_ratio") >= 0.5, 5), (F.col("diversity_ratio") >= 0.5, 5)):
        score = F.least(F.lit(100), score + F.when(good, more).otherwise(0))
    out = rows.withColumn("issues", issues).withColumn("score", F.when(some, score).otherwise(0))
    out = out.withColumn("passed", some & (F.col("score") >= 50) & ~F.exists("issues", lambda i: i.severity == "CRITICAL"))
    return out.select("query_id", "preset", *(c for c in m.columns if c[0] != "_" and c != "query_id"), "issues", "score", "passed")


def issue_counts(tests: DataFrame) -> DataFrame:
    """(by, issue, n) of tests(issues of severity and check): how often each check failed, and each with its severity."""
    each = tests.select(F.explode("issues").alias("i"))
    named = F.explode(F.array(F.struct(F.lit("check").alias("by"), F.col("i.check").alias("issue")), F.struct(F.lit("severity").alias("by"), F.concat_ws(":", "i.severity", "i.check").alias("issue")))).alias("k")
    return each.select(named).groupBy("k.by", "k.issue").agg(F.count("*").alias("n"))


def issue_histogram(runs: DataFrame, most: int = 20) -> DataFrame:
    """Issues by name before the colon, the most frequent; equal counts by name."""
    each = runs.select(F.explode("issues").alias("issue")).groupBy(F.element_at(F.split("issue", ":"), 1).alias("issue")).agg(F.count("*").alias("n"))
    return each.orderBy(F.desc("n"), "issue").limit(most)


def run_summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """Tests, successes, and mean score, characters and time over successes, by group and in all."""
    ok = lambda c: F.round(F.avg(F.when(F.col("success"), F.col(c))), 1)
    agg = [F.count("*").alias("tests"), F.count_if("success").alias("successes"), ok("score").alias("mean_score"), ok("chars").alias("mean_chars")]
    return runs.rollup(*by).agg(*agg)


def type_shares(runs: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Share of each type and its distance to the target."""
    goal = runs.sparkSession.createDataFrame(list(targets.items()), "news_type string, target double")
    n = runs.groupBy("news_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    out = n.join(F.broadcast(goal), "news_type", "left").join(F.broadcast(total))
    return out.select("news_type", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), F.round(F.col("n") / F.col("total") - F.coalesce("target", F.lit(0.0)), 4).alias("off"))


def compare_runs(a: DataFrame, b: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Full outer join of two summaries with the change of each value."""
    left = a.select(key, *(F.col(v).alias(f"{v}_before") for v in values))
    right = b.select(key, *(F.col(v).alias(f"{v}_after") for v in values))
    out = left.join(right, key, "full_outer")
    return out.withColumns({f"{v}_change": F.round(F.coalesce(f"{v}_after", F.lit(0)) - F.coalesce(f"{v}_before", F.lit(0)), 3) for v in values})


def batch_report(runs: DataFrame, by: str) -> DataFrame:
    """A row for each value of `by`, and one for all (`all` = 1), of runs(by, passed, error, score, issues): tests, passed, failed, errors,
    pass rate, mean score, and how often each of the ten most frequent issues occurs."""
    groups = runs.rollup(by).agg(
        F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"), F.count_if("error").alias("errors"),
        F.round(F.count_if("passed") / F.count("*") * 100, 1).alias("pass_rate"), F.round(F.avg("score"), 1).alias("mean_score"), F.grouping(by).alias("all"),
    )
    counts = runs.select(by, F.explode("issues").alias("issue")).groupingSets([[by, "issue"], ["issue"]], by, "issue").agg(F.count("*").alias("n"), F.grouping(by).alias("all"))
    order = Window.partitionBy("all", by).orderBy(F.desc("n"), "issue")
    top = counts.withColumn("k", F.row_number().over(order)).where("k <= 10").groupBy("all", by).agg(F.array_sort(F.collect_list(F.struct("k", "issue", "n"))).alias("top"))
    listed = top.select("all", by, F.array_join(F.transform("top", lambda t: F.concat_ws(":", t.issue, t.n.cast("string"))), ",").alias("issues"))
    joined = groups.join(listed, (groups["all"] == listed["all"]) & groups[by].eqNullSafe(listed[by]), "left")
    return joined.select(groups[by], groups["all"], "total", "passed", "failed", "errors", "pass_rate", "mean_score", F.coalesce("issues", F.lit("")).alias("issues"))


def run_rows(queries: DataFrame, found: DataFrame, made: DataFrame, least: int = 400) -> DataFrame:
    """One row per query: results found, characters made, success, issues of missing stages, and a score.

    found(query_id, ...) and made(query_id, chars, issues) are outputs of the stages; what is not there is an issue of its own."""
    searched = found.groupBy("query_id").agg(F.count("*").alias("search_count"))
    rows = queries.select("query_id").join(searched, "query_id", "left").join(made, "query_id", "left")
    none = F.array().cast("array<string>")
    stage = F.when(F.col("search_count").isNull(), F.array(F.lit("NO_SEARCH_RESULTS"))).when(F.col("chars").isNull(), F.array(F.lit("GENERATION_FAILED"))).otherwise(none)
    rows = rows.withColumn("issues", F.concat(stage, F.coalesce("issues", none))).withColumn("success", F.col("chars").isNotNull() & F.col("search_count").isNotNull())
    return rows.select("query_id", F.coalesce("search_count", F.lit(0)).alias("search_count"), F.coalesce("chars", F.lit(0)).alias("chars"), "success", "issues")


def image_counts(articles: DataFrame, kind: str) -> DataFrame:
    """Mean, least, most and number of articles by number of images, by kind and in all: articles(kind, images)."""
    stats = articles.rollup(kind).agg(F.count("*").alias("n"), F.round(F.avg("images"), 3).alias("mean"), F.min("images").alias("least"), F.max("images").alias("most"), F.grouping(kind).alias("all"))
    values = articles.groupingSets([[kind, "images"], ["images"]], kind, "images").agg(F.count("*").alias("held"), F.grouping(kind).alias("all"))
    listed = values.groupBy(kind, "all").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("images", "held"))), lambda v: F.concat_ws(":", v.images.cast("string"), v.held.cast("string"))), ",").alias("values"))
    return stats.join(listed, (stats["all"] == listed["all"]) & stats[kind].eqNullSafe(listed[kind])).select(stats[kind], stats["all"], "n", "mean", "least", "most", "values")
