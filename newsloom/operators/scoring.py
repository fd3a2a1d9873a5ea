"""Integrity, credibility, evidence, popularity, freshness and relevance of articles, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import news as rules
from ..storage import materialized, small
from .similarity import by_class, similarity_edges

Rules = rules.Rules


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def paragraphs(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda s: F.trim(s)), lambda p: p != "")


def consistency(r: Rules = rules.KOREAN) -> Column:
    """Share of title entities in the body, less a fifth of how much title words crowd in one of the first five paragraphs."""
    title, body = _text("title"), _text("body")
    parts = F.struct(
        x.entities(title, r.entities).alias("names"), F.array_distinct(F.filter(x.words(F.lower(title)), lambda w: F.length(w) > 2)).alias("words"),
        F.transform(F.slice(paragraphs(body), 1, 5), lambda p: F.lower(p)).alias("few"), F.lower(body).alias("low"),
    )

    def found(p: Column) -> Column:
        share = F.size(F.filter(p.names, lambda e: p.low.contains(F.lower(e)))) / F.greatest(F.size(p.names), F.lit(1))
        return F.struct(share.alias("share"), F.transform(p.few, lambda t: F.size(F.filter(p.words, lambda w: t.contains(w)))).alias("hits"), F.size(p.names).alias("names"), ((F.size(p.few) == 0) | (F.size(p.words) == 0)).alias("bare"))

    def value(p: Column) -> Column:
        total = F.aggregate(p.hits, F.lit(0), lambda a, h: a + h)
        crowd = F.array_max(p.hits) / F.greatest(total, F.lit(1))
        return F.when(p.names == 0, 1.0).when(p.bare, p.share).when(total == 0, p.share * 0.5).otherwise(F.least(F.lit(1.0), p.share * (1 - crowd * 0.2)))

    return F.when((title == "") | (body == ""), 0.5).otherwise(x.let(parts, lambda p: x.let(found(p), value)))


def neighbour_similarities(r: Rules = rules.KOREAN) -> Column:
    """Jaccard of the keywords of neighbouring paragraphs, the first ten; pairs without keywords are left out."""
    keys = F.transform(F.slice(paragraphs(_text("body")), 1, 10), lambda p: F.array_distinct(x.keywords(p, r.stop_words)))

    def compared(k: Column) -> Column:
        n = F.greatest(F.size(k) - 1, F.lit(0))
        both = F.zip_with(F.slice(k, F.lit(1), n), F.slice(k, F.lit(2), n), lambda a, b: F.struct(F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("either")))
        return F.transform(F.filter(both, lambda p: p.either > 0), lambda p: p.both / p.either)

    return x.let(keys, compared)


def contamination(sims: Column) -> Column:
    """Struct of score and flag."""

    def judged(s: Column) -> Column:
        mean = F.aggregate(s, F.lit(0.0), lambda a, v: a + v) / F.size(s)
        low = F.size(F.filter(s, lambda v: v < 0.2))
        return F.when(F.coalesce(F.size(s), F.lit(0)) == 0, 0.0).when(mean < 0.3, 0.7).when(low > F.size(s) * 0.5, 0.5).otherwise(0.0)

    flag = lambda score: F.when(score == 0.7, "unrelated_topics").when(score == 0.5, "inconsistent_topics")
    return x.let(x.let(sims, judged), lambda score: F.struct(score.alias("score"), flag(score).alias("flag")))


def repeats(body: Column) -> Column:
    """Over 0.3 of at least three sentences occurred before."""
    parts = F.filter(F.transform(F.split(body, r"\."), lambda s: F.trim(s)), lambda s: s != "")
    return x.let(parts, lambda p: (F.size(p) >= 3) & (1 - F.size(F.array_distinct(p)) / F.size(p) > 0.3))


def spam_parts(r: Rules = rules.KOREAN) -> dict[str, tuple[Column, float]]:
    low = F.lower(F.concat(_text("body"), F.lit(" "), _text("title")))

    def thin(words: Column) -> Column:
        dense = F.size(F.filter(words, lambda w: ~w.isin(*r.function_words) & (F.length(w) > 1)))
        return (F.size(words) > 0) & (dense / F.greatest(F.size(words), F.lit(1)) < 0.4)

    title = _text("title").rlike("|".join(f"(?:{p})" for p in r.sensational_titles))
    return {
        "repetitive_content": (repeats(_text("body")), 0.3),
        "ad_content": (x.let(low, lambda t: x.contains_any(t, r.ads)), 0.3),
        "illegal_content": (x.let(low, lambda t: x.contains_any(t, r.illegal)), 0.5),
        "low_content_quality": (x.let(x.words(low), thin), 0.2),
        "sensational_title": (title, 0.1),
    }


def with_integrity(news: DataFrame, r: Rules = rules.KOREAN) -> DataFrame:
    """Adds title_body_consistency, contamination_score, spam_score, integrity_flags and integrity_score."""
    parts = spam_parts(r)
    marks = F.array(*(F.when(flag, name) for name, (flag, _) in parts.items()))
    weights = F.create_map(*(F.lit(v) for name, (_, w) in parts.items() for v in (name, w)))

    def whole(p: Column) -> Column:
        spam = F.least(F.lit(1.0), F.aggregate(p.marks, F.lit(0.0), lambda a, m: a + weights[m]))
        score = 0.4 * p.consistency + 0.3 * (1 - p.contamination.score) + 0.3 * (1 - spam)
        flags = F.concat(F.array_compact(F.array(p.contamination.flag)), p.marks)
        return F.struct(
            F.round(p.consistency, 3).alias("title_body_consistency"), F.round(p.contamination.score, 3).alias("contamination_score"), F.round(spam, 3).alias("spam_score"), flags.alias("integrity_flags"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("integrity_score"),
        )

    one = F.struct(consistency(r).alias("consistency"), contamination(neighbour_similarities(r)).alias("contamination"), F.array_compact(marks).alias("marks"))
    # inline() gives the columns once, where a projection would repeat their expressions
    return news.select("*", F.inline(F.transform(F.array(one), lambda p: whole(p))))


def trust(registry: DataFrame | None = None) -> Column:
    return x.by_tier(F.col("source_tier"), rules.TIER_TRUST, 0.5)


def with_quality(news: DataFrame, r: Rules = rules.KOREAN, registry: DataFrame | None = None) -> DataFrame:
    """Adds trust (of the registry(source_id, credibility_base_score), else of the tier), evidence_score, sensationalism_penalty and quality_score."""
    body, title = _text("body"), _text("title")
    found = F.lit(0)
    for p in r.evidence:
        found = found + body.rlike(p).cast("int")
    base = x.by_tier(F.col("source_tier"), rules.TIER_EVIDENCE, 0.1)
    evidence = F.when(body == "", 0.3).otherwise(F.least(F.lit(1.0), base + F.least(F.lit(1.0), found * 0.15) + F.least(F.lit(0.3), F.length(body) / 3000)))
    loud = F.least(F.lit(0.5), x.count_contained(F.lower(title), r.sensational_words) * 0.15)
    loud = loud + F.least(F.lit(0.2), F.regexp_count(title, F.lit(r"[!?]{2,}|[ㅋㅎ]{2,}")) * 0.1)
    own = trust()
    if registry is not None:
        news = news.join(small(registry.select("source_id", "credibility_base_score")), "source_id", "left")
        own = F.coalesce(F.col("credibility_base_score") / 100.0, own)
    out = news.withColumns({"trust": own, "_evidence": evidence, "_loud": F.least(F.lit(1.0), loud)})
    out = out.withColumns(
        {
            "evidence_score": F.round("_evidence", 3), "sensationalism_penalty": F.round("_loud", 3),
            "quality_score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_evidence") - F.col("_loud"))), 3),
        }
    )
    return out.drop("_evidence", "_loud", *(["credibility_base_score"] if registry is not None else []))


def cross_counts(news: DataFrame, least: int = 3) -> DataFrame:
    """(id, cross_count): titles of other sources with a Jaccard similarity of at least 0.5, of articles with a title of `least` distinct words or more.

    Equal titles are counted as one class by source, so that copies make no pairs."""
    items = news.select(F.lit(0).alias("grp"), "id", "ord", "source_id", x.words(F.lower(_text("title"))).alias("tokens"))
    classes, members = by_class(items)
    classes = materialized(classes, "classes")
    members = members.join(items.select("id", "source_id", F.size(F.array_distinct("tokens")).alias("n")), "id").where("n > 0")
    held = members.groupBy("first", "source_id").agg(F.count("*").alias("held"))
    pairs = similarity_edges(classes, 1, 2).select("a", "b")
    both = pairs.union(pairs.select("b", "a")).union(classes.select("id", F.col("id").alias("b"))).toDF("first", "other")
    near = both.join(held.withColumnRenamed("first", "other"), "other").groupBy("first", "source_id").agg(F.sum("held").alias("own"))
    total = near.groupBy("first").agg(F.sum("own").alias("total"))
    out = members.where(F.col("n") >= least).join(near, ["first", "source_id"]).join(total, "first")
    return out.select("id", (F.col("total") - F.col("own")).alias("cross_count")).where("cross_count > 0")


def credibility(own: Column, cross_count: Column) -> Column:
    bonus = F.when(cross_count >= 3, 0.15).when(cross_count >= 1, 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), own + bonus), 3)


def hours(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 3.6e9


def batch_limits(news: DataFrame, by: list[str]) -> DataFrame:
    """Of each batch: the largest views, shares and comments (1 if all are 0), and the latest time."""
    top = lambda c: F.greatest(F.max(F.coalesce(F.col(c), F.lit(0))), F.lit(1))
    return news.groupBy(*by).agg(top("view_count").alias("max_views"), top("share_count").alias("max_shares"), top("comment_count").alias("max_comments"), F.max("published_at").alias("latest"))


def with_popularity(news: DataFrame, by: list[str], as_of: Column, half_life: float = 24.0) -> DataFrame:
    """Adds freshness, popularity_score and trending_velocity of each batch.

    A batch whose latest article is seven days old or more is judged from that article on, not from as_of."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = news.join(materialized(batch_limits(news, by), "batch-limits"), by)  # Spark broadcasts what is written small
    old = F.floor((F.unix_micros(as_of) - F.unix_micros("latest")) / 86_400_000_000) >= 7
    since = F.when(old, F.col("latest")).otherwise(as_of)
    fresh = F.when(F.col("published_at").isNull(), 0.3).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), hours(since, F.col("published_at"))) / half_life))
    metric = 0.4 * zero("view_count") / F.col("max_views") + 0.35 * zero("share_count") / F.col("max_shares") + 0.25 * zero("comment_count") / F.col("max_comments")
    none = (zero("view_count") == 0) & (zero("share_count") == 0) & (zero("comment_count") == 0)
    popular = F.when(none, F.greatest(F.lit(0.3), fresh)).otherwise(metric)
    pull = zero("view_count") + 3 * zero("share_count") + 2 * zero("comment_count")
    speed = F.when(F.col("published_at").isNull(), 0.0).otherwise(F.least(F.lit(1.0), pull / F.greatest(F.lit(1.0), hours(as_of, F.col("published_at"))) / 10000))
    return out.withColumns({"freshness": F.round(fresh, 3), "popularity_score": F.round(F.least(F.lit(1.0), popular), 3), "trending_velocity": F.round(speed, 3)}).drop("max_views", "max_shares", "max_comments", "latest")


def plain_relevance() -> Column:
    """Without keywords: half, more with a category, tags and a body over 100 characters."""
    base = 0.5 + F.when(_text("category") != "", 0.2).otherwise(0.0) + F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), base + F.when(F.length(_text("body")) > 100, 0.1).otherwise(0.0))


def expanded_terms(queries: DataFrame, r: Rules = rules.KOREAN) -> DataFrame:
    """(query_id, terms): for each keyword, lower-cased, the array of itself and its synonyms."""
    spark = queries.sparkSession
    known = spark.createDataFrame([(k.lower(), [s.lower() for s in v]) for k, v in r.synonyms.items()], "keyword string, synonyms array<string>")
    each = queries.select("query_id", F.posexplode("keywords").alias("place", "keyword")).withColumn("keyword", F.lower("keyword"))
    each = each.join(small(known), "keyword", "left")
    terms = F.array_union(F.array("keyword"), F.coalesce("synonyms", F.array().cast("array<string>")))
    ordered = F.sort_array(F.collect_list(F.struct("place", terms.alias("terms"))))
    return each.groupBy("query_id").agg(F.transform(ordered, lambda x_: x_.terms).alias("terms"))


def keyword_relevance() -> Column:
    """With columns keywords and terms: the mean over keywords of the best term, and 0.1 more if a keyword fits the category."""

    def term_score(p: Column, t: Column) -> Column:
        return F.when(p.title.contains(t), 0.6).otherwise(0.0) + F.when(p.body.contains(t), 0.3).otherwise(0.0) + F.least(F.lit(0.3), x.occurrences(p.body, t) * 0.05)

    def value(p: Column) -> Column:
        best = F.transform("terms", lambda ts: F.array_max(F.transform(ts, lambda t: term_score(p, t))))
        mean = F.aggregate(best, F.lit(0.0), lambda a, s: a + s) / F.size("terms")
        fits = (p.cat != "") & F.exists("keywords", lambda k: p.cat.contains(F.lower(k)) | F.lower(k).contains(p.cat))
        blank = F.trim(F.concat(p.title, F.lit(" "), p.body)) == ""
        return F.when(blank, 0.0).otherwise(F.least(F.lit(1.0), mean + F.when(fits, 0.1).otherwise(0.0)))

    low = F.struct(F.lower(_text("title")).alias("title"), F.lower(_text("body")).alias("body"), F.lower(_text("category")).alias("cat"))
    return x.let(low, value)
