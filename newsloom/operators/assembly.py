"""Sections and texts of topics from their ranked sentences; every function gives one row per topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules.formats import IMAGES_OF_TYPE
from .sentences import with_connectors

LEAD, BODY, CLOSING = ("lead", "fact"), ("background", "detail", "quote"), ("outlook", "implication")


def ordered(rows: DataFrame, topic: str) -> DataFrame:
    """(topic, primary_id, s): at most thirty sentences in order of importance, as an array of structs."""
    fields = F.struct("place", "sentence", "role", "id", "has_number", "matched")
    return rows.groupBy(topic).agg(F.first("primary_id").alias("primary_id"), F.sort_array(F.collect_list(fields)).alias("s"))


def texts(s: Column) -> Column:
    return F.transform(s, lambda e: e.sentence)


def joined(s: Column, sep: str = " ") -> Column:
    return F.array_join(texts(s), sep)


def paragraphs(s: Column, least: int = 50, most: int = 400) -> Column:
    """Sentences as paragraphs: a new one where the role changes or the length would pass `most`, once `least` is reached; short ones join the one before."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("role"))

    def step(a: Column, e: Column) -> Column:
        size = F.length(e.sentence)
        cut = (a.n >= least) & ((a.role.isNotNull() & (a.role != e.role)) | (a.n + size > most))
        return F.struct(
            F.when(cut, F.concat(a.done, F.array(a.now))).otherwise(a.done).alias("done"),
            F.when(cut | (a.now == ""), e.sentence).otherwise(F.concat(a.now, F.lit(" "), e.sentence)).alias("now"),
            F.when(cut, size).otherwise(a.n + size).alias("n"), e.role.alias("role"),
        )

    cut = F.aggregate(s, start, step, lambda a: F.when(a.now == "", a.done).otherwise(F.concat(a.done, F.array(a.now))))

    def merge(a: Column, p: Column) -> Column:
        last = F.size(a)
        return F.when((F.length(p) < least) & (last > 0), F.concat(F.slice(a, F.lit(1), last - 1), F.array(F.concat(F.element_at(a, -1), F.lit(" "), p)))).otherwise(F.concat(a, F.array(p)))

    return F.array_join(F.aggregate(cut, F.array().cast("array<string>"), merge), "\n\n")


def straight(topics: DataFrame) -> DataFrame:
    """lead, body and closing by role, of the primary article; the first sentence leads if none has a leading role."""
    own = lambda roles: F.filter("s", lambda e: e.role.isin(*roles) & (e.id == F.col("primary_id")))
    lead = F.when(F.size(own(LEAD)) > 0, own(LEAD)).otherwise(F.slice("s", 1, 1))
    used = texts(lead)
    body = F.filter(own(BODY), lambda e: ~F.array_contains(used, e.sentence))
    closing = F.filter(own(CLOSING), lambda e: ~F.array_contains(used, e.sentence))
    return topics.withColumns({"lead": joined(lead), "body": paragraphs(body), "closing": joined(closing)})


def brief(topics: DataFrame, most: int = 150) -> DataFrame:
    """Up to three sentences while they fit; the first that does not ends it."""
    start = F.struct(F.lit("").alias("t"), F.lit(True).alias("open"))

    def step(a: Column, e: Column) -> Column:
        fits = a.open & (F.length(a.t) + F.length(e.sentence) <= most)
        return F.struct(F.when(fits & (a.t == ""), e.sentence).when(fits, F.concat(a.t, F.lit(" "), e.sentence)).otherwise(a.t).alias("t"), fits.alias("open"))

    return topics.withColumn("headline", F.aggregate(F.slice("s", 1, 3), start, step, lambda a: a.t))


def feature(topics: DataFrame) -> DataFrame:
    """Three sentences of introduction, up to fifteen of body, four of conclusion."""
    return topics.withColumns({"introduction": joined(F.slice("s", 1, 3)), "feature_body": joined(F.slice("s", 4, 15)), "conclusion": joined(F.slice("s", 19, 4))})


def newsletter(topics: DataFrame) -> DataFrame:
    return topics.withColumns({"highlights": joined(F.slice("s", 1, 5), "\n"), "deep_dive": joined(F.slice("s", 6, 4))})


def cards(topics: DataFrame, least: int = 5, most: int = 10, size: int = 200) -> DataFrame:
    """Five to ten cards of at most 200 characters; sentences come again where there are fewer than five."""
    n = F.least(F.greatest(F.size("s"), F.lit(least)), F.lit(most))
    picked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.element_at(texts(F.col("s")), (i % F.size("s") + 1).cast("int")), 1, size))
    return topics.withColumn("cards", F.when(F.size("s") > 0, picked))


def fallback_cards(title: Column, body: Column, most: int = 5) -> Column:
    """Cards (title, body) of one article where its topic gives none: its title, then its first sentences of more than twenty characters, cut at 150."""
    said = F.filter(F.transform(F.split(body, r"[.!?]\s*"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.length(s) > 20)
    points = F.transform(F.slice(said, 1, most - 1), lambda s, i: F.struct(F.concat(F.lit("Point "), (i + 1).cast("string")).alias("title"), F.substring(s, 1, 150).alias("body")))
    return F.concat(F.array(F.struct(F.substring(title, 1, 30).alias("title"), title.alias("body"))), points)


def social_post(topics: DataFrame) -> DataFrame:
    words = F.slice(F.array_distinct(F.flatten(F.transform("s", lambda e: e.matched))), 1, 5)
    return topics.withColumns(
        {"hook": F.substring(F.element_at(texts(F.col("s")), 1), 1, 50), "core": F.substring(joined(F.slice("s", 2, 2)), 1, 150), "hashtags": F.array_join(F.transform(words, lambda w: F.concat(F.lit("#"), w)), " ")}
    )


def rendered(topics: DataFrame, sections: list[str], name: str = "text") -> DataFrame:
    """The sections that are not empty, with blank lines between them."""
    return topics.withColumn(name, F.array_join(F.filter(F.array(*sections), lambda t: t.isNotNull() & (t != "")), "\n\n"))


def structure_issues(title: Column, body: Column, kind: Column, images: Column) -> Column:
    """Issues of a generated text by its type."""
    parts, n = F.split(body, "\n\n"), F.length(body)
    low = F.when(kind == "standard", 400).when(kind == "visual", 200).otherwise(300)
    numbers = body.rlike(r"\d+%|\d+억|\d+만|\d+조")
    return F.array_compact(
        F.array(
            F.when(F.length(title) == 0, "MISSING_TITLE").when(F.length(title) > 60, F.concat(F.lit("TITLE_TOO_LONG:"), F.length(title).cast("string"))),
            F.when(n < low, F.concat(F.lit("BODY_TOO_SHORT:"), n.cast("string"))).when((kind == "standard") & (n > 800), F.concat(F.lit("BODY_TOO_LONG:"), n.cast("string"))),
            F.when((kind == "visual") & (images < 2), F.concat(F.lit("NOT_ENOUGH_IMAGES_FOR_VISUAL:"), images.cast("string"))),
            F.when((kind == "data") & ~numbers, "NO_NUMBERS_IN_DATA_TYPE"), F.when(~((n > 0) & (F.length(F.element_at(parts, 1)) > 30)), "MISSING_LEAD"), F.when(n < 100, "CONTENT_TOO_SHORT"),
        )
    )


def generation_score(chars: Column, issues: Column, millis: Column, bad_images: Column, success: Column) -> Column:
    """0 to 100: length in steps, five an issue, slow runs, three an invalid image."""
    length = F.when(chars >= 400, 0).when(chars >= 300, 10).when(chars >= 200, 20).otherwise(30)
    slow = F.when(millis > 10000, 10).when(millis > 5000, 5).otherwise(0)
    return F.when(success, F.greatest(F.lit(0.0), F.lit(100.0) - length - 5 * issues - slow - 3 * bad_images)).otherwise(0.0)


def picked(s: Column, used: Column, roles: tuple[str, ...], quota: int, least: int) -> Column:
    """Up to `quota` sentences of the roles that are not used; if fewer than `least`, others that are not used fill the quota."""
    free = F.filter(s, lambda e: ~F.array_contains(used, e.sentence))

    def filled(own: Column) -> Column:
        more = F.filter(free, lambda e: ~F.array_contains(own, e))
        return F.when(F.size(own) < least, F.concat(own, F.slice(more, F.lit(1), quota - F.size(own)))).otherwise(own)

    return x.let(F.slice(F.filter(free, lambda e: e.role.isin(*roles)), 1, quota), filled)


def analysis(topics: DataFrame) -> DataFrame:
    """current_situation, background, outlook and implications: quotas of five, five, four and three; the last three are filled up from what is left."""
    out = topics.withColumn("_now", F.slice(F.filter("s", lambda e: e.role.isin("lead", "fact", "statistic")), 1, 5)).withColumn("_used", texts(F.col("_now")))
    for name, role, quota, least in (("background", "background", 5, 3), ("outlook", "outlook", 4, 3), ("implications", "implication", 3, 2)):
        out = out.withColumn("_own", picked(F.col("s"), F.col("_used"), (role,), quota, least))
        out = out.withColumn(name, joined(F.col("_own"))).withColumn("_used", F.concat("_used", texts(F.col("_own"))))
    return out.withColumn("current_situation", joined(F.col("_now"))).drop("_now", "_used", "_own")


def of_primary(roles: tuple[str, ...] | None = None) -> Column:
    """Sentences of the primary article, of these roles or of any but closing ones."""
    return F.filter("s", lambda e: (e.id == F.col("primary_id")) & (e.role.isin(*roles) if roles else ~e.role.isin(*CLOSING)))


def laid_out(topics: DataFrame, lead: Column, numbers_first: bool, prefix: str) -> DataFrame:
    """lead (the first sentence if empty), body and closing of the primary article; no text twice."""
    out = topics.withColumn("_lead", F.when(F.size(lead) > 0, lead).otherwise(F.slice("s", 1, 1)))
    fresh = lambda s: F.filter(s, lambda e: ~F.array_contains(texts(F.col("_lead")), e.sentence))
    body = fresh(of_primary())
    if numbers_first:
        body = F.concat(F.filter(body, lambda e: e.has_number), F.filter(body, lambda e: ~e.has_number))
    out = out.withColumn("_body", body).withColumn("_text", joined(F.col("_body")))
    closing = F.filter(fresh(of_primary(CLOSING)), lambda e: ~F.array_contains(texts(F.col("_body")), e.sentence))
    linked = F.when(F.col("_text") != "", with_connectors(F.trim("_text"))).otherwise("")
    return out.withColumns({f"{prefix}_lead": F.trim(joined(F.col("_lead"))), f"{prefix}_plain": F.trim("_text"), f"{prefix}_body": linked, f"{prefix}_closing": F.trim(joined(closing))}).drop("_lead", "_body", "_text")


def visual(topics: DataFrame) -> DataFrame:
    """Texts around images: scenes lead, then the rest of the primary article."""
    return laid_out(topics, of_primary(("lead", "fact", "background")), False, "visual")


def data(topics: DataFrame) -> DataFrame:
    """Texts around figures: sentences with numbers lead, and come first in the body."""
    sure = F.filter(of_primary(("statistic", "lead")), lambda e: e.has_number)
    return laid_out(topics, F.when(F.size(sure) > 0, sure).otherwise(of_primary(("lead", "fact"))), True, "data")


def preferred(s: Column, primary: Column, most: int, strict: bool = True) -> Column:
    """Up to `most` sentences of the primary article; filled up with others unless strict. Without a primary article the first ones."""
    own = F.filter(s, lambda e: e.id == primary)
    other = F.filter(s, lambda e: e.id != primary)
    kept = F.slice(own, 1, most)
    if not strict:
        kept = F.slice(F.concat(kept, other), 1, most)
    return F.when(primary.isNull(), F.slice(s, 1, most)).otherwise(kept)


def images_of_type(images: Column, kind: Column) -> Column:
    """The first images of a topic, as many as its type keeps."""
    most = F.lit(5)
    for name, n in IMAGES_OF_TYPE.items():
        most = F.when(kind == name, n).otherwise(most)
    return F.slice(images, F.lit(1), most)


def copied(sentences: DataFrame, outputs: DataFrame, topic: str, least: int = 10) -> DataFrame:
    """(topic, sentences, copied): source sentences of over `least` characters, and how many of them the topic's output(topic, text) holds."""
    rows = sentences.where(F.length("sentence") > least).join(outputs.select(topic, "text"), topic)
    return rows.groupBy(topic).agg(F.count("*").alias("sentences"), F.count_if(F.col("text").contains(F.col("sentence"))).alias("copied"))
