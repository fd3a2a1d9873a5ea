"""A column of request texts, or rows of request parameters, as structured queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import news as rules
from ..storage import materialized, small, stated

#: Keyword, exclusion and limit patterns, and option words.
KEYWORD_PATTERNS = (r"([가-힣A-Za-z0-9]+)\s*관련", r"([가-힣A-Za-z0-9]+)에\s*대한")
EXCLUDE_PATTERNS = (r"([가-힣A-Za-z0-9]+)\s*제외", r"([가-힣A-Za-z0-9]+)\s*빼고")
LIMIT_PATTERNS = (r"[Tt]op\s*(\d+)", r"(\d+)\s*[개건]")
VERIFIED_WORDS, DIVERSE_WORDS = ("검증된", "공식"), ("다양한", "다양하게")
POPULARITY, GROUPS = ("trending", "popular", "quality", "latest", "credible"), ("none", "day", "source")


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return x.filled(F.regexp_extract(text, pattern, group))


def intent(text: Column) -> Column:
    """The first intent, in declared order, of which a word occurs; else null."""
    out = F.lit(None).cast("string")
    for name, words in reversed(rules.INTENTS):
        out = F.when(x.contains_any(text, words), name).otherwise(out)
    return out


def categories(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(x.contains_any(text, words), name) for name, words in rules.QUERY_CATEGORIES.items())))


def found_words(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns)))


def limit_of(text: Column) -> Column:
    return F.coalesce(*(F.try_to_number(_first(text, p), F.lit("999999999")).cast("int") for p in LIMIT_PATTERNS))


def _range(start: Column, end: Column) -> Column:
    """Both ends or nothing."""
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("date_from"), end.alias("date_to")))


def _day(year: Column, month: Column, day: Column, last: bool = False) -> Column:
    clock = (F.lit(23), F.lit(59), F.lit(59)) if last else (F.lit(0), F.lit(0), F.lit(0))
    return F.try_make_timestamp(year, month, day, *clock)


def dates(text: Column, as_of: Column) -> Column:
    """Struct of date_from and date_to by the first of: ISO range, relative word, number of days or weeks back, days of a month, single day.

    A day without a year is in the year of as_of, or the one before if that lies ahead. Days that do not exist give nothing."""
    today = F.date_trunc("day", as_of)
    iso = r"(\d{4}-\d{2}-\d{2})\s*[~\-]\s*(\d{4}-\d{2}-\d{2})"
    days = lambda c, n: F.timestamp_add("DAY", n, c)
    last = lambda c: F.timestamp_add("SECOND", F.lit(86399), c)
    at = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))
    choices = [_range(at(_first(text, iso, 1)), last(at(_first(text, iso, 2))))]
    word = F.lit(None)
    for name, offset, length in reversed(rules.RELATIVE_DAYS):
        start = days(today, F.lit(offset))
        word = F.when(text.contains(name), F.struct(start.alias("date_from"), F.timestamp_add("SECOND", F.lit(-1), days(start, F.lit(length))).alias("date_to"))).otherwise(word)
    choices.append(word)
    for pattern, unit in ((r"지난\s*(\d+)\s*일", 1), (r"지난\s*(\d+)\s*주일?", 7), (r"최근\s*(\d+)\s*일", 1), (r"최근\s*(\d+)\s*주일?", 7)):
        n = _first(text, pattern).cast("int") * unit
        choices.append(_range(days(today, -n), last(today)))
    num = lambda pattern, k: _first(text, pattern, k).cast("int")

    def year(month: Column, day: Column) -> Column:
        now = F.year(as_of)
        return F.when(_day(now, month, day) > as_of, now - 1).otherwise(now)

    span = r"(\d{1,2})월\s*(\d{1,2})일\s*[~\-부]\s*(\d{1,2})일"
    month, first, end = num(span, 1), num(span, 2), num(span, 3)
    choices.append(_range(_day(year(month, first), month, first), _day(year(month, first), month, end, True)))
    single = r"(?:(\d{4})년\s*)?(\d{1,2})월\s*(\d{1,2})일"
    y, month, first = num(single, 1), num(single, 2), num(single, 3)
    y = F.coalesce(y, year(month, first))
    choices.append(_range(_day(y, month, first), _day(y, month, first, True)))
    return F.coalesce(*choices)


def parse_requests(requests: DataFrame, as_of: Column) -> DataFrame:
    """requests(query_id, text) with intent, group_by, categories, keywords, exclude_keywords, limit, options and dates, defaults filled in."""
    t = F.coalesce("text", F.lit(""))
    kind, cats = intent(t), categories(t)
    return requests.select(
        "query_id", "text", F.coalesce(kind, F.lit("latest")).alias("popularity_type"), F.when(kind == "trending", "day").otherwise("none").alias("group_by"), cats.alias("category"),
        F.array_except(found_words(t, KEYWORD_PATTERNS), cats).alias("keywords"), found_words(t, EXCLUDE_PATTERNS).alias("exclude_keywords"), F.coalesce(limit_of(t), F.lit(20)).alias("limit"),
        F.lit(0).alias("offset"), x.contains_any(t, VERIFIED_WORDS).alias("verified_sources_only"), x.contains_any(t, DIVERSE_WORDS).alias("diversity"), dates(t, as_of).alias("d"),
    ).select("*", "d.date_from", "d.date_to").drop("d")


def parse_parameters(rows: DataFrame) -> DataFrame:
    """Rows of string parameters: comma lists, numbers and flags with defaults, unknown names replaced by defaults; sort_by stands for popularity_type."""
    kind = F.coalesce("popularity_type", "sort_by")
    whole = lambda c, default: F.coalesce(F.expr(f"try_cast({c} as int)"), F.lit(default))
    return rows.select(
        "query_id", F.when(kind.isin(*POPULARITY), kind).otherwise("latest").alias("popularity_type"), F.when(F.col("group_by").isin(*GROUPS), F.col("group_by")).otherwise("none").alias("group_by"),
        x.split_tags(F.col("category")).alias("category"), x.split_tags(F.col("keywords")).alias("keywords"), whole("limit", 20).alias("limit"), whole("offset", 0).alias("offset"),
        F.lower("verified_sources_only").isin("true", "1", "yes").alias("verified_sources_only"), x.parse_time(F.col("date_from")).alias("date_from"), x.parse_time(F.col("date_to")).alias("date_to"),
    )


def query_errors() -> Column:
    """Messages on a structured query; empty if it is valid."""
    return F.array_compact(
        F.array(
            F.when(~F.col("limit").between(1, 100), "limit must be 1 to 100"), F.when(F.col("offset") < 0, "offset must not be negative"),
            F.when(~F.col("popularity_type").isin(*POPULARITY), "unknown popularity_type"), F.when(~F.col("group_by").isin(*GROUPS), "unknown group_by"),
            F.when(F.col("date_from") > F.col("date_to"), "date_from is after date_to"), F.when(F.size("keywords") > 10, "more than 10 keywords"), F.when(F.size("category") > 5, "more than 5 categories"),
        )
    )


def sources_of(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, source_id, place): active sources that fit a query, by credibility; the registry is a stated set, a row per outlet."""
    free = lambda c: F.coalesce(F.size(c), F.lit(0)) == 0
    fits = F.col("is_active") & (~F.col("verified_sources_only") | F.col("tier").isin("whitelist", "tier1"))
    fits = fits & (free("category") | free("supported_categories") | F.arrays_overlap("category", "supported_categories"))
    rows = queries.join(stated(sources), fits)
    order = Window.partitionBy("query_id").orderBy(F.desc("credibility_base_score"), "source_id")
    return rows.select("query_id", "source_id", F.row_number().over(order).alias("place"))


#: Words of queries that are looked for in every text; beyond that each text is brought to the queries of its days.
MARKED = 500


def widened(queries: DataFrame, news: DataFrame, days: int = 3, enough: int = 5, most: int = 30, times: DataFrame | None = None) -> DataFrame:
    """(query_id, id, step) of queries(query_id, keywords, date): articles of that day with all keywords; if there are none, those of `days` days around it;
    and if a query of several keywords has fewer than `enough`, also those of the day with any one of them. step tells which of the three found it; the first `most` by ord.

    A query is dealt to the days around its own, which are the key of the join. One pass over the articles of those days marks what each step finds; counts by query decide which steps hold.
    With times(id, published_at) news has no time of its own: the words of all queries, if they are at most MARKED, are marked in the texts first, so that no text is
    brought to its time. What is found is written once, as ids and numbers."""
    text = F.lower(F.concat_ws(" ", "title", "body"))
    low = F.transform("keywords", lambda k: F.lower(k))
    held = lambda k: F.col("_text").contains(k)
    if times is not None:
        words = [r["word"] for r in queries.select(F.explode(low).alias("word")).where("word is not null").distinct().limit(MARKED + 1).collect()]
        if len(words) <= MARKED:
            marks = x.let(text, lambda t: F.filter(x.strings(words), lambda w: t.contains(w)))
            news, text = news.select("id", "ord", marks.alias("_marks")).where(F.size("_marks") > 0), F.col("_marks")
            held = lambda k: F.array_contains("_text", k)
        news = news.join(times.select("id", "published_at"), "id")
    hits = F.size(F.filter(low, held))
    away = F.abs(F.datediff(F.col("_day"), F.col("date")))
    dealt = queries.where((F.size("keywords") > 0) & F.col("date").isNotNull()).withColumn("_day", F.explode(F.sequence(F.date_sub("date", days), F.date_add("date", days))))
    rows = news.select("id", "ord", F.to_date("published_at").alias("_day"), text.alias("_text")).join(small(dealt, 500), "_day").select("query_id", "id", "ord", F.size("keywords").alias("n"), hits.alias("hits"), away.alias("away"))
    rows = rows.where("hits > 0").withColumns({"exact": F.expr("away = 0 and hits = n"), "wide": F.expr("hits = n"), "any": F.expr("away = 0")})
    rows = materialized(rows, "marked")
    counts = rows.groupBy("query_id").agg(F.count_if("exact").alias("n_exact"), F.count_if("wide").alias("n_wide"))
    rows = rows.join(small(counts), "query_id")
    found = F.when(F.col("exact"), 1).when(F.col("wide") & (F.col("n_exact") == 0), 2)
    first = F.when(F.col("n_exact") > 0, F.col("n_exact")).otherwise(F.col("n_wide"))
    step = F.coalesce(found, F.when(F.col("any") & (F.col("n") >= 2) & (first < enough), 3))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("step", "ord", "id"))
    return rows.withColumn("step", step).where("step is not null").withColumn("place", place).where(F.col("place") <= most).select("query_id", "id", "step", "place")
