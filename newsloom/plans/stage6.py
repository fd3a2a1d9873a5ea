"""Queries over raw records, collections, citations, checks of texts, images of pages, and totals of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import assembly, citations, dedup, images, qa, querylog, registry
from ..rules import news as rules
from ..sources import feeds
from ..storage import materialized
from .registry import SQL, query
from .stage1 import _CLEAN, _URL
from .stage3 import q
from .stage4 import _URLS, sources
from .stage5 import _EVERY_URL, _JOIN, _TOP, ordered_topics
from .tables import ARTICLES, articles, sql_text, table

_TIMES = ("2024-01-05T10:00:00+09:00", "Thu, 05 Feb 2026 10:00:00 +0900", "2024-01-05", "junk")
_FETCHED = "2024-02-01 00:00:00"


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw JSON: by their number some have no title, description, author or valid time, and some are video items."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.coalesce("text", F.lit(""))
    when = F.element_at(x.strings(_TIMES), (F.pmod(n, F.lit(4)) + 1).cast("int"))
    fields = F.struct(
        F.when(n % 7 == 0, "뉴스데스크 1월 4일").when(n % 3 == 0, F.substring_index(body, "\n", 1)).alias("title"), body.alias("text"), F.when(n % 2 == 0, F.substring(body, 1, 300)).otherwise("").alias("description"),
        F.when(n % 5 == 0, F.substring(body, 1, 100)).alias("summary"), F.when(n % 4 == 0, F.col("source")).alias("author"), F.col("lang").alias("creator"), F.concat_ws(", ", "lang", F.lit(""), "source").alias("tags"), when.alias("published"),
    )
    return d.select(F.col("doc_id").alias("id"), F.to_json(fields).alias("json"))


@query(
    f"""with r as (select doc_id as id, coalesce(text, '') as html0, nullif(case when doc_id % 3 = 0 then split_part(coalesce(text, ''), chr(10), 1) end, '') as title, nullif(case when doc_id % 2 = 0 then left(coalesce(text, ''), 300) else '' end, '') as description,
  nullif(case when doc_id % 5 = 0 then left(coalesce(text, ''), 100) end, '') as summary, source, lang, doc_id from documents where doc_id % 7 <> 0),
b as (select *, coalesce(description, summary, html0) as body0, coalesce(title, left(html0, 200)) as title0 from r)
select id, md5({_CLEAN.replace('html', 'title0')}) as title_md5, md5({_CLEAN.replace('html', 'body0')}) as body_md5, case when doc_id % 4 = 0 then source else lang end as author,
  array_to_string(list_filter([trim(coalesce(lang, '')), trim(coalesce(source, ''))], lambda t: t <> ''), '|') as tags,
  case doc_id % 4 when 0 then timestamp '2024-01-05 01:00:00' when 1 then timestamp '2026-02-05 01:00:00' when 2 then timestamp '2024-01-05' else timestamp '{_FETCHED}' end as published_at from b"""
)
def p01_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw JSON as articles, with fallbacks for what is missing and without video items."""
    out = feeds.normalized(raw_records(spark, sf_dir), F.lit(_FETCHED).cast("timestamp"))
    return out.select("id", F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"), "author", F.array_join("tags", "|").alias("tags"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query(
    f"""with p as (select page_id, {_URL} as k, case when page_id % 3 = 1 then 0 else 1 end as part from pages where page_id % 3 in (1, 2)), u as (select page_id, k, part, row_number() over (partition by k order by part, page_id) as n from p)
select page_id, part from u where k is null or n = 1 union all select page_id, 2 as part from pages where page_id % 3 = 0 and ({_URL} is null or {_URL} not in (select k from p where k is not null))"""
)
def u01_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two collections of pages as one by address, the first collection wins; and what a third one adds to both."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("ord"))
    parts = [p.where(F.pmod("page_id", F.lit(3)) == k).withColumn("part", F.lit(n)) for n, k in enumerate((1, 2, 0))]
    both = dedup.union_first(parts[0], parts[1])
    return both.select("page_id", "part").union(feeds.unseen(parts[2], parts[0].union(parts[1])).select("page_id", "part"))


@query(
    f"""with {ARTICLES}, p as (select page_id as id, {_CLEAN} as f from pages), e as (select a.id, a.body, p.f from articles a left join p on p.id = a.id and length(a.body) < 150 and length(p.f) > length(a.body))
select id, md5(coalesce(f, body)) as body_md5, f is not null as taken from e"""
)
def j09_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short articles take the text of the page of their number where it is longer."""
    n = articles(spark, sf_dir).select("id", "body", F.md5("body").alias("before"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), x.clean_html(F.col("html")).alias("full"))
    return feeds.enriched(n, pages, "id").select("id", F.md5("body").alias("body_md5"), (F.md5("body") != F.col("before")).alias("taken"))


_WORDS = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"


@query(
    f"""with {_TOP}, made as (select topic_id, e.place as place, e.s as quote from (select topic_id, unnest(l[1:8]) as e from st)), said as (select distinct id // 5 as topic_id, id, s from sentences),
mw as (select distinct topic_id, quote, trim(lower(quote)) as lq, {_WORDS.format('trim(lower(quote))')} as qw from made), sw as (select topic_id, id, trim(lower(s)) as ls, {_WORDS.format('trim(lower(s))')} as w from said),
c as (select distinct mw.topic_id, quote, id from mw join sw on mw.topic_id = sw.topic_id and (lq = ls or (len(w) > 0 and len(list_intersect(qw, w)) / len(w) >= 0.7))),
f as (select topic_id, id from (select distinct topic_id, id from said)), o as (select topic_id, {_JOIN.format('l[1:3]')} as text from st)
select topic_id, count(c.quote) as quotes, count(distinct c.id) as sources, count(distinct c.quote) as matched, count(distinct c.quote) filter (not contains(text, c.quote)) as missing,
  (select count(*) from f where f.topic_id = o.topic_id) as facts from o left join c using (topic_id) group by topic_id"""
)
def c02_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best eight sentences of each topic as quotes found in its articles, summed by kind, and those that the introduction leaves out."""
    from .stage3 import topic_sentences

    rows = topic_sentences(spark, sf_dir)
    news_ = rows.groupBy("topic_id", "id").agg(F.collect_list("sentence").alias("quotes")).withColumn("title", F.lit("t"))
    t = assembly.feature(ordered_topics(spark, sf_dir))
    made = t.select("topic_id", F.transform(F.slice("s", 1, 8), lambda e: e.sentence).alias("quotes"))
    matches = materialized(citations.quote_matches(made, news_, "topic_id"), "matches")
    summed = citations.summary(citations.citations(matches, news_, "topic_id"), "topic_id")
    cited = matches.groupBy("topic_id").agg(F.count("*").alias("quotes"), F.countDistinct("id").alias("sources"), F.collect_set("quote").alias("cited"))
    out = t.select("topic_id", "introduction").join(cited, "topic_id", "left").join(summed.select("topic_id", "facts"), "topic_id", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "topic_id", F.coalesce("quotes", F.lit(0)).alias("quotes"), F.coalesce("sources", F.lit(0)).alias("sources"), F.size(F.coalesce("cited", none)).alias("matched"),
        F.size(citations.missing_quotes(F.col("introduction"), F.coalesce("cited", none))).alias("missing"), F.coalesce("facts", F.lit(0)).alias("facts"),
    )


@query(
    f"""with {_TOP}, h as (select topic_id, l, case when len(l) >= 1 and length(l[1].s) <= 150 then l[1].s else '' end as a from st),
i as (select *, case when a <> '' and len(l) >= 2 and length(a) + length(l[2].s) <= 150 then a || ' ' || l[2].s else a end as b from h), j as (select *, case when b <> a and len(l) >= 3 and length(b) + length(l[3].s) <= 150 then b || ' ' || l[3].s else b end as c from i)
select topic_id, c as headline, len(cards) as n_cards, md5(array_to_string(cards, chr(10))) as cards_md5, left({_JOIN.format('l[2:3]')}, 150) as core
from (select *, list_transform(range(0, least(greatest(len(l), 5), 10)), lambda k: left(l[k % len(l) + 1].s, 200)) as cards from j)"""
)
def m07_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, M7, M8: brief, cards and post of each topic."""
    t = assembly.social_post(assembly.cards(assembly.brief(ordered_topics(spark, sf_dir))))
    return t.select("topic_id", "headline", F.size("cards").alias("n_cards"), F.md5(F.array_join("cards", "\n")).alias("cards_md5"), "core")


_KIND = "case id % 3 when 0 then 'standard' when 1 then 'visual' else 'data' end"
_LENGTH = "length(body)"
_ISSUES = f"""list_filter([case when length(title) = 0 then 'MISSING_TITLE' when length(title) > 60 then 'TITLE_TOO_LONG:' || length(title) end,
  case when {_LENGTH} < case {_KIND} when 'standard' then 400 when 'visual' then 200 else 300 end then 'BODY_TOO_SHORT:' || {_LENGTH} when {_KIND} = 'standard' and {_LENGTH} > 800 then 'BODY_TOO_LONG:' || {_LENGTH} end,
  case when {_KIND} = 'visual' and id % 5 < 2 then 'NOT_ENOUGH_IMAGES_FOR_VISUAL:' || id % 5 end, case when {_KIND} = 'data' and not regexp_matches(body, '\\d+%|\\d+억|\\d+만|\\d+조') then 'NO_NUMBERS_IN_DATA_TYPE' end,
  case when not ({_LENGTH} > 0 and length(string_split(body, chr(10) || chr(10))[1]) > 30) then 'MISSING_LEAD' end, case when {_LENGTH} < 100 then 'CONTENT_TOO_SHORT' end], lambda v: v is not null)"""


@query(
    f"""with {ARTICLES}, i as (select id, {_LENGTH} as n, {_ISSUES} as issues, id % 3 as bad, (id * 37) % 13000 as millis from articles)
select id, array_to_string(issues, ',') as issues, case when id % 11 = 0 then 0.0 else greatest(0.0, 100.0 - case when n >= 400 then 0 when n >= 300 then 10 when n >= 200 then 20 else 30 end - 5 * len(issues)
  - case when millis > 10000 then 10 when millis > 5000 then 5 else 0 end - 3 * bad) end as score from i"""
)
def v03_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3, V4: structure issues and scores of texts by type (type, images, time and success by number)."""
    n = F.col("id")
    kind = F.when(n % 3 == 0, "standard").when(n % 3 == 1, "visual").otherwise("data")
    rows = articles(spark, sf_dir).select("id", "body", assembly.structure_issues(F.col("title"), F.col("body"), kind, n % 5).alias("issues"))
    score = assembly.generation_score(F.length("body"), F.size("issues"), (n * 37) % 13000, n % 3, n % 11 != 0)
    return rows.select("id", F.array_join("issues", ",").alias("issues"), score.alias("score"))


@query(
    """with o as (select o_orderkey as k, cast(o_orderkey % 110 as int) as lim, cast(o_custkey % 5 - 1 as int) as off, o_orderkey % 3 = 0 as bad_kind, o_orderkey % 4 = 0 as bad_group, o_custkey % 13 as words, o_custkey % 8 as cats, o_orderdate::timestamp as d1,
  o_orderdate::timestamp + interval (cast(o_orderkey % 7 - 2 as int)) day as d2 from orders)
select k as query_id, array_to_string(list_filter([case when not lim between 1 and 100 then 'limit must be 1 to 100' end, case when off < 0 then 'offset must not be negative' end, case when bad_kind then 'unknown popularity_type' end,
  case when bad_group then 'unknown group_by' end, case when d1 > d2 then 'date_from is after date_to' end, case when words > 10 then 'more than 10 keywords' end, case when cats > 5 then 'more than 5 categories' end], lambda v: v is not null), ';') as errors from o"""
)
def f17_query_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F17, QL9: all errors of structured queries (from orders)."""
    k, c, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate").cast("timestamp")
    many = lambda n: F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: F.concat(F.lit("w"), i.cast("string")))
    q_ = table(spark, sf_dir, "orders").select(
        k.alias("query_id"), (k % 110).cast("int").alias("limit"), (c % 5 - 1).cast("int").alias("offset"), F.when(k % 3 == 0, "odd").otherwise("latest").alias("popularity_type"), F.when(k % 4 == 0, "odd").otherwise("none").alias("group_by"),
        F.slice(many(c % 13), F.lit(2), (c % 13).cast("int")).alias("keywords"), F.slice(many(c % 8), F.lit(2), (c % 8).cast("int")).alias("category"), d.alias("date_from"), (d + F.make_interval(days=(k % 7 - 2).cast("int"))).alias("date_to"),
    )
    return q_.select("query_id", F.array_join(querylog.query_errors(), ";").alias("errors"))


def _steps(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n")


SQL["a15_funnel"] = (
    SQL["d04_deduplicate"].rsplit("select led.id", 1)[0].rstrip()
    + """ select 'raw' as step, count(*) as n from articles union all select 'title', count(*) from arts union all select 'cluster', count(*) from sized union all select 'in clusters', coalesce(sum(size), 0) from sized where size > 1"""
)


@query(SQL["a15_funnel"])
def a15_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles that are left after each step of the dedup, and those that share a cluster."""
    n = articles(spark, sf_dir)
    titles = materialized(dedup.by_title(n).select("id", "ord", "title", "body"), "titles")
    heads = materialized(dedup.cluster_heads(titles).select("id", "size"), "heads")
    shared = heads.where("size > 1").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).select(F.lit("in clusters").alias("step"), "n")
    return _steps(n, "raw").union(_steps(titles, "title")).union(_steps(heads, "cluster")).union(shared)


@query(
    f"""with {ARTICLES}, r as (select *, id % 2 as run from articles), s as (select run, language, count(*) as tests, round(avg(length(body)), 3) as chars from r where language is not null group by 1, 2),
a as (select * from s where run = 0), b as (select * from s where run = 1)
select coalesce(a.language, b.language) as language, a.tests as tests_before, b.tests as tests_after, a.chars as chars_before, b.chars as chars_after, round(coalesce(b.tests, 0) - coalesce(a.tests, 0), 3) as tests_change,
  round(coalesce(b.chars, 0) - coalesce(a.chars, 0), 3) as chars_change from a full join b on a.language = b.language"""
)
def j15_compared_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs (even and odd articles) side by side by language, with the changes."""
    rows = articles(spark, sf_dir).where("language is not null")
    run = lambda k: rows.where(F.pmod("id", F.lit(2)) == k).groupBy("language").agg(F.count("*").alias("tests"), F.round(F.avg(F.length("body")), 3).alias("chars"))
    return qa.compare_runs(run(0), run(1), "language", ["tests", "chars"])


@query(
    f"""with {_TOP}, o as (select id // 5 as topic_id, count(*) as n, sum(length(body)) as chars, round(avg(length(body)), 3) as mean, string_agg(title, ' | ' order by ord) filter (k <= 3) as first_titles from (select *, row_number() over (partition by id // 5 order by ord) as k from articles) group by 1)
select topic_id, n, chars, mean, md5(first_titles) as titles_md5, coalesce(length({_JOIN.format('l')}), 0) as made, round(coalesce(length({_JOIN.format('l')}), 0) / greatest(chars, 1), 6) as ratio from o left join st using (topic_id)"""
)
def a19_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles, characters and first titles of each topic, and the length of what is made of it."""
    n = articles(spark, sf_dir).withColumn("topic_id", F.floor(F.col("id") / 5).cast("long")).withColumn("k", F.row_number().over(Window.partitionBy("topic_id").orderBy("ord")))
    titles = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 3, F.struct("k", "title")))), lambda e: e.title), " | ")
    o = n.groupBy("topic_id").agg(F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"), F.round(F.avg(F.length("body")), 3).alias("mean"), F.md5(titles).alias("titles_md5"))
    made = ordered_topics(spark, sf_dir).select("topic_id", F.length(assembly.joined(F.col("s"))).alias("made"))
    out = o.join(made, "topic_id", "left").withColumn("made", F.coalesce("made", F.lit(0)))
    return out.withColumn("ratio", F.round(F.col("made") / F.greatest("chars", F.lit(1)), 6))


_KEYWORDS = ("the", "la", "en")


@query(
    SQL["i02_link_urls"].replace(_URLS, _EVERY_URL, 1).replace("select page_id, url as base, unnest(", f"select page_id, generate_subscripts({_EVERY_URL}, 1) - 1 as position, url as base, unnest(", 1)
    .replace("a as (select page_id, case", "a as (select page_id, position, case", 1).replace("select page_id, url, lower(case", ", k as (select page_id, position, url, lower(case", 1)
    + f"""), o as (select * from (select *, row_number() over (partition by page_id, image_key order by position, url) as n from k) where n = 1),
g as (select page_id, position, url, position % 4 = 0 as inside, case when position % 5 = 0 then 'the photo' else '' end as said, 5000 * ((page_id + position) % 7) * 40 as size, case when position % 3 = 0 then 300 else 500 end as width from o),
h as (select *, lower(string_split(url, '/')[-1]) as file from g),
r as (select *, 3 * inside::int + 3 * ({" or ".join(f"contains(said, '{k}')" for k in _KEYWORDS)})::int + case when position < 3 then case when said = '' and not inside then 2 else 1 end else 0 end + 2 * ({" or ".join(f"contains(file, '{k}')" for k in _KEYWORDS)})::int as relevance,
  size between 10 * 1024 and 5000 * 1024 and width >= 400 as good from h),
p as (select *, row_number() over (partition by page_id order by position, url) as rank, count(*) over (partition by page_id) as n from r where relevance >= 2 and good)
select page_id, url, relevance, rank, case when rank <= case when n >= 5 then 4 when n = 4 then 3 else n end then 'inline' when rank <= case when n >= 5 then 4 when n = 4 then 3 else n end + 6 then 'gallery' end as place from p"""
)
def i04_image_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses inside pages as images: distinct by key, fit by metadata (by number) and relevance, and where they go."""
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1))).alias("position", "src"))
    rows = rows.select("page_id", "position", images.image_url(F.col("src"), F.col("base")).alias("url"))
    first = F.row_number().over(Window.partitionBy("page_id", images.image_key(F.col("url"))).orderBy("position", "url"))
    rows = rows.withColumn("n", first).where("n = 1").drop("n")
    k = F.col("position")
    rows = rows.withColumns({"in_article": k % 4 == 0, "alt": F.when(k % 5 == 0, "the photo").otherwise(""), "title": F.lit(""), "size": 5000 * ((F.col("page_id") + k) % 7) * 40, "width": F.when(k % 3 == 0, 300).otherwise(500)})
    good = images.quality_ok(F.lit("image/png"), F.col("size"), F.col("width"), F.lit(300))
    rows = rows.withColumn("relevance", images.relevance(x.strings(_KEYWORDS))).where((F.col("relevance") >= 2) & good)
    w = Window.partitionBy("page_id")
    rows = rows.withColumn("rank", F.row_number().over(w.orderBy("position", "url"))).withColumn("n", F.count("*").over(w))
    return rows.select("page_id", "url", "relevance", "rank", images.placement(F.col("rank"), F.col("n")).alias("place"))


@query(
    f"""with {ARTICLES}, r as (select *, row_number() over (partition by source_id order by ord) as n from articles) select id from r where n <= 25 and (contains(lower(title || ' ' || body), 'thand') or contains(lower(title || ' ' || body), 'license'))"""
)
def l05_first_of_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first 25 articles of each source those with a keyword."""
    n = articles(spark, sf_dir).select("id", "ord", F.col("source_id").alias("feed"), "title", F.col("body").alias("description"))
    return feeds.first_of_feed(n, 25, ["thand", "license"]).select("id")


@query(
    """with s as (select source as source_id, case cast(regexp_extract(source, '(\\d+)', 1) as int) % 4 when 0 then 'blacklist' when 1 then 'tier1' when 2 then 'tier2' else 'tier3' end as tier, cast(regexp_extract(source, '(\\d+)', 1) as int) as n from documents group by source)
select source_id, tier, tier <> 'blacklist' and (n % 2 = 0 or n % 3 = 0) as is_active, case when n % 3 = 0 and tier <> 'blacklist' then 0 else 7 end as failure_count from s"""
)
def r03_reactivated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that failed become active again on request, but never blacklisted ones."""
    n = F.regexp_extract("source_id", r"(\d+)", 1).cast("int")
    s = sources(spark, sf_dir).withColumn("tier", F.when(n % 4 == 0, "blacklist").otherwise(F.col("tier")))
    s = s.withColumns({"failure_count": F.lit(7), "is_active": (F.col("tier") != "blacklist") & (n % 2 == 0)})
    return registry.reactivated(s, n % 3 == 0).select("source_id", "tier", "is_active", "failure_count")


_HEAD = "trim(regexp_replace(string_split(body, chr(10))[1], '^#+\\s*', ''))"


@query(
    f"""with {ARTICLES}, h as (select id, body, {_HEAD} as head, trim(regexp_replace(body, '^[^\\n]*\\n?', '')) as rest from articles)
select id, case when length(head) > 100 or head = '' then 'untitled' else head end as title, md5(case when length(head) > 100 or head = '' then body else rest end) as body_md5 from h"""
)
def p18_title_and_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts split into a title and a body."""
    parts = x.split_title_body(F.col("body"), F.lit("untitled"))
    return articles(spark, sf_dir).select("id", parts.alias("p")).select("id", F.col("p.title").alias("title"), F.md5("p.body").alias("body_md5"))


_BLOCKS = "regexp_extract_all(coalesce(html, ''), '(?is)<p[^>]*>(.*?)(?:</p>|<p[ >]|\\z)', 1)"


@query(
    f"""with b as (select page_id, html, list_filter(list_transform({_BLOCKS}, lambda p: trim(regexp_replace({_CLEAN.replace('html', 'p')}, '\\s+', ' ', 'g'))), lambda p: p <> '') as ps from pages)
select page_id, len(ps) as n_paragraphs, md5(array_to_string(ps, chr(10) || chr(10))) as body_md5, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) as headline from b"""
)
def s09_page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline and paragraphs of pages."""
    blocks = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?is)<p[^>]*>(.*?)(?:</p>|<p[ >]|\z)"), F.lit(1))
    ps = F.filter(F.transform(blocks, lambda p: F.trim(F.regexp_replace(x.clean_html(p), r"\s+", " "))), lambda p: p != "")
    return table(spark, sf_dir, "pages").select("page_id", ps.alias("ps"), "html").select("page_id", F.size("ps").alias("n_paragraphs"), F.md5(F.array_join("ps", "\n\n")).alias("body_md5"), F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1).alias("headline"))


_CLEANING = [
    (r"\n{3,}", "\n\n"), (" {2,}", " "), (r"[가-힣]{2,4}\s*기자\s*[\p{L}\p{N}_.]*@[\p{L}\p{N}_.]+", ""), (r"[\p{L}\p{N}_.]+@[\p{L}\p{N}_.]+\.[\p{L}\p{N}_.]+", ""), (r"(?m)\n[가-힣]{2,4}\s*기자\s*$", ""), (r"(?:\n\s*-\s*[^\n]+){2,}", ""),
    *(("(?i)" + w, "") for w in rules.BODY_SERVICE), *(("(?im)" + w, "") for w in rules.BODY_TAILS),
]
_LIST_LINE = "^[-·•]\\s*.+[-–]\\s*(?:" + "|".join(rules.LIST_OUTLETS) + ")"


def _clean_sql(text: str) -> str:
    for pattern, value in _CLEANING:
        text = f"regexp_replace({text}, {sql_text(pattern)}, {sql_text(value)}, 'g')"
    return text


@query(
    f"""with {ARTICLES}, c as (select id, {_clean_sql('body')} as t from articles), l as (select id, i, string_split(t, chr(10))[i] as line from (select id, t, unnest(range(1, len(string_split(t, chr(10))) + 1)) as i from c)),
m as (select *, sum((trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) = '')::int) over (partition by id order by i) as section, regexp_matches(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), '{_LIST_LINE}') as listed from l),
k as (select *, bool_or(listed) over (partition by id, section order by i) as skip from m), j as (select id, string_agg(line, chr(10) order by i) filter (not skip) as t from k group by id),
e as (select id, regexp_replace(regexp_replace(regexp_replace(coalesce(t, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s*\\n', '', 'g'), '^\\s+|\\s+$', '', 'g') as t from j)
select id, length(t) as n_chars, md5(t) as text_md5 from e"""
)
def p16_clean_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies without bylines, addresses, lists of articles (up to a blank line), sentences of services and tails about rights."""
    t = articles(spark, sf_dir).select("id", x.clean_body(F.col("body")).alias("t"))
    return t.select("id", F.length("t").alias("n_chars"), F.md5("t").alias("text_md5"))


_CUTS = "string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_LINK = f"""list_reduce(list_transform({{0}}, lambda s: {{{{'t': '', 'i': 0, 'k': 0, 's': s}}}}), lambda a, e: {{{{
  't': case when a.i = 0 then '' else a.t || ' ' end || case when a.i > 0 and a.i % 2 = 0 and a.k < {len(rules.CONNECTORS)} and not regexp_matches(e.s, {sql_text('^(?:' + '|'.join(rules.CONNECTED) + ')')}) then {sql_text(list(rules.CONNECTORS))}[a.k + 1] || ' ' || e.s else e.s end,
  'i': a.i + 1, 'k': a.k + case when a.i > 0 and a.i % 2 = 0 and a.k < {len(rules.CONNECTORS)} and not regexp_matches(e.s, {sql_text('^(?:' + '|'.join(rules.CONNECTED) + ')')}) then 1 else 0 end, 's': ''}}}}, {{{{'t': '', 'i': 0, 'k': 0, 's': ''}}}}).t"""
_MARKED = """list_reduce(list_transform({0}, lambda e: {{'t': '', 'c': e.s, 'g': {1}}}), lambda a, e: {{'t': case when length(e.c) > 0 and contains(a.t, e.c) then left(a.t, strpos(a.t, e.c) - 1) || e.c || e.g || substr(a.t, strpos(a.t, e.c) + length(e.c)) else a.t end, 'c': '', 'g': ''}}, {{'t': {2}, 'c': '', 'g': ''}}).t"""


@query(
    f"""with {_TOP}, o as (select topic_id, l, {_JOIN.format('l[1:8]')} as text from st), c as (select topic_id, text, l[2:4] as cited, {_JOIN.format('l[1:5]')} as intro from o),
f as (select topic_id, string_agg(source_name, ', ' order by first) as names from (select id // 5 as topic_id, source_name, min(ord) as first from articles where source_name is not null group by 1, 2) group by topic_id)
select topic_id, md5({_LINK.format(_CUTS.format('text'))}) as linked_md5, md5({_MARKED.format('cited', "' (src' || e.place || ')'", 'intro')}) as inline_md5,
  md5({_MARKED.format('cited', "'[' || (e.place - 1) || ']'", 'intro')} || chr(10) || chr(10) || array_to_string(list_transform(cited, lambda e: '[' || (e.place - 1) || '] src' || e.place), chr(10))) as endnote_md5, names from c join f using (topic_id)"""
)
def c03_marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each topic with connecting words; its introduction with markers of three cited sentences, inline and as notes; its sources in order of first use."""
    from ..operators.sentences import with_connectors

    t = ordered_topics(spark, sf_dir)
    some = lambda n: assembly.joined(F.slice("s", 1, n))
    cited = F.transform(F.slice("s", 2, 3), lambda e: F.struct(e.sentence.alias("cited"), F.concat(F.lit("src"), e.place.cast("string")).alias("source")))
    named = citations.source_list(articles(spark, sf_dir).where("source_name is not null").select(F.floor(F.col("id") / 5).cast("long").alias("topic_id"), "source_name", "ord"), "topic_id")
    made = t.select("topic_id", F.md5(with_connectors(some(8))).alias("linked_md5"), F.md5(citations.marked(some(5), cited)).alias("inline_md5"), F.md5(citations.marked(some(5), cited, "endnote")).alias("endnote_md5"))
    return made.join(named.withColumnRenamed("sources", "names"), "topic_id")


_KEY = "trim(regexp_replace(regexp_replace(lower(title), '\\s+', ' ', 'g'), '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\s]', '', 'g'))"


@query(
    f"""with recursive {ARTICLES}, k0 as (select coalesce(source_id, '') as grp, id, ord, {_KEY} as key from articles), f as (select *, list_distinct(list_filter(string_split_regex(key, '\\s+'), lambda w: w <> '')) as t from (select *, row_number() over (partition by grp, key order by ord, id) as n from k0) where n = 1),
g as (select distinct grp, id, substr(key, i, 15) as gram from (select grp, id, key, unnest(range(1, length(key) - 13)) as i from f where length(key) >= 15)), m as (select grp, gram from g group by all having count(*) > 1),
e0 as (select a.grp, a.id as a, b.id as b from f a join f b on a.grp = b.grp and a.id <> b.id where len(a.t) > 0 and len(b.t) > 0 and len(list_intersect(a.t, b.t)) * 2 >= len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))),
e1 as (select distinct x.grp, x.id as a, y.id as b from g x join m using (grp, gram) join g y on y.grp = x.grp and y.gram = x.gram and y.id <> x.id), nb as (select grp, b as id, list(distinct a) as near from (select * from e0 union all select * from e1) group by all),
nodes_ as (select grp, id, row_number() over (partition by grp order by ord, id) as k from f),
steps(grp, k, leaders) as (select grp, cast(0 as bigint), cast([] as bigint[]) from (select distinct grp from f) union all
  select n.grp, n.k, case when len(list_intersect(leaders, coalesce(near, []))) > 0 then leaders else list_append(leaders, n.id) end from steps s join nodes_ n on n.grp = s.grp and n.k = s.k + 1 left join nb on nb.grp = n.grp and nb.id = n.id)
select grp, unnest(leaders) as id from (select grp, leaders, row_number() over (partition by grp order by k desc) as z from steps) where z = 1"""
)
def d08_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of each source without those equal or similar to an earlier kept one, or sharing fifteen characters with it."""
    from ..operators.sentences import distinct_sentences

    rows = articles(spark, sf_dir).select(F.coalesce("source_id", F.lit("")).alias("grp"), "id", "ord", F.col("title").alias("sentence"))
    return distinct_sentences(rows).select("grp", "id")


_SOURCES = """s as (select source as source_id, case cast(regexp_extract(source, '(\\d+)', 1) as int) % 4 when 0 then 'whitelist' when 1 then 'tier1' when 2 then 'tier2' else 'tier3' end as tier, cast(regexp_extract(source, '(\\d+)', 1) as int) as n, list(distinct lang) as cats from documents group by source),
r as (select *, case when n % 3 = 0 then 'api' else 'rss' end as kind, n % 5 <> 0 as active, case when n % 2 = 0 then ['KR', 'US'] else ['US'] end as locales, case tier when 'whitelist' then 95.0 when 'tier1' then 85.0 when 'tier2' then 65.0 else 40.0 end as base from s)"""
_FILTERS = {
    "active": (dict(), "active"), "all": (dict(active=False), "true"), "tier": (dict(tier="tier2"), "active and tier = 'tier2'"), "type": (dict(ingestion_type="api"), "active and kind = 'api'"),
    "category": (dict(category="fr", active=False), "list_contains(cats, 'fr')"), "locale": (dict(locale="KR"), "active and list_contains(locales, 'KR')"), "verified": (dict(verified=True), "active and tier in ('whitelist', 'tier1')"),
}


@query(f"with {_SOURCES} " + " union all ".join(f"select '{name}' as filter, source_id, row_number() over (order by base desc, source_id) as place from r where {test}" for name, (_, test) in _FILTERS.items()))
def f18_source_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by each filter of the registry, by credibility."""
    n = F.regexp_extract("source_id", r"(\d+)", 1).cast("int")
    s = sources(spark, sf_dir).withColumns({"ingestion_type": F.when(n % 3 == 0, "api").otherwise("rss"), "is_active": n % 5 != 0, "supported_locales": F.when(n % 2 == 0, x.strings(("KR", "US"))).otherwise(x.strings(("US",)))})
    s = materialized(s, "sources")
    place = F.row_number().over(Window.orderBy(F.desc("credibility_base_score"), "source_id"))  # a row an outlet
    out = [registry.select(s, **how).select(F.lit(name).alias("filter"), "source_id", place.alias("place")) for name, (how, _) in _FILTERS.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4]).union(out[5]).union(out[6])


_FEW = "length({0}) > {1} and length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g')) > 0 and length(regexp_replace({0}, '[^가-힣]', '', 'g')) < 0.2 * length(regexp_replace({0}, '[^\\p{{L}}]', '', 'g'))"


@query(f"with {ARTICLES}, m as (select id, title, case when id % 2 = 0 then '한국어 제목이 앞에 섭니다 ' || left(title, 12) else title end as mixed from articles) select id, {_FEW.format('title', 15)} as title_few, {_FEW.format('mixed', 10)} as mixed_few from m")
def f09_hangul_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """titles of which less than a fifth of the letters are Hangul, as they are and behind a Korean phrase."""
    from ..operators.sentences import few_hangul

    title = F.col("title")
    mixed = F.when(F.col("id") % 2 == 0, F.concat(F.lit("한국어 제목이 앞에 섭니다 "), F.substring("title", 1, 12))).otherwise(title)
    return articles(spark, sf_dir).select("id", few_hangul(title).alias("title_few"), few_hangul(mixed, longer=10).alias("mixed_few"))
