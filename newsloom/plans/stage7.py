"""Queries over files that are landed from the driver's tables and read back: feeds, API responses, reports, nested groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import assembly, images, qa, ranking, registry, scoring
from ..operators import pages as page_blocks
from ..rules import formats
from ..sources import feeds, landing
from ..storage import materialized, new_path
from .registry import query
from .stage1 import _LATIN, RANKED, _unescape
from .stage3 import _TITLES
from .stage4 import _verdict_sql
from .tables import ARTICLES, AS_OF, articles, as_of, news, query_table, sql_text, table

#: Pages of a landed feed, of an API response, and runs of a report.
FEED, RESPONSE, REPORT = 20, 10, 50
_DATES = ("Thu, 05 Feb 2026 10:00:00 +0900", "2026-02-05T10:00:00+09:00")
_CONTROL, _BLANKS = "[\\x00-\\x08\\x0E-\\x1F]", "[ \\t\\n\\x0B\\f\\r]+"


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, _CONTROL, ""), _BLANKS, " "))


def _plain_sql(sql: str) -> str:
    return f"trim(regexp_replace(regexp_replace({sql}, '{_CONTROL}', '', 'g'), '{_BLANKS}', ' ', 'g'))"


def _page_fields(pages: DataFrame) -> DataFrame:
    """Title, description, date and author of pages; some have none of the last three."""
    n, html = F.col("page_id"), F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", "url", F.concat(n.cast("string"), F.lit(": "), _plain(F.regexp_extract(html, "<title>([^<]*)</title>", 1))).alias("title"), F.when(n % 5 != 0, _plain(F.substring(html, 1, 200))).alias("description"),
        F.when(n % 3 == 0, _DATES[0]).when(n % 3 == 1, _DATES[1]).alias("published"), F.when(n % 7 != 0, F.concat(F.lit("author "), (n % 7).cast("string"))).alias("author"),
    )


_PAGE_FIELDS = f"""f as (select page_id, url, page_id || ': ' || {_plain_sql("regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)")} as title, case when page_id % 5 <> 0 then {_plain_sql("left(coalesce(html, ''), 200)")} end as description,
  case page_id % 3 when 0 then {sql_text(_DATES[0])} when 1 then {sql_text(_DATES[1])} end as published, case when page_id % 7 <> 0 then 'author ' || (page_id % 7) end as author from pages)"""


def feed_documents(pages: DataFrame) -> DataFrame:
    """(feed, search, xml): each FEED pages as RSS, Atom, search RSS or RSS with creators by turns; in some feeds one element is never closed."""
    n, tag = F.col("page_id"), feeds.xml_element
    rows = _page_fields(pages).withColumn("feed", F.floor(n / FEED)).withColumn("kind", F.pmod("feed", F.lit(4)))
    source = F.when(n % 3 != 0, tag("source", F.concat(F.lit("Outlet "), (n % 5).cast("string")), ' url="http://outlet.example/"'))
    common = [tag("title", F.col("title")), tag("link", F.col("url")), tag("description", F.col("description")), tag("pubDate", F.col("published"))]
    item = lambda *more: F.concat(F.lit("<item>"), F.concat_ws("", *common, *more), F.lit("</item>\n"))
    link = F.concat(F.lit('<link rel="alternate" href="'), feeds.xml_text(F.col("url")), F.lit('"/><link rel="self" href="http://self.example/"/>'))
    entry_text = F.when(n % 2 == 0, tag("summary", F.col("description"))).otherwise(tag("content", F.col("description"), ' type="html"'))
    entry_time = F.when(n % 2 == 0, tag("published", F.col("published"))).otherwise(tag("updated", F.col("published")))
    entry = F.concat(F.lit("<entry>"), F.concat_ws("", tag("title", F.col("title"), ' type="html"'), link, entry_text, entry_time, F.concat(F.lit("<author>"), tag("name", F.col("author")), F.lit("</author>"))), F.lit("</entry>\n"))
    xml = (
        F.when(F.col("kind") == 0, item(tag("author", F.col("author")))).when(F.col("kind") == 1, entry).when(F.col("kind") == 2, item(source, tag("guid", n.cast("string"), ' isPermaLink="false"')))
        .otherwise(item(F.lit("<author></author>"), tag("dc:creator", F.col("author"))))
    )
    broken = (F.pmod("feed", F.lit(7)) == 3) & (n % FEED == 2)
    rows = rows.withColumn("xml", F.when(broken, F.replace(xml, F.lit("</title>"), F.lit(""))).otherwise(xml))
    whole = rows.groupBy("feed", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "xml"))), lambda r: r.xml), "").alias("xml"))
    head = F.when(F.col("kind") == 1, '<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>').otherwise('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>feed</title>')
    tail = F.when(F.col("kind") == 1, "</feed>").otherwise("</channel></rss>")
    return whole.select("feed", (F.col("kind") == 2).alias("search"), F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), head, "xml", tail).alias("xml"))


@query(
    f"""with {_PAGE_FIELDS}, r as (select *, page_id // {FEED} as feed, page_id // {FEED} % 4 as kind from f), bad as (select distinct feed from r where feed % 7 = 3 and page_id % {FEED} = 2)
select feed, case when kind = 2 then 'search' else 'record' end as status, title, url, description, published, case when kind <> 2 then author end as author,
  case when kind = 2 then case when page_id % 3 <> 0 then 'Outlet ' || (page_id % 5) else 'Unknown' end end as source_name, cast(null as int) as elements from r where feed not in (select feed from bad)
union all select feed, 'malformed', null, null, null, null, null, null, cast(count(*) as int) from r where feed in (select feed from bad) group by feed"""
)
def s01_landed_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds written to the shared folder and scanned: RSS items, Atom entries, search results with outlets, and documents that are malformed."""
    root, docs, out = new_path(spark, "feeds"), feed_documents(table(spark, sf_dir, "pages")), None
    none = F.lit(None)
    for name, search, read in (("general", False, feeds.read_feeds), ("search", True, feeds.read_search_rss)):
        docs.where(F.col("search") == search).select("feed", "xml").write.partitionBy("feed").text(f"{root}/{name}")
        bad = materialized(feeds.malformed(spark, f"{root}/{name}").select("feed", "elements"), "malformed")
        records = read(spark, f"{root}/{name}", bad).select("feed", F.lit("search" if search else "record").alias("status"), *feeds.RECORD[1:], none.cast("int").alias("elements"))
        lost = bad.select("feed", F.lit("malformed").alias("status"), *(none.cast("string").alias(c) for c in feeds.RECORD[1:]), "elements")
        part = records.unionByName(lost)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("feed", F.regexp_extract("feed", "/feed=([0-9]+)/", 1).cast("long"))


_SNIPPET_OF = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
_OUTLET = f"case when coalesce(url, '') = '' then '네이버 뉴스' when regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1) = '' then 'Unknown' else coalesce(map_extract({{}}, regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1))[1], regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1)) end".format(
    "map {" + ", ".join(f"{sql_text(k)}: {sql_text(v)}" for k, v in formats.DOMAIN_NAMES.items()) + "}"
)


@query(
    f"""with {_PAGE_FIELDS}, r as (select *, page_id // {RESPONSE} as response, page_id % {RESPONSE} as place, case when page_id % 3 = 0 then 'http://n.example/' || page_id else url end as address from f),
c as (select address as url, {_SNIPPET_OF.format(_unescape("('<b>' || title || '</b>')"))} as title, {_SNIPPET_OF.format(_unescape("coalesce(description, chr(32))"))} as description, published from r where response % 5 <> 4 and place < 8)
select 'record' as status, title, url, case when description <> '' then description end as description, published, {_OUTLET} as source_name, cast(null as bigint) as responses from c
union all select 'malformed', null, null, null, null, null, count(distinct response) from r where response % 5 = 4"""
)
def s04_api_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON responses written as lines, `items` or `articles`, and read with at most eight results each; and how many were no JSON."""
    n, path = F.col("page_id"), new_path(spark, "responses")
    rows = _page_fields(table(spark, sf_dir, "pages")).withColumn("response", F.floor(n / RESPONSE))
    item = F.struct(
        n.alias("place"), F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.when(n % 3 == 0, "").otherwise(F.col("url")).alias("originallink"),
        F.concat(F.lit("http://n.example/"), n.cast("string")).alias("link"), "description", F.col("published").alias("pubDate"),
    )
    whole = rows.groupBy("response").agg(F.array_sort(F.collect_list(item)).alias("all"))
    json = F.when(F.col("response") % 3 == 1, F.to_json(F.struct(F.col("all").alias("articles")))).otherwise(F.to_json(F.struct(F.col("all").alias("items"))))
    whole.select(F.when(F.col("response") % 5 == 4, F.substring(json, F.lit(1), F.length(json) - 2)).otherwise(json)).write.text(path)
    records = feeds.read_api(spark, path, 8, lines=True)
    blank = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    records = records.select(F.lit("record").alias("status"), "title", "url", blank("description"), "published", registry.outlet(F.col("url")).alias("source_name"), F.lit(None).cast("long").alias("responses"))
    none = F.lit(None).cast("string")
    lost = feeds.malformed_api(spark, path, lines=True).agg(F.count("*").alias("responses")).select(F.lit("malformed").alias("status"), *(none.alias(c) for c in records.columns[1:-1]), "responses")
    return records.unionByName(lost)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as runs of a report: type, time, success and images by number."""
    n = F.col("id")
    return articles(spark, sf_dir).select(
        F.floor(n / REPORT).alias("report"), n.alias("test_id"), F.substring("title", 1, 20).alias("keyword"), (n % 11 != 0).alias("success"), F.when(n % 11 != 0, F.round(100 - (n % 13) * 2.3, 1)).otherwise(0.0).alias("score"),
        F.length("body").alias("generated_char_count"), ((n * 37) % 13000).alias("generation_time_ms"), F.when(n % 3 == 0, F.array(F.concat(F.lit("BODY_TOO_SHORT:"), F.length("body").cast("string")))).otherwise(F.array().cast("array<string>")).alias("issues"),
        F.struct(F.when(n % 2 == 0, "standard").otherwise("data").alias("news_type")).alias("structure"), F.struct((n % 4).cast("int").alias("total_count"), (n % 2).cast("int").alias("valid_count")).alias("images"),
    )


@query(
    f"""with {ARTICLES}, r as (select id // {REPORT} as report, id as test_id, left(title, 20) as keyword, id % 11 <> 0 as success, case when id % 11 <> 0 then round(100 - (id % 13) * 2.3, 1) else 0.0 end as score, length(body) as generated_char_count,
  (id * 37) % 13000 as generation_time_ms, case when id % 3 = 0 then 'BODY_TOO_SHORT:' || length(body) else '' end as issues, case when id % 2 = 0 then 'standard' else 'data' end as news_type, cast(id % 4 as int) as total_count from articles)
select *, count(*) over (partition by report) as tests, count(*) filter (success) over (partition by report) as successes, round(avg(score) filter (success) over (partition by report), 3) as mean_score from r"""
)
def s07_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs published as nested reports in two landings with a manifest, a third one that never got its entry, and read back with the summaries."""
    root, docs = new_path(spark, "reports"), feeds.report_documents(runs(spark, sf_dir), "report")
    for half in (0, 1):
        landing.publish(docs.where(F.col("report") % 2 == half), root)
    docs.limit(1).write.json(f"{root}/runs/unfinished")
    out = feeds.report_rows(landing.read_published(spark, root), "report")
    return out.select("report", "test_id", "keyword", "success", "score", "generated_char_count", "generation_time_ms", F.array_join("issues", ",").alias("issues"), "structure.news_type", "images.total_count", "tests", "successes", "mean_score")


@query(
    f"""with {ARTICLES}, h as (select id, title, source_name, md5(lower(trim(title))) as k from articles), g as (select *, min(id) over (partition by k) as leader, count(*) over (partition by k) as size from h)
select leader, size, id, title, source_name from g where size > 1"""
)
def s11_nested_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal titles published as nested JSON (representative and members, hot groups in parts), read back by schema."""
    n = articles(spark, sf_dir).select("id", "title", "source_name", x.title_hash(F.col("title")).alias("k"))
    first = n.groupBy("k").agg(F.min("id").alias("leader"), F.count("*").alias("size")).where("size > 1")
    root = new_path(spark, "groups")
    landing.publish(feeds.nested_groups(n.join(first, "k").select("leader", "id"), n), root)
    return feeds.group_rows(landing.read_published(spark, root))


def image_pages(p: DataFrame) -> DataFrame:
    """Pages of image tags in every quoting and order: two that stay, one without scheme, one without source, a repeated one, one that the rules refuse, and metadata in every third."""
    k = F.col("page_id")
    n = lambda m: F.pmod(k, F.lit(m)).cast("string")
    first = F.concat(F.lit("<IMG alt='A \"q\" "), k.cast("string"), F.lit('\' src="http://img.example/photo-'), n(7), F.lit('_600x400.jpg" class=wide>'))
    second = F.concat(F.lit('<img title="T > '), k.cast("string"), F.lit('" data-src="http://no.example/x.jpg" src=\'/images/p'), n(3), F.lit(".png' alt=plain>"))
    third = F.concat(F.lit('<img class="c d" src=//cdn.example/news'), n(5), F.lit(".webp>"))
    meta = F.when(k % 3 == 0, F.concat(F.lit('<meta content="http://img.example/og'), n(4), F.lit(".jpg\" property='og:image'>"))).otherwise("")
    html = F.concat(F.lit("<head>"), meta, F.lit("</head><body><p>x</p>"), first, F.lit('<img src="http://x.example/logo.png"><img alt="none">'), second, F.when(k % 2 == 0, first).otherwise(""), third, F.lit("</body>"))
    return p.select("page_id", "url", html.alias("html"))


@query(
    f"""with p as (select page_id, regexp_extract(url, '^(https?://[^/]+)', 1) as host, regexp_extract(url, '^(https?:)', 1) as scheme, page_id % 3 = 0 as og from pages),
r as (select page_id, -1 as n, 'http://img.example/og' || (page_id % 4) || '.jpg' as url, '' as alt, 'Open Graph Image' as title, 'og-image' as css_class from p where og
  union all select page_id, 0, 'http://img.example/photo-' || (page_id % 7) || '_600x400.jpg', 'A "q" ' || page_id, '', 'wide' from p
  union all select page_id, 1, host || '/images/p' || (page_id % 3) || '.png', 'plain', 'T > ' || page_id, '' from p union all select page_id, 2, scheme || '//cdn.example/news' || (page_id % 5) || '.webp', '', '', 'c d' from p),
v as (select *, {_verdict_sql("", 100, 100, "when not regexp_matches(low, '[.](jpg|jpeg|png|webp)|image|img|photo') then 'no_image_name'")} as verdict from (select *, lower(url) as low from r))
select page_id, cast(row_number() over (partition by page_id order by n) as int) as place, cast(case when n < 0 then -1 else row_number() over (partition by page_id, n < 0 order by n) - 1 end as int) as position, url, alt, title, css_class, true as in_article
from v where verdict = 'valid'"""
)
def i02_image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image records of pages: attributes in any order and quoting, og:image first, each address once, without refused ones."""
    return images.image_records(image_pages(table(spark, sf_dir, "pages")))


def _blocks_sql() -> str:
    out = "regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g')"
    for tag in page_blocks.SKIPPED:
        out = f"regexp_replace({out}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', chr(57344), 'g')"
    return f"string_split(regexp_replace({out}, '(?i)</?(?:{'|'.join(page_blocks.BLOCKS)})(?:\\s[^>]*)?/?>', chr(57344), 'g'), chr(57344))"


_PLAIN_OF = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@query(
    f"""with b0 as (select page_id, unnest({_blocks_sql()}) as part, generate_subscripts({_blocks_sql()}, 1) as i from pages),
b1 as (select page_id, i, {_PLAIN_OF.format(_unescape("regexp_replace(part, '<[^>]*>', '', 'g')"))} as text, {_PLAIN_OF.format(_unescape("regexp_replace(regexp_replace(part, '(?is)<a(?:\\s[^>]*)?>.*?</a\\s*>', '', 'g'), '<[^>]*>', '', 'g')"))} as alone from b0),
b as (select page_id, row_number() over (partition by page_id order by i) as i, text, 2 * length(alone) - length(text) - {page_blocks.COST} as weight from b1 where text <> ''),
s as (select *, sum(weight) over w as s, sum(weight) over w - weight as before from b window w as (partition by page_id order by i)), m as (select *, min(before) over (partition by page_id order by i) as least from s),
e as (select page_id, first(i order by s - least desc, i) as last, first(least order by s - least desc, i) as least, max(s - least) as best from m group by 1 having max(s - least) > 0),
f as (select e.page_id, last, min(s.i) as first from e join s on s.page_id = e.page_id and s.before = e.least group by 1, 2)
select p.page_id, count(b.i) as n_blocks, count(b.i) filter (b.i between first and last) as n_run, md5(coalesce(string_agg(text, chr(10) order by b.i) filter (b.i between first and last), '')) as body_md5
from pages p left join b using (page_id) left join f using (page_id) group by 1"""
)
def s09_page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of each page: the run of blocks with most text and least links, without navigation, lists of links and scripts."""
    out = page_blocks.page_bodies(table(spark, sf_dir, "pages"))
    return out.select("page_id", "n_blocks", "n_run", F.md5("body").alias("body_md5"))


#: The rankings of the stated queries as search tests, with every fiftieth article lacking its address.
_TESTS = f"""{RANKED}, t as (select query_id, preset, lim, keywords, coalesce(date_from, timestamp '{AS_OF}') as target, (select count(*) from news) as raw from queries),
rr as (select r.*, t.target, coalesce(lead(final_score) over (partition by r.query_id, group_key order by rank_position) > final_score, false) as rises,
  len(list_filter(flatten(terms), lambda w: contains(lower(title) || ' ' || lower(body), w))) > 0 as hit, coalesce(abs(floor((epoch_us(published_at) - epoch_us(t.target)) / 86400000000)) <= 3, false) as near from ranked r join t using (query_id) where rank_position > off and rank_position <= off + r.lim),
mm as (select query_id, count(*) as n, round(avg(final_score), 1) as avg_score, round(min(final_score), 1) as min_score, round(max(final_score), 1) as max_score, round(max(final_score) - min(final_score), 1) as score_range, round(count(*) filter (hit) / count(*), 2) as relevance_ratio,
  count(distinct coalesce(source_name, '')) as unique_sources, round(count(distinct coalesce(source_name, '')) / count(*), 2) as diversity_ratio, round(count(*) filter (near) / count(*), 2) as date_match_ratio, avg(popularity_score) as pop, avg(credibility_score) as cred,
  count(*) filter (title = '' or body = '') as empty_, count(*) filter (id % 50 = 0) as unlinked, count(*) filter (rises) as rises from rr group by 1),
ii as (select t.query_id, preset, coalesce(n, 0) as n, mm.* exclude (query_id, n), list_filter([case when raw = 0 then 'CRITICAL:collection_empty' end, case when raw > 0 and n is null then 'HIGH:pipeline_empty' end, case when n < lim and raw >= lim then 'MEDIUM:insufficient_results' end,
  case when avg_score < case when preset = 'latest' then 20 else 30 end then 'HIGH:low_avg_score' when avg_score < case when preset = 'latest' then 35 else 50 end then 'MEDIUM:mediocre_avg_score' end, case when relevance_ratio < 0.3 and len(keywords) > 0 then 'HIGH:low_relevance' end,
  case when n >= 3 and unique_sources = 1 then 'MEDIUM:no_diversity' end, case when date_match_ratio < 0.5 then 'MEDIUM:date_mismatch' end, case when preset = 'trending' and pop < 0.1 then 'LOW:low_trending_popularity' end, case when preset = 'credible' and cred < 0.5 then 'MEDIUM:low_credibility_in_credible_preset' end,
  case when empty_ > 0 then 'HIGH:empty_content' end, case when unlinked > 0 then 'LOW:missing_url' end, case when preset <> 'latest' and rises > 0 then 'CRITICAL:score_ordering' end], lambda v: v is not null) as issues from t left join mm using (query_id)),
ss as (select *, greatest(0, 100 - coalesce(list_sum(list_transform(issues, lambda v: case split_part(v, ':', 1) when 'CRITICAL' then 30 when 'HIGH' then 15 when 'MEDIUM' then 5 else 2 end)), 0)) as s0 from ii),
s3 as (select *, case when n = 0 then 0 else least(100, least(100, least(100, s0 + case when avg_score >= 60 then 10 else 0 end) + case when relevance_ratio >= 0.5 then 5 else 0 end) + case when diversity_ratio >= 0.5 then 5 else 0 end) end as score from ss),
tests as (select query_id, preset, n, avg_score, min_score, max_score, score_range, relevance_ratio, unique_sources, diversity_ratio, date_match_ratio, issues, cast(score as int) as score,
  n > 0 and score >= 50 and len(list_filter(issues, lambda v: starts_with(v, 'CRITICAL'))) = 0 as passed from s3)"""


def search_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries as tests of the ranking, checked."""
    q, n = query_table(spark), news(spark, sf_dir)
    ranked = ranking.rank(q, n, as_of(), _LATIN)
    results = ranked.join(n.select("id", "body"), "id").withColumn("url", F.when(F.col("id") % 50 != 0, F.concat(F.lit("http://news.example/"), F.col("id").cast("string"))))
    raw = table(spark, sf_dir, "documents").count()
    terms = scoring.expanded_terms(q, _LATIN).select("query_id", F.array_distinct(F.flatten("terms")).alias("terms"))
    tests = q.join(terms, "query_id", "left").select("query_id", "preset", "limit", F.coalesce("date_from", as_of()).alias("date"), F.lit(raw).alias("raw_count"), F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    return qa.validated(tests, results)


@query(f"with {_TESTS} select * replace (array_to_string(issues, ',') as issues) from tests")
def v01_search_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten checks of each query's results: collection, number, scores, relevance with synonyms, sources, dates, preset, content, addresses, order."""
    return search_tests(spark, sf_dir).withColumn("issues", F.array_join(F.transform("issues", lambda i: F.concat_ws(":", i.severity, i["check"])), ","))


@query(f"""with {_TESTS}, i as (select unnest(issues) as v from tests) select 'check' as by, split_part(v, ':', 2) as issue, count(*) as n from i group by 2 union all select 'severity', v, count(*) from i group by 2""")
def a07_search_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of search tests by check, and by severity and check."""
    return qa.issue_counts(search_tests(spark, sf_dir))


@query(
    f"""with {_TESTS}, g as (select preset, grouping(preset) as "all", count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, 0 as errors, round(count(*) filter (passed) / count(*) * 100, 1) as pass_rate, round(avg(score), 1) as mean_score from tests group by rollup (preset)),
i as (select preset, issue, grouping(preset) as "all", count(*) as n from (select preset, split_part(unnest(issues), ':', 2) as issue from tests) group by grouping sets ((preset, issue), (issue))),
k as (select * from (select *, row_number() over (partition by "all", preset order by n desc, issue) as k from i) where k <= 10)
select g.*, coalesce((select string_agg(issue || ':' || n, ',' order by k) from k where k."all" = g."all" and k.preset is not distinct from g.preset), '') as issues from g"""
)
def v02_search_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over a batch of search tests, by preset and in all."""
    tests = search_tests(spark, sf_dir).withColumns({"issues": F.transform("issues", lambda i: i["check"]), "error": F.lit(False)})
    return qa.batch_report(tests, "preset")


@query(
    f"""with {ARTICLES}, t as (select id, trim(regexp_replace({_TITLES}, '\\s{{2,}}', ' ', 'g')) as title, list_filter(list_transform(string_split_regex(body, '[.!?]\\s*'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20)[1:4] as said from articles)
select id, len(said) + 1 as n_cards, left(title, 30) as first_title, md5(array_to_string(list_concat([title], list_transform(said, lambda s: left(s, 150))), chr(10))) as bodies_md5 from t"""
)
def m07_fallback_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of each article from its title and first sentences."""
    cards = assembly.fallback_cards(x.clean_title(F.col("title")), F.col("body"))
    t = articles(spark, sf_dir).select("id", cards.alias("cards"))
    return t.select("id", F.size("cards").alias("n_cards"), F.get("cards", F.lit(0))["title"].alias("first_title"), F.md5(F.array_join(F.transform("cards", lambda c: c.body), "\n")).alias("bodies_md5"))
