"""Queries over normalisation, filters, dedup, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import dedup, ranking, scoring
from ..operators.similarity import link_counts
from ..rules import news as rules
from ..rules.news import LATIN
from .registry import SQL, query
from .tables import ARTICLES, AS_OF, LATER, NEWS, QUERIES, any_of, articles, as_of, category_sql, count_of, news, query_table, sql_text, table, words_sql

_BARE = "regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"


def _unescape(sql: str) -> str:
    for name, char in x.ENTITIES:
        sql = f"replace({sql}, {sql_text(name)}, {sql_text(char)})"
    return sql


_CLEAN = f"array_to_string(list_filter(list_transform(string_split({_unescape(_BARE)}, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10))"
_SNIPPET = f"trim(regexp_replace(regexp_replace({_unescape('coalesce(html, chr(32))')}, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))"
_URL = "nullif(rtrim(lower(regexp_replace(regexp_replace(url, '[?#].*$', ''), ';[^/]*$', '')), '/'), '')"


@query(
    f"""select page_id, md5({_CLEAN}) as clean_md5, length({_CLEAN}) as clean_length, md5({_SNIPPET}) as snippet_md5,
  length(trim(regexp_replace(coalesce(html, ''), '<[^>]+>', '', 'g'))) as stripped_length, left({_CLEAN}, 200) as summary,
  {_URL} as url_key, md5(concat('web:', coalesce(url, ''))) as record_id,
  lower(regexp_replace(regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1), '[^a-zA-Z0-9가-힣_]', '_', 'g')) as safe_source,
  regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1) as domain, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as page_title,
  len(regexp_extract_all(coalesce(html, ''), '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1)) as n_images,
  case when regexp_extract(html, '<html lang="([a-z]+)', 1) = 'ko' then 'KR' else 'US' end as country
from pages"""
)
def p_page_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as records."""
    p, html, url = table(spark, sf_dir, "pages"), F.col("html"), F.col("url")
    clean = x.clean_html(html)
    domain = F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)
    return p.select(
        "page_id", F.md5(clean).alias("clean_md5"), F.length(clean).alias("clean_length"), F.md5(x.clean_snippet(html)).alias("snippet_md5"),
        F.length(x.strip_tags(html)).alias("stripped_length"), F.substring(clean, 1, 200).alias("summary"), x.url_key(url).alias("url_key"),
        x.record_id(F.lit("web"), url).alias("record_id"), x.safe_id(domain).alias("safe_source"), domain.alias("domain"),
        F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1).alias("page_title"),
        F.size(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<img[^>]+src=["']([^"']+)["']"""), F.lit(1))).alias("n_images"),
        F.when(F.regexp_extract(html, '<html lang="([a-z]+)', 1) == "ko", "KR").otherwise("US").alias("country"),
    )


@query(
    f"""with {ARTICLES} select id, title, category, tags, left(body, 200) as summary, length(body) as n_chars, len({words_sql("body")}) as n_words,
  md5(lower(trim(title))) as title_hash, case source_tier when 'whitelist' then 1.0 when 'tier1' then 0.95 when 'tier2' then 0.8 when 'tier3' then 0.6 else 0.5 end as tier_weight,
  regexp_extract_all(title, '[a-zA-Z]+')[1:3] as hashtags, length(body) < 150 as is_short, regexp_matches(body, '\\d+[%억만조배위]') as has_statistics,
  contains(body, '"') or contains(body, '''') or contains(body, '라고 ') as has_quote,
  len(list_filter(regexp_extract_all(lower(title), '[가-힣]+|[a-z]+|[0-9]+'), lambda t: length(t) >= 2)) as n_mixed, len(regexp_extract_all(lower(title), '[가-힣a-z]{{2,}}')) as n_letters,
  len(list_distinct(regexp_extract_all(title, '[A-Z][a-z]{{2,}}'))) as n_entities
from articles"""
)
def p_article_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles."""
    body, title = F.col("body"), F.col("title")
    return articles(spark, sf_dir).select(
        "id", "title", "category", "tags", F.substring(body, 1, 200).alias("summary"), F.length(body).alias("n_chars"), F.size(x.words(body)).alias("n_words"),
        x.title_hash(title).alias("title_hash"), x.by_tier(F.col("source_tier"), rules.TIER_WEIGHT, 0.5).alias("tier_weight"),
        F.slice(F.regexp_extract_all(title, F.lit("[a-zA-Z]+"), F.lit(0)), 1, 3).alias("hashtags"), (F.length(body) < 150).alias("is_short"),
        body.rlike(r"\d+[%억만조배위]").alias("has_statistics"), x.has_quote(body).alias("has_quote"), F.size(x.mixed_tokens(title)).alias("n_mixed"),
        F.size(x.title_tokens(title)).alias("n_letters"), F.size(x.entities(title, ("[A-Z][a-z]{2,}",))).alias("n_entities"),
    )


@query(
    f"""with {NEWS} select id,
  abs(floor((epoch(published_at) - epoch(timestamp '2024-01-15 12:00:00')) / 86400)) <= 1 as near_date, published_at is null or published_at between timestamp '2024-01-10' and timestamp '2024-01-20' as in_range,
  {any_of("lower(title || ' ' || body)", ("thand", "eaux"))} as keyword_match, not {any_of("lower(title || ' ' || body)", ("idiot", "clown"))} as not_excluded,
  datediff('day', published_at, timestamp '{AS_OF}') <= 7 as recent
from news"""
)
def f_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date and keyword predicates."""
    n, pub = news(spark, sf_dir), F.col("published_at")
    text = F.lower(F.concat("title", F.lit(" "), "body"))
    days = F.floor((F.unix_micros(pub) / 1e6 - F.unix_timestamp(F.lit("2024-01-15 12:00:00"))) / 86400)
    return n.select(
        "id", (F.abs(days) <= 1).alias("near_date"), (pub.isNull() | pub.between("2024-01-10", "2024-01-20")).alias("in_range"),
        x.contains_any(text, ("thand", "eaux")).alias("keyword_match"), (~x.contains_any(text, ("idiot", "clown"))).alias("not_excluded"), (F.datediff(as_of(), pub) <= 7).alias("recent"),
    )


_TITLES = f"titles as (select id, ord, source_id, list_distinct({words_sql('lower(title)')}) as t from articles)"
_JACC = "len(list_intersect(a.t, b.t))"


def _counts_sql(num: int, den: int, tokens: str = _TITLES) -> str:
    """Of each article the first with the same tokens, and how many others are similar."""
    return f"""with {ARTICLES}, {tokens}, e as (select a.id, count(*) as links from titles a join titles b on a.id <> b.id where len(a.t) > 0 and len(b.t) > 0 and {_JACC} * {den} >= (len(a.t) + len(b.t) - {_JACC}) * {num} group by a.id)
select id, case when len(t) > 0 then min(id) over (partition by list_sort(t)) else id end as class_id, coalesce(links, 0) as links from titles left join e using (id)"""


def _counts(df: DataFrame) -> DataFrame:
    return df.select("id", F.col("first").alias("class_id"), "links")


@query(_counts_sql(6, 10))
def j03_title_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal titles, and how many titles are similar to each."""
    return _counts(link_counts(dedup.title_items(articles(spark, sf_dir)), 6, 10))


@query(
    f"""with {ARTICLES}, {_TITLES} select a.id, count(*) as cross_count from titles a join titles b on a.id <> b.id and a.source_id <> b.source_id
where len(a.t) > 0 and len(b.t) > 0 and {_JACC} * 2 >= len(a.t) + len(b.t) - {_JACC} group by a.id"""
)
def j04_cross_source_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many titles of other sources are similar to each."""
    return scoring.cross_counts(articles(spark, sf_dir), 1)


@query(_counts_sql(4, 10, "titles as (select id, list_distinct(regexp_extract_all(lower(title), '[가-힣a-z]{2,}')) as t from articles)"))
def j06_letter_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of titles by runs of letters, and how many are similar to each."""
    n = articles(spark, sf_dir)
    return _counts(link_counts(dedup.title_items(n, x.title_tokens(F.col("title"))), 4, 10))


_MIXED = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[가-힣]+|[a-z]+|[0-9]+'), lambda t: length(t) >= 2))"


_WEIGHTED = f"""s as (select id, ord, length(body) as chars, list_sort({_MIXED.format("title")}) as t, list_sort({_MIXED.format("body")}) as w from articles),
p as (select a.id as a, b.id as b, a.t as ta, b.t as tb, a.w as wa, b.w as wb from s a join s b on a.id < b.id where len(list_intersect(a.t, b.t)) * 4 >= len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) and len(a.t) > 0 and len(b.t) > 0),
q as (select a, b, 0.6 * (len(list_intersect(ta, tb)) / (len(ta) + len(tb) - len(list_intersect(ta, tb)))) + 0.4 * (case when len(wa) > 0 and len(wb) > 0 then len(list_intersect(wa, wb)) / (len(wa) + len(wb) - len(list_intersect(wa, wb))) else 0 end) as s from p),
w0 as (select a, b, round(s, 6) as score from q where round(s, 6) >= 0.55), w2 as (select a, b, score from w0 union all select b, a, score from w0)"""


@query(
    f"""with {ARTICLES}, {_WEIGHTED}, n as (select a as id, count(*) as links from w2 group by a)
select id, first_value(id) over (partition by t, w order by chars desc, ord, id) as class_id, coalesce(links, 0) as links from s left join n using (id)"""
)
def j05_weighted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of equal token sets, and how many articles are similar by title and body."""
    return _counts(dedup.weighted_counts(articles(spark, sf_dir)))


@query(f"select min(page_id) as page_id, {_URL} as url_key from pages where {_URL} is not null group by 2 union all select page_id, null from pages where {_URL} is null")
def d01_url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of each url key."""
    p = table(spark, sf_dir, "pages").withColumn("ord", F.col("page_id"))
    return dedup.by_url(p).select("page_id", x.url_key(F.col("url")).alias("url_key"))


@query(f"with {ARTICLES} select min(id) as id, md5(lower(trim(title))) as title_hash from articles group by 2")
def d02_title_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first article of each title."""
    return dedup.by_title(articles(spark, sf_dir)).select("id", x.title_hash(F.col("title")).alias("title_hash"))


def _greedy_sql(nodes: str, edges: str) -> str:
    """SQL of the sequential rule, one node a step: nodes_(id, k) in order, e(a, b) both ways, led(id, leader)."""
    return f"""nodes_ as ({nodes}), e as ({edges}), nb as (select b as id, list(a) as near from e group by b),
steps(k, leaders) as (select cast(0 as bigint), cast([] as bigint[]) union all select n.k, case when len(list_intersect(leaders, coalesce(near, []))) > 0 then leaders else list_append(leaders, n.id) end
  from steps s join nodes_ n on n.k = s.k + 1 left join nb on nb.id = n.id),
heads as (select leaders from steps order by k desc limit 1), led as (select n.id, case when list_contains(leaders, n.id) then n.id else list_filter(leaders, lambda l: list_contains(coalesce(near, []), l))[1] end as leader from nodes_ n cross join heads left join nb using (id))"""


_TITLE_PAIRS = f"select a.id as a, b.id as b from titles a join titles b on a.id <> b.id where len(a.t) > 0 and len(b.t) > 0 and {_JACC} * 10 >= (len(a.t) + len(b.t) - {_JACC}) * 6"
_CLUSTERS = """sized as (select leader, count(*) as size, first(id order by length(body) desc, ord) as representative from led join arts using (id) group by leader)"""


@query(
    f"""with recursive {ARTICLES}, {_TITLES}, arts as (select * from articles), {_greedy_sql("select id, row_number() over (order by ord, id) as k from articles", _TITLE_PAIRS)}, {_CLUSTERS}
select id, leader, size, representative, case when size > 1 then sha256(cast(leader as varchar)) end as cluster_id from led join sized using (leader)"""
)
def d03_title_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: greedy title clusters."""
    return dedup.title_clusters(articles(spark, sf_dir)).select("id", "leader", "size", "representative", "cluster_id")


_FIRSTS = "arts as (select * from (select *, row_number() over (partition by md5(lower(trim(title))) order by ord) as n from articles) where n = 1)"


@query(
    f"""with recursive {ARTICLES}, {_FIRSTS}, {_TITLES.replace("from articles", "from arts")}, {_greedy_sql("select id, row_number() over (order by ord, id) as k from arts", _TITLE_PAIRS)}, {_CLUSTERS}
select led.id, leader, leader as leader_ord, size, case when size > 1 then sha256(cast(leader as varchar)) end as cluster_id from led join sized using (leader) where led.id = representative"""
)
def d04_deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Url, title and cluster dedup in turn."""
    n = articles(spark, sf_dir).withColumn("url", F.concat(F.lit("http://news.example/"), F.col("source_id"), F.lit("/"), F.col("id").cast("string"), F.lit("?ref=x")))
    return dedup.deduplicate(n).select("id", "leader", "leader_ord", "size", "cluster_id")


@query(
    f"""with recursive {ARTICLES}, {_WEIGHTED}, {_greedy_sql("select id, row_number() over (order by chars desc, ord, id) as k from s", "select a, b from w2")}
select leader, led.id, score from led join w2 on w2.a = leader and w2.b = led.id where leader <> led.id"""
)
def d05_similar_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of articles with similar titles and bodies."""
    return dedup.similar_groups(articles(spark, sf_dir))


_LETTERS = "titles as (select id, ord, list_distinct(regexp_extract_all(lower(title), '[가-힣a-z]{2,}')) as t from articles)"


@query(
    f"""with recursive {ARTICLES}, @QUALITY@, {_LETTERS},
web as (select id, ord, case when length(body) >= 500 then 40 when length(body) >= 300 then 30 when length(body) >= 100 then 20 else length(body) / 10 end + round(quality, 3) * 20 + case when {any_of("source_name", rules.MAJOR_SOURCES)} then 10 else 0 end as q from quality),
{_greedy_sql("select id, row_number() over (order by q desc, ord, id) as k from web", _TITLE_PAIRS.replace("* 6", "* 4"))}, n as (select leader, count(*) as size from led group by leader)
select leader, led.id, case when len(a.t) > 0 and len(b.t) > 0 then round(len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))), 6) else 0 end as similarity, size
from led join n using (leader) join titles a on a.id = led.id join titles b on b.id = leader"""
)
def d07_web_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by letters of titles, the best article leading."""
    n = scoring.with_quality(articles(spark, sf_dir), LATIN).withColumns({"final_score": F.col("quality_score"), "image_urls": F.array().cast("array<string>")})
    return dedup.web_groups(n, dedup.web_quality())


_PARA = "list_filter(list_transform(string_split(body, chr(10)), lambda p: trim(p)), lambda p: p <> '')"
_KEYS = f"list_transform({_PARA}[1:10], lambda p: list_distinct(list_filter(string_split_regex(lower(p), '\\s+'), lambda w: length(w) > 2 and w not in ({', '.join(map(sql_text, LATIN.stop_words))}))))"
_SENT = "list_filter(list_transform(string_split(body, '.'), lambda s: trim(s)), lambda s: s <> '')"
_LOW = "lower(body || ' ' || title)"
INTEGRITY = f"""feat as (select *, list_distinct(regexp_extract_all(title, '[A-Z][a-z]{{2,}}')) as names, list_distinct(list_filter({words_sql("lower(title)")}, lambda w: length(w) > 2)) as tw,
  {_PARA}[1:5] as few, {_KEYS} as keys, {_SENT} as sent, {words_sql(_LOW)} as ws from news),
feat2 as (select *, list_transform(few, lambda p: len(list_filter(tw, lambda w: contains(lower(p), w)))) as hits, len(list_filter(names, lambda e: contains(lower(body), lower(e)))) / nullif(len(names), 0) as share,
  list_filter(list_transform(range(1, len(keys)), lambda i: case when len(keys[i]) + len(keys[i + 1]) > 0 then len(list_intersect(keys[i], keys[i + 1])) / (len(keys[i]) + len(keys[i + 1]) - len(list_intersect(keys[i], keys[i + 1]))) end), lambda s: s is not null) as sims from feat),
feat3 as (select *, case when title = '' or body = '' then 0.5 when len(names) = 0 then 1.0 when len(few) = 0 or len(tw) = 0 then share when list_sum(hits) = 0 then share * 0.5
    else least(1.0, share * (1 - list_max(hits) / greatest(list_sum(hits), 1) * 0.2)) end as cons,
  case when len(sims) = 0 then 0.0 when list_sum(sims) / len(sims) < 0.3 then 0.7 when len(list_filter(sims, lambda s: s < 0.2)) > len(sims) * 0.5 then 0.5 else 0.0 end as cont,
  len(sent) >= 3 and 1 - len(list_distinct(sent)) / len(sent) > 0.3 as f1, {any_of(_LOW, LATIN.ads)} as f2, {any_of(_LOW, LATIN.illegal)} as f3,
  len(ws) > 0 and len(list_filter(ws, lambda w: length(w) > 1 and w not in ({', '.join(map(sql_text, LATIN.function_words))}))) / greatest(len(ws), 1) < 0.4 as f4,
  regexp_matches(title, '{"|".join(f"(?:{p})" for p in LATIN.sensational_titles)}') as f5 from feat2),
integ as (select *, least(1.0, 0.3 * f1::int + 0.3 * f2::int + 0.5 * f3::int + 0.2 * f4::int + 0.1 * f5::int) as spam from feat3),
integrity as (select *, greatest(0.0, least(1.0, 0.4 * cons + 0.3 * (1 - cont) + 0.3 * (1 - spam))) as integrity_score,
  list_filter([case cont when 0.7 then 'unrelated_topics' when 0.5 then 'inconsistent_topics' end, case when f1 then 'repetitive_content' end, case when f2 then 'ad_content' end,
    case when f3 then 'illegal_content' end, case when f4 then 'low_content_quality' end, case when f5 then 'sensational_title' end], lambda f: f is not null) as integrity_flags from integ)"""


@query(
    f"with {NEWS}, {INTEGRITY} select id, round(cons, 3) as title_body_consistency, round(cont, 3) as contamination_score, round(spam, 3) as spam_score, round(integrity_score, 6) as integrity_score, array_to_string(integrity_flags, ',') as integrity_flags from integrity"
)
def k01_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity and its parts."""
    out = scoring.with_integrity(articles(spark, sf_dir), _LATIN)
    return out.select("id", "title_body_consistency", "contamination_score", "spam_score", F.round("integrity_score", 6).alias("integrity_score"), F.array_join("integrity_flags", ",").alias("integrity_flags"))


_LATIN = rules.Rules(**{**LATIN.__dict__, "entities": ("[A-Z][a-z]{2,}",)})
_TRUST = "case source_tier when 'whitelist' then 0.95 when 'tier1' then 0.85 when 'tier2' then 0.65 when 'tier3' then 0.40 when 'blacklist' then 0.0 else 0.5 end"
_EVID = " + ".join(f"cast(regexp_matches(body, {sql_text(p)}) as int)" for p in LATIN.evidence)
QUALITY = f"""evid as (select *, {_TRUST} as trust, case when body = '' then 0.3 else least(1.0, case source_tier when 'whitelist' then 0.3 when 'tier1' then 0.25 when 'tier2' then 0.15 when 'tier3' then 0.05 else 0.1 end
    + least(1.0, ({_EVID}) * 0.15) + least(0.3, length(body) / 3000)) end as evidence,
  least(1.0, least(0.5, {count_of("lower(title)", LATIN.sensational_words)} * 0.15) + least(0.2, len(regexp_extract_all(title, '[!?]{{2,}}|[ㅋㅎ]{{2,}}')) * 0.1)) as loud from {{0}}),
quality as (select *, greatest(0.0, least(1.0, evidence - loud)) as quality from evid)"""


@query(f"with {NEWS}, {QUALITY.replace('{0}', 'news')} select id, trust, round(evidence, 3) as evidence_score, round(loud, 3) as sensationalism_penalty, round(quality, 3) as quality_score from quality")
def k05_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5, K7-K9: trust, evidence, sensationalism, quality."""
    return scoring.with_quality(articles(spark, sf_dir), _LATIN).select("id", "trust", "evidence_score", "sensationalism_penalty", "quality_score")


SQL["d07_web_groups"] = SQL["d07_web_groups"].replace("@QUALITY@", QUALITY.replace("{0}", "articles"))
_CROSS = f"""{_TITLES}, cross_ as (select a.id, count(*) as cross_count from titles a join titles b on a.id <> b.id and a.source_id <> b.source_id
  where len(a.t) >= 3 and len(b.t) > 0 and {_JACC} * 2 >= len(a.t) + len(b.t) - {_JACC} group by a.id)"""
_CRED = "round(least(1.0, trust + case when cross_count >= 3 then 0.15 when cross_count >= 1 then 0.05 else 0.0 end), 3)"


@query(f"with {NEWS}, {QUALITY.replace('{0}', 'news')}, {_CROSS} select id, coalesce(cross_count, 0) as cross_count, {_CRED} as credibility_score from quality left join cross_ using (id)")
def k06_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credibility with the cross-source bonus."""
    n = articles(spark, sf_dir)
    out = scoring.with_quality(n, _LATIN).join(scoring.cross_counts(n), "id", "left").withColumn("cross_count", F.coalesce("cross_count", F.lit(0)))
    return out.select("id", "cross_count", scoring.credibility(F.col("trust"), F.col("cross_count")).alias("credibility_score"))


def _popularity_sql(source: str, by: str, when: str) -> str:
    return f"""lim as (select {by}, greatest(max(coalesce(view_count, 0)), 1) as mv, greatest(max(coalesce(share_count, 0)), 1) as ms, greatest(max(coalesce(comment_count, 0)), 1) as mc, max(published_at) as latest from {source} group by {by}),
pop0 as (select s.*, mv, ms, mc, case when floor((epoch_us(timestamp '{when}') - epoch_us(latest)) / 86400000000) >= 7 then latest else timestamp '{when}' end as since from {source} s join lim using ({by})),
pop1 as (select *, case when published_at is null then 0.3 else pow(0.5, greatest(0.0, (epoch_us(since) - epoch_us(published_at)) / 3.6e9) / 24.0) end as fresh,
  coalesce(view_count, 0) + 3 * coalesce(share_count, 0) + 2 * coalesce(comment_count, 0) as pull,
  0.4 * coalesce(view_count, 0) / mv + 0.35 * coalesce(share_count, 0) / ms + 0.25 * coalesce(comment_count, 0) / mc as metric from pop0),
popularity as (select *, round(fresh, 3) as freshness, round(least(1.0, case when coalesce(view_count, 0) = 0 and coalesce(share_count, 0) = 0 and coalesce(comment_count, 0) = 0 then greatest(0.3, fresh) else metric end), 3) as popularity_score,
  round(case when published_at is null then 0.0 else least(1.0, pull / greatest(1.0, (epoch_us(timestamp '{when}') - epoch_us(published_at)) / 3.6e9) / 10000) end, 3) as trending_velocity from pop1)"""


def _popularity(spark: SparkSession, sf_dir: str, when: str) -> DataFrame:
    return scoring.with_popularity(news(spark, sf_dir), ["language"], as_of(when)).select("id", "freshness", "popularity_score", "trending_velocity")


@query(f"with {NEWS}, {_popularity_sql('news', 'language', AS_OF)} select id, freshness, popularity_score, trending_velocity from popularity")
def k10_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Popularity, freshness and velocity of batches."""
    return _popularity(spark, sf_dir, AS_OF)


@query(f"with {NEWS}, {_popularity_sql('news', 'language', LATER)} select id, freshness, popularity_score, trending_velocity from popularity")
def k11_old_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same a month later, when each batch is judged from its latest article."""
    return _popularity(spark, sf_dir, LATER)


_TERMS = "list_transform(keywords, lambda k: case lower(k) " + " ".join(f"when {sql_text(k)} then {sql_text([k, *v])}" for k, v in LATIN.synonyms.items()) + " else [lower(k)] end)"
_COUNT = "(length(lb) - length(replace(lb, t, ''))) // length(t)"
_REL = f"""case when len(keywords) > 0 then case when trim(lt || ' ' || lb) = '' then 0.0 else least(1.0, list_sum(list_transform(terms, lambda ts: list_max(list_transform(ts, lambda t:
    (case when contains(lt, t) then 0.6 else 0.0 end) + (case when contains(lb, t) then 0.3 else 0.0 end) + least(0.3, {_COUNT} * 0.05))))) / len(terms)
    + case when coalesce(category, '') <> '' and len(list_filter(keywords, lambda k: contains(lower(category), lower(k)) or contains(lower(k), lower(category)))) > 0 then 0.1 else 0.0 end) end
  else least(1.0, 0.5 + (case when coalesce(category, '') <> '' then 0.2 else 0.0 end) + (case when len(tags) > 0 then 0.1 else 0.0 end) + (case when length(body) > 100 then 0.1 else 0.0 end)) end"""
_CAND = f"""cand as (select c.*, q.*, {_TERMS} as terms, lower(title) as lt, lower(body) as lb from {{0}} c join queries q on (published_at is null or ((date_from is null or published_at >= date_from) and (date_to is null or published_at <= date_to)))
  and len(list_filter(exclude_keywords, lambda k: contains(lower(title || ' ' || body), lower(k)))) = 0)"""


@query(f"with {NEWS}, {QUERIES}, {_CAND.replace('{0}', 'news')} select query_id, id, round({_REL}, 6) as relevance from cand")
def k13_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance of candidates of each query, with synonyms."""
    q = query_table(spark)
    rows = ranking.candidates(q.join(F.broadcast(scoring.expanded_terms(q, _LATIN)), "query_id", "left"), news(spark, sf_dir))
    value = F.when(F.coalesce(F.size("keywords"), F.lit(0)) > 0, scoring.keyword_relevance()).otherwise(scoring.plain_relevance())
    return rows.select("query_id", "id", F.round(value, 6).alias("relevance"))


_PRESET = "case preset " + " ".join(
    f"when '{k}' then popularity_score * {a} + relevance_score * {b} + quality_score * {c} + credibility_score * {d}" for k, (a, b, c, d) in rules.PRESETS.items()
) + " end"
_ORDER = "case when preset = 'latest' then coalesce(epoch_us(published_at), 0) end desc nulls last, case when preset <> 'latest' then final_score end desc nulls last, ord"
RANKED = f"""{NEWS}, {INTEGRITY}, {QUALITY.replace('{0}', 'integrity')}, {_CROSS}, base as (select q.* exclude (quality), round(quality, 3) as quality_score, {_CRED} as credibility_score from quality q left join cross_ using (id)),
{QUERIES}, {_CAND.replace('{0}', 'base')}, {_popularity_sql('cand', 'query_id', AS_OF)},
rel as (select *, {_REL} as relevance_score from popularity), fin as (select *, round(round(({_PRESET}) * 100, 6), 1) as final_score from rel),
pol as (select * from fin where integrity_score >= 0.5 and round(spam, 3) <= 0.7),
srcs as (select query_id, count(*) as rows_, min(source_id) as lo, max(source_id) as hi from pol group by query_id),
div_ as (select pol.*, row_number() over (partition by pol.query_id, case when lo = hi and rows_ > 1 then source_name else source_id end order by {_ORDER}) as n_ from pol join srcs using (query_id)),
grp as (select *, coalesce(case group_by when 'day' then strftime(published_at, '%Y-%m-%d') when 'source' then source_id else '' end, '') as group_key from div_ where not diversity or n_ <= 3),
ranked as (select *, row_number() over (partition by query_id, group_key order by {_ORDER}) as rank_position from grp)"""


@query(f"with {RANKED} select query_id, group_key, rank_position, id, final_score, relevance_score, popularity_score, quality_score, credibility_score, credibility_score < 0.6 as doubtful from ranked where rank_position > off and rank_position <= off + lim".replace("relevance_score, popularity_score, quality", "round(relevance_score, 6) as relevance_score, popularity_score, quality", 1))
def k16_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking of every query."""
    out = ranking.rank(query_table(spark), news(spark, sf_dir), as_of(), _LATIN)
    return out.select(
        "query_id", "group_key", "rank_position", "id", "final_score", F.round("relevance_score", 6).alias("relevance_score"), "popularity_score", "quality_score", "credibility_score",
        (F.size("policy_flags") > 0).alias("doubtful"),
    )


@query(
    f"""with {NEWS}, {QUALITY.replace('{0}', 'news')}, s as (select *, round(quality, 3) as q3, trust as c3 from quality), k as (select *, round(50 * {count_of("lower(title)", ("the", "que"))} + 10 * {count_of("lower(left(body, 300))", ("the", "que"))}
  + (case when {any_of("lower(title)", LATIN.newsworthy)} then 30 else 0 end) + 10 * q3 + 10 * c3 + least(length(body) / 100, 10.0), 6) as score from s)
select source_id, id, round(score, 3) as score from (select *, row_number() over (partition by source_id order by score desc, ord) as n from k) where n = 1"""
)
def k17_best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best article of each topic (here: each source)."""
    n = scoring.with_quality(articles(spark, sf_dir), _LATIN).withColumn("credibility_score", F.col("trust"))
    return ranking.best_source(n, "source_id", ["the", "que"], LATIN.newsworthy)


@query(
    f"""with {ARTICLES}, w as (select unnest({words_sql("lower(title)")}) as word from articles) select word, count(*) as n from w where length(word) >= 4 and word not in ('that', 'with', 'dans', 'para') group by word"""
)
def a17_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title words and how often they occur, without stop words."""
    w = articles(spark, sf_dir).select(F.explode(x.words(F.lower("title"))).alias("word"))
    return w.where((F.length("word") >= 4) & ~F.col("word").isin("that", "with", "dans", "para")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    f"""with {ARTICLES}, s as (select source_id, source_tier, language, length(body) as n from articles)
select source_tier, language, count(*) as n_articles, count(distinct source_id) as n_sources, sum(n) as n_chars, round(avg(n), 3) as mean_chars, min(n) as least, max(n) as most, round(count(*) / sum(count(*)) over (partition by grouping(source_tier, language)), 6) as share
from s group by grouping sets ((source_tier), (language), ())"""
)
def a05_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, means, extremes and shares by tier, by language and in all."""
    s = articles(spark, sf_dir).select("source_id", "source_tier", "language", F.length("body").alias("n"))
    out = s.groupingSets([["source_tier"], ["language"], []], "source_tier", "language").agg(
        F.count("*").alias("n_articles"), F.countDistinct("source_id").alias("n_sources"), F.sum("n").alias("n_chars"), F.round(F.avg("n"), 3).alias("mean_chars"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.grouping_id().alias("g"),
    )
    share = F.col("n_articles") / F.sum("n_articles").over(Window.partitionBy("g"))
    return out.withColumn("share", F.round(share, 6)).drop("g")
