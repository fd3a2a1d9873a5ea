"""Queries over formats, rendered texts, layouts, prompts, source maps, images of pages and runs of the whole job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..operators import assembly, citations, facts, images, qa, querylog, ranking, registry, scoring, sentences, templates
from ..operators import formats as chosen
from ..rules import formats as rules
from ..rules.news import LATIN
from ..storage import ID_BYTES, mark, materialized, settled, small
from .registry import SQL, query
from .stage1 import _LATIN
from .stage3 import _FEATURES, _PRIMARY, _STRUCT, KEYS, _top, q, scored_topics
from .stage4 import NAMED, _URLS, sources
from .tables import ARTICLES, NEWS, any_of, articles, count_of, news, sql_text, table, times

_TOP = f"""{_PRIMARY}, b as (select s.id // 5 as topic_id, p.id as primary_id, s.id, s.ord, position, s.s, s.role, s.has_number, round(case when s.id = p.id then least(importance * 1.5, 1.0) when len(matched) > 0 then importance * 0.6 else importance * 0.3 end, 6) as importance
  from sentences s join primary_ p on s.id // 5 = p.topic_id),
top_ as (select * from (select *, row_number() over (partition by topic_id order by importance desc, ord, position) as place from b) where place <= 30),
{_STRUCT.replace("'id': id}", "'id': id, 'num': has_number}")}"""


def ordered_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with their sentences in order, written once; what they were made of is deleted then."""
    since = mark()
    return settled(assembly.ordered(_top(spark, sf_dir), "topic_id"), "topics", since)


def md5s(df: DataFrame, *names: str) -> list:
    return [F.md5(c).alias(f"{c}_md5") for c in names]


_JOIN = "array_to_string(list_transform({0}, lambda e: e.s), ' ')"


def _sections(lead: str, other: str, body: str, prefix: str) -> str:
    """SQL of a layout: the leading list (or the first sentence), the rest of the primary article, and its closing sentences."""
    texts = "list_transform({0}, lambda f: f.s)"
    return f"""{prefix}_l as (select *, case when len({lead}) > 0 then {lead} when len({other}) > 0 then {other} else l[1:1] end as ld from st),
{prefix}_b as (select *, list_filter(l, lambda e: e.id = primary_id and e.role not in ('outlook', 'implication') and not list_contains({texts.format('ld')}, e.s)) as rest from {prefix}_l),
{prefix}_c as (select *, {body} as bd from {prefix}_b),
{prefix} as (select topic_id, md5({_JOIN.format('ld')}) as {prefix}_lead_md5, md5({_JOIN.format('bd')}) as {prefix}_plain_md5,
  md5({_JOIN.format(f"list_filter(l, lambda e: e.id = primary_id and e.role in ('outlook', 'implication') and not list_contains({texts.format('ld')}, e.s) and not list_contains({texts.format('bd')}, e.s))")}) as {prefix}_closing_md5 from {prefix}_c)"""


_OWN = "list_filter(l, lambda e: e.id = primary_id and {0})"


@query(
    f"""with {_TOP}, {_sections(_OWN.format("e.role in ('lead', 'fact', 'background')"), "[]", "rest", "visual")},
{_sections(_OWN.format("e.role in ('statistic', 'lead') and e.num"), _OWN.format("e.role in ('lead', 'fact')"), "list_concat(list_filter(rest, lambda e: e.num), list_filter(rest, lambda e: not e.num))", "data")}
select * from visual join data using (topic_id)"""
)
def m03_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3, M4: sections of texts around images and around figures, before connecting words."""
    t = assembly.data(assembly.visual(ordered_topics(spark, sf_dir)))
    return t.select("topic_id", *md5s(t, "visual_lead", "visual_plain", "visual_closing", "data_lead", "data_plain", "data_closing"))


_OTHER = "not list_contains(list_transform(ld, lambda f: f.s), e.s)"
_FOLD = """list_reduce(list_transform(bd, lambda e: {'done': cast([] as varchar[]), 'now': e.s, 'n': length(e.s), 'role': e.role}),
  lambda a, e: {'done': case when a.n >= 50 and (coalesce(a.role <> e.role, false) or a.n + e.n > 400) then list_append(a.done, a.now) else a.done end,
    'now': case when a.now = '' or (a.n >= 50 and (coalesce(a.role <> e.role, false) or a.n + e.n > 400)) then e.now else a.now || ' ' || e.now end,
    'n': case when a.n >= 50 and (coalesce(a.role <> e.role, false) or a.n + e.n > 400) then e.n else a.n + e.n end, 'role': e.role},
  {'done': cast([] as varchar[]), 'now': '', 'n': cast(0 as bigint), 'role': cast(null as varchar)})"""
_MERGE = """list_reduce(list_transform(case when cut.now = '' then cut.done else list_append(cut.done, cut.now) end, lambda p: {'l': cast([] as varchar[]), 'p': p}),
  lambda a, e: {'l': case when length(e.p) < 50 and len(a.l) > 0 then list_append(a.l[1:len(a.l) - 1], a.l[len(a.l)] || ' ' || e.p) else list_append(a.l, e.p) end, 'p': ''}, {'l': cast([] as varchar[]), 'p': ''}).l"""
#: Topics with the text of their straight form.
ASSEMBLED = f"""{_TOP}, as_l as (select *, case when len(list_filter(l, lambda e: e.role in ('lead', 'fact') and e.id = primary_id)) > 0 then list_filter(l, lambda e: e.role in ('lead', 'fact') and e.id = primary_id) else l[1:1] end as ld from st),
as_b as (select *, list_filter(l, lambda e: e.id = primary_id and e.role in ('background', 'detail', 'quote') and {_OTHER}) as bd, {_JOIN.format(f"list_filter(l, lambda e: e.id = primary_id and e.role in ('outlook', 'implication') and {_OTHER})")} as closing from as_l),
as_c as (select *, {_FOLD} as cut from as_b), as_d as (select *, array_to_string({_MERGE}, chr(10) || chr(10)) as body from as_c),
assembled as (select topic_id, l, body, array_to_string(list_filter([{_JOIN.format('ld')}, body, closing], lambda t: t is not null and t <> ''), chr(10) || chr(10)) as text from as_d)"""
_HEADLINE = "case when length(l[1].s) > 150 then '' when len(l) < 2 or length(l[1].s) + length(l[2].s) > 150 then l[1].s when len(l) < 3 or length(l[1].s) + 1 + length(l[2].s) + length(l[3].s) > 150 then l[1].s || ' ' || l[2].s else l[1].s || ' ' || l[2].s || ' ' || l[3].s end"
SQL["m05_folds"] = f"""with {ASSEMBLED}, t as (select topic_id, md5(body) as body_md5, {_HEADLINE} as headline, cast(least(greatest(len(l), 5), 10) as int) as n_cards, length(text) as n_chars,
  list_filter([case when length(left(l[1].s, 60)) = 0 then 'MISSING_TITLE' end, case when length(text) < 400 then 'BODY_TOO_SHORT:' || length(text) when length(text) > 800 then 'BODY_TOO_LONG:' || length(text) end,
    case when not (length(text) > 0 and length(string_split(text, chr(10) || chr(10))[1]) > 30) then 'MISSING_LEAD' end, case when length(text) < 100 then 'CONTENT_TOO_SHORT' end], lambda v: v is not null) as found from assembled)
select topic_id, body_md5, headline, n_cards, n_chars, array_to_string(found, ',') as issues, greatest(0.0, 100.0 - case when n_chars >= 400 then 0 when n_chars >= 300 then 10 when n_chars >= 200 then 20 else 30 end - 5 * len(found)) as score from t"""
_SPLIT = "list_transform(list_filter(list_transform(flatten(list_transform(string_split({0}, chr(10)), lambda l: string_split(regexp_replace(trim(l), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))), lambda s: trim(s)), lambda s: s <> ''), lambda s: case when regexp_matches(s, '[.!?]$') then s else s || '.' end)"
_BAG = "list_distinct(list_filter(string_split_regex({0}, '\\s+'), lambda w: w <> ''))"
SQL["c01_citations"] = f"""with {ASSEMBLED}, mq as (select distinct topic_id, unnest({_SPLIT.format('text')}) as quote from assembled), m as (select *, trim(lower(quote)) as lq, {_BAG.format('trim(lower(quote))')} as qw from mq),
sq as (select distinct id // 5 as topic_id, id, trim(lower(unnest({_SPLIT.format('body')}))) as ls from articles), w as (select *, {_BAG.format('ls')} as sw from sq),
c as (select distinct m.topic_id, quote, w.id from m join w on m.topic_id = w.topic_id and (lq = ls or (len(sw) > 0 and len(list_intersect(qw, sw)) / len(sw) >= 0.7))),
u as (select topic_id, id, 1 as direct from c union all select id // 5, id, 0 from articles)
select topic_id, count(*) filter (direct = 1) as quotes, count(*) filter (direct = 0) as facts, count(*) as total, count(distinct id) as sources from u group by topic_id"""


def _quota(source: str, name: str, role: str, quota: int, least: int) -> str:
    free = "list_filter(l, lambda e: not list_contains(used, e.s))"
    return f"""{name}_a as (select *, list_filter({free}, lambda e: e.role = '{role}')[1:{quota}] as own from {source}),
{name}_b as (select * exclude (own), case when len(own) < {least} then list_concat(own, list_filter({free}, lambda e: not list_contains(own, e))[1:{quota} - len(own)]) else own end as own from {name}_a),
{name}_q as (select * exclude (own, used), {_JOIN.format('own')} as {name}, list_concat(used, list_transform(own, lambda e: e.s)) as used from {name}_b)"""


@query(
    f"""with {_TOP}, now_ as (select *, list_filter(l, lambda e: e.role in ('lead', 'fact', 'statistic'))[1:5] as cur from st),
used_ as (select * exclude (cur), {_JOIN.format('cur')} as current_situation, list_transform(cur, lambda e: e.s) as used from now_),
{_quota('used_', 'background', 'background', 5, 3)}, {_quota('background_q', 'outlook', 'outlook', 4, 3)}, {_quota('outlook_q', 'implications', 'implication', 3, 2)}
select topic_id, md5(current_situation) as current_situation_md5, md5(background) as background_md5, md5(outlook) as outlook_md5, md5(implications) as implications_md5 from implications_q"""
)
def m06_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6: four sections with quotas, filled up from what is left."""
    t = assembly.analysis(ordered_topics(spark, sf_dir))
    return t.select("topic_id", *md5s(t, "current_situation", "background", "outlook", "implications"))


@query(
    f"""with {_TOP} select topic_id, md5({_JOIN.format('list_filter(l, lambda e: e.id = primary_id)[1:4]')}) as strict_md5,
  md5({_JOIN.format('list_concat(list_filter(l, lambda e: e.id = primary_id), list_filter(l, lambda e: e.id <> primary_id))[1:12]')}) as lenient_md5, md5({_JOIN.format('l[1:4]')}) as plain_md5 from st"""
)
def n06_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the primary article first, strict and lenient, and without a primary article."""
    s, none = F.col("s"), F.lit(None).cast("long")
    parts = {"strict": assembly.preferred(s, F.col("primary_id"), 4), "lenient": assembly.preferred(s, F.col("primary_id"), 12, False), "plain": assembly.preferred(s, none, 4)}
    t = ordered_topics(spark, sf_dir)
    return t.select("topic_id", *(F.md5(assembly.joined(c)).alias(f"{k}_md5") for k, c in parts.items()))


@query(
    f"""with {_TOP}, o as (select topic_id, {_JOIN.format('l[1:3]')} as text from st)
select topic_id, count(*) as sentences, count(*) filter (contains(text, s)) as copied from sentences join o on id // 5 = topic_id where length(s) > 10 group by topic_id"""
)
def j13_copied_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the articles of each topic, and how many its introduction holds."""
    news_, rows = scored_topics(spark, sf_dir)
    top = sentences.top_sentences(sentences.boosted(rows, sentences.primary_articles(rows, news_, "topic_id", _LATIN), "topic_id"), "topic_id")
    made = assembly.feature(assembly.ordered(top, "topic_id")).select("topic_id", F.col("introduction").alias("text"))
    return assembly.copied(rows, made, "topic_id")


_K17 = f"""kq as (select id // 5 as topic_id, id, ord, title, round(50 * {count_of("lower(title)", KEYS)} + 10 * {count_of("lower(left(body, 300))", KEYS)} + (case when {any_of("lower(title)", LATIN.newsworthy)} then 30 else 0 end)
  + 10 * round(quality, 3) + 10 * round(trust, 3) + least(length(body) / 100, 10.0), 6) as score from quality),
best_ as (select topic_id, id from (select *, row_number() over (partition by topic_id order by score desc, ord) as k from kq) where k = 1)"""


@query(f"with {_PRIMARY}, {_K17} select b.topic_id, coalesce(p.id, b.id) as id, p.id is null as fallback, a.title from best_ b left join primary_ p using (topic_id) join articles a on a.id = coalesce(p.id, b.id)")
def j11_title_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article that names each topic: the primary one, else the best source."""
    news_, rows = scored_topics(spark, sf_dir, ranking.source_score(KEYS, LATIN.newsworthy).alias("source_score"))
    primary = sentences.primary_articles(rows, news_, "topic_id", _LATIN).select("topic_id", F.col("id").alias("primary_id"))
    best = ranking.best_source(news_, "topic_id", KEYS, score=F.col("source_score")).select("topic_id", F.col("id").alias("best_id"))
    both = best.join(primary, "topic_id", "left").select("topic_id", F.coalesce("primary_id", "best_id").alias("id"), F.col("primary_id").isNull().alias("fallback"))
    return both.join(news_.select("id", "title"), "id").select("topic_id", "id", "fallback", "title")


#: Fields of texts that are made of an article for the templates; `closing` and `summary` are left out, so that a field is missing.
def article_fields() -> dict:
    p = F.filter(F.transform(F.split(F.substring("body", 1, 2000), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    part = lambda k: F.coalesce(F.get(p, F.lit(k)), F.lit(""))
    few = F.slice(p, 1, 3)
    pair = lambda a, b: F.transform(few, lambda s, i: F.struct(F.substring(s, 1, 20).alias(a), s.alias(b)))
    texts = ("lead", "body", "content", "subtitle", "current_situation", "background", "outlook", "implications", "question", "answer", "hook", "main_content", "hashtags", "cta", "greeting", "footer", "intro", "conclusion", "current_status", "item_a_name", "item_a_content", "item_b_name", "item_b_content", "comparison_analysis")
    return {"title": F.col("title"), "sources": F.col("source_name")} | {n: part(k % 4) for k, n in enumerate(texts)} | {
        "cards": pair("title", "body"), "items": pair("title", "description"), "qa_pairs": pair("question", "answer"), "events": pair("date", "event"), "sections": pair("title", "content"), "key_points": few,
    }


_P = "list_filter(list_transform(string_split(left(body, 2000), chr(10)), lambda s: trim(s)), lambda s: s <> '')"
_TEXT_FIELDS = ("lead", "body", "content", "subtitle", "current_situation", "background", "outlook", "implications", "question", "answer", "hook", "main_content", "hashtags", "cta", "greeting", "footer", "intro", "conclusion", "current_status", "item_a_name", "item_a_content", "item_b_name", "item_b_content", "comparison_analysis")
_LISTED = {
    "cards": ("'[' || i || '] ' || left(p[i], 20) || chr(10) || p[i]", "chr(10) || chr(10)"), "items": ("i || '. ' || left(p[i], 20) || chr(10) || '   ' || p[i]", "chr(10) || chr(10)"),
    "qa_pairs": ("'Q. ' || left(p[i], 20) || chr(10) || 'A. ' || p[i]", "chr(10) || chr(10)"), "events": ("'• [' || left(p[i], 20) || '] ' || p[i]", "chr(10)"),
    "sections": ("'▶ ' || left(p[i], 20) || chr(10) || p[i]", "chr(10) || chr(10)"), "key_points": ("'• ' || p[i]", "chr(10)"),
}
_CUT = "case when length(title) <= 60 then title when length(regexp_extract(left(title, 57), '(?s)^(.*)[ ,.]', 1)) > 40 then regexp_extract(left(title, 57), '(?s)^(.*)[ ,.]', 1) || '...' else left(title, 57) || '...' end"


def _field_sql(name: str) -> str:
    if name == "title":
        return f"({_CUT})"
    if name == "sources":
        return "coalesce(source_name, '')"
    if name in _LISTED:
        one, between = _LISTED[name]
        return f"array_to_string(list_transform(range(1, least(len(p), 3) + 1), lambda i: {one}), {between})"
    return f"coalesce(p[{_TEXT_FIELDS.index(name) % 4 + 1}], '')" if name in _TEXT_FIELDS else "''"


def _render_sql(name: str) -> str:
    parts, at = [], 0
    for m in templates.FIELD.finditer(rules.TEMPLATES[name]):
        parts += [sql_text(rules.TEMPLATES[name][at : m.start()]), _field_sql(m[1])]
        at = m.end()
    text = " || ".join([*parts, sql_text(rules.TEMPLATES[name][at:])])
    return f"regexp_replace(regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query(f"with {ARTICLES}, f as (select *, {_P} as p from articles) select id, {', '.join(f'md5({_render_sql(n)}) as {n}_md5, length({_render_sql(n)}) as {n}_chars' for n in rules.TEMPLATES)} from f")
def m11_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each article in all twelve formats; a missing field is empty, blank lines collapse, long titles are cut."""
    fields, lists = article_fields(), tuple(templates.LISTS)
    texts = articles(spark, sf_dir).select("id", *(templates.render(n, fields, lists).alias(n) for n in rules.TEMPLATES))
    return texts.select("id", *(c for n in rules.TEMPLATES for c in (F.md5(n).alias(f"{n}_md5"), F.length(n).alias(f"{n}_chars"))))


def _lacking_sql(name: str) -> str:
    tests = {f: f"{_field_sql(f)} = ''" if f not in _LISTED else "len(p) = 0" for f in sorted(templates.field_names(name))}
    tests |= {"title": "title = ''"} if "title" in tests else {}
    return "array_to_string(list_filter([" + ", ".join(f"case when {t} then {sql_text(f)} end" for f, t in tests.items()) + "], lambda v: v is not null), ',')"


@query(f"with {ARTICLES}, f as (select *, {_P} as p from articles) select id, {', '.join(f'{_lacking_sql(n)} as {n}' for n in rules.TEMPLATES)} from f")
def m13_lacking_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each format that an article cannot fill."""
    fields, lists = article_fields(), tuple(templates.LISTS)
    return articles(spark, sf_dir).select("id", *(F.array_join(templates.lacking(n, fields, lists), ",").alias(n) for n in rules.TEMPLATES))


_TRIM = "regexp_replace({0}, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query(
    f"""with {ARTICLES}, f as (select *, {_P} as p from articles), r as (select id, {_render_sql('straight')} as st, {_render_sql('card_news')} as cn from f),
c as (select id, list_filter(list_transform(string_split(st, chr(10) || chr(10)), lambda s: {_TRIM.format('s')}), lambda s: s <> '') as ps,
  list_transform(regexp_extract_all(cn, '\\[(\\d+)\\]\\s*([^\\[]+)', 2), lambda s: {_TRIM.format('s')}) as cs, regexp_extract_all(cn, '\\[(\\d+)\\]\\s*([^\\[]+)', 1) as ns from r)
select id, len(ps) as n_paragraphs, md5(array_to_string(ps, '|')) as paragraphs_md5, md5(array_to_string(list_transform(range(1, len(cs) + 1), lambda i: ns[i] || ':' || cs[i]), '|')) as cards_md5, len(cs) as n_cards from c"""
)
def m14_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and cards read back from rendered texts."""
    fields, lists = article_fields(), tuple(templates.LISTS)
    t = articles(spark, sf_dir).select("id", templates.paragraphs_of(templates.render("straight", fields, lists)).alias("p"), templates.cards_of(templates.render("card_news", fields, lists)).alias("c"))
    cards = F.transform("c", lambda e: F.concat_ws(":", e.number.cast("string"), e.content))
    return t.select("id", F.size("p").alias("n_paragraphs"), F.md5(F.array_join("p", "|")).alias("paragraphs_md5"), F.md5(F.array_join(cards, "|")).alias("cards_md5"), F.size("c").alias("n_cards"))


_PROMPT_HEAD, _PROMPT_STYLE = "Write an analysis.", "Plain and neutral."
_RULES = {m: "\n[제약 조건]\n" + "\n".join(f"- {c}" for c in templates.constraints("analysis", m)) for m in ("synthesis", "rewrite")}


def _prompt_sql(mode: str, source: str) -> str:
    return " || chr(10) || ".join([sql_text(_PROMPT_HEAD), sql_text(_PROMPT_STYLE), sql_text(_RULES[mode]), f"(chr(10) || '[원본 뉴스]' || chr(10) || {source})", "(chr(10) || '위 정보를 바탕으로 새로운 뉴스 기사를 작성해주세요.')"])


@query(
    f"""with {NEWS}, t as (select *, id // 5 as topic_id, row_number() over (partition by id // 5 order by ord, id) as k from news),
s as (select topic_id, string_agg('[뉴스 ' || k || ']' || chr(10) || '제목: ' || title || chr(10) || '출처: ' || coalesce(source_name, '') || chr(10) || '내용: ' || body || chr(10), chr(10) order by k) as source from t where k <= 5 group by topic_id),
o as (select topic_id, '제목: ' || title || chr(10) || '출처: ' || coalesce(source_name, '') || chr(10) || '발행: ' || coalesce(strftime(published_at, '%Y-%m-%d'), '알 수 없음') || chr(10) || '내용:' || chr(10) || body as source from t where k = 1)
select s.topic_id, md5({_prompt_sql('synthesis', 's.source')}) as synthesis_md5, md5({_prompt_sql('rewrite', 'o.source')}) as rewrite_md5, length({_prompt_sql('synthesis', 's.source')}) as n_chars from s join o using (topic_id)"""
)
def m16_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of each topic for an offline model: all its articles, and its first one."""
    n = news(spark, sf_dir).withColumn("topic_id", F.floor(F.col("id") / 5).cast("long"))
    made = {m: templates.prompts(n, "topic_id", "analysis", m, _PROMPT_HEAD, _PROMPT_STYLE).withColumnRenamed("prompt", m) for m in ("synthesis", "rewrite")}
    return made["synthesis"].join(made["rewrite"], "topic_id").select("topic_id", F.md5("synthesis").alias("synthesis_md5"), F.md5("rewrite").alias("rewrite_md5"), F.length("synthesis").alias("n_chars"))


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics with the text of every format, their best format by the assembled length, and the primary article's title and body."""
    since = mark()
    t = ordered_topics(spark, sf_dir)
    t = assembly.social_post(assembly.newsletter(assembly.feature(assembly.analysis(assembly.cards(assembly.brief(assembly.straight(t)))))))
    n = articles(spark, sf_dir).withColumn("topic_id", F.floor(F.col("id") / 5).cast("long"))
    named = n.groupBy("topic_id", "source_name").agg(F.min("ord").alias("ord")).groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_name"))), lambda s: s.source_name), ", ").alias("sources"))
    primary = n.select(F.col("id").alias("primary_id"), "title", F.col("body").alias("primary_body")).join(small(t.select("primary_id"), ID_BYTES), "primary_id", "left_semi")
    t = settled(t.join(primary, "primary_id").join(named, "topic_id", "left").withColumn("sources", F.coalesce("sources", F.lit(""))), "assembled", since)
    # the format is chosen again by the length of what was assembled, as one long sentence without keywords
    length = F.length("body") + F.length("lead")
    seen = t.select(F.col("topic_id").alias("id"), "title", F.repeat(F.lit("x"), length).alias("body"))
    best = small(materialized(chosen.recommend(chosen.features(seen), 1).select(F.col("id").alias("topic_id"), "format"), "formats"), ID_BYTES)
    texts = templates.texts_of(t)
    t = t.join(best, "topic_id", "left").withColumns({f"text_{k}": c for k, c in texts.items()})
    text = F.col("text_straight")
    for k in texts:
        text = F.when(F.col("format") == k, F.col(f"text_{k}")).otherwise(text)
    return t.withColumn("text", text)


@query()
def m15_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generated text of each topic: format chosen by length, rendered, split into title and body, with its parts and citations."""
    since = mark()
    t = settled(generated(spark, sf_dir).select("topic_id", "format", "title", "text", "text_card_news"), "generated", since)
    parts = x.split_title_body(F.col("text"), F.col("title"))
    made = t.select("topic_id", x.sentences(F.col("text")).alias("quotes"))
    n = articles(spark, sf_dir).withColumn("topic_id", F.floor(F.col("id") / 5).cast("long")).withColumn("quotes", x.sentences(F.col("body")))
    cited = citations.quote_matches(made, n, "topic_id").groupBy("topic_id").agg(F.count("*").alias("n_quotes"))
    return t.join(cited, "topic_id", "left").select(
        "topic_id", F.coalesce("format", F.lit("straight")).alias("format"), parts.title.alias("title"), F.md5(parts.body).alias("body_md5"), F.length(parts.body).alias("n_chars"), F.size(x.words(parts.body)).alias("n_words"),
        F.size(templates.paragraphs_of(F.col("text"))).alias("n_paragraphs"), F.size(templates.cards_of(F.col("text_card_news"))).alias("n_cards"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
    )


_SPECS = ", ".join(f"({sql_text(n)}, {sql_text(s.use + '에 적합')}, {sql_text(list(s.structure))})" for n, s in rules.SPECS.items())
_SAID = ", ".join(f"case when {f} = {sql_text(v)} and format in ({', '.join(map(sql_text, names))}) then {sql_text(t)} end" for f, v, names, t in rules.REASONS)


@query(
    f"""{SQL['e01_formats'].rsplit('select id, format, score, place', 1)[0].rstrip()}, top_ as (select id, format from (select *, row_number() over (partition by id order by score desc, format) as place from s) where place <= 5),
spec(format, used, parts) as (values {_SPECS})
select id, format, case when concat_ws(', ', used, {_SAID}) = '' then '기본 추천' else concat_ws(', ', used, {_SAID}) end as reason,
  array_to_string(coalesce(parts, ['title', 'body']), ',') as required, case when parts is null then '' else 'image,quote,background' end as optional
from top_ join feat using (id) left join spec using (format)"""
)
def e03_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons and elements of the recommended formats."""
    f = materialized(chosen.features(articles(spark, sf_dir)), "features")
    out = chosen.reasons(chosen.recommend(f), f)
    return out.select("id", "format", "reason", F.array_join("required", ",").alias("required"), F.array_join("optional", ",").alias("optional"))


#: Patterns, kinds and words that occur in the test tables.
NUMBER_PATTERNS = ((r"\d+\.\d+", "비율", 90), (r"\d{3,}", "금액", 60), (r"\d+", "수량", 40))
DATE_PATTERNS, ACTION_WORDS = (r"\d{4}-\d{2}-\d{2}", r"\d{1,2}/\d{1,2}"), ("hand", "tion", "ment", "recht")
_VALUE = "replace(regexp_extract(number, '(\\d+(?:,\\d{3})*(?:\\.\\d+)?)', 1), ',', '')"
_TOPIC_TEXTS = "t as (select id // 5 as topic_id, string_agg(title, ' ' order by ord) as titles, string_agg(title || ' ' || body, ' ' order by ord) as text from articles group by 1)"


def numbers_sql(patterns: tuple) -> str:
    each = " union all ".join(f"select topic_id, {k} as pattern, generate_subscripts(l, 1) as at_, unnest(l) as number, {sql_text(kind)} as kind, {rank} as rank_ from (select topic_id, regexp_extract_all(text, {sql_text(p)}) as l from t)" for k, (p, kind, rank) in enumerate(patterns))
    return f"""{_TOPIC_TEXTS}, each_ as ({each}), once_ as (select * from (select *, row_number() over (partition by topic_id, {_VALUE} order by pattern, at_) as n from each_) where n = 1),
kinds_ as (select * from (select * exclude (n), row_number() over (partition by topic_id, kind order by rank_ desc, pattern, at_) as n from once_) where n = 1),
numbers_ as (select topic_id, trim(regexp_replace(number, '^(시가?총액|주가?)\\s*', '')) as number, kind, place from (select *, row_number() over (partition by topic_id order by rank_ desc, pattern, at_) as place from kinds_) where place <= 3)"""


SQL["e05_numbers"] = f"with {ARTICLES}, {numbers_sql(((r'\d+\.\d+', 'version', 90), (r'\d{3,}', 'long', 60), (r'\d+', 'short', 40)))} select topic_id, number, kind, place from numbers_"

_FIRST = "case when len(nums) > 0 then {0} end"
_E, _A, _N, _KIND, _T = "ents[1]", "acts[1]", "nums[1].number", "nums[1].kind", "coalesce(ents[1], '')"
_CONTEXT = "case " + " ".join(f"when contains(array_to_string(list_concat(acts, ents), ' '), {sql_text(w)}) or contains({_T}, {sql_text(w)}) then {sql_text(c)}" for w, c in rules.NUMBER_CONTEXTS.items()) + " else '' end"
_WITH = f"case when {_CONTEXT} <> '' then {_CONTEXT} || ' ' else '' end"
_TOLD = "case when e.kind = '금액' then {0} when e.kind = '비율' then {1} when e.kind = '수량' then e.number || '를 달성했다' end"
_SAYS = f"list_filter(list_transform(range(1, least(len(nums), 2) + 1), lambda i: case when i = 1 then {_TOLD.format(chr(39) * 2 + ' || nums[i].number || ' + sql_text(' 규모를 기록했다'), 'nums[i].number || ' + sql_text('의 성장률을 보였다')).replace('e.', 'nums[i].')} else {_TOLD.format(sql_text('추가로 ') + ' || nums[i].number || ' + sql_text('의 성과를 달성했다'), 'nums[i].number || ' + sql_text(' 개선되었다')).replace('e.', 'nums[i].')} end), lambda v: v is not null)"


@query(
    f"""{SQL['e04_entities'].replace("select topic_id, entity, score, place from", ", ranked_ as (select topic_id, entity, score, place from", 1)}),
{numbers_sql(NUMBER_PATTERNS)[len(_TOPIC_TEXTS) + 2:]},
f as (select t.topic_id, coalesce((select list(entity order by place) from ranked_ r where r.topic_id = t.topic_id), []) as ents, coalesce((select list({{'number': number, 'kind': kind}} order by place) from numbers_ m where m.topic_id = t.topic_id), []) as nums,
  list_concat({', '.join(f"regexp_extract_all(text, {sql_text(p)})[1:2]" for p in DATE_PATTERNS)})[1:3] as dats, list_filter([{', '.join(f"case when contains(text, {sql_text(w)}) then {sql_text(w)} end" for w in ACTION_WORDS)}], lambda v: v is not null)[1:5] as acts from t),
g as (select topic_id, len(dats) as n_dates, array_to_string(acts, ',') as actions,
  case when len(ents) > 0 and len(acts) > 0 and len(nums) > 0 then {_E} || ', ' || (case when {_KIND} = '비율' then {_WITH} else '' end) || {_N} || ' ' || {_A} when len(ents) > 0 and len(acts) > 0 then {_E} || ', ' || {_A} || ' 소식'
    when len(ents) > 0 and len(nums) > 0 then {_E} || ', ' || {_WITH} || {_N} || ' 기록' when len(ents) > 0 then {_E} || ' 최신 동향' else {_T} || ' 업계 동향' end as title,
  case when len(ents) > 0 and len(acts) > 0 then (case when len(dats) > 0 then dats[1] || ' ' else '' end) || {_E} || '가 ' || {_A} || ' 관련 소식을 전했다.' when len(ents) > 0 and len(nums) > 0 then {_E} || '가 ' || {_N} || '를 기록하며 업계의 주목을 받고 있다.'
    when len(ents) > 0 then {_E} || ' 관련 최신 동향이 전해졌다.' else {_T} || ' 분야의 새로운 소식이 전해졌다.' end as lead,
  concat_ws(' ', case len({_SAYS}) when 1 then coalesce({_A}, '이번 실적') || '에서 ' || ({_SAYS})[1] || '.' when 2 then ({_SAYS})[1] || '. ' || ({_SAYS})[2] || '.' end,
    case when len(ents) > 0 and len(acts) > 0 then {_E} || '는 최근 ' || {_A} || ' 등의 성과를 이어가고 있다.' when len(ents) > 0 then {_E} || '는 관련 분야에서 지속적인 발전을 보이고 있다.' else {_T} || ' 시장이 주목받고 있다.' end,
    case when len(ents) > 1 then array_to_string(ents[1:3], ', ') || ' 등 주요 기업들이 관련 분야에 참여하고 있다.' end, '관련 업계의 향후 움직임이 주목된다.') as body from f)
select topic_id, n_dates, actions, title, lead, body from g"""
)
def e09_fact_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, actions, the main topic, and texts made from facts alone."""
    texts = materialized(facts.topic_texts(articles(spark, sf_dir).withColumn("topic_id", F.floor(F.col("id") / 5).cast("long")), "topic_id"), "topic-texts")
    named = facts.entity_scores(texts, "topic_id", **NAMED)
    ents = named.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "entity"))), lambda e: e.entity).alias("entities"))
    found = facts.numbers(texts, "topic_id", NUMBER_PATTERNS)
    nums = found.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "number", "kind"))), lambda e: F.struct(e.number.alias("number"), e.kind.alias("kind"))).alias("numbers"))
    none = F.array().cast("array<string>")
    rows = texts.select("topic_id", facts.dates(F.col("text"), DATE_PATTERNS).alias("dates"), facts.actions(F.col("text"), ACTION_WORDS).alias("actions")).join(ents, "topic_id", "left").join(nums, "topic_id", "left")
    rows = rows.withColumns({"entities": F.coalesce("entities", none), "numbers": F.coalesce("numbers", F.array().cast("array<struct<number:string,kind:string>>"))})
    rows = rows.withColumn("main_topic", F.coalesce(facts.main_topic(F.get("entities", F.lit(0)), F.lit(None), F.lit(None)), F.lit("")))
    return facts.article_of(rows).select("topic_id", F.size("dates").alias("n_dates"), F.array_join("actions", ",").alias("actions"), "title", "lead", "body")


_DOMAIN = "regexp_extract(url, 'https?://(?:www\\.)?([^/]+)', 1)"
_DOMAINS = {**rules.DOMAIN_NAMES, "blog.tionsh.example.net": "연합뉴스", "thther.example.org": "매일경제", "ththhe.example.com": "네이트"}


def _map_sql(value: str, pairs: dict[str, str], default: str) -> str:
    return f"case {value} " + " ".join(f"when {sql_text(k)} then {sql_text(v)}" for k, v in pairs.items()) + f" else {default} end"


@query(
    f"""with n as (select page_id, case when coalesce(url, '') = '' then '네이버 뉴스' when {_DOMAIN} = '' then 'Unknown' else {_map_sql(_DOMAIN, _DOMAINS, _DOMAIN)} end as outlet from pages)
select page_id, outlet, case when outlet in ({', '.join(map(sql_text, rules.FIRST_TIER))}) then 'tier1' when outlet in ({', '.join(map(sql_text, rules.SECOND_TIER))}) then 'tier2' else 'tier3' end as inferred_tier, {_map_sql('outlet', rules.KNOWN_TIERS, "'tier2'")} as known_tier from n"""
)
def p11_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlets of pages by domain, and their tiers by the two rules (with names for three domains of the test table)."""
    name = registry.outlet(F.col("url"), _DOMAINS)
    p = table(spark, sf_dir, "pages").select("page_id", name.alias("outlet"))
    return p.select("page_id", "outlet", registry.inferred_tier(F.col("outlet")).alias("inferred_tier"), registry.known_tier(F.col("outlet")).alias("known_tier"))


@query(
    f"""with {ARTICLES}, s as (select source as source_id, case when regexp_extract(source, '(\\d+)', 1)::int % 4 = 0 then 95.0 when regexp_extract(source, '(\\d+)', 1)::int % 4 = 1 then 85.0 end as base, case cast(regexp_extract(source, '(\\d+)', 1) as int) % 4 when 0 then 'whitelist' when 1 then 'tier1' end as tier
  from documents group by source having cast(regexp_extract(source, '(\\d+)', 1) as int) % 4 < 2)
select a.id, coalesce(s.tier, a.source_tier) as source_tier, s.base as credibility_base_score, coalesce(s.base / 100.0, case a.source_tier when 'whitelist' then 0.95 when 'tier1' then 0.85 when 'tier2' then 0.65 when 'tier3' then 0.40 else 0.5 end) as trust
from articles a left join s using (source_id)"""
)
def j01_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with what the registry knows of their source (half of the sources), whose score overrides the tier's trust."""
    known = sources(spark, sf_dir).where(F.col("tier").isin("whitelist", "tier1"))
    out = registry.with_source(articles(spark, sf_dir), known)
    base = out.select("id", "credibility_base_score")
    scored = scoring.with_quality(out.drop("credibility_base_score"), _LATIN, known)
    return scored.select("id", "source_tier", "trust").join(base, "id").select("id", "source_tier", "credibility_base_score", "trust")


_EVERY_URL = "regexp_extract_all(html, '(?:href|src)=\"([^\"]+)\"', 1)"
_WANTED = [(1, ["thand", "eaux"], "2024-01-05"), (2, ["the"], "2024-01-10"), (3, ["license", "mit"], "2024-01-15"), (4, ["zzz", "que"], "2024-01-20"), (5, ["zzzz"], "2024-01-20"), (6, ["apache"], "2024-01-12")]


@query(
    f"""with {NEWS}, w(query_id, keywords, d) as (values {', '.join(f"({i}, {sql_text(k)}, date '{d}')" for i, k, d in _WANTED)}),
h as (select query_id, id, ord, len(keywords) as n, len(list_filter(keywords, lambda k: contains(lower(title || ' ' || body), lower(k)))) as hits, abs(datediff('day', d, published_at::date)) as away from news join w on abs(datediff('day', d, published_at::date)) <= 3),
c as (select *, count(*) filter (away = 0 and hits = n) over (partition by query_id) as ne, count(*) filter (hits = n) over (partition by query_id) as nw from h where hits > 0),
s as (select query_id, id, ord, case when away = 0 and hits = n then 1 when hits = n and ne = 0 then 2 when away = 0 and n >= 2 and (case when ne > 0 then ne else nw end) < 5 then 3 end as step from c)
select query_id, id, step, place from (select *, row_number() over (partition by query_id order by step, ord, id) as place from s where step is not null) where place <= 30"""
)
def u03_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query finds on its day, else around it, and by single keywords if that is little."""
    wanted = spark.createDataFrame(_WANTED, "query_id int, keywords array<string>, date string").withColumn("date", F.col("date").cast("date"))
    return querylog.widened(wanted, articles(spark, sf_dir), times=times(spark, sf_dir)[0])


@query(
    f"""with u as (select page_id, url as base, unnest({_EVERY_URL}) as src, generate_subscripts({_EVERY_URL}, 1) as k from pages), a as (select page_id, k, case when regexp_matches(src, '^https?:') then src when starts_with(src, '//') then regexp_extract(base, '^(https?:)', 1) || src
  when starts_with(src, '/') then regexp_extract(base, '^(https?://[^/]+)', 1) || src else regexp_replace(regexp_replace(base, '[?#].*$', ''), '/[^/]*$', '/') || src end as url from u),
b as (select *, lower(url) as low, string_split(lower(url), '?')[1] as path from a),
v as (select page_id, k, url, coalesce(not (not starts_with(url, 'http') or contains(url, '{{{{') or contains(url, '}}}}') or regexp_matches(path, '\\.(svg|ico|cur|gif)$') or {any_of('low', rules.WEB_IMAGE_WORDS)}
    or coalesce(try_cast(regexp_extract(low, '[_-](\\d+)x(\\d+)', 1) as int) < 150 or try_cast(regexp_extract(low, '[_-](\\d+)x(\\d+)', 2) as int) < 100, false)) and (regexp_matches(path, '\\.(jpg|jpeg|png|webp)$') or {any_of('low', rules.WEB_IMAGE_HOSTS)}), false) as fits from b),
o as (select page_id, url, fits, min(k) - 1 as position from v group by all)
select page_id, url, fits, place from (select *, row_number() over (partition by page_id order by position, url) as place from o) where place <= 5"""
)
def w09_page_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses inside pages judged by the rules of the web page, the first five by position."""
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", F.col("url").alias("base"), F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit('(?:href|src)="([^"]+)"'), F.lit(1)))).alias("position", "src"))
    rows = rows.select("page_id", "position", images.image_url(F.col("src"), F.col("base")).alias("url"))
    return images.in_order(rows, "page_id").select("page_id", "url", images.fits_page(F.col("url")).alias("fits"), "place")


_KIND = "case cast(page_id % 3 as int) when 0 then 'standard' when 1 then 'visual' else 'data' end"


@query(
    f"""with p as (select page_id, {_KIND} as kind, len({_URLS.replace('html', "coalesce(html, '')")}) as n from pages), i as (select kind, least(n, case kind when 'standard' then 5 when 'visual' then 8 else 3 end) as images from p),
s as (select kind, grouping(kind) as "all", count(*) as n, round(avg(images), 3) as mean, min(images) as least, max(images) as most from i group by rollup (kind)),
v as (select kind, images, grouping(kind) as "all", count(*) as held from i group by grouping sets ((kind, images), (images)))
select s.kind, s."all", n, mean, least, most, (select string_agg(images || ':' || held, ',' order by images) from v where v."all" = s."all" and v.kind is not distinct from s.kind) as values from s"""
)
def a11_image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that each type keeps, counted by type and in all (types by page number)."""
    n = F.pmod("page_id", F.lit(3))
    kind = F.when(n == 0, "standard").when(n == 1, "visual").otherwise("data")
    urls = F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?:href|src)="([^"]+)"'), F.lit(1)))
    p = table(spark, sf_dir, "pages").select(kind.alias("kind"), F.size(assembly.images_of_type(urls, kind)).alias("images"))
    return qa.image_counts(p, "kind")


@query(
    f"""with {ARTICLES}, pool as (select unnest({sql_text(list(LATIN.categories))}) as category, unnest([{', '.join(sql_text(list(v)) for v in LATIN.categories.values())}]) as words), k as (select category, unnest(words) as keyword from pool)
select k.category, keyword, count(a.id) as n_titles from k left join articles a on contains(lower(a.title), keyword) group by 1, 2"""
)
def s08_keyword_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of categories, and titles that hold them."""
    pool = spark.createDataFrame([(k, list(v)) for k, v in LATIN.categories.items()], "category string, words array<string>").select("category", F.explode("words").alias("keyword"))
    words = [r["keyword"] for r in pool.select("keyword").distinct().collect()]  # the stated pool of keywords
    held = articles(spark, sf_dir).select(F.explode(F.filter(x.strings(words), lambda w: F.lower("title").contains(w))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n_titles"))
    return pool.join(held, "keyword", "left").select("category", "keyword", F.coalesce("n_titles", F.lit(0)).alias("n_titles"))


_ISSUES = "list_filter([case when length(body) < 400 then 'BODY_TOO_SHORT' when length(body) > 800 then 'BODY_TOO_LONG' end, case when length(body) < 100 then 'CONTENT_TOO_SHORT' end], lambda v: v is not null)"


@query(
    f"""with {ARTICLES}, r as (select language, body = '' as error, {_ISSUES} as issues, greatest(0, 100 - 15 * len({_ISSUES})) as score from articles), p as (select *, score >= 85 as passed from r),
g as (select language, grouping(language) as "all", count(*) as total, count(*) filter (passed) as passed, count(*) filter (not passed) as failed, count(*) filter (error) as errors, round(count(*) filter (passed) / count(*) * 100, 1) as pass_rate, round(avg(score), 1) as mean_score from p group by rollup (language)),
i as (select language, issue, grouping(language) as "all", count(*) as n from (select language, unnest(issues) as issue from p) group by grouping sets ((language, issue), (issue))),
t as (select * from (select *, row_number() over (partition by "all", language order by n desc, issue) as k from i) where k <= 10)
select g.*, coalesce((select string_agg(issue || ':' || n, ',' order by k) from t where t."all" = g."all" and t.language is not distinct from g.language), '') as issues from g"""
)
def v02_batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: a report over runs (articles) by preset (language) and in all."""
    n = F.length("body")
    issues = F.array_compact(F.array(F.when(n < 400, "BODY_TOO_SHORT").when(n > 800, "BODY_TOO_LONG"), F.when(n < 100, "CONTENT_TOO_SHORT")))
    runs = articles(spark, sf_dir).select("language", (F.col("body") == "").alias("error"), issues.alias("issues"))
    runs = runs.withColumn("score", F.greatest(F.lit(0), 100 - 15 * F.size("issues"))).withColumn("passed", F.col("score") >= 85)
    return qa.batch_report(runs, "language")


@query(
    f"""with {_TOP}, o as (select id // 5 as topic_id, count(*) as originals, sum(length(body)) as source_chars, count(distinct source_name) as n_sources, string_agg(distinct source_name, ',' order by source_name) as sources from articles group by 1),
i as (select page_id // 5 as topic_id, count(distinct u) as n_images from (select page_id, unnest({_URLS.replace('html', "coalesce(html, '')")}) as u from pages) group by 1)
select topic_id, originals, source_chars, n_sources, sources, coalesce(n_images, 0) as n_images, length({_JOIN.format('l[1:3]')}) as made_chars from o left join st using (topic_id) left join i using (topic_id)"""
)
def v06_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6: the articles of each topic beside what was made of them: sizes, sources, distinct addresses of its pages."""
    n = articles(spark, sf_dir).withColumn("topic_id", F.floor(F.col("id") / 5).cast("long"))
    o = n.groupBy("topic_id").agg(F.count("*").alias("originals"), F.sum(F.length("body")).alias("source_chars"), F.countDistinct("source_name").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("source_name")), ",").alias("sources"))
    urls = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 5).cast("long").alias("topic_id"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('(?:href|src)="([^"]+)"'), F.lit(1))).alias("u"))
    i = urls.groupBy("topic_id").agg(F.countDistinct("u").alias("n_images"))
    made = assembly.feature(ordered_topics(spark, sf_dir)).select("topic_id", F.length("introduction").alias("made_chars"))
    return o.join(made, "topic_id", "left").join(i, "topic_id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))


SQL["v07_run_rows"] = (
    SQL["u03_widened"].replace("select query_id, id, step, place from (", ", hit_ as (select query_id, id, step, place from (", 1)
    + """), f as (select query_id, count(*) as search_count, sum(length(body)) filter (place <= 2) as total from hit_ join articles using (id) group by query_id),
m as (select query_id, total as chars, list_filter([case when total < 400 then 'BODY_TOO_SHORT' when total > 800 then 'BODY_TOO_LONG' end], lambda v: v is not null) as own from f where query_id <> 2)
select w.query_id, coalesce(search_count, 0) as search_count, coalesce(chars, 0) as chars, chars is not null as success,
  array_to_string(list_concat(case when search_count is null then ['NO_SEARCH_RESULTS'] when chars is null then ['GENERATION_FAILED'] else [] end, coalesce(own, [])), ',') as issues from w left join f using (query_id) left join m using (query_id)"""
)


@query(SQL["v07_run_rows"])
def v07_run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: one row a query over the whole run: what was found, what was made of it (the first two bodies; nothing for query 2), and what is missing."""
    wanted = spark.createDataFrame(_WANTED, "query_id int, keywords array<string>, date string").withColumn("date", F.col("date").cast("date"))
    found = materialized(querylog.widened(wanted, articles(spark, sf_dir), times=times(spark, sf_dir)[0]), "found")
    bodies = articles(spark, sf_dir).select("id", F.length("body").alias("chars"))
    made = found.where("place <= 2 and query_id <> 2").join(bodies, "id").groupBy("query_id").agg(F.sum("chars").alias("chars"))
    made = made.withColumn("issues", F.array_compact(F.array(F.when(F.col("chars") < 400, "BODY_TOO_SHORT").when(F.col("chars") > 800, "BODY_TOO_LONG"))))
    return qa.run_rows(wanted, found, made).withColumn("issues", F.array_join("issues", ","))
