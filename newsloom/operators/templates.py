"""Texts of formats from their fields: rendering, checks of fields, parts of a rendered text, and prompts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import formats as rules

FIELD = re.compile(r"\{(\w+)\}")
#: How each item of a list field is written, and what stands between items; `i` is its number.
LISTS = {
    "cards": (lambda e, i: F.concat(F.lit("["), i, F.lit("] "), e.title, F.lit("\n"), e.body), "\n\n"),
    "items": (lambda e, i: F.concat(i, F.lit(". "), e.title, F.lit("\n   "), e.description), "\n\n"),
    "qa_pairs": (lambda e, i: F.concat(F.lit("Q. "), e.question, F.lit("\nA. "), e.answer), "\n\n"),
    "events": (lambda e, i: F.concat(F.lit("• ["), e.date, F.lit("] "), e.event), "\n"),
    "sections": (lambda e, i: F.concat(F.lit("▶ "), e.title, F.lit("\n"), e.content), "\n\n"),
    "key_points": (lambda e, i: F.concat(F.lit("• "), e), "\n"),
}


def field_names(name: str, templates: dict[str, str] = rules.TEMPLATES) -> list[str]:
    return list(dict.fromkeys(FIELD.findall(templates[name])))


def short_title(title: Column, most: int = 60, least: int = 40) -> Column:
    """Titles over `most` characters: the first 57, cut at their last space, comma or full stop if that is beyond `least`, and three dots."""
    head = F.substring(title, 1, most - 3)
    cut = F.regexp_extract(head, "(?s)^(.*)[ ,.]", 1)
    return F.when(F.length(title) <= most, title).when(F.length(cut) > least, F.concat(cut, F.lit("..."))).otherwise(F.concat(head, F.lit("...")))


def list_text(name: str, items: Column) -> Column:
    """A list field as text; a field that has no form of its own is one line an item."""
    form, between = LISTS.get(name, (lambda e, i: e, "\n"))
    return F.array_join(F.transform(items, lambda e, i: form(e, (i + 1).cast("string"))), between)


def render(name: str, fields: dict[str, Column], lists: tuple[str, ...] = (), templates: dict[str, str] = rules.TEMPLATES) -> Column:
    """The text of a format: fields that are missing or null are empty, `lists` are arrays, runs of blank lines become one."""
    pieces, at = [], 0
    for m in FIELD.finditer(templates[name]):
        value = fields.get(m[1], F.lit(""))
        value = list_text(m[1], value) if m[1] in lists else short_title(value) if m[1] == "title" else value
        pieces += [F.lit(templates[name][at : m.start()]), F.coalesce(value, F.lit(""))]
        at = m.end()
    text = F.concat(*pieces, F.lit(templates[name][at:]))
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def lacking(name: str, fields: dict[str, Column], lists: tuple[str, ...] = (), templates: dict[str, str] = rules.TEMPLATES) -> Column:
    """Names of fields of a format that are missing or empty, sorted."""

    def empty(field: str) -> Column:
        if field not in fields:
            return F.lit(True)
        return F.coalesce(F.size(fields[field]) == 0 if field in lists else fields[field] == "", F.lit(True))

    return F.array_compact(F.array(*(F.when(empty(f), f) for f in sorted(field_names(name, templates)))))


def _numbered(text: Column, pattern: str) -> Column:
    numbers, parts = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(numbers, parts, lambda n, p: F.struct(n.cast("int").alias("number"), trimmed(p).alias("content")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def paragraphs_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), trimmed), lambda p: p != "")


def cards_of(text: Column) -> Column:
    return _numbered(text, r"\[(\d+)\]\s*([^\[]+)")


def items_of(text: Column) -> Column:
    return _numbered(text, r"(?s)(\d+)\.\s*(.+?)(?=\d+\.|\z)")


def pairs_of(text: Column) -> Column:
    pattern = r"(?s)Q\.\s*(.+?)\s*A\.\s*(.+?)(?=Q\.|\z)"
    asked, said = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(asked, said, lambda q, a: F.struct(trimmed(q).alias("question"), trimmed(a).alias("answer")))


def hashtags(title: Column, most: int = 3) -> Column:
    return F.array_join(F.transform(F.slice(F.regexp_extract_all(title, F.lit("[가-힣]{2,}|[A-Za-z]{3,}"), F.lit(0)), 1, most), lambda w: F.concat(F.lit("#"), w)), " ")


def first_sentences(body: Column, most: int, chars: int) -> Column:
    return F.substring(F.array_join(F.slice(F.split(F.trim(body), r"(?<=[.!?])\s+"), 1, most), " "), 1, chars)


def texts_of(topics: DataFrame) -> dict[str, Column]:
    """The text of each format that topics are assembled for, from title (of the primary article), primary_body, sources and the sections of
    `assembly`: straight, brief, analysis, feature, newsletter, cards and social_post."""
    title = x.clean_title(F.col("title"))
    or_else = lambda c, other: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(other)
    body = F.coalesce("primary_body", F.lit(""))
    # a card is named by its number but the first, and cards stand in the order of the names of their sections: card_1, card_10, card_2
    named = F.transform("cards", lambda c, i: F.struct(F.concat(F.lit("card_"), (i + 1).cast("string")).alias("name"), (i + 1).alias("n"), c.alias("text")))
    cards = F.transform(F.array_sort(named), lambda c: F.struct(F.when(c.n == 1, F.substring(title, 1, 30)).otherwise(F.concat(F.lit("Point "), c.n.cast("string"))).alias("title"), c.text.alias("body")))
    letter = F.concat(F.lit("▶ 주요 뉴스\n"), "highlights", F.lit("\n\n▶ 심층 분석\n"), "deep_dive")
    sources = F.when(F.col("sources") != "", F.col("sources")).otherwise("뉴스 출처")
    col = lambda *names: {n: F.col(n) for n in names}
    return {
        "straight": render("straight", col("lead", "body", "closing") | {"title": title, "sources": sources}),
        "brief": render("brief", {"title": title, "content": or_else("headline", first_sentences(body, 1, 10**9))}),
        "analysis": render("analysis", col("current_situation", "background", "outlook", "implications") | {"title": title, "subtitle": F.concat(F.lit("[심층 분석] "), F.substring(title, 1, 30), F.lit("...")), "sources": sources}),
        "feature": render("feature", {"title": title, "intro": F.col("introduction"), "sections": F.col("feature_body"), "conclusion": F.col("conclusion"), "sources": sources}),
        "newsletter": render("newsletter", {"greeting": F.lit("오늘의 주요 뉴스입니다."), "sections": letter, "footer": F.lit("더 자세한 내용은 원문을 확인해주세요.")}),
        "card_news": render("card_news", {"title": title, "cards": cards, "sources": sources}, ("cards",)),
        "social_post": render("social_post", {"hook": F.substring(title, 1, 50), "main_content": or_else("core", first_sentences(body, 2, 150)), "hashtags": hashtags(F.col("title")), "cta": F.lit("자세히 보기 ▶")}),
    }


def constraints(name: str, mode: str, longest: int | None = None, cited: bool = True) -> list[str]:
    spec = rules.SPECS.get(name)
    size = [f"{longest}자 이내로 작성"] if longest else [f"{spec.least}-{spec.most}자 분량"] if spec else []
    return [*size, *([rules.MODE_CONSTRAINTS[mode]] if mode in rules.MODE_CONSTRAINTS else []), *rules.CONSTRAINTS, *([rules.CITED_CONSTRAINT] if cited else [])]


def prompts(news: DataFrame, topic: str, name: str, mode: str, instruction: str, style: str, most: int = 5, context: Column | None = None, longest: int | None = None) -> DataFrame:
    """(topic, prompt) from news(topic, ord, title, source_name, body, published_at): one row a topic for a batch of an offline model.

    In mode synthesis the first `most` articles are joined, in others the first one stands alone; context is a column of the topic's rows."""
    told = lambda name, value: F.concat(F.lit(f"{name}: "), F.coalesce(value, F.lit("")))
    fields = F.struct("ord", "id", "title", "source_name", "published_at", "body")
    first = news.groupBy(topic).agg(F.min(F.struct("ord", "id")).alias("least")) if mode != "synthesis" else None
    if first is not None:
        rows = news.join(first, topic).where((F.col("ord") == F.col("least.ord")) & (F.col("id") == F.col("least.id")))
        day = F.coalesce(F.date_format("published_at", "yyyy-MM-dd"), F.lit("알 수 없음"))
        source = F.concat_ws("\n", told("제목", F.col("title")), told("출처", F.col("source_name")), told("발행", day), F.lit("내용:"), F.coalesce("body", F.lit("")))
        topics = rows.groupBy(topic).agg(F.min(source).alias("source"), *([F.first(context).alias("context")] if context is not None else []))
    else:
        of_topic = news.groupBy(topic).agg(F.slice(F.array_sort(F.collect_list(fields)), 1, most).alias("articles"), *([F.first(context).alias("context")] if context is not None else []))
        one = lambda a, i: F.concat_ws("\n", F.concat(F.lit("[뉴스 "), (i + 1).cast("string"), F.lit("]")), told("제목", a.title), told("출처", a.source_name), told("내용", a.body), F.lit(""))
        topics = of_topic.withColumn("source", F.array_join(F.transform("articles", one), "\n"))
    parts = [F.lit(instruction), F.lit(style), F.lit("\n[제약 조건]\n" + "\n".join(f"- {c}" for c in constraints(name, mode, longest))), F.concat(F.lit("\n[원본 뉴스]\n"), "source")]
    if context is not None:
        parts.append(F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit("\n[추가 정보]\n"), "context")))
    return topics.select(topic, F.concat_ws("\n", *parts, F.lit("\n위 정보를 바탕으로 새로운 뉴스 기사를 작성해주세요.")).alias("prompt"))
