"""Facts of topics: entities, numbers, dates, actions and the main topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import formats
from ..rules import news as rules


def topic_texts(news: DataFrame, topic: str) -> DataFrame:
    """(topic, titles, text): titles, and titles with bodies, of each topic's articles in order."""
    rows = news.groupBy(topic).agg(F.sort_array(F.collect_list(F.struct("ord", "title", "body"))).alias("r"))
    titles = F.array_join(F.transform("r", lambda e: e.title), " ")
    return rows.select(topic, titles.alias("titles"), F.array_join(F.transform("r", lambda e: F.concat(e.title, F.lit(" "), e.body)), " ").alias("text"))


def entity_scores(
    texts: DataFrame, topic: str, keywords: list[str], brands: tuple[str, ...] = rules.BRANDS, names: str = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", most: int = 5,
    companies: str = rules.COMPANY, nouns: str = "[가-힣]{2,}", stop_words: tuple[str, ...] = rules.NOUN_STOP,
) -> DataFrame:
    """(topic, entity, score, place) of texts(topic, titles, text): the best five entities; of equal scores the one that was listed first.

    Keywords give 50 (20 more in a title), brands 10 (20), names by their company ending 5 (15) each time they stand, other capitalised names 5
    (15) once, and only if nothing before lists them. Each listing gives one more: a keyword that is a brand too has two. A topic
    without any has its most frequent nouns: of the first five those that are no stop words and stand twice."""
    text, titles = F.col("text"), F.col("titles")
    low, low_titles = F.lower(text), F.lower(titles)

    def entry(entity: Column, points: Column, listed: Column | int, kind: int, at: Column | int) -> Column:
        columns = {"entity": entity, "points": points.cast("long"), "listed": F.lit(listed).cast("long"), "kind": F.lit(kind), "at": F.lit(at).cast("int")}
        return F.struct(*(c.alias(n) for n, c in columns.items()))

    def hits(words: list[str] | tuple[str, ...], kind: int, base: int, more: int, fold: bool) -> list[Column]:
        inside = lambda t, lower, w: (lower.contains(w.lower()) | t.contains(w)) if fold else t.contains(w)
        return [F.when(inside(text, low, w), entry(F.lit(w), base + F.when(inside(titles, low_titles, w), more).otherwise(0), 1, kind, i)) for i, w in enumerate(words)]

    known = F.array_compact(F.array(*hits(keywords, 0, 50, 20, True), *hits(brands, 1, 10, 20, False)))
    listed = {"known": known, "ended": F.regexp_extract_all(text, F.lit(companies), F.lit(0)), "named": F.regexp_extract_all(text, F.lit(names), F.lit(0))}
    # inline() gives the lists once: through a projection Spark would push the filters below, and search the whole text again for every name
    once = lambda **columns: F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    rows = texts.select(topic, "titles", "text", once(**listed))
    said = F.transform("known", lambda e: e.entity)
    in_title = lambda n: 5 + F.when(titles.contains(n), 15).otherwise(0)
    # a name counts each time, but is listed where it stands first
    ended = F.transform("ended", lambda n, i: entry(n, in_title(n), ((F.array_position("ended", n) == i + 1) & ~F.array_contains(said, n)).cast("int"), 2, i))
    fresh = F.filter(F.array_distinct("named"), lambda n: (F.length(n) > 2) & ~F.array_contains(said, n) & ~F.array_contains("ended", n))
    named = F.transform(fresh, lambda n, i: entry(n, in_title(n), 1, 3, i))
    rows = rows.select(topic, "text", once(entries=F.concat("known", ended, named)))
    each = rows.select(topic, F.explode("entries").alias("e")).select(topic, "e.*")
    scored = each.groupBy(topic, "entity").agg((F.sum("points") + F.sum("listed")).alias("score"), F.min(F.struct("kind", "at")).alias("first"))
    order = Window.partitionBy(topic).orderBy(F.desc("score"), "first")
    best = scored.withColumn("place", F.row_number().over(order)).where((F.col("place") <= most) & (F.col("score") >= 2)).select(topic, "entity", "score", "place")
    # topics without an entity
    bare = rows.where(F.size("entries") == 0).select(topic, F.posexplode(F.regexp_extract_all(text, F.lit(nouns), F.lit(0))).alias("at", "entity"))
    often = bare.groupBy(topic, "entity").agg(F.count("*").alias("score"), F.min("at").alias("at"))
    nouns_of = often.withColumn("n", F.row_number().over(Window.partitionBy(topic).orderBy(F.desc("score"), "at"))).where((F.col("n") <= most) & ~F.col("entity").isin(*stop_words) & (F.col("score") >= 2))
    return best.union(nouns_of.select(topic, "entity", "score", F.row_number().over(Window.partitionBy(topic).orderBy("n")).alias("place")))


def numbers(texts: DataFrame, topic: str, patterns=rules.NUMBERS, most: int = 3) -> DataFrame:
    """(topic, number, kind, place): by priority of the pattern, each value once, one of a kind, three in all."""
    value = r"(\d+(?:,\d{3})*(?:\.\d+)?)"

    def found(k: int, pattern: str, kind: str, rank: int) -> Column:
        entry = lambda n, i: F.struct(F.lit(-rank).alias("rank"), F.lit(k).alias("pattern"), i.alias("at"), n.alias("number"), F.lit(kind).alias("kind"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), entry)

    each = F.concat(*(found(k, *p) for k, p in enumerate(patterns)))
    rows = texts.select(topic, F.explode(each).alias("e")).select(topic, "e.*").withColumn("value", F.replace(F.regexp_extract("number", value, 1), F.lit(",")))
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy(topic, "value").orderBy("pattern", "at"))).where("n = 1")
    kinds = once.withColumn("n", F.row_number().over(Window.partitionBy(topic, "kind").orderBy("rank", "pattern", "at"))).where("n = 1")
    place = F.row_number().over(Window.partitionBy(topic).orderBy("rank", "pattern", "at"))
    return kinds.withColumn("place", place).where(F.col("place") <= most).select(topic, F.trim(F.regexp_replace("number", r"^(시가?총액|주가?)\s*", "")).alias("number"), "kind", "place")


def dates(text: Column, patterns: tuple[str, ...] = rules.DATES) -> Column:
    """Two of each pattern, three in all."""
    return F.slice(F.concat(*(F.slice(F.regexp_extract_all(text, F.lit(p), F.lit(0)), 1, 2) for p in patterns)), 1, 3)


def actions(text: Column, words: tuple[str, ...] = rules.ACTIONS) -> Column:
    return F.slice(F.array_compact(F.array(*(F.when(text.contains(w), w) for w in words))), 1, 5)


def main_topic(entity: Column, noun: Column, keyword: Column) -> Column:
    return F.coalesce(x.filled(keyword), x.filled(entity), x.filled(noun))


def headline(topic: Column, action: Column, number: Column) -> Column:
    """A title of the main topic, with what is known of number and action."""
    return F.concat_ws(" ", topic, number, action)


def _words(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def number_context(kind: Column) -> Column:
    """What a number is about: the first known word in actions, entities or topic; price words for shares that rise or fall."""
    known = F.array_join(F.concat("actions", "entities"), " ")
    out = F.when((kind == "비율") & F.exists("actions", lambda a: a.isin(*formats.PRICE_ACTIONS)), "주가").otherwise("")
    for word, context in reversed(formats.NUMBER_CONTEXTS.items()):
        out = F.when(known.contains(word) | F.col("main_topic").contains(word), context).otherwise(out)
    return out


def article_of(rows: DataFrame) -> DataFrame:
    """Adds title, lead and body made from facts alone: entities, numbers (number, kind), dates, actions, main_topic."""
    first = lambda c: F.get(F.col(c), F.lit(0))
    entity, action, topic = first("entities"), first("actions"), F.col("main_topic")
    number, kind = first("numbers").getField("number"), first("numbers").getField("kind")
    has = lambda c: F.size(c) > 0
    verbs = F.create_map(*(F.lit(v) for pair in formats.ACTION_VERBS.items() for v in pair))
    verb, context = F.coalesce(verbs[action], action), number_context(kind)
    with_context = F.when(context != "", _words(context, " ")).otherwise("")
    title = (
        F.when(has("entities") & has("actions") & has("numbers"), _words(entity, ", ", F.when(kind == "비율", with_context).otherwise(""), number, " ", verb))
        .when(has("entities") & has("actions"), _words(entity, ", ", action, " 소식")).when(has("entities") & has("numbers"), _words(entity, ", ", with_context, number, " 기록"))
        .when(has("entities"), _words(entity, " 최신 동향")).otherwise(_words(topic, " 업계 동향"))
    )
    when = F.when(has("dates"), _words(first("dates"), " ")).otherwise("")
    amount = F.coalesce(F.when(kind == "금액", _words(" ", number, "의")).when(kind == "비율", _words(" ", number)), F.lit(""))
    acts = (
        F.when(action.isin("발표", "공개", "출시"), _words(when, entity, "가", amount, " ", action, "를 진행했다.")).when(action.isin("달성", "기록", "돌파"), _words(when, entity, "가", amount, " ", action, "했다."))
        .when(action.isin("상승", "증가", "확대"), _words(when, entity, "의 실적이", amount, " ", action, "했다.")).otherwise(_words(when, entity, "가 ", action, " 관련 소식을 전했다."))
    )
    lead = F.when(has("entities") & has("actions"), acts).when(has("entities") & has("numbers"), _words(entity, "가 ", number, "를 기록하며 업계의 주목을 받고 있다."))
    lead = lead.when(has("entities"), _words(entity, " 관련 최신 동향이 전해졌다.")).otherwise(_words(topic, " 분야의 새로운 소식이 전해졌다."))

    def told(e: Column, i: Column) -> Column:
        first_said = F.when(e.kind == "금액", _words(e.number, " 규모를 기록했다")).when(e.kind == "비율", _words(e.number, "의 성장률을 보였다"))
        later = F.when(e.kind == "금액", _words("추가로 ", e.number, "의 성과를 달성했다")).when(e.kind == "비율", _words(e.number, " 개선되었다"))
        return F.coalesce(F.when(i == 0, first_said).otherwise(later), F.when(e.kind == "수량", _words(e.number, "를 달성했다")))

    said = F.array_compact(F.transform(F.slice("numbers", 1, 2), told))
    figures = F.when(F.size(said) == 1, _words(F.coalesce(action, F.lit("이번 실적")), "에서 ", F.get(said, F.lit(0)), ".")).when(F.size(said) == 2, _words(F.get(said, F.lit(0)), ". ", F.get(said, F.lit(1)), "."))
    same = (F.lower(entity) == F.lower(topic)) | topic.contains(entity)
    back = F.when(has("entities") & same & has("actions"), _words(entity, "는 최근 ", action, " 등의 성과를 이어가고 있다.")).when(has("entities") & same, _words(entity, "는 관련 분야에서 지속적인 발전을 보이고 있다."))
    back = back.when(has("entities"), _words(entity, "는 ", topic, " 분야에서 두각을 나타내고 있다.")).otherwise(_words(topic, " 시장이 주목받고 있다."))
    others = F.when(F.size("entities") > 1, _words(F.array_join(F.slice("entities", 1, 3), ", "), " 등 주요 기업들이 관련 분야에 참여하고 있다."))
    any_action = lambda *names: F.exists("actions", lambda a: a.isin(*names))
    ahead = F.when(any_action("증가", "상승"), "업계에서는 이러한 추세가 당분간 이어질 것으로 전망하고 있다.").when(any_action("감소", "하락"), "전문가들은 향후 상황을 주의 깊게 지켜보고 있다.").otherwise("관련 업계의 향후 움직임이 주목된다.")
    return rows.withColumns({"title": title, "lead": lead, "body": F.concat_ws(" ", figures, back, others, ahead)})
