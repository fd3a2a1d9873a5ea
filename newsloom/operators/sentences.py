"""Sentences of articles: extraction, roles, importance, duplicates within topics, and the primary article of a topic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import news as rules
from ..storage import mark, materialized, settled, small
from .similarity import TASK, edge_keys, greedy_leaders_by_keys, link_counts, pairs_within, reached, shared_substrings, similarity_edges

Rules = rules.Rules
BOILERPLATE = "|".join(f"(?:{p})" for p in rules.BOILERPLATE)
#: Costly patterns, and those that match without Hangul, by how they begin, and words of which one stands in whatever they match; these are looked for first.
GUARDS = {
    ".{2,10}": ("기자", "특파원", "앵커", "리포터"), "[a-zA-Z0-9._%+-]+@": ("@",), r"\w+\.(": (".com", ".co.kr", ".net", ".or.kr", ".go.kr"), "(?i)Copyright": ("©", "ⓒ"), r"All\s*[Rr]ights": ("ights",),
    r"^\|.*\|$": ("|",), r"\[?(전화|": ("전화", "팩스", "메일", "Tel", "Fax", "Email"), r"\[%%": ("[%%",), "^AD$": ("AD",), "DB": ("DB",),
}
HANGUL = re.compile("[가-힣]")
UNFINISHED = f"(?:{'|'.join(rules.UNFINISHED)})\\.*$"
OUTLET_TAIL = f"^.{{0,59}}\\s(?:{'|'.join(map(re.escape, rules.OUTLETS))})[.!?]*$"
OPINION = r"\[(?:" + "|".join(map(re.escape, rules.OPINION)) + r")\]"


def few_hangul(text: Column, least: float = 0.2, longer: int = 15) -> Column:
    """Of a text over 15 characters less than a fifth of the letters are Hangul."""
    hangul, letters = F.length(F.regexp_replace(text, r"[^가-힣]", "")), F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return (F.length(text) > longer) & (letters > 0) & (hangul < least * letters)


def is_boilerplate(text: Column, hangul: bool = True) -> Column:
    guards = {p: words for p in rules.BOILERPLATE for start, words in GUARDS.items() if p.startswith(start)}
    korean = lambda words: tuple(w for w in words if HANGUL.search(w))
    other = lambda words: tuple(w for w in words if not HANGUL.search(w))
    outlet = lambda names: x.contains_any(text, names) & text.rlike(OUTLET_TAIL)
    # patterns without guards hold Hangul; whatever needs some is asked only where there is some
    inside = text.rlike("|".join(f"(?:{p})" for p in rules.BOILERPLATE if p not in guards)) | outlet(korean(rules.OUTLETS))
    out = outlet(other(rules.OUTLETS))
    for p, words in guards.items():
        if korean(words):
            inside = inside | (x.contains_any(text, korean(words)) & text.rlike(p))
        if other(words):
            out = out | (x.contains_any(text, other(words)) & text.rlike(p))
    out = out | (text.rlike("[가-힣]") & inside)
    return out | few_hangul(text) if hangul else out


def is_unfinished(text: Column) -> Column:
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    odd = lambda c: text.contains(c) & (count(c) % 2 != 0)
    return (text.contains("(") & (count("(") > count(")"))) | odd('"') | odd("'") | (text.rlike("[가-힣]") & text.rlike(UNFINISHED))


def is_opinion(title: Column) -> Column:
    return F.coalesce(title.rlike(OPINION), F.lit(False))


def role_of(text: Column, r: Rules = rules.KOREAN, strict: bool = False) -> Column:
    """Quotes before statistics before keyword roles before endings; else a fact. Endings are matched without the final
    punctuation; strict matches them with it, as the added full stop demands."""
    out = F.when(x.contains_any(text, rules.QUOTE_MARKS), "quote").when(x.digits_before(text, rules.STATISTICS), "statistic")
    for role, keys in r.role_words.items():
        # a plain search first, as most sentences hold none of the words
        out = out.when(x.contains_any(text, keys) & text.rlike(f"(?:{'|'.join(map(re.escape, keys))}){rules.WORD_END}"), role)
    for role, endings in r.role_endings.items():
        # the final punctuation may stand before or behind a last line end, as `$` has it
        tail = "$" if strict else r"(?:[.!?]*$|(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])[.!?]+\z)"
        out = out.when(x.contains_any(text, endings) & text.rlike(f"(?:{'|'.join(map(re.escape, endings))}){tail}"), role)
    return out.otherwise("fact")


def importance(r: Rules = rules.KOREAN) -> Column:
    n, p = F.length("sentence"), F.col("position")
    place = F.when(p == 0, 1.0).when(p < 3, 0.8).when(p >= F.col("total") - 2, 0.6).otherwise(0.5)
    size = F.when(n.between(20, 60), 1.0).when(n.between(15, 80), 0.7).otherwise(0.4)
    score = 0.35 * F.least(F.size("matched") * 0.3, F.lit(1.0)) + 0.2 * place + 0.1 * F.col("has_number").cast("int") + 0.1 * size
    score = score + 0.25 * x.by_tier(F.col("role"), rules.ROLE_SCORE, 0.5) + 0.15 * x.contains_any(F.col("sentence"), r.newsworthy).cast("int")
    return F.least(score, F.lit(1.0)) * F.when(F.col("opinion"), 0.2).otherwise(1.0)


def extract(news: DataFrame, keywords: list[str], r: Rules = rules.KOREAN, hangul: bool = True, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per kept sentence: position, total, sentence, role, has_number, has_quote, matched, opinion, importance."""
    # the number of sentences and the mark of the title are carried in each, as beside the generator they would be computed again for every sentence
    # (and the title, which may be all of a text without lines, copied with it);
    # sentences are made in the generator too, as the filters would repeat what makes them for each of their patterns
    bare = lambda raw: F.trim(F.regexp_replace(raw, r"^[○●◎▶▷►◆◇■□★☆·•※→\-]\s*", ""))
    whole = F.struct(x.sentences(F.coalesce("body", F.lit(""))).alias("cut"), is_opinion(F.col("title")).alias("opinion"))
    every = x.let(whole, lambda e: F.transform(e.cut, lambda s: F.struct(F.size(e.cut).alias("total"), e.opinion.alias("opinion"), bare(s).alias("sentence"))))
    rows = news.select(*keep, F.posexplode(every).alias("position", "cut"))
    rows = rows.select(*keep, "cut.opinion", "position", "cut.total", "cut.sentence").where(F.length("sentence") >= 10)
    s = F.col("sentence")
    rows = rows.where(~is_boilerplate(s, hangul) & ~is_unfinished(s))
    # lowered once, not for each keyword
    found = lambda low: F.array_compact(F.array(*(F.when(low.contains(F.lower(F.lit(k))), k) for k in keywords)))
    matched = x.let(F.lower(s), found) if keywords else x.strings(keywords)
    rows = rows.withColumns({"role": role_of(s, r), "has_number": x.has_number(s), "has_quote": x.has_quote(s), "matched": matched})
    return rows.withColumn("importance", F.round(importance(r), 6))


#: Characters of a group that is held whole by one task.
GROUP = 1_000_000


def distinct_sentences(rows: DataFrame, num: int = 1, den: int = 2, shared: int = 15, least: int = 0) -> DataFrame:
    """rows(grp, id, ord, sentence) without those equal or similar to an earlier kept one of their group.

    Groups of up to GROUP characters are dealt whole to tasks that find there who is near whom, so that texts are shuffled and not their words and substrings;
    only who has neighbours is written. The words and substrings of larger groups are dealt over all tasks."""
    rows = rows.where("grp is not null and id is not null")
    sizes = materialized(rows.groupBy("grp").agg(F.sum(F.length("sentence")).alias("chars")).where("chars >= 0"), "group-sizes")
    small_, large = sizes.where(F.col("chars") <= GROUP), sizes.where(F.col("chars") > GROUP)
    if large.isEmpty():
        return distinct_within(rows, small_, num, den, shared, least)
    these = small(large.select("grp"))
    every = distinct_between(rows.join(these, "grp", "left_semi"), num, den, shared, least)
    return every if small_.isEmpty() else every.unionByName(distinct_within(rows.join(these, "grp", "left_anti"), small_, num, den, shared, least))


def keyed(rows: DataFrame, least: int) -> DataFrame:
    return rows.withColumn("key", x.for_dedup(F.col("sentence"))).where(F.length("key") >= least)


def firsts(rows: DataFrame) -> DataFrame:
    """(grp, key, id, ord) of the first of equal keys."""
    return rows.groupBy("grp", "key").agg(F.min(F.struct("ord", "id")).alias("f")).select("grp", "key", F.col("f.id").alias("id"), F.col("f.ord").alias("ord"))


def distinct_within(rows: DataFrame, sizes: DataFrame, num: int, den: int, shared: int, least: int) -> DataFrame:
    """`distinct_sentences` of groups that a task can hold, with sizes(grp, chars)."""
    spark, since = rows.sparkSession, mark()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (sizes.agg(F.sum("chars")).first()[0] or 0) // TASK + 1)
    rows = keyed(rows, least)
    dealt = rows.repartition(tasks, "grp")
    first = firsts(dealt)
    tokens = F.array_distinct(x.words(F.col("key"))).alias("tokens")
    pairs = materialized(pairs_within(first.select("grp", "id", tokens), num, den), "met")
    ends = small(materialized(pairs.select("grp", F.explode(F.array("a", "b")).alias("id")).distinct(), "ends"))
    sets = rows.join(ends, ["grp", "id"], "left_semi").select("grp", "id", F.lit(num).cast("long").alias("num"), tokens).withColumn("n", F.size("tokens").cast("long"))
    keys = edge_keys(reached(pairs, materialized(sets, "end-sets"), den).select("grp", "a", "b"))
    if shared:
        keys = keys.union(shared_substrings(first.select("grp", "id", F.col("key").alias("text")), shared))
    keys = materialized(keys, "near")
    nodes = rows.join(small(materialized(keys.select("grp", "id").distinct(), "near-ids")), ["grp", "id"], "left_semi").select("grp", "id", "ord")
    led = greedy_leaders_by_keys(materialized(nodes, "nodes"), keys)
    out = small(settled(led.where("id <> leader").select("grp", "id"), "out", since))
    place = F.struct("ord", "id")
    kept = dealt.withColumn("_first", F.min(place).over(Window.partitionBy("key", "grp"))).where(place == F.col("_first")).drop("key", "_first")
    return kept.join(out, ["grp", "id"], "left_anti")


def distinct_between(rows: DataFrame, num: int, den: int, shared: int, least: int) -> DataFrame:
    """`distinct_sentences` of groups of any size."""
    since = mark()
    first = materialized(firsts(keyed(rows, least)), "sentences")
    tokens = first.select("grp", "id", x.words(F.col("key")).alias("tokens"))
    keys = edge_keys(similarity_edges(tokens, num, den).select("grp", "a", "b"))
    if shared:
        keys = keys.union(shared_substrings(first.select("grp", "id", F.col("key").alias("text")), shared))
    led = greedy_leaders_by_keys(first.select("grp", "id", "ord"), keys)
    return rows.join(settled(led.where("id = leader").select("grp", "id"), "kept", since), ["grp", "id"], "left_semi")


def merge_bodies(groups: DataFrame, news: DataFrame, target: int = 500) -> DataFrame:
    """(leader, merged): for leaders with bodies under `target` characters, the near-distinct sentences of the group in order.

    groups(leader, id): members, the leader left out."""
    short = news.where(F.length("body") < target).select(F.col("id").alias("leader"))
    members = groups.select("leader", "id").union(groups.select("leader", F.col("leader").alias("id")).distinct()).join(short, "leader", "left_semi")
    rows = members.join(news.select("id", "body", "ord"), "id").select(
        F.col("leader").alias("grp"), (F.col("id") != F.col("leader")).alias("other"), "ord", F.posexplode(x.sentences(F.col("body"))).alias("position", "sentence"), F.col("id").alias("news_id")
    )
    rows = rows.where(F.length("sentence") >= 10).withColumn("id", F.concat_ws(":", "news_id", "position")).withColumn("ord", F.struct("other", "ord", "position"))
    # written once, as the bodies would be brought to their groups again for what is kept of them
    rows = materialized(rows.select("grp", "id", "ord", "sentence"), "group-sentences")
    kept = distinct_sentences(rows, 7, 10, 0)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "sentence"))), lambda s: s.sentence), " ")
    return kept.groupBy(F.col("grp").alias("leader")).agg(joined.alias("merged"))


#: Articles of a topic up to which each is compared with all others.
FEW = 200


def coverage(news: DataFrame, topic: str) -> DataFrame:
    """(topic, id, coverage): one and the number of other articles of the topic with a title similarity of a fifth (case matters).

    The topic is the key of the join; topics of more than FEW articles are joined by prefixes of their titles, where copies make no pairs."""
    items = materialized(news.select(F.col(topic).alias("grp"), "id", "ord", F.array_distinct(x.words(F.col("title"))).alias("tokens")), "topic-titles")
    sizes = items.groupBy("grp").agg(F.count("*").alias("n"))
    a, b = items.alias("a"), items.select("grp", "id", "tokens").join(sizes.where(F.col("n") <= FEW), "grp").alias("b")
    both = F.size(F.array_intersect("a.tokens", "b.tokens"))
    alike = (both > 0) & (both * 5 >= F.size("a.tokens") + F.size("b.tokens") - both)
    near = a.join(b, (F.col("a.grp") == F.col("b.grp")) & (F.col("a.id") != F.col("b.id"))).where(alike).groupBy(F.col("a.grp").alias("grp"), F.col("a.id").alias("id")).agg(F.count("*").alias("links"))
    large = sizes.where(F.col("n") > FEW).select("grp")
    if not large.isEmpty():
        near = near.union(link_counts(items.join(large, "grp", "left_semi"), 1, 5).select("grp", "id", "links"))
    return items.join(near, ["grp", "id"], "left").select(F.col("grp").alias(topic), "id", (1 + F.coalesce("links", F.lit(0))).alias("coverage"))


def primary_articles(rows: DataFrame, news: DataFrame, topic: str, r: Rules = rules.KOREAN) -> DataFrame:
    """(topic, id, score): the best article of each topic by its sentences, trust and coverage; the first of equals.

    Articles of credibility below 0.5 are out where one of at least 0.6 exists."""
    own = rows.groupBy(topic, "id").agg(
        F.avg("importance").alias("mean"), F.count("*").alias("n"), F.sum(F.size("matched")).alias("hits"), F.max(x.contains_any(F.col("sentence"), r.newsworthy)).alias("worthy")
    )
    meta = news.select(topic, "id", "ord", "credibility_score", "quality_score")
    all_ = own.join(meta, [topic, "id"]).join(coverage(news, topic), [topic, "id"])
    best = all_.groupBy(topic).agg(F.max("credibility_score").alias("best"))
    all_ = all_.join(best, topic).where(~((F.col("best") >= 0.6) & (F.col("credibility_score") < 0.5)))
    score = F.col("mean") + 0.5 * F.col("hits") / F.col("n") + 0.3 * F.col("worthy").cast("int") + F.least(F.col("n") * 0.02, F.lit(0.2))
    score = score + 0.3 * (F.col("credibility_score") + F.col("quality_score")) + F.least((F.col("coverage") - 1) * 0.15, F.lit(0.45))
    scored = all_.withColumn("score", F.round(score, 6))
    top = F.max_by(F.struct("id", "score"), F.struct("score", -F.col("ord"))).alias("top")
    return scored.groupBy(topic).agg(top).select(topic, "top.id", "top.score")


def boosted(rows: DataFrame, primary: DataFrame, topic: str) -> DataFrame:
    """Importance of the primary article's sentences times 1.5 (at most 1), of others times 0.6 with a keyword, else 0.3."""
    mark = primary.select(topic, F.col("id").alias("primary_id"))
    own = F.col("id") == F.col("primary_id")
    value = F.when(own, F.least(F.col("importance") * 1.5, F.lit(1.0))).when(F.size("matched") > 0, F.col("importance") * 0.6).otherwise(F.col("importance") * 0.3)
    return rows.join(mark, topic).withColumn("importance", F.round(value, 6))


def top_sentences(rows: DataFrame, topic: str, most: int = 30) -> DataFrame:
    order = Window.partitionBy(topic).orderBy(F.desc("importance"), "ord", "position")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def article_type(text: Column, image_count: Column) -> Column:
    """visual, data or standard, by images, words, digits and number patterns."""
    sure, maybe = x.count_contained(text, rules.VISUAL_SURE) >= 1, x.count_contained(text, rules.VISUAL_MAYBE) >= 3
    digits = F.length(F.regexp_replace(text, r"[^0-9]", "")) / F.greatest(F.length(text), F.lit(1))
    patterns = F.lit(0)
    for p in rules.DATA_PATTERNS:
        patterns = patterns + text.rlike(p).cast("int")
    data = ((digits >= 0.08) & (patterns >= 4)) | (x.count_contained(text, rules.DATA_WORDS) >= 4)
    return F.when((image_count >= 5) | sure | maybe, "visual").when(data, "data").otherwise("standard")


def relevant_articles(news: DataFrame, topic: str, keywords: list[str], hangul: bool = True) -> DataFrame:
    """The articles of each topic that fit its keywords: 3 for one in the title, 1 in the first 300 characters.

    Titles without Hangul and other senses of a keyword are out. Kept is what reaches 0.4 of the best score if that is over 3, else what has a
    score; if nothing has, all that is not out; if all are out, all. Topics of one article, and calls without keywords, stay as they are."""
    if not keywords:
        return news
    title, head = F.coalesce("title", F.lit("")), F.substring(F.coalesce("body", F.lit("")), 1, 300)
    out = F.lit(False)
    if hangul:
        out = (F.length(title) > 10) & (F.length(F.regexp_replace(title, "[^가-힣]", "")) < 0.2 * F.length(title))
    for k in keywords:
        if pattern := rules.OTHER_SENSES.get(k.lower()):
            out = out | F.concat(title, F.lit(" "), head).rlike(pattern)
    low = [k.lower() for k in keywords]
    score = F.when(out, -1).otherwise(3 * x.count_contained(F.lower(title), low) + x.count_contained(F.lower(head), low))
    scored = news.withColumn("_score", score)
    best = scored.groupBy(topic).agg(F.max("_score").alias("_best"), F.count("*").alias("_n"))
    rows = scored.join(best, topic)
    keep = F.when(F.col("_best") > 3, F.col("_score") >= 0.4 * F.col("_best")).when(F.col("_best") > 0, F.col("_score") > 0).when(F.col("_best") == 0, F.col("_score") == 0).otherwise(True)
    return rows.where((F.col("_n") <= 1) | keep).drop("_score", "_best", "_n")


def with_connectors(text: Column, connectors: tuple[str, ...] = rules.CONNECTORS) -> Column:
    """A connecting word before every second sentence that does not begin with one, each in turn while they last."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    begins = lambda s: s.rlike("^(?:" + "|".join(rules.CONNECTED) + ")")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("i"), F.lit(1).alias("next"))

    def step(a: Column, s: Column) -> Column:
        add = (a.i > 0) & (a.i % 2 == 0) & ~begins(s) & (a.next <= len(connectors))
        piece = F.when(add, F.concat(F.element_at(x.strings(connectors), F.least(a.next, F.lit(len(connectors)))), F.lit(" "), s)).otherwise(s)
        return F.struct(F.when(a.i == 0, piece).otherwise(F.concat(a.text, F.lit(" "), piece)).alias("text"), (a.i + 1).alias("i"), (a.next + add.cast("int")).alias("next"))

    return F.aggregate(parts, start, step, lambda a: a.text)
