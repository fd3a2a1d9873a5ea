"""Operators on small fixtures: a plain model of the greedy rule, feeds, normalisation, scoring, requests, images, citations, streams."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

AS_OF = "2026-02-05 14:00:00"


def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols else spark.range(1)
    return df.select(expr.alias("v")).first()["v"]


# similarity and dedup ------------------------------------------------------------------------------
def greedy_model(nodes, edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    leader, leads = {}, []
    for i, _ in sorted(nodes, key=lambda n: (n[1], n[0])):
        own = [x for x in leads if x in near.get(i, ())]
        leader[i] = own[0] if own else i
        if not own:
            leads.append(i)
    return leader


def test_greedy_leaders_like_the_sequential_rule(spark):
    from newsloom.operators.similarity import greedy_leaders

    r, nodes, edges, want = random.Random(1), [], [], {}
    for g in range(40):
        n = r.randrange(1, 14)
        own = [(i, r.randrange(6)) for i in range(n)]
        links = [(a, b) for a in range(n) for b in range(a) if r.random() < 0.25]
        nodes += [(g, *x) for x in own]
        edges += [(g, a, b) for a, b in links]
        want |= {(g, i): v for i, v in greedy_model(own, links).items()}
    got = greedy_leaders(rows(spark, nodes, "grp int, id int, ord int"), rows(spark, edges, "grp int, a int, b int"))
    assert {(x.grp, x.id): x.leader for x in got.collect()} == want


def test_similarity_edges_like_all_pairs(spark):
    from newsloom.operators.similarity import leaders_by_tokens, link_counts, shared_substrings, similarity_edges

    r = random.Random(2)
    items = [(g, i, i, [r.choice("abcdefgh") for _ in range(r.randrange(0, 7))]) for g in range(3) for i in range(40)]
    df = rows(spark, items, "grp int, id int, ord int, tokens array<string>").repartition(3)
    for num, den in ((1, 2), (6, 10), (1, 4)):
        want = {(g, a, b) for g, a, _, s in items for h, b, _, t in items if g == h and a < b and s and t and len(set(s) & set(t)) * den >= len(set(s) | set(t)) * num}
        assert {(x.grp, x.a, x.b) for x in similarity_edges(df, num, den).collect()} == want
        led = {(x.grp, x.id): x.leader for x in leaders_by_tokens(df, num, den).collect()}
        for g in range(3):
            own = greedy_model([(i, i) for i in range(40)], [(a, b) for h, a, b in want if h == g])
            assert {i: led[g, i] for i in range(40)} == own
    texts = rows(spark, [(0, 1, "abcdefghij klmnop"), (0, 2, "xx abcdefghij klmno"), (0, 3, "short"), (1, 4, "abcdefghij klmnop")], "grp int, id int, text string")
    assert {x.id for x in shared_substrings(texts).collect()} == {1, 2}
    counts = {(x.grp, x.id): (x.first, x.links) for x in link_counts(df, 1, 2).collect()}
    for g in range(3):
        own = {i: set(s) for h, i, _, s in items if h == g}
        for i, s in own.items():
            near = [j for j, t in own.items() if j != i and s and t and len(s & t) * 2 >= len(s | t)]
            assert counts[g, i] == (min(j for j, t in own.items() if t == s) if s else i, len(near))


def test_many_equal_titles_make_no_pairs(spark):
    from newsloom.operators import dedup
    from newsloom.operators.similarity import link_counts

    df = spark.range(50_000).select("id", F.col("id").alias("ord"), F.lit("the same five word title").alias("title"), F.concat(F.lit("body "), F.pmod("id", F.lit(2)).cast("string")).alias("body"))
    assert link_counts(dedup.title_items(df), 6, 10).agg(F.min("links"), F.max("links"), F.max("first")).first() == (49_999, 49_999, 0)
    assert dedup.weighted_counts(df).agg(F.min("links"), F.max("links")).first() == (49_999, 49_999)
    groups = dedup.similar_groups(df).agg(F.count("*"), F.countDistinct("leader")).first()
    assert groups == (49_999, 1) and dedup.title_clusters(df).agg(F.min("size"), F.max("leader")).first() == (50_000, 0)


NEWS = "id long, ord long, title string, body string, source_id string, source_name string, source_tier string, url string, category string, tags array<string>, published_at timestamp, view_count long, share_count long, comment_count long"


def article(i, title="t", body="b", source="s", tier="tier1", url=None, when=dt.datetime(2026, 2, 5, 13), views=None):
    return (i, i, title, body, source, source, tier, url, None, [], when, views, None, None)


def test_url_and_title_dedup(spark):
    from newsloom.operators import dedup

    urls = ["https://Example.com/Article", "https://example.com/article?ref=twitter", "https://example.com/article#s", "https://example.com/article/", "https://example.com/other", "", None]
    df = rows(spark, [article(i, f"T{i}", url=u) for i, u in enumerate(urls)], NEWS)
    assert sorted(x.id for x in dedup.by_url(df).collect()) == [0, 4, 5, 6]
    df = rows(spark, [article(0, "AI News"), article(1, " ai news "), article(2, "other")], NEWS)
    assert sorted(x.id for x in dedup.by_title(df).collect()) == [0, 2]
    other = rows(spark, [article(9, url=urls[0]), article(8, url="http://new/")], NEWS)
    first = dedup.union_first(rows(spark, [article(1, url=urls[1])], NEWS), other)
    assert sorted(x.id for x in first.collect()) == [1, 8]


def test_clusters_keep_chains_apart_and_longest_bodies(spark):
    from newsloom.operators import dedup

    df = rows(spark, [article(0, "a b c d"), article(1, "b c d e", "long body"), article(2, "c d e f"), article(3, "x y", "b"), article(4, "x z", "b")], NEWS)
    got = {x.id: (x.leader, x.representative, x.cluster_id is None) for x in dedup.title_clusters(df, 1, 2).collect()}
    assert got[0][:2] == (0, 1) and got[1][0] == 0 and got[2] == (2, 2, True) and got[3] == (3, 3, True)
    groups = rows(spark, [article(0, "chip invest plan", "the chip plant grows fast. more chips"), article(1, "chip invest plan big", "the chip plant grows. more chips now yes"), article(2, "cars on roads", "ev")], NEWS)
    assert {(x.leader, x.id) for x in dedup.similar_groups(groups).collect()} == {(1, 0)}


# scoring and ranking -------------------------------------------------------------------------------
def test_scores(spark):
    from newsloom.operators import ranking, scoring
    from newsloom.rules.news import PRESETS

    body = '성장률 2.5% 기록. "매우 중요한 발표입니다" 관계자는 보고서에서 1000억 투자라고 말했다.'
    df = rows(spark, [article(0, "성장률 발표", body), article(1, "[충격] 할인", "클릭 지금구매. 카지노. 카지노. 카지노."), article(2, "", "")], NEWS)
    x = {r.id: r for r in ranking.score_articles(df).collect()}
    assert x[0].evidence_score == pytest.approx(0.25 + 0.75 + len(body) / 3000, abs=1) and x[0].spam_score == 0 and x[0].trust == 0.85
    assert {"ad_content", "illegal_content", "sensational_title", "repetitive_content"} <= set(x[1].integrity_flags) and x[1].spam_score == 1.0
    assert x[2].title_body_consistency == 0.5 and x[2].evidence_score == 0.3
    assert all(sum(w) == pytest.approx(1) for w in PRESETS.values())
    when = F.lit(AS_OF).cast("timestamp")
    fresh = rows(spark, [article(0), article(1, when=dt.datetime(2026, 2, 4, 14)), article(2, when=None), article(3, views=10)], NEWS).withColumn("q", F.lit(1))
    p = {r.id: r for r in scoring.with_popularity(fresh, ["q"], when).collect()}
    assert p[1].freshness == 0.5 and p[2].popularity_score == 0.3 and p[3].popularity_score == 0.4 and p[2].trending_velocity == 0
    old = rows(spark, [article(0, when=dt.datetime(2025, 8, 1)), article(1, when=dt.datetime(2025, 7, 31))], NEWS).withColumn("q", F.lit(1))
    assert [r.freshness for r in scoring.with_popularity(old, ["q"], when).orderBy("id").collect()] == [1.0, 0.5]


def test_diversity_and_source_name_switch(spark):
    from newsloom.operators.ranking import ranked

    cols = "query_id int, id long, ord long, source_id string, source_name string, final_score double, published_at timestamp, preset string, limit int, offset int, group_by string, diversity boolean"
    data = [(1, i, i, "a" if i < 5 else "b", "n", 10.0 - i, None, "quality", 5, 0, None, True) for i in range(7)]
    data += [(2, i, i, "g", f"n{i % 2}", 5.0, None, "latest", 20, 0, None, True) for i in range(8)]
    got = ranked(rows(spark, data, cols)).orderBy("query_id", "rank_position").collect()
    assert [x.id for x in got if x.query_id == 1] == [0, 1, 2, 5, 6] and [x.id for x in got if x.query_id == 2] == [0, 1, 2, 3, 4, 5]


# text ----------------------------------------------------------------------------------------------
def test_text_functions(spark):
    from newsloom.functions import text as x

    c = F.col
    assert one(spark, x.clean_html(c("h")), h="<style>a{}</style><p>A &amp; B</p>\n\n <script>x()</script> <b>c</b> &lt;") == "A & B\nc <"
    assert one(spark, x.clean_snippet(c("h")), h="<b>a</b>  &lt;i&gt;b&lt;/i&gt;\n c") == "a b c"
    times = ["2026-02-05T10:00:00+09:00", "Thu, 05 Feb 2026 10:00:00 +0900", "2026-02-05", "junk", None]
    got = rows(spark, [(t,) for t in times], "t string").select(x.parse_time(c("t")).cast("string").alias("v")).collect()
    assert [g.v for g in got] == ["2026-02-05 01:00:00", "2026-02-05 01:00:00", "2026-02-05 00:00:00", None, None]
    assert one(spark, x.sentences(c("s")), s="One. Two!  Three\n\nFour?") == ["One.", "Two!", "Three.", "Four?"]
    assert one(spark, x.infer_category(F.lit(""), c("t")), t="새 AI 기술") == "IT" and one(spark, x.is_video(c("t")), t="뉴스데스크 1월 4일") and one(spark, x.is_video(c("t")), t="[LIVE] now")
    long = "가" * 45 + " " + "나" * 30
    assert one(spark, x.cut_title(c("t")), t=long) == "가" * 45 and one(spark, x.cut_title(c("t")), t="short") == "short"
    assert one(spark, x.occurrences(c("t"), F.lit("aa")), t="aaaa aa") == 3 and one(spark, x.has_number(c("t")), t="3개")


def test_sentence_roles(spark):
    from newsloom.operators.sentences import is_boilerplate, is_unfinished, role_of

    for end in ("", "."):
        for text, role in (("정부가 대책을 발표했다", "lead"), ("비가 내릴 전망이 있다", "outlook"), ('"좋다"라고 말했다', "quote"), ("매출은 30% 늘었다", "statistic"), ("그것은 사실이다", "fact"), ("물가 상승의 배경은", "background")):
            assert one(spark, role_of(F.col("s")), s=text + end) == role
    assert one(spark, role_of(F.col("s"), strict=True), s="정부가 대책을 발표했다.") == "fact"
    assert one(spark, is_boilerplate(F.col("s")), s="무단 전재 및 재배포 금지") and one(spark, is_boilerplate(F.col("s")), s="This is an English sentence here.") and not one(spark, is_boilerplate(F.col("s")), s="정부가 새로운 정책을 발표했다.")
    assert one(spark, is_unfinished(F.col("s")), s="비가 왔지만.") and one(spark, is_unfinished(F.col("s")), s="(열린 괄호") and not one(spark, is_unfinished(F.col("s")), s="끝난 문장이다.")


def test_titles_topics_and_connectors(spark):
    from newsloom.functions import text as x
    from newsloom.operators.sentences import relevant_articles, with_connectors

    assert one(spark, x.clean_title(F.col("t")), t="[논썰] 반도체 '이 기업' 급등 - 연합뉴스") == "반도체 급등"
    assert one(spark, x.split_title_body(F.col("t"), F.lit("d")), t="# Title\nBody\nmore").asDict() == {"title": "Title", "body": "Body\nmore"}
    assert one(spark, x.section_parts(F.col("t")), t="a\n\nb\n\nc\n\nd").asDict() == {"lead": "a", "body": "b\n\nc", "closing": "d"}
    assert one(spark, x.clean_body(F.col("t")), t="본문이다.\n홍길동 기자 hong@news.kr\n▶ 목록\n무단 전재 금지") == "본문이다."
    assert one(spark, with_connectors(F.col("t")), t="하나. 둘. 셋. 넷. 또한 다섯. 여섯. 일곱.") == "하나. 둘. 한편 셋. 넷. 또한 다섯. 여섯. 또한 일곱."
    news = rows(spark, [article(0, "AI 반도체 투자 확대"), article(1, "고병원성 AI 발생 방역 강화"), article(2, "English title only here"), article(3, "축구 경기 결과", "인공지능")], NEWS).withColumn("topic", F.lit(1))
    assert [r.id for r in relevant_articles(news, "topic", ["AI"]).collect()] == [0]


def test_paragraphs_and_sections(spark):
    from newsloom.operators import assembly

    s = [(i, t, r, "p", False, ["k"]) for i, (t, r) in enumerate([("a" * 60, "fact"), ("b" * 30, "quote"), ("c" * 30, "quote"), ("d" * 380, "background"), ("e" * 20, "detail"), ("f" * 10, "outlook")], 1)]
    df = rows(spark, [(1, "p", s)], "topic_id int, primary_id string, s array<struct<place:int,sentence:string,role:string,id:string,has_number:boolean,matched:array<string>>>")
    t = assembly.social_post(assembly.cards(assembly.brief(assembly.straight(df)))).first()
    assert t.lead == "a" * 60 and t.closing == "f" * 10 and t.body == "b" * 30 + " " + "c" * 30 + "\n\n" + "d" * 380 + " " + "e" * 20
    assert t.headline == "a" * 60 + " " + "b" * 30 + " " + "c" * 30 and len(t.cards) == 6 and t.hook == "a" * 50 and t.hashtags == "#k"


# requests ------------------------------------------------------------------------------------------
def test_requests(spark):
    from newsloom.operators import querylog

    texts = ["어제 정치 뉴스 Top 10", "2월 1일~5일 동안 AI 관련 뉴스", "지난 1주일간 가장 많이 본 과학 뉴스", "화제의 경제 뉴스 20개", "12월 25일 뉴스", "2026-01-01 ~ 2026-01-10 축구 제외", "2월 30일 뉴스", "", None]
    got = querylog.parse_requests(rows(spark, list(enumerate(texts)), "query_id int, text string"), F.lit(AS_OF).cast("timestamp")).orderBy("query_id").collect()
    day = lambda x: x and (x.month, x.day)
    assert (got[0].category, got[0].limit, day(got[0].date_from), day(got[0].date_to)) == (["정치"], 10, (2, 4), (2, 4))
    assert (got[1].keywords, got[1].category, day(got[1].date_from), day(got[1].date_to)) == (["AI"], ["IT"], (2, 1), (2, 5))
    assert (got[2].popularity_type, got[2].category, day(got[2].date_from)) == ("popular", ["과학"], (1, 29))
    assert (got[3].popularity_type, got[3].group_by, got[3].limit) == ("trending", "day", 20)
    assert got[4].date_from.year == 2025 and day(got[5].date_to) == (1, 10) and got[5].exclude_keywords == ["축구"]
    assert [got[k].date_from for k in (6, 7, 8)] == [None] * 3
    bad = rows(spark, [(101, -1, "odd", "none", ["k"] * 11, ["c"] * 6)], "limit int, offset int, popularity_type string, group_by string, keywords array<string>, category array<string>")
    assert len(bad.withColumns({"date_from": F.current_timestamp(), "date_to": F.lit(AS_OF).cast("timestamp") - F.expr("interval 900 days")}).select(querylog.query_errors().alias("e")).first().e) >= 5


# feeds ---------------------------------------------------------------------------------------------
def test_feeds(spark, tmp_path):
    from newsloom.sources import feeds

    (tmp_path / "f").mkdir()
    rss = "<rss><channel>" + "".join(f"<item><title>T{i} &amp; more</title><link>http://n/{i}</link><description>d</description><pubDate>Thu, 05 Feb 2026 10:00:00 +0900</pubDate><author>A</author></item>" for i in range(3)) + "</channel></rss>"
    (tmp_path / "f/a.xml").write_text(rss)
    (tmp_path / "f/b.xml").write_text('<feed><entry><title>E</title><link href="http://e/"/><summary>s</summary><published>2026-02-05T10:00:00+09:00</published></entry></feed>')
    (tmp_path / "f/c.xml").write_text("<rss><channel></channel></rss>")
    got = feeds.read_feeds(spark, str(tmp_path / "f")).collect()
    assert sorted(x.title for x in got) == ["E", "T0 & more", "T1 & more", "T2 & more"] and {x.url for x in got} >= {"http://e/", "http://n/1"}
    (tmp_path / "j").mkdir()
    item = {"title": "<b>X</b> &amp;", "originallink": "", "link": "http://l/", "description": "a <b>b</b>", "pubDate": "Thu, 05 Feb 2026 10:00:00 +0900"}
    (tmp_path / "j/1.json").write_text(json.dumps({"items": [item, item | {"originallink": "http://o/"}]}))
    (tmp_path / "j/2.json").write_text(json.dumps({"articles": [item, item, item]}))
    api = feeds.read_api(spark, str(tmp_path / "j"), 2)
    assert sorted(x.url for x in api.collect()) == ["http://l/", "http://l/", "http://l/", "http://o/"] and api.first().title == "X &"
    news = feeds.to_news(api.withColumn("source_name", F.lit("Out let")), None, F.current_timestamp()).first()
    assert news.source_id == "out_let" and news.body == "a b" and str(news.published_at) == "2026-02-05 01:00:00"
    (tmp_path / "r.json").write_text(json.dumps({"summary": {}, "results": [{"test_id": 1, "success": True, "score": 90.0, "issues": ["BODY_TOO_SHORT:3"], "structure": {"news_type": "data"}}]}))
    assert feeds.read_reports(spark, str(tmp_path / "r.json")).first().news_type == "data"
    feeds.write_report(api, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 4


# registry, images, citations, quality --------------------------------------------------------------
def test_registry(spark):
    from newsloom.operators import registry

    t = lambda i: dt.datetime(2026, 1, 1, 0, i)
    log = [("a", t(i), False, i) for i in range(5)] + [("b", t(0), False, 0), ("b", t(1), True, 1), ("b", t(2), False, 2)] + [("c", t(0), True, 0)]
    h = {x.source_id: x for x in registry.health(rows(spark, log, "source_id string, ts timestamp, ok boolean, ord int")).collect()}
    assert (h["a"].failure_count, h["a"].is_active, h["b"].failure_count, h["c"].failure_count) == (5, False, 1, 0)
    s = registry.load(rows(spark, [("x", "tier1", None, None, None, ["IT"], ["ko"]), ("y", "blacklist", "api", 0.0, None, [], []), ("z", None, None, 70.0, False, [], ["ko"])], "source_id string, tier string, ingestion_type string, credibility_base_score double, is_active boolean, supported_categories array<string>, supported_locales array<string>"))
    assert [x.source_id for x in registry.select(s).collect()] == ["x"] and [x.source_id for x in registry.select(s, active=False, locale="ko").collect()] == ["x", "z"]
    back = registry.reactivated(s.withColumn("failure_count", F.lit(5)), F.lit(True)).where("is_active").collect()
    assert sorted(x.source_id for x in back) == ["x", "z"]


def test_images(spark):
    from newsloom.operators import images

    html = '<meta property="og:image" content="http://c/main.jpg"><img src="/a/photo.jpg" alt="chip"><img src="//cdn/A/photo.jpg"><img src="icon.png"><img src="http://x/p_50x50.jpg"><img src="http://x/{{IMAGE}}"><img src="v.svg">'
    got = {x.url: (x.position, x.verdict) for x in images.page_images(rows(spark, [(1, "http://h/n/1.html", html)], "page_id int, url string, html string")).collect()}
    assert got["http://c/main.jpg"] == (-1, "valid") and got["http://h/a/photo.jpg"][1] == "valid" and "http://cdn/A/photo.jpg" not in got
    assert got["http://h/n/icon.png"][1] == "pattern:icon" and got["http://x/p_50x50.jpg"][1] == "too_small:50x50" and got["http://x/{{IMAGE}}"][1] == "placeholder" and got["http://h/n/v.svg"][1] == "pattern:.svg"
    assert one(spark, images.watermark(F.col("u")), u="http://x/wm/center.jpg") == "center" and one(spark, images.placement(F.lit(5), F.lit(6)), u="") == "gallery"


def test_quotes_like_all_pairs_and_late_sentences(spark, monkeypatch):
    from newsloom.operators import citations
    from newsloom.plans import stage4

    r = random.Random(5)
    some = lambda n: [" ".join(r.choice("aBcdefghij") for _ in range(r.randrange(1, 9))) for _ in range(n)]
    made, said = [(t, some(30)) for t in range(2)], [(t, i, some(20)) for t in range(2) for i in range(4)]
    got = citations.quote_matches(rows(spark, made, "topic int, quotes array<string>"), rows(spark, said, "topic int, id int, quotes array<string>"), "topic").collect()
    share = lambda q, o: len(set(q.lower().split()) & set(o.lower().split())) / len(set(o.lower().split()))
    assert {tuple(x) for x in got} == {(t, q, i) for t, qs in made for q in qs for u, i, os in said if t == u for o in os if share(q, o) >= 0.7}

    late = " ".join(f"Filler number {w} stands here." for w in ("one", "two", "three", "four", "five")) + " The late sentence counts too."
    articles = rows(spark, [(0, 1, "T", late), (0, 2, "U", "Nothing of the kind.")], "topic_id long, id long, title string, body string")
    monkeypatch.setattr(stage4, "topic_articles", lambda s, d: articles)
    monkeypatch.setattr(stage4, "assembled", lambda s, d: rows(s, [(0, "The late sentence counts too.")], "topic_id long, text string"), raising=False)
    assert [(x.quotes, x.facts, x.total) for x in stage4.c01_citations(spark, "").collect()] == [(1, 2, 3)]


def test_sentences_are_made_once_and_guards_lose_no_boilerplate(spark):
    from newsloom.operators import sentences

    news = rows(spark, [(1, "T", "● The first sentence is here. Seen on 10% of all days. Copyright © of us all.")], "id long, title string, body string")
    out = sentences.extract(news, ["THE", "all"], hangul=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("○●◎▶") == 1  # the mark of a sentence is cut once, not for each pattern that it is asked for
    assert [(x.position, x.sentence, x.matched) for x in out.orderBy("position").collect()] == [(0, "The first sentence is here.", ["THE"]), (1, "Seen on 10% of all days.", ["all"])]
    every = "|".join(f"(?:{p})" for p in sentences.rules.BOILERPLATE)
    texts = ["저작권자 (c)", "copyright ⓒ", "All rights Reserved", "| a |", "[%%x%%]", "AD", "AD.", "Tel: 02-1", "[Fax] 1", "Email 3", "메일: 5", "APP 다운", "DB 금지", "출처 = x", "a@b.co", "b.com", "[기자] x", "plain words", "Rights", "전화 1", "*재판매", "홍길동 기자 보도"]
    got = rows(spark, [(t,) for t in texts], "t string").select("t", sentences.is_boilerplate(F.col("t"), False).alias("got"), F.col("t").rlike(every).alias("want")).collect()
    assert [x.t for x in got if x.got != x.want] == [] and 15 < sum(x.got for x in got) < len(texts)


def test_quotes_of_long_sentences_are_written_once(spark):
    from newsloom.operators import citations

    def shuffled():
        store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
        stages = store.stageList(None, False, False, none, spark.sparkContext._jvm.java.util.ArrayList())
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    r = random.Random(8)
    long = " ".join({"".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(3000)})
    made, said = rows(spark, [(1, [long])], "topic int, quotes array<string>"), rows(spark, [(1, 7, [long.upper(), long.rsplit(" ", 1)[0], "another"])], "topic int, id int, quotes array<string>")
    before = shuffled()
    assert [tuple(x) for x in citations.quote_matches(made, said, "topic").collect()] == [(1, long, 7)]
    assert shuffled() - before < 20 * len(long)


def test_citations(spark):
    from newsloom.operators import citations

    made = rows(spark, [(1, ["we will grow fast next year", "never said"])], "topic int, quotes array<string>")
    said = rows(spark, [(1, "a", "T", ["we will grow very fast next year"]), (1, "b", "U", ["we will grow fast next year"]), (1, "c", "V", [])], "topic int, id string, title string, quotes array<string>")
    m = citations.quote_matches(made, said, "topic")
    assert sorted((x.quote, x.id) for x in m.collect()) == [("we will grow fast next year", "a"), ("we will grow fast next year", "b")]
    s = citations.summary(citations.citations(m, said, "topic"), "topic").first()
    assert (s.quotes, s.facts, s.sources) == (2, 3, 3)
    cited = F.array(F.struct(F.lit("x y").alias("cited"), F.lit("S").alias("source")), F.struct(F.lit("none").alias("cited"), F.lit("R").alias("source")))
    assert one(spark, citations.marked(F.col("t"), cited), t='he said "x y" and x y') == 'he said "x y (S)" and x y'
    assert one(spark, citations.marked(F.col("t"), cited, "endnote"), t="x y") == "x y[1]\n\n[1] S\n[2] R"


def test_texts_are_searched_for_names_once(spark):
    from newsloom.operators import facts

    t = rows(spark, [(1, "Acme Works", "Acme Works and Zeta Labs and Acme Works"), (2, "x", "가나 가나 다라")], "topic int, titles string, text string")
    out = facts.entity_scores(t, "topic", ["zeta"], (), r"[A-Z][a-z]+ (?:Works|Labs)", companies="[A-Z][a-z]+ Works")
    assert sorted((x.topic, x.entity, x.score, x.place) for x in out.collect()) == [(1, "Acme Works", 41, 2), (1, "Zeta Labs", 6, 3), (1, "zeta", 51, 1), (2, "가나", 2, 1)]
    # the text is not searched again for each of its names
    word = lambda k: "N" + "".join(chr(97 + k // 26**i % 26) for i in range(4))
    many = rows(spark, [(1, "x", ". ".join(word(k) for k in range(10_000)))], "topic int, titles string, text string")
    start = time.monotonic()
    assert [x.score for x in facts.entity_scores(many, "topic", ["qqq"], ()).collect()] == [6] * 5
    assert time.monotonic() - start < 20


def test_facts(spark):
    from newsloom.operators import facts

    t = rows(spark, [(1, "삼성전자 실적", "삼성전자 실적 삼성전자 매출 10조5000억원, 50% 증가. 10조원 돌파. 7월 5일 발표. Apple Inc 협력, 50개 출시")], "topic int, titles string, text string")
    n = [(x.number, x.kind) for x in facts.numbers(t, "topic").orderBy("place").collect()]
    assert n[0] == ("10조원", "금액") and ("50%", "비율") in n and len({k for _, k in n}) == len(n) <= 3
    e = [x.entity for x in facts.entity_scores(t, "topic", ["실적"]).orderBy("place").collect()]
    assert e[0] == "실적" and "삼성전자" in e
    assert e == ["실적", "삼성전자", "삼성", "Apple Inc"]
    texts = [
        (1, "Tesla 판매", "Tesla 판매 Tesla 공장 Tesla"), (2, "현대자동차 신차", "현대자동차 신차 현대자동차 수출 한국에너지 LG Apple 애플"), (3, "날씨 소식", "날씨 소식 날씨 오늘 오늘 오늘 우산 우산 비"), (4, "", "비"),
    ]
    found = {}
    for x in facts.entity_scores(rows(spark, texts, "topic int, titles string, text string"), "topic", ["tesla", "애플", "Tesla"]).orderBy("topic", "place").collect():
        found.setdefault(x.topic, []).append((x.entity, x.score))
    assert found == {
        1: [("tesla", 71), ("Tesla", 71)],  # a listed name gets no second points
        2: [("애플", 50 + 10 + 2), ("현대자동차", 5 + 15 + 5 + 15 + 1), ("현대", 10 + 20 + 1), ("LG", 11), ("한국에너지", 6)],
        3: [("날씨", 2), ("우산", 2)],
    }
    assert t.select(facts.dates(F.col("text")).alias("d"), facts.actions(F.col("text")).alias("a")).first().asDict() == {"d": ["7월 5일"], "a": ["발표", "돌파", "증가", "출시", "협력"]}


def test_run_reports(spark):
    from newsloom.operators import qa

    runs = rows(spark, [("data", True, 90.0, 400, ["BODY_TOO_SHORT:396"]), ("data", False, 0.0, 0, ["GENERATION_FAILED"]), ("standard", True, 80.0, 700, ["BODY_TOO_SHORT:1", "MISSING_LEAD"])], "news_type string, success boolean, score double, chars int, issues array<string>")
    assert [(x.issue, x.n) for x in qa.issue_histogram(runs).collect()][0] == ("BODY_TOO_SHORT", 2)
    total = qa.run_summary(runs, ["news_type"]).where("news_type is null").first()
    assert (total.tests, total.successes, total.mean_score, total.mean_chars) == (3, 2, 85.0, 550.0)
    change = qa.compare_runs(rows(spark, [("a", 1.0)], "k string, v double"), rows(spark, [("a", 3.0), ("b", 2.0)], "k string, v double"), "k", ["v"])
    assert {x.k: x.v_change for x in change.collect()} == {"a": 2.0, "b": 2.0}


def test_search_tests_are_checked(spark):
    from newsloom.operators import qa

    day = dt.datetime(2026, 1, 10)
    tests = rows(spark, [(1, "quality", 2, day, 9, ["ai"]), (2, "latest", 5, day, 9, ["ai"]), (3, "trending", 3, day, 3, ["x"]), (4, "quality", 5, day, 0, ["x"]), (5, "quality", 5, day, 7, ["x"]), (6, "credible", 1, day, 1, [])], "query_id int, preset string, limit int, date timestamp, raw_count int, terms array<string>")
    found = [(1, "", k + 1, 80.0 - k, "AI " + "t" * k, "b", f"s{k}", day, 0.5, 0.9, "u") for k in range(3)]
    found += [(2, "", 1, 30.0, "no", "b", "s", day + dt.timedelta(days=4), 0.5, 0.9, "u"), (2, "", 2, 25.0, "no", "b", "s", None, 0.5, 0.9, None), (2, "", 3, 26.0, "no", "", "s", day, 0.5, 0.9, "u")]
    found += [(3, "", 1, 40.0, "x", "b", "s", day, 0.0, 0.9, "u"), (3, "", 2, 41.0, "x", "b", "r", day - dt.timedelta(days=3), 0.1, 0.9, "u"), (3, "", 3, 2.0, "x", "b", None, day + dt.timedelta(days=3, hours=5), 0.1, 0.9, "u"), (6, "", 1, 55.0, "q", "b", "s", day, 0.0, 0.4, "u")]
    schema = "query_id int, group_key string, rank_position int, final_score double, title string, body string, source_name string, published_at timestamp, popularity_score double, credibility_score double, url string"
    out = qa.validated(tests, rows(spark, found, schema))
    got = {x.query_id: ({f"{i.severity}:{i.check}" for i in x.issues}, x.score, x.passed, x.avg_score, x.relevance_ratio, x.date_match_ratio) for x in out.collect()}
    assert got[1] == (set(), 100, True, 79.0, 1.0, 1.0)
    # 100 - 5 (too few) - 5 (27 of 35) - 15 (relevance) - 5 (one source) - 5 (dates) - 15 (an empty body) - 2 (no address); order does not count for latest
    assert got[2] == ({"MEDIUM:insufficient_results", "MEDIUM:mediocre_avg_score", "HIGH:low_relevance", "MEDIUM:no_diversity", "MEDIUM:date_mismatch", "HIGH:empty_content", "LOW:missing_url"}, 48, False, 27.0, 0.0, 0.33)
    assert got[3][0] == {"HIGH:low_avg_score", "LOW:low_trending_popularity", "CRITICAL:score_ordering"} - ({"HIGH:low_avg_score"} if got[3][3] >= 30 else set()) and not got[3][2] and got[3][5] == 1.0
    assert got[4] == ({"CRITICAL:collection_empty"}, 0, False, None, None, None) and got[5] == ({"HIGH:pipeline_empty"}, 0, False, None, None, None)
    assert got[6] == ({"MEDIUM:low_credibility_in_credible_preset"}, 100, True, 55.0, 0.0, 1.0)
    counts = {(x.by, x.issue): x.n for x in qa.issue_counts(out).collect()}
    assert counts["check", "score_ordering"] == counts["severity", "CRITICAL:score_ordering"] == 1 and len(counts) == 2 * len({k for _, k in counts if ":" not in k})


# streams -------------------------------------------------------------------------------------------
def test_streams(spark, tmp_path):
    from newsloom.streaming import jobs

    t = lambda h, m=0: dt.datetime(2026, 1, 1, h, m)
    log = rows(spark, [(1, t(0, i), i >= 5, f"http://a/?x={i}") for i in range(5)] + [(2, t(1), True, "http://b/")], "source_id long, ts timestamp, ok boolean, url string")
    log.repartition(1).write.parquet(str(tmp_path / "log"))
    read = lambda: jobs.stream(spark, str(tmp_path / "log"))
    h = {x.source_id: (x.failures, x.active) for x in jobs.drain(jobs.health(read()), "health").collect()}
    assert h == {1: (5, False), 2: (0, True)}
    u = {(x.source_id, x.slot.hour): x.requests for x in jobs.drain(jobs.usage(read()), "usage", "update").collect()}
    assert u == {(1, 0): 5, (2, 1): 1}
    from newsloom.functions.text import url_key

    seen = jobs.drain(jobs.first_seen(read().withColumn("url_key", url_key(F.col("url")))), "seen")
    assert sorted(x.url_key for x in seen.collect()) == ["http://a", "http://b"]


def test_entry_without_the_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name in [m for m in sys.modules if m.startswith(("corpus_pipeline", "newsloom.llm"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.reload(entry)
    assert alone.queries() and not [q for q in alone.queries() if q.startswith("op") or q == "pipeline"]
    monkeypatch.undo()
    importlib.reload(entry)


def in_files(spark, path, parts, schema):
    """One file for each part, in that order by time of change."""
    import os

    for i, part in enumerate(parts):
        rows(spark, part, schema).coalesce(1).write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and os.stat(f"{path}/{f}").st_mtime > 2_000_000:
                os.utime(f"{path}/{f}", (1_000_000 + i, 1_000_000 + i))


def test_usage_stream_counts_files_out_of_order(spark, tmp_path, monkeypatch):
    from newsloom.plans.stage4 import t04_usage_stream
    from newsloom.streaming import jobs

    t0 = dt.datetime(2026, 1, 1)
    parts = [[(7, t0 + dt.timedelta(hours=h, minutes=m), "click", m) for m in range(h + 1)] for h in (9, 6, 3, 0)]
    in_files(spark, str(tmp_path / "events.parquet"), parts, "user_id long, ts timestamp, event_type string, event_id long")
    whole = jobs.stream
    monkeypatch.setattr(jobs, "stream", lambda s, path: whole(s, path, 1))
    assert {(x.slot.hour, x.requests) for x in t04_usage_stream(spark, str(tmp_path)).collect()} == {(h, h + 1) for h in (9, 6, 3, 0)}


def test_health_stream_needs_no_order(spark, tmp_path, monkeypatch):
    from newsloom.operators import registry
    from newsloom.plans.stage4 import fetch_log, t03_health_stream
    from newsloom.streaming import jobs

    r, t0 = random.Random(3), dt.datetime(2026, 1, 1)
    log = [(s, t0 + dt.timedelta(minutes=m), "error" if m > 60 - 3 * s or r.random() < 0.5 else "click", m) for s in range(4) for m in range(61)]
    r.shuffle(log)
    in_files(spark, str(tmp_path / "events.parquet"), [log[:100], log[100:180], log[180:]], "user_id long, ts timestamp, event_type string, event_id long")
    want = {(x.source_id, x.failure_count, x.is_active) for x in registry.health(fetch_log(spark, str(tmp_path))).collect()}
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, whole = spark.conf.get(key), jobs.stream
    try:
        spark.conf.set(key, "2")
        assert {tuple(x) for x in t03_health_stream(spark, str(tmp_path)).collect()} == want
        monkeypatch.setattr(jobs, "stream", lambda s, path: whole(s, path, 1))
        assert {tuple(x) for x in t03_health_stream(spark, str(tmp_path)).collect()} == want
    finally:
        spark.conf.set(key, before)


def test_queries_meet_articles_without_nested_loops(spark):
    from newsloom.operators import querylog, ranking

    at = lambda d: dt.datetime(2026, 1, d, 12)
    news = rows(spark, [(i, i, f"title {i}", "body ai", None if i == 7 else at(i % 5 + 1)) for i in range(12)], "id int, ord int, title string, body string, published_at timestamp")
    q = rows(spark, [(1, at(2), at(3), []), (2, None, at(1), ["TITLE 5"]), (3, at(4), None, None), (4, at(9), None, []), (5, at(3), at(2), []), (6, None, None, [])], "query_id int, date_from timestamp, date_to timestamp, exclude_keywords array<string>")
    out = ranking.candidates(q, news)
    got = {(x.query_id, x.id) for x in out.collect()}
    days = {1: {2, 3}, 2: {1}, 3: {4, 5}, 4: set(), 5: set(), 6: {1, 2, 3, 4, 5}}
    assert got == {(k, i) for k, d in days.items() for i in range(12) if (i == 7 or i % 5 + 1 in d) and not (k == 2 and i == 5)}
    wanted = rows(spark, [(1, ["ai", "Title 3"], dt.date(2026, 1, 4)), (2, ["title 3"], dt.date(2026, 1, 7)), (3, ["ai"], None), (4, [], dt.date(2026, 1, 1))], "query_id int, keywords array<string>, date date")
    wide = querylog.widened(wanted, news)
    assert {(x.query_id, x.id, x.step) for x in wide.collect()} == {(1, 3, 1), (1, 8, 3), (2, 3, 2)}
    for df in (out, wide):
        assert "NestedLoop" not in df._jdf.queryExecution().toString() and "Cartesian" not in df._jdf.queryExecution().toString()


def test_over_limit_counts_every_request(spark, tmp_path):
    from newsloom.plans.stage4 import t04_over_limit

    t0 = dt.datetime(2026, 1, 1)
    log = [(7, t0, "signup", 3), (7, t0 + dt.timedelta(minutes=1), "click", 4), (10, t0, "signup", 6), (10, t0 + dt.timedelta(minutes=2), "signup", 9), (None, t0, "click", 1), (None, t0, "error", 2), (8, t0, "click", 5)]
    rows(spark, log, "user_id long, ts timestamp, event_type string, event_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert {tuple(x) for x in t04_over_limit(spark, str(tmp_path)).collect()} == {(s, t0, 2, "hour") for s in (7, 10, None)}
