"""Formats, layouts, fact articles, source maps, rankings and runs against plain models and small fixtures."""

import datetime as dt
import random

from pyspark.sql import functions as F


def frame(spark, values, schema):
    return spark.createDataFrame(values, schema)


def one(spark, column, **cols):
    return frame(spark, [tuple(cols.values())] if cols else [(1,)], ", ".join(f"{k} string" for k in cols) or "x int").select(column.alias("v")).first()["v"]


def test_templates(spark):
    from newsloom.operators import templates as t
    from newsloom.rules.formats import TEMPLATES

    c = F.lit
    straight = one(spark, t.render("straight", {"title": c("제목"), "lead": c("리드"), "body": c("본문"), "sources": c("연합뉴스")}))
    assert straight == "제목\n\n리드\n\n본문\n\n---\n출처: 연합뉴스"  # the missing closing leaves no blank lines
    cards = F.array(F.struct(c("A").alias("title"), c("x").alias("body")), F.struct(c("B").alias("title"), c("y").alias("body")))
    news = one(spark, t.render("card_news", {"title": c("T"), "cards": cards, "sources": c("s")}, ("cards",)))
    assert news == "=== T ===\n\n[1] A\nx\n\n[2] B\ny\n\n---\n출처: s"
    assert [(e.number, e.content) for e in one(spark, t.cards_of(c(news)))] == [(1, "A\nx"), (2, "B\ny\n\n---\n출처: s")]
    listicle = one(spark, t.render("listicle", {"title": c("T"), "items": F.array(F.struct(c("a").alias("title"), c("d").alias("description")))}, ("items",)))
    assert "1. a\n   d" in listicle and [(e.number, e.content) for e in one(spark, t.items_of(c("1. a b\n2. c")))] == [(1, "a b"), (2, "c")]
    assert [(e.question, e.answer) for e in one(spark, t.pairs_of(c("Q. why?\nA. so\n\nQ. how?\nA. thus")))] == [("why?", "so"), ("how?", "thus")]
    assert one(spark, t.lacking("straight", {"title": c("x"), "lead": c(""), "body": c(None)})) == ["body", "closing", "lead", "sources"]
    assert all(t.field_names(n) for n in TEMPLATES) and len(TEMPLATES) == 12
    long = "가" * 45 + " " + "나" * 30
    assert one(spark, t.short_title(c(long))) == "가" * 45 + "..." and one(spark, t.short_title(c("가" * 70))) == "가" * 57 + "..." and one(spark, t.short_title(c("short"))) == "short"


def test_prompts(spark):
    from newsloom.operators.templates import constraints, prompts

    rows = [(1, 2, 2, "B", "s2", "two", None), (1, 1, 1, "A", "s1", "one", dt.datetime(2026, 2, 5)), (2, 3, 3, "C", None, None, None)]
    news = frame(spark, rows, "topic long, id long, ord long, title string, source_name string, body string, published_at timestamp")
    both = {r.topic: r.prompt for r in prompts(news, "topic", "analysis", "synthesis", "do", "plain").collect()}
    assert "[뉴스 1]\n제목: A\n출처: s1\n내용: one\n\n[뉴스 2]\n제목: B" in both[1] and "1500-3000자 분량" in both[1] and both[1].index("[제약 조건]") < both[1].index("[원본 뉴스]")
    single = {r.topic: r.prompt for r in prompts(news, "topic", "brief", "rewrite", "do", "plain", context=F.lit("ctx"), longest=80).collect()}
    assert "발행: 2026-02-05" in single[1] and "B" not in single[1].split("[원본 뉴스]")[1].split("[추가 정보]")[0] and "발행: 알 수 없음" in single[2] and "80자 이내로 작성" in single[1] and "[추가 정보]\nctx" in single[1]
    assert len(constraints("straight", "rewrite")) == len(constraints("straight", "synthesis")) - 1


S = "array<struct<place:int,sentence:string,role:string,id:long,has_number:boolean,matched:array<string>>>"


def topic(spark, sentences, primary=1):
    data = [(k, f"s{k}", role, i, number, []) for k, (role, i, number) in enumerate(sentences)]
    return frame(spark, [(7, primary, data)], f"topic_id long, primary_id long, s {S}")


def analysis_model(s):
    used = set()

    def take(roles, quota, least):
        own = [e for e in s if e[1] in roles and (e[0] not in used)][:quota]
        if len(own) < least:
            own += [e for e in s if e[0] not in used and e not in own][: quota - len(own)]
        used.update(e[0] for e in own)
        return " ".join(e[0] for e in own)

    return [take(("lead", "fact", "statistic"), 5, 0), take(("background",), 5, 3), take(("outlook",), 4, 3), take(("implication",), 3, 2)]


def test_analysis_and_layouts_like_plain_models(spark):
    from newsloom.operators import assembly

    r, roles = random.Random(4), ["lead", "fact", "statistic", "background", "outlook", "implication", "quote", "detail"]
    for n in (0, 1, 3, 9, 30):
        sentences = [(r.choice(roles), r.choice([1, 2]), r.random() < 0.4) for _ in range(n)]
        named = [(f"s{k}", role, i, number) for k, (role, i, number) in enumerate(sentences)]
        got = assembly.data(assembly.visual(assembly.analysis(topic(spark, sentences)))).first()
        assert [got.current_situation, got.background, got.outlook, got.implications] == analysis_model(named)
        own, close = [e for e in named if e[2] == 1], ("outlook", "implication")
        lead = [e for e in own if e[1] in ("lead", "fact", "background")] or named[:1]
        assert got.visual_lead == " ".join(e[0] for e in lead)
        body = [e for e in own if e not in lead and e[1] not in close]
        assert got.visual_plain == " ".join(e[0] for e in body)
        figures = [e for e in own if e[1] in ("statistic", "lead") and e[3]] or [e for e in own if e[1] in ("lead", "fact")] or named[:1]
        rest = [e for e in own if e not in figures and e[1] not in close]
        assert got.data_lead == " ".join(e[0] for e in figures) and got.data_plain == " ".join(e[0] for e in [*(e for e in rest if e[3]), *(e for e in rest if not e[3])])
        assert got.data_closing == " ".join(e[0] for e in own if e[1] in close and e not in figures and e not in rest)
    t = topic(spark, [("fact", 2, False), ("fact", 1, False), ("fact", 2, False)])
    names = lambda c: [e.sentence for e in t.select(c.alias("v")).first()["v"]]
    p = F.col("primary_id")
    assert names(assembly.preferred(F.col("s"), p, 2)) == ["s1"] and names(assembly.preferred(F.col("s"), p, 2, False)) == ["s1", "s0"] and names(assembly.preferred(F.col("s"), F.lit(None).cast("long"), 2)) == ["s0", "s1"]
    images = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i.cast("string"))
    assert [len(one(spark, assembly.images_of_type(images, F.lit(k)))) for k in ("standard", "visual", "data", "other")] == [5, 8, 3, 5]
    rows = frame(spark, [(7, "s0 is copied here."), (7, "short"), (7, "this one is not")], "topic long, sentence string")
    out = assembly.copied(rows, frame(spark, [(7, "x s0 is copied here. y")], "topic long, text string"), "topic").first()
    assert (out.sentences, out.copied) == (2, 1)


def test_fact_articles(spark):
    from newsloom.operators.facts import article_of

    schema = "id int, entities array<string>, numbers array<struct<number:string,kind:string>>, dates array<string>, actions array<string>, main_topic string"
    cases = [
        (0, ["삼성전자", "LG"], [("1000조원", "금액"), ("3.5%", "비율")], ["오늘"], ["돌파"], "반도체"), (1, ["테슬라"], [("3.5%", "비율")], [], ["상승"], "주식"), (2, ["애플"], [], [], ["발표"], "애플 소식"),
        (3, ["구글"], [("5명", "수량")], [], [], "AI"), (4, ["메타"], [], [], [], "x"), (5, [], [("1%", "비율")], [], [], "경제"),
    ]
    got = {x.id: x for x in article_of(frame(spark, cases, schema)).collect()}
    assert got[0].title == "삼성전자, 1000조원 돌파" and got[0].lead == "오늘 삼성전자가 1000조원의 돌파했다." and got[0].body.startswith("1000조원 규모를 기록했다. 3.5% 개선되었다. 삼성전자는 반도체 분야에서")
    assert "삼성전자, LG 등 주요 기업들이" in got[0].body
    assert got[1].title == "테슬라, 주가 3.5% 상승" and got[1].lead == "테슬라의 실적이 3.5% 상승했다." and got[1].body.endswith("전망하고 있다.") and "상승에서 3.5%의 성장률을 보였다." in got[1].body
    assert got[2].title == "애플, 발표 소식" and got[2].lead == "애플가 발표를 진행했다." and "애플는 최근 발표 등의 성과를" in got[2].body
    assert got[3].title == "구글, 5명 기록" and got[3].body.startswith("이번 실적에서 5명를 달성했다.") and got[4].title == "메타 최신 동향"
    assert got[5].title == "경제 업계 동향" and got[5].body == "이번 실적에서 1%의 성장률을 보였다. 경제 시장이 주목받고 있다. 관련 업계의 향후 움직임이 주목된다."


def test_recommended_formats(spark):
    from newsloom.operators import formats

    rows = [(0, "속보: 급등", "짧다", "경제"), (1, "guide", "x" * 900 + ". 5%", None), (2, "t", "보통 길이의 문장이다. " * 30, "정치")]
    f = formats.features(frame(spark, rows, "id long, title string, body string, category string"))
    got = {}
    for x in formats.recommend(f).orderBy("id", "place").collect():
        got.setdefault(x.id, []).append((x.format, x.score))
    assert got[0][0][0] == "brief" and dict(got[0])["brief"] == 0.9 and got[1][0] == ("feature", 0.8) and dict(got[1])["explainer"] == 0.7
    assert dict(got[2])["straight"] >= 0.8
    why = {(x.id, x.format): x for x in formats.reasons(formats.recommend(f), f).collect()}
    assert why[0, "brief"].reason == "속보, 단신에 적합, 속보성 뉴스" and why[1, "feature"].reason == "기획 시리즈에 적합, 충분한 콘텐츠 깊이" and why[0, "brief"].required == ["single_paragraph"]


def test_source_maps(spark):
    from newsloom.operators import registry, scoring

    urls = ["https://www.yna.co.kr/a", "http://hankyung.com", "https://new.example.com/x", "", None, "nothing"]
    df = frame(spark, [(i, u) for i, u in enumerate(urls)], "i int, url string").withColumn("name", registry.outlet(F.col("url")))
    got = df.select("i", "name", registry.inferred_tier(F.col("name")).alias("a"), registry.known_tier(F.col("name")).alias("b")).orderBy("i").collect()
    assert [tuple(x)[1:] for x in got] == [("연합뉴스", "tier1", "tier1"), ("한국경제", "tier2", "tier2"), ("new.example.com", "tier3", "tier2"), ("네이버 뉴스", "tier3", "tier2"), ("네이버 뉴스", "tier3", "tier2"), ("Unknown", "tier3", "tier2")]
    news = frame(spark, [(1, "a", "tier3", "t", "b"), (2, "z", "tier2", "t", "b")], "id long, source_id string, source_tier string, title string, body string")
    known = frame(spark, [("a", "tier1", 77.0)], "source_id string, tier string, credibility_base_score double")
    assert {x.id: (x.source_tier, x.credibility_base_score) for x in registry.with_source(news, known).collect()} == {1: ("tier1", 77.0), 2: ("tier2", None)}
    assert {x.id: x.trust for x in scoring.with_quality(news, registry=known).collect()} == {1: 0.77, 2: 0.65}


def test_longest_failures_like_a_scan(spark):
    from newsloom.operators.registry import longest_failures

    r, rows = random.Random(7), []
    for s in range(12):
        for k in range(r.randrange(1, 60)):
            rows.append((s, dt.datetime(2026, 1, 1) + dt.timedelta(hours=r.randrange(24 * 9)), r.random() < (s % 4) / 4, k))
    want = {}
    for s in {x[0] for x in rows}:
        best = now = 0
        for *_, ok, _ in sorted((x for x in rows if x[0] == s), key=lambda x: (x[1], x[3])):
            now = 0 if ok else now + 1
            best = max(best, now)
        if best:
            want[s] = best
    got = longest_failures(frame(spark, rows, "source_id int, ts timestamp, ok boolean, ord int").repartition(4))
    assert {x.source_id: x.longest for x in got.collect()} == want


def test_ranking_of_a_hot_query_like_a_plain_sort(spark):
    from newsloom.operators.ranking import ranked

    r = random.Random(3)
    cols = "query_id int, id long, ord long, source_id string, source_name string, final_score double, published_at timestamp, preset string, limit int, offset int, group_by string, diversity boolean"
    data = []
    for i in range(600):
        q = 1 if i % 3 else r.choice([2, 3])
        data.append((q, i, i, r.choice("aaaab"), "n", float(r.randrange(40)), dt.datetime(2026, 1, 1 + i % 4), ["quality", "latest", "popular"][q - 1], [7, 5, 4][q - 1], [2, 0, 1][q - 1], [None, "source", "day"][q - 1], q != 2))
    want = set()
    for q in (1, 2, 3):
        mine = [x for x in data if x[0] == q]
        mine.sort(key=lambda x: (-x[6].timestamp() if x[7] == "latest" else -x[5], x[2]))
        kept, seen = [], {}
        for x in mine:
            seen[x[3]] = seen.get(x[3], 0) + 1
            if not x[11] or seen[x[3]] <= 3:
                kept.append(x)
        groups = {}
        for x in kept:
            key = x[3] if x[10] == "source" else x[6].strftime("%Y-%m-%d") if x[10] == "day" else ""
            groups.setdefault(key, []).append(x)
        want |= {(q, k, n, x[1]) for k, g in groups.items() for n, x in enumerate(g, 1) if x[9] < n <= x[9] + x[8]}
    assert {(x.query_id, x.group_key, x.rank_position, x.id) for x in ranked(frame(spark, data, cols)).collect()} == want


def test_widened_queries(spark):
    from newsloom.operators.querylog import widened

    day = lambda d: dt.datetime(2026, 2, d, 8)
    news = frame(spark, [(i, i, t, "", day(d)) for i, (t, d) in enumerate([("chip plan", 5), ("chip", 5), ("plan", 5), ("car", 7), ("car", 9), ("Chip PLAN", 6)])], "id long, ord long, title string, body string, published_at timestamp")
    q = frame(spark, [(1, ["chip", "plan"], dt.date(2026, 2, 5)), (2, ["car"], dt.date(2026, 2, 5)), (3, ["none"], dt.date(2026, 2, 5))], "query_id int, keywords array<string>, date date")
    got = sorted((x.query_id, x.id, x.step) for x in widened(q, news).collect())
    assert got == [(1, 0, 1), (1, 1, 3), (1, 2, 3), (2, 3, 2)]


def test_reports_and_runs(spark):
    from newsloom.operators import qa

    runs = frame(spark, [("a", True, False, 90.0, ["x"]), ("a", False, True, 40.0, ["x", "y"]), ("b", True, False, 80.0, [])], "preset string, passed boolean, error boolean, score double, issues array<string>")
    got = {(x.preset, x["all"]): x for x in qa.batch_report(runs, "preset").collect()}
    assert got["a", 0].pass_rate == 50.0 and got["a", 0].issues == "x:2,y:1" and got["b", 0].issues == "" and got[None, 1].total == 3 and got[None, 1].errors == 1 and got[None, 1].issues == "x:2,y:1"
    rows = qa.run_rows(frame(spark, [(1,), (2,), (3,)], "query_id int"), frame(spark, [(1, 5), (1, 6), (2, 7)], "query_id int, id int"), frame(spark, [(1, 500, ["E"])], "query_id int, chars int, issues array<string>"))
    assert {x.query_id: (x.search_count, x.chars, x.success, x.issues) for x in rows.collect()} == {1: (2, 500, True, ["E"]), 2: (1, 0, False, ["GENERATION_FAILED"]), 3: (0, 0, False, ["NO_SEARCH_RESULTS"])}
    counts = {(x.kind, x["all"]): (x.n, x["values"]) for x in qa.image_counts(frame(spark, [("a", 1), ("a", 3), ("b", 1)], "kind string, images int"), "kind").collect()}
    assert counts == {("a", 0): (2, "1:1,3:1"), ("b", 0): (1, "1:1"), (None, 1): (3, "1:2,3:1")}


def test_raw_records_and_page_images(spark):
    from newsloom.operators import images
    from newsloom.sources import feeds

    raw = frame(spark, [(1, '{"text": "' + "t" * 250 + '", "creator": "c", "tags": "a, ,b", "published": "junk"}'), (2, '{"title": "<b>T</b>", "summary": "s", "content": "c", "author": "x"}'), (3, '{"title": "[LIVE] now"}'), (4, None)], "id int, json string")
    got = {x.id: x for x in feeds.normalized(raw, F.lit("2026-02-05").cast("timestamp")).collect()}
    assert set(got) == {1, 2, 4} and got[1].title == "t" * 200 and got[1].author == "c" and got[1].tags == ["a", "b"] and got[1].published_at == dt.datetime(2026, 2, 5)
    assert (got[2].title, got[2].body, got[2].author) == ("T", "s", "x") and got[4].body == ""
    news = frame(spark, [(1, "short"), (2, "x" * 200), (3, "longer than its page")], "id int, body string")
    pages = frame(spark, [(1, "a longer text"), (1, "mid text"), (2, "y" * 300), (3, "p")], "id int, full string")
    assert {x.id: x.body for x in feeds.enriched(news, pages, "id").collect()} == {1: "a longer text", 2: "x" * 200, 3: "longer than its page"}
    urls = {"https://img.a.com/p.jpg": True, "https://a.com/logo.png": False, "https://cdn.a.com/x?y=1": True, "ftp://img/x.jpg": False, "https://a.com/a_100x90.jpg": False, "https://a.com/p.gif": False, "https://a.com/page": False, None: False}
    df = frame(spark, [(u,) for u in urls], "url string")
    assert {x.url: x.fits for x in df.select("url", images.fits_page(F.col("url")).alias("fits")).collect()} == urls


def test_fallback_cards(spark):
    from newsloom.operators import assembly

    body = "짧다. " + "가" * 21 + "! 둘째 문장은 이십 자를 넘는 긴 문장이라고 한다? " + "라" * 200 + ". " + "마" * 30 + ". " + "바" * 30
    df = frame(spark, [("제" * 40, body), ("t", ""), ("t", "x" * 21)], "title string, body string").select(assembly.fallback_cards(F.col("title"), F.col("body")).alias("c"))
    got = [[(c.title, c.body) for c in x.c] for x in df.collect()]
    assert got[0] == [("제" * 30, "제" * 40), ("Point 1", "가" * 21), ("Point 2", "둘째 문장은 이십 자를 넘는 긴 문장이라고 한다"), ("Point 3", "라" * 150), ("Point 4", "마" * 30)]
    assert got[1:] == [[("t", "t")], [("t", "t"), ("Point 1", "x" * 21)]]


def test_intermediate_tables_are_swept(spark):
    import os

    from newsloom import storage

    start = storage.mark()
    a = storage.materialized(spark.range(5), "a")
    paths = [storage._own.paths[-1].removeprefix("file://")]
    out = storage.settled(a.where("id > 2"), "b", start)
    assert out.count() == 2 and not os.path.exists(paths[0]) and storage.mark() == start + 1
    assert storage.sweep(spark, start) == 1 and storage.mark() == start


def test_a_job_that_settles_leaves_those_on_other_threads_alone(spark):
    import threading

    from newsloom import storage

    half, go, got = threading.Event(), threading.Event(), []

    def slow():
        start = storage.mark()
        a = storage.materialized(spark.range(7), "slow")
        half.set()
        go.wait(60)
        got.append(storage.settled(a.where("id > 3"), "slow-out", start).count())

    t = threading.Thread(target=slow)
    t.start()
    half.wait(60)
    start = storage.mark()  # a whole job between the other's two writes
    b = storage.materialized(spark.range(5), "fast")
    assert storage.settled(b, "fast-out", start).count() == 5
    go.set()
    t.join(60)
    assert got == [3]
    assert storage.sweep(spark, start) == 1 and storage.sweep(spark) >= 1


def test_a_shared_folder_is_needed_on_a_cluster():
    import pytest

    from newsloom.storage import shared_dir

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, other: other)

    with pytest.raises(RuntimeError):
        shared_dir(Session())
