"""Steps whose cost must not grow faster than their input."""

from __future__ import annotations

import datetime as dt
import re


def test_sentences_do_not_carry_the_title(spark):
    """A text without lines is its own title: beside the generator it would be searched and copied for each of its sentences."""
    from newsloom.operators import sentences
    from newsloom.rules.news import LATIN

    body = " ".join(f"This is sentence number {k} of a long line." for k in range(50))
    news = spark.createDataFrame([(1, body, body), (2, "[사설] Title", "One sentence that is long enough.")], "id long, title string, body string")
    out = sentences.extract(news, ["the"], LATIN, False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    carried = re.search(r"Generate posexplode.*\[([^\[\]]*)\], false, \[position", plan, re.S)[1]
    assert "id#" in carried and "title#" not in carried
    got = out.select("id", "opinion", "total").distinct().collect()
    assert {tuple(x) for x in got} == {(1, False, 50), (2, True, 1)}


def test_rules_of_sentences_with_plain_searches_first(spark):
    """The searches that come first let through what the patterns match."""
    from pyspark.sql import functions as F

    from newsloom.functions import text as x
    from newsloom.operators import sentences

    texts = ["값이 5% 올랐다.", "5 % up", "12억", "기자 = 홍길동 기자 보도", "YTN 뉴스 KBS.", "그는 \"말", "(a", "a) (", "보기 때문...", "Tel: 02-1", "전화: 02-1", "ends in ed.!", "ends in ed\r.", "ends in ed.\r", "the end"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    s = F.col("s")
    got = df.select("s", x.has_number(s).alias("n"), sentences.is_boilerplate(s, False).alias("b"), sentences.is_unfinished(s).alias("u"), sentences.role_of(s, sentences.rules.LATIN).alias("r")).collect()
    by = {g.s: g for g in got}
    assert {t for t in texts if by[t].n} == {"값이 5% 올랐다.", "12억"}
    assert {t for t in texts if by[t].b} == {"기자 = 홍길동 기자 보도", "YTN 뉴스 KBS.", "Tel: 02-1", "전화: 02-1"}
    assert {t for t in texts if by[t].u} == {"그는 \"말", "(a", "보기 때문..."}
    assert {t: by[t].r for t in texts if by[t].r not in ("fact", "quote")} == {"값이 5% 올랐다.": "statistic", "12억": "statistic", "ends in ed.!": "lead", "ends in ed\r.": "lead", "ends in ed.\r": "lead", "the end": "background"}


def _documents(spark, path):
    rows = [(i, f"Title {i}\nThe first sentence of article {i} is here. Another sentence number {i % 3} follows it.", "en", f"src{i % 4}") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_title_articles_score_texts_once(spark, tmp_path, monkeypatch):
    from newsloom.plans import stage3, stage5

    calls, scored = [], stage3.scoring.with_quality
    monkeypatch.setattr(stage3.scoring, "with_quality", lambda *a, **b: calls.append(1) or scored(*a, **b))
    assert stage5.j11_title_articles(spark, _documents(spark, tmp_path)).count() == 2
    assert len(calls) == 1


def test_merged_bodies_cut_sentences_once(spark, tmp_path, monkeypatch):
    from newsloom.operators import sentences
    from newsloom.plans import stage3

    names, write = [], sentences.materialized
    monkeypatch.setattr(sentences, "materialized", lambda df, name: names.append(name) or write(df, name))
    got = stage3.d06_merged_bodies(spark, _documents(spark, tmp_path)).collect()
    assert sorted(x.leader for x in got) == [0, 5] and "group-sentences" in names


def test_tokens_of_other_groups_meet_nothing(spark):
    from newsloom.operators.similarity import numbered, similarity_edges

    items = spark.createDataFrame([("g", 1, ["a", "b", "c"]), ("g", 2, ["a", "b", "d"]), ("h", 3, ["a", "b", "c"]), ("h", 4, ["e", "f"])], "grp string, id long, tokens array<string>")
    assert {(x.grp, x.id, x.n, len(x.tokens)) for x in numbered(items, 1).collect()} == {("g", 1, 3, 2), ("g", 2, 3, 2)}
    assert [(x.grp, x.a, x.b, x.both, x.either) for x in similarity_edges(items, 1, 2).collect()] == [("g", 1, 2, 2, 4)]


def test_widened_by_times(spark, monkeypatch):
    from newsloom.operators import querylog

    day = lambda d: dt.datetime(2026, 2, d, 8)
    titles = [("chip plan", 5), ("chip", 5), ("plan", 5), ("car", 7), ("car", 9), ("Chip PLAN", 6), ("car", None)]
    news = spark.createDataFrame([(i, i, t, "") for i, (t, _) in enumerate(titles)], "id long, ord long, title string, body string")
    times = spark.createDataFrame([(i, day(d)) for i, (_, d) in enumerate(titles) if d], "id long, published_at timestamp")
    q = spark.createDataFrame([(1, ["chip", "Plan"], dt.date(2026, 2, 5)), (2, ["car"], dt.date(2026, 2, 5)), (3, ["none"], dt.date(2026, 2, 5))], "query_id int, keywords array<string>, date date")
    want = [(1, 0, 1), (1, 1, 3), (1, 2, 3), (2, 3, 2)]
    for most in (querylog.MARKED, 1):
        monkeypatch.setattr(querylog, "MARKED", most)
        assert sorted((x.query_id, x.id, x.step) for x in querylog.widened(q, news, times=times).collect()) == want


def test_malformed_feeds_are_looked_for_once(spark, tmp_path, monkeypatch):
    from newsloom.plans import stage7

    rows = [(i, f"http://n/{i}", f"<html><title>t{i}</title><body>x</body></html>") for i in range(100)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    calls, found = [], stage7.feeds.malformed
    monkeypatch.setattr(stage7.feeds, "malformed", lambda *a: calls.append(1) or found(*a))
    out = stage7.s01_landed_feeds(spark, str(tmp_path)).collect()
    assert len(calls) == 2
    assert {x.status for x in out} == {"record", "search", "malformed"} and [(x.feed, x.elements) for x in out if x.status == "malformed"] == [(3, 20)]
