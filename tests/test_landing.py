"""Landed feeds, responses, reports and groups: what is malformed is kept apart and counted, what is unfinished is not read."""

import json
import os
import shutil

import pytest


def write(path, **files):
    os.makedirs(path, exist_ok=True)
    for name, text in files.items():
        with open(f"{path}/{name}.xml", "w", encoding="utf-8") as f:
            f.write(text)


ITEM = "<item><title>{0}</title><link>http://n/{0}</link></item>"
RSS = '<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>c</title>{}</channel></rss>'


def test_documents_count_as_a_whole(spark, tmp_path):
    from newsloom.sources import feeds

    path = str(tmp_path / "f")
    write(
        path, good=RSS.format(ITEM.format("g1") + ITEM.format("g2")), unclosed=RSS.format(ITEM.format("u1") + "<item><title>u2<link>x</link></item>" + ITEM.format("u3")), entity=RSS.format(ITEM.format("e&nbsp;1")),
        cut=RSS.format(ITEM.format("c1") + ITEM.format("c2"))[:-40], garbage="no feed", empty="", none=RSS.format(""), page="<html><body><p>x</body></html>",
        atom='<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="html">a &lt;b&gt;</title><link rel="alternate" href="http://first"/><link href="http://second"/><content type="html"> text\n</content><updated>2024-01-01T00:00:00Z</updated><author><name> N </name></author></entry><entry><title>bare</title><link/></entry></feed>',
        cut_atom='<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>x</title></entry><entry><ti',
        both='<feed><item><title>only this</title></item><entry><title>not this</title></entry></feed>',
    )
    got = {(x.feed.rsplit("/")[-1][:-4], x.title, x.url, x.description, x.published, x.author) for x in feeds.read_feeds(spark, path).collect()}
    assert got == {
        ("good", "g1", "http://n/g1", None, None, None), ("good", "g2", "http://n/g2", None, None, None), ("atom", "a <b>", "http://first", "text", "2024-01-01T00:00:00Z", "N"),
        ("atom", "bare", None, None, None, None), ("both", "only this", None, None, None, None),
    }
    lost = {x.feed.rsplit("/")[-1][:-4]: (x.elements, bool(x.corrupt)) for x in feeds.malformed(spark, path).collect()}
    assert lost == {"unclosed": (3, True), "entity": (1, True), "cut": (2, True), "garbage": (0, True), "page": (0, True), "cut_atom": (2, True)}


def test_search_results_and_creators(spark, tmp_path):
    from newsloom.sources import feeds

    path = str(tmp_path / "s")
    write(path, s=RSS.format('<item><title>a</title><author></author><dc:creator>Jo</dc:creator><source url="http://s">Paper</source></item><item><title>b</title><description><![CDATA[<p>x</p>]]></description></item>'))
    got = {x.title: (x.source_name, x.author, x.description) for x in feeds.read_search_rss(spark, path).collect()}
    assert got == {"a": ("Paper", "Jo", None), "b": ("Unknown", None, "<p>x</p>")}
    assert {x.source_name for x in feeds.read_rss(spark, path).collect()} == {"Paper", None}


def test_responses_that_are_no_json(spark, tmp_path):
    from newsloom.sources import feeds

    path = tmp_path / "j"
    path.mkdir()
    good = json.dumps({"items": [{"title": f"t{i}", "link": f"http://l/{i}"} for i in range(4)]})
    (path / "a.json").write_text("\n".join([good, good[:-3], json.dumps({"articles": [{"title": "x", "url": "http://u"}]}), json.dumps({"items": []}), json.dumps({"other": 1})]))
    got = feeds.read_api(spark, str(path), 2, lines=True).collect()
    assert sorted(x.url for x in got) == ["http://l/0", "http://l/1", "http://u"]
    assert [x.corrupt for x in feeds.malformed_api(spark, str(path), lines=True).collect()] == [good[:-3]]


def test_a_run_counts_once_its_entry_stands(spark, tmp_path):
    from pyspark.sql import functions as F

    from newsloom.sources import landing

    root = str(tmp_path / "l")
    a = spark.range(10).select("id", F.array(F.struct((F.col("id") * 0.1).alias("v"), F.lit(None).cast("string").alias("none"))).alias("nested"), F.lit("é\n\"x\"").alias("text"), F.current_timestamp().alias("at"))
    a = a.cache()
    first = landing.publish(a.where("id < 6"), root)
    second = landing.publish(a.where("id >= 6").repartition(3), root)
    a.where("id < 3").write.json(f"{root}/runs/unfinished")
    whole = landing.read_published(spark, root)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, a.collect())) and whole.schema.simpleString() == a.schema.simpleString()
    assert landing.read_published(spark, root, first).count() == 6
    assert {x.run: (x.rows, x.found) for x in landing.verify(spark, root).collect()} == {first: (6, 6), second: (4, 4)}
    shutil.rmtree(f"{root}/runs/{second}")
    os.makedirs(f"{root}/runs/{second}")
    assert {x.run: (x.rows, x.found) for x in landing.verify(spark, root).collect()} == {first: (6, 6), second: (4, 0)}
    empty = landing.publish(a.where("false"), str(tmp_path / "e"))
    assert landing.read_published(spark, str(tmp_path / "e"), empty).count() == 0
    landing.publish(a.select("id"), root)
    with pytest.raises(ValueError):
        landing.read_published(spark, root)


def test_reports_and_groups_come_back(spark, tmp_path):
    from newsloom.sources import feeds, landing

    runs = spark.createDataFrame([("r", 2, True, 80.0, ["A"]), ("r", 1, False, 0.0, []), ("q", 3, False, 0.0, None)], "report string, test_id int, success boolean, score double, issues array<string>")
    landing.publish(feeds.report_documents(runs, "report"), str(tmp_path / "r"))
    got = sorted(map(tuple, feeds.report_rows(landing.read_published(spark, str(tmp_path / "r")), "report").collect()))
    assert got == [("q", 1, 0, None, 3, False, 0.0, None), ("r", 2, 1, 80.0, 1, False, 0.0, []), ("r", 2, 1, 80.0, 2, True, 80.0, ["A"])]
    news = spark.createDataFrame([(i, f"t{i}", None if i == 4 else "s") for i in range(40)], "id long, title string, source_name string")
    groups = spark.createDataFrame([(0, i) for i in range(30)] + [(31, 31), (31, 35)], "leader long, id long")
    nested = feeds.nested_groups(groups, news, 4)
    parts = nested.collect()
    assert len([p for p in parts if p.leader == 0]) > 3 and max(len(p.members) for p in parts) < 12 and {p.representative.id for p in parts} == {0, 31}
    landing.publish(nested, str(tmp_path / "g"))
    rows = feeds.group_rows(landing.read_published(spark, str(tmp_path / "g"))).collect()
    assert sorted((x.leader, x.id, x.title, x.source_name) for x in rows) == [(0 if i < 30 else 31, i, f"t{i}", None if i == 4 else "s") for i in [*range(30), 31, 35]]
    assert {(x.leader, x.size) for x in rows} == {(0, 30), (31, 2)}
