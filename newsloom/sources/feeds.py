"""Landed feeds, pages and reports as tables, and result tables as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..storage import small

RSS = "title string, link string, description string, pubDate string, author string, `dc:creator` string, guid string, source string"
ATOM = "title string, link array<struct<_href:string>>, summary string, content string, published string, updated string, author struct<name:string>"
API_ITEM = "array<struct<title:string,originallink:string,link:string,url:string,description:string,summary:string,pubDate:string,published:string>>"
#: Records have these columns whatever they were read from.
RECORD = ("feed", "title", "url", "description", "published", "author", "source_name")


#: Elements that a feed document has at its root.
ROOTS = ("rss", "feed", "rdf:RDF")
#: Where the XML reader puts what it cannot parse.
CORRUPT = "corrupt"


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """Elements of a tag with the address of their file as `feed`, and a row with the text in `corrupt` where the reader met something malformed."""
    df = spark.read.format("xml").option("rowTag", tag).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).schema(f"{schema}, {CORRUPT} string").load(path)
    return df.withColumn("feed", F.input_file_name())


def _named(df: DataFrame, source: Column, title: Column, url: Column, text: Column, time: Column, author: Column) -> DataFrame:
    cols = (F.col("feed"), title, url, text, time, author, source)
    # the reader refuses to look at corrupt records alone; as no XML text holds a NUL, the title keeps every row
    return df.where(F.col(CORRUPT).isNull() & (F.coalesce(title, F.lit("")) != "\0")).select(*(F.btrim(c, F.lit(" \t\r\n")).alias(n) for c, n in zip(cols, RECORD)))


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """(feed, corrupt, elements): landed files that are no well-formed document, with their text and the number of items and entries in it.

    Kept apart, not dropped unseen: a document counts as a whole, so none of its elements are records."""
    found = None
    for root in ROOTS:
        # a second column, which has no value there, as the reader refuses to look at corrupt records alone
        part = _elements(spark, path, root, "_version string").where(F.col(CORRUPT).isNotNull() & F.col("_version").isNull()).select("feed", CORRUPT)
        found = part if found is None else found.union(part)
    return found.groupBy("feed").agg(F.first(CORRUPT).alias(CORRUPT)).withColumn("elements", F.regexp_count(CORRUPT, F.lit("<(?:item|entry)[ />]")))


def _whole(records: DataFrame, spark: SparkSession, path: str, lost: DataFrame | None) -> DataFrame:
    """records of files that are not among the malformed ones; lost is `malformed` where it is known, as finding it lists and reads all files once for each root."""
    return records.join((malformed(spark, path) if lost is None else lost).select("feed"), "feed", "left_anti")


def _items(spark: SparkSession, path: str) -> DataFrame:
    df = _elements(spark, path, "item", RSS)
    return _named(df, x.filled("source"), F.col("title"), x.filled("link"), F.col("description"), F.col("pubDate"), x.first_filled("author", "dc:creator"))


def read_rss(spark: SparkSession, path: str, lost: DataFrame | None = None) -> DataFrame:
    """`<item>` elements of well-formed RSS files; empty feeds give no rows, malformed ones are in `malformed`."""
    return _whole(_items(spark, path), spark, path, lost)


def read_search_rss(spark: SparkSession, path: str, lost: DataFrame | None = None) -> DataFrame:
    """The same with the name of the outlet, `Unknown` if it is missing."""
    return read_rss(spark, path, lost).withColumn("source_name", F.coalesce("source_name", F.lit("Unknown")))


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """`<entry>` elements of Atom files, with the first of their links."""
    df = _elements(spark, path, "entry", ATOM)
    return _named(df, F.lit(None).cast("string"), F.col("title"), F.get("link", F.lit(0))["_href"], x.first_filled("summary", "content"), x.first_filled("published", "updated"), x.filled("author.name"))


def read_atom(spark: SparkSession, path: str, lost: DataFrame | None = None) -> DataFrame:
    return _whole(_entries(spark, path), spark, path, lost)


def read_feeds(spark: SparkSession, path: str, lost: DataFrame | None = None) -> DataFrame:
    """Records of well-formed files: RSS items, and Atom entries of files without any item."""
    rss = _items(spark, path)
    atom = _entries(spark, path).join(rss.select("feed").distinct(), "feed", "left_anti")
    return _whole(rss.unionByName(atom), spark, path, lost)


def xml_text(c: Column) -> Column:
    """Text as it stands in an XML document: no characters that XML forbids, and `&`, `<`, `>` and quotes as entities."""
    out = F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def xml_element(tag: str, c: Column, attributes: str = "") -> Column:
    """An element with the text of c; nothing where that is null."""
    return F.concat(F.lit(f"<{tag}{attributes}>"), xml_text(c), F.lit(f"</{tag}>"))


def _responses(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    df = spark.read.schema(f"items {API_ITEM}, articles {API_ITEM}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", not lines).json(path)
    return df.withColumn("feed", F.input_file_name())


def read_api(spark: SparkSession, path: str, most: int | None = None, lines: bool = False) -> DataFrame:
    """`items`, else `articles`, of JSON responses, one a file or one a line; original links before links; at most so many of each response."""
    rows = _responses(spark, path, lines).where(F.col(CORRUPT).isNull()).select("feed", F.posexplode(F.coalesce("items", "articles")).alias("place", "i"))
    rows = rows.where(F.col("place") < most) if most is not None else rows
    out = rows.select("feed", "place", "i.*")
    text = x.clean_snippet(x.first_filled("description", "summary"))
    cols = (F.col("feed"), x.clean_snippet(F.col("title")), x.first_filled("originallink", "link", "url"), text, x.first_filled("pubDate", "published"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return out.select(*(c.alias(n) for c, n in zip(cols, RECORD)))


def malformed_api(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(feed, corrupt): responses that are no JSON, which give no records."""
    return _responses(spark, path, lines).where(F.col(CORRUPT).isNotNull() & F.col("items").isNull() & F.col("articles").isNull()).select("feed", CORRUPT)


def first_of_feed(records: DataFrame, most: int, keywords: list[str]) -> DataFrame:
    """The first rows of each feed, and of these the ones with a keyword: the limit comes before the keywords."""
    n = F.row_number().over(Window.partitionBy("feed").orderBy("ord"))
    text = F.lower(F.concat_ws(" ", "title", "description"))
    return records.withColumn("_n", n).where(F.col("_n") <= most).drop("_n").where(F.exists(x.strings(keywords), lambda k: text.contains(F.lower(k))) if keywords else F.lit(True))


def to_news(records: DataFrame, sources: DataFrame | None, fetched: Column) -> DataFrame:
    """Records as articles: cleaned texts, times with the fetch time as fallback, source by name, category, language and country."""
    body = x.clean_html(F.col("description"))
    out = records.select(
        x.record_id(F.col("source_name"), F.col("url")).alias("id"), x.safe_id(F.coalesce("source_name", F.lit("unknown"))).alias("source_id"), "source_name", x.clean_html(F.col("title")).alias("title"), body.alias("body"),
        F.substring(body, 1, 200).alias("summary"), "author", F.coalesce(x.parse_time(F.col("published")), fetched).alias("published_at"), "url",
        x.infer_category(F.lit(""), F.col("title")).alias("category"),
    ).where(~x.is_video(F.col("title")))
    if sources is not None:
        out = out.join(small(sources.select("source_id", "tier")), "source_id", "left").withColumn("source_tier", F.coalesce("tier", F.lit("tier3"))).drop("tier")
    return out


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Rows of nested report files {summary, results[]}."""
    item = "array<struct<test_id:int,keyword:string,success:boolean,score:double,generated_char_count:int,generation_time_ms:long,issues:array<string>,structure:struct<news_type:string>,images:struct<total_count:int,valid_count:int,invalid_count:int>>>"
    return spark.read.schema(f"results {item}").option("multiLine", True).json(path).select(F.explode("results").alias("r")).select("r.*", "r.structure.news_type")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_documents(runs: DataFrame, report: str) -> DataFrame:
    """One row for each report: its name, a summary of its runs, and the runs by test_id; a report holds the runs of one batch."""
    fields = F.struct(*(c for c in runs.columns if c != report))
    summary = F.struct(F.count("*").alias("tests"), F.count_if("success").alias("successes"), F.round(F.avg(F.when(F.col("success"), F.col("score"))), 3).alias("mean_score"))
    return runs.groupBy(report).agg(summary.alias("summary"), F.sort_array(F.collect_list(fields)).alias("results"))


def report_rows(reports: DataFrame, report: str) -> DataFrame:
    """The runs of nested reports, each with the summary of its report."""
    return reports.select(report, "summary", F.explode("results").alias("r")).select(report, "summary.*", "r.*")


#: Members of a group that stand in one row of its JSON.
MEMBERS = 1_000


def nested_groups(groups: DataFrame, news: DataFrame, most: int = MEMBERS) -> DataFrame:
    """(leader, size, part, parts, representative, members): nested rows of groups(leader, id), for JSON output.

    A group of many members is dealt by a hash into parts of about `most`, one row each, so that no group is gathered in one task."""
    sizes = groups.groupBy("leader").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / most).cast("int"))
    item = F.struct("id", "title", "source_name")
    rows = groups.join(sizes, "leader").join(news.select("id", "title", "source_name"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    members = rows.groupBy("leader", "size", "parts", "part").agg(F.sort_array(F.collect_list(F.when(F.col("id") != F.col("leader"), item))).alias("members"))
    return members.join(rows.where("id = leader").select("leader", item.alias("representative")), "leader", "left").select("leader", "size", "part", "parts", "representative", "members")


def group_rows(nested: DataFrame) -> DataFrame:
    """(leader, size, id, title, source_name) of nested groups: the representatives and all members."""
    # the representative stands in every part; the first part that there is gives it
    first = nested.groupBy("leader").agg(F.min("part").alias("first"))
    every = F.concat(F.when(F.col("part") == F.col("first"), F.array("representative")).otherwise(F.array().cast(nested.schema["members"].dataType)), F.col("members"))
    return nested.join(first, "leader").select("leader", "size", F.explode(every).alias("m")).select("leader", "size", "m.*")


RAW = "struct<title:string,text:string,description:string,summary:string,content:string,raw_html:string,author:string,creator:string,tags:string,published:string>"


def normalized(raw: DataFrame, fetched: Column) -> DataFrame:
    """Raw JSON rows(id, json) as articles: the first filled of several fields for title, body and author, tags, the time with the fetch time as fallback; video items are out."""
    r = raw.select("id", F.from_json("json", RAW).alias("r")).select("id", "r.*")
    title = F.coalesce(x.filled("title"), F.substring(F.coalesce("text", F.lit("")), 1, 200))
    body = F.coalesce(x.filled("description"), x.filled("summary"), x.filled("content"), x.filled("raw_html"), "text", F.lit(""))
    out = r.select("id", x.clean_html(title).alias("title"), x.clean_html(body).alias("body"), x.first_filled("author", "creator").alias("author"), x.split_tags(F.col("tags")).alias("tags"), F.coalesce(x.parse_time(F.col("published")), fetched).alias("published_at"))
    return out.where(~x.is_video(F.col("title")))


def enriched(news: DataFrame, pages: DataFrame, key: str, least: int = 150) -> DataFrame:
    """news with the longer of two bodies where its own is shorter than `least`: pages(key, full) are joined to short articles only."""
    short = news.where(F.length("body") < least)
    longer = short.select(key, F.length("body").alias("own")).join(pages.select(key, "full"), key).where(F.length("full") > F.col("own")).groupBy(key).agg(F.max_by("full", F.length("full")).alias("full"))
    return news.join(longer, key, "left").withColumn("body", F.coalesce("full", "body")).drop("full")


def unseen(records: DataFrame, seen: DataFrame) -> DataFrame:
    """Records whose address no row of seen(url) has."""
    known = seen.select(x.url_key(F.col("url")).alias("_known")).where("_known is not null").distinct()
    return records.join(known, x.url_key(F.col("url")) == F.col("_known"), "left_anti")
