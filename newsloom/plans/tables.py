"""The driver's tables as articles, sources, queries and logs; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules.news import LATIN

AS_OF = "2024-01-31 00:00:00"
LATER = "2024-03-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores, as one Parquet row group is one task; larger inputs are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def tier_of(source: Column) -> Column:
    n = F.pmod(F.regexp_extract(source, r"(\d+)", 1).cast("int"), F.lit(4))
    return F.when(n == 0, "whitelist").when(n == 1, "tier1").when(n == 2, "tier2").when(n == 3, "tier3")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as news, without time and engagement."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    body = F.coalesce("text", F.lit(""))
    title = F.substring_index(body, "\n", 1)
    return d.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), title.alias("title"), body.alias("body"), F.col("source").alias("source_id"),
        F.col("source").alias("source_name"), tier_of(F.col("source")).alias("source_tier"), F.col("lang").alias("language"),
        x.infer_category(F.lit(""), title, LATIN.categories).alias("category"), F.slice(x.words(title), 1, 2).alias("tags"),
    )


def times(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """(id, published_at) of articles: event doc_id * step gives the time; and the number of documents."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    n = d.agg(F.count("*").alias("n")).first()["n"]
    step = max(1, e.count() // max(1, n))
    return e.where(F.col("event_id") % step == 0).select((F.col("event_id") / step).cast("long").alias("id"), F.col("ts").cast("timestamp").alias("published_at")), n


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """articles with published_at from `times` and engagement from events: events with id = doc_id modulo documents give the counts."""
    e, (at, n) = table(spark, sf_dir, "events"), times(spark, sf_dir)
    counts = e.groupBy((F.col("event_id") % max(1, n)).alias("id")).agg(
        F.count_if(F.col("event_type") == "view").alias("view_count"), F.count_if(F.col("event_type") == "click").alias("share_count"),
        F.count_if(F.col("event_type") == "signup").alias("comment_count"),
    )
    return articles(spark, sf_dir).join(at, "id", "left").join(counts, "id", "left")


QUERY_ROWS = [
    (1, "quality", 20, 0, ["the", "thing"], ["casino"], None, True, None, None),
    (2, "latest", 10, 5, ["que"], [], None, True, "2024-01-05 00:00:00", "2024-01-25 00:00:00"),
    (3, "trending", 15, 0, [], ["worthless", "idiot"], "source", False, None, None),
    (4, "popular", 3, 0, ["eau", "der"], [], "day", True, "2024-01-10 00:00:00", None),
]


def query_table(spark: SparkSession) -> DataFrame:
    schema = "query_id int, preset string, limit int, offset int, keywords array<string>, exclude_keywords array<string>, group_by string, diversity boolean, date_from string, date_to string"
    q = spark.createDataFrame(QUERY_ROWS, schema)
    return q.withColumn("date_from", F.col("date_from").cast("timestamp")).withColumn("date_to", F.col("date_to").cast("timestamp"))


def sql_text(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(sql_text, value)) + "]"
    return str(value).lower() if isinstance(value, bool) else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def any_of(text: str, words: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, {sql_text(w)})" for w in words) + ")"


def count_of(text: str, words: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"cast(contains({text}, {sql_text(w)}) as int)" for w in words) + ")"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '\\s+'), lambda w: w <> '')"


def category_sql(text: str) -> str:
    return "case " + " ".join(f"when {any_of(text, keys)} then {sql_text(name)}" for name, keys in LATIN.categories.items()) + " end"


_TITLE = "split_part(coalesce(text, ''), chr(10), 1)"
ARTICLES = f"""articles as (select doc_id as id, doc_id as ord, {_TITLE} as title, coalesce(text, '') as body, source as source_id, source as source_name,
  case cast(regexp_extract(source, '(\\d+)', 1) as int) % 4 when 0 then 'whitelist' when 1 then 'tier1' when 2 then 'tier2' when 3 then 'tier3' end as source_tier,
  lang as language, {category_sql("lower(' ' || " + _TITLE + ")")} as category, {words_sql(_TITLE)}[1:2] as tags from documents)"""
NEWS = f"""{ARTICLES},
size_ as (select count(*) as n, greatest((select count(*) from events) // count(*), 1) as step from documents),
times as (select event_id // step as id, ts as published_at from events, size_ where event_id % step = 0),
counts as (select event_id % n as id, count(*) filter (event_type = 'view') as view_count, count(*) filter (event_type = 'click') as share_count,
  count(*) filter (event_type = 'signup') as comment_count from events, size_ group by 1),
news as (select a.*, published_at, view_count, share_count, comment_count from articles a left join times using (id) left join counts using (id))"""
QUERIES = "queries(query_id, preset, lim, off, keywords, exclude_keywords, group_by, diversity, date_from, date_to) as (values " + ", ".join(
    "(" + ", ".join([*map(sql_text, r[:4]), f"cast({sql_text(r[4])} as varchar[])", f"cast({sql_text(r[5])} as varchar[])", sql_text(r[6]), sql_text(r[7]), *(f"cast({sql_text(d)} as timestamp)" for d in r[8:])]) + ")" for r in QUERY_ROWS
) + ")"
