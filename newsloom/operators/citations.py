"""Citations: quotes of generated texts found in their sources, markers, lists and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as x

QUOTES = r"[\"“]([^\"”]{5,})[\"”]"


def quotes(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(QUOTES), F.lit(1)))


def quote_matches(generated: DataFrame, sources: DataFrame, topic: str, least: float = 0.7) -> DataFrame:
    """(topic, quote, id): quotes of generated(topic, quotes) that equal a quote of sources(topic, id, quotes) or hold that share of its words; case does not count.

    The topic is the key of the join, so each quote and sentence is written once, with the number and a sketch of its words: a bit that only the sentence
    has is a word that the quote lacks. Only what passes numbers and sketches is cut in words again and intersected, inside the join."""
    low = lambda c: F.trim(F.lower(c))
    words = lambda c: F.array_distinct(x.words(c))
    bits = lambda c: F.struct(F.size(c).alias("n"), *(b.alias(f"s{k}") for k, b in enumerate(x.sketch(c, 2))))
    made = generated.select(topic, F.explode(F.array_distinct("quotes")).alias("quote")).withColumn("said", low(F.col("quote")))
    said = sources.select(topic, "id", F.explode(F.array_distinct(F.transform("quotes", low))).alias("said"))
    a, b = (df.withColumn("of", x.let(words(F.col("said")), bits)).alias(name) for df, name in ((made, "a"), (said, "b")))
    n, lacks = F.col("b.of.n"), F.lit(0)
    for k in range(2):
        lacks = lacks + F.bit_count(F.col(f"b.of.s{k}").bitwiseAND(F.bitwise_not(F.col(f"a.of.s{k}"))))
    holds = (n > 0) & (F.least(F.col("a.of.n"), n - lacks) / n >= least) & (F.size(F.array_intersect(words(F.col("a.said")), words(F.col("b.said")))) / n >= least)
    return a.join(b, (F.col(f"a.{topic}") == F.col(f"b.{topic}")) & ((F.col("a.said") == F.col("b.said")) | holds)).select(f"a.{topic}", "a.quote", "b.id").distinct()


def citations(matches: DataFrame, sources: DataFrame, topic: str) -> DataFrame:
    """(topic, id, type, cited): matched quotes, and one fact row for each source."""
    direct = matches.select(topic, "id", F.lit("direct_quote").alias("type"), F.col("quote").alias("cited"))
    return direct.union(sources.select(topic, "id", F.lit("fact"), F.substring("title", 1, 100)))


def summary(cited: DataFrame, topic: str) -> DataFrame:
    return cited.groupBy(topic).agg(F.count_if(F.col("type") == "direct_quote").alias("quotes"), F.count_if(F.col("type") == "fact").alias("facts"), F.count("*").alias("total"), F.countDistinct("id").alias("sources"))


def marked(text: Column, cited: Column, style: str = "inline") -> Column:
    """Each cited quote gets a marker behind its first occurrence: its source, or its number with a list at the end."""

    numbered = F.transform(cited, lambda c, i: F.struct(c.cited.alias("cited"), c.source.alias("source"), (i + 1).cast("string").alias("n")))
    tag = lambda c: F.concat(F.lit(" ("), c.source, F.lit(")")) if style == "inline" else F.concat(F.lit("["), c.n, F.lit("]"))

    def step(a: Column, c: Column) -> Column:
        head = F.substring(a, F.lit(1), F.position(c.cited, a) - 1)
        return F.when(a.contains(c.cited) & (F.length(c.cited) > 0), F.concat(head, c.cited, tag(c), F.substring(a, F.length(head) + F.length(c.cited) + 1, F.length(a)))).otherwise(a)

    out = F.aggregate(numbered, text, step)
    if style == "inline":
        return out
    return F.concat(out, F.lit("\n\n"), F.array_join(F.transform(numbered, lambda c: F.concat(F.lit("["), c.n, F.lit("] "), c.source)), "\n"))


def source_list(cited: DataFrame, topic: str) -> DataFrame:
    """Distinct source names of each topic in order of first use."""
    first = cited.groupBy(topic, "source_name").agg(F.min("ord").alias("ord"))
    return first.groupBy(topic).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "source_name"))), lambda s: s.source_name), ", ").alias("sources"))


def missing_quotes(text: Column, cited: Column) -> Column:
    """Cited quotes that the text does not hold."""
    return F.filter(cited, lambda c: ~text.contains(c))
