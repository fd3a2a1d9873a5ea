"""Format recommendation: features of articles joined with a table of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as x
from ..rules import formats as more
from ..rules import news as rules

STATISTICS = r"\d+%|\d+억|\d+만|\d+조|\d+배|\d+위"


def features(news: DataFrame) -> DataFrame:
    """id, length, complexity (mean sentence length), visual, figures (whether there are any), urgency, audience and topic (the category, if any)."""
    n = F.length("title") + F.length("body")
    parts = F.split("body", r"[.!?]\s*")
    mean = F.aggregate(parts, F.lit(0), lambda a, s: a + F.length(s)) / F.size(parts)
    text = F.concat("title", F.lit(" "), "body")
    low = F.lower("title")
    return news.select(
        "id", F.when(n < 200, "short").when(n < 800, "medium").otherwise("long").alias("length"), F.when(mean > 50, "complex").when(mean < 25, "simple").otherwise("moderate").alias("complexity"),
        F.when(text.rlike(STATISTICS), "medium").otherwise("none").alias("visual"), F.when(text.rlike(STATISTICS), "yes").otherwise("no").alias("figures"),
        F.when(x.contains_any(low, rules.BREAKING), "breaking").when(x.contains_any(F.lower(text), rules.EVERGREEN), "evergreen").otherwise("daily").alias("urgency"),
        F.when(x.contains_any(text, rules.YOUTH), "youth").otherwise("general").alias("audience"), (F.col("category") if "category" in news.columns else F.lit(None).cast("string")).alias("topic"),
    )


def preferences(values: dict[str, tuple[str, ...]], feature: str, top: float, step: float) -> list[tuple[str, str, str, float]]:
    """Weights of formats that a value of a feature prefers, each next one less by `step`."""
    return [(feature, value, name, round(top - k * step, 6)) for value, names in values.items() for k, name in enumerate(names)]


#: (feature, value, format, weight) of all rules; what has no value of a feature gets none of its weights.
WEIGHTS = [
    *rules.FORMAT_WEIGHTS, *preferences(more.URGENCY_FORMATS, "urgency", 0.3, 0.1), *preferences(more.TOPIC_FORMATS, "topic", 0.2, 0.05), *(("figures", "yes", name, 0.2) for name in more.FIGURE_FORMATS),
    *(("people", "many", name, 0.1) for name in more.PEOPLE_FORMATS),
]


def recommend(features_: DataFrame, most: int = 5, weights: list[tuple[str, str, str, float]] | None = None) -> DataFrame:
    """id, format, score and place: weights of the rules that hold, at most 1, the best five; equal scores by name."""
    weights = WEIGHTS if weights is None else weights
    table = features_.sparkSession.createDataFrame(list(weights), "feature string, value string, format string, weight double")
    names = [n for n in sorted({w[0] for w in weights}) if n in features_.columns]
    rows = features_.select("id", F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.col(k).alias("value")) for k in names))).alias("f")).select("id", "f.*")
    scored = rows.join(F.broadcast(table), ["feature", "value"]).groupBy("id", "format").agg(F.round(F.least(F.sum("weight"), F.lit(1.0)), 3).alias("score"))  # a row a rule
    order = Window.partitionBy("id").orderBy(F.desc("score"), "format")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def reasons(recommended: DataFrame, features_: DataFrame) -> DataFrame:
    """recommended(id, format) with reason, required and optional elements of the format."""
    rows = recommended.join(features_.select("id", "length", "complexity", "urgency"), "id")
    use = F.create_map(*(F.lit(v) for name, spec in more.SPECS.items() for v in (name, f"{spec.use}에 적합")))[F.col("format")]
    said = [F.when((F.col(feature) == value) & F.col("format").isin(*names), text) for feature, value, names, text in more.REASONS]
    reason = F.concat_ws(", ", use, *said)
    parts = F.create_map(*(v for name, spec in more.SPECS.items() for v in (F.lit(name), x.strings(spec.structure))))[F.col("format")]
    none = F.array().cast("array<string>")
    return rows.select(
        "id", "format", F.when(reason == "", "기본 추천").otherwise(reason).alias("reason"), F.coalesce(parts, x.strings(("title", "body"))).alias("required"),
        F.when(parts.isNotNull(), x.strings(more.OPTIONAL)).otherwise(none).alias("optional"),
    )
