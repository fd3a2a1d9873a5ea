"""JSON tables that several runs land in one place: a run writes its files, then its entry of the manifest, and only then is it read.

A run that fails leaves files but no entry, so readers never see part of it; Spark's committer keeps the files of lost attempts out.
An entry is one row (folder, files, rows, schema), so the manifest grows with the runs, not with the data."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Timestamps in full, where Spark's default stops at milliseconds.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
ENTRY = "run string, folder string, files long, rows long, schema string"


def publish(df: DataFrame, root: str) -> str:
    """Writes df as JSON files of a new run under root and then its entry; returns the name of the run."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    folder = f"{root}/runs/{run}"
    df.write.options(ignoreNullFields=False, **TIMES).json(folder)
    # what stands in the files is counted, not what was meant to
    counts = read_files(spark, [folder], df.schema).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n")).agg(F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    entry = spark.createDataFrame([(run, folder, counts["files"], counts["rows"], df.schema.json())], ENTRY)
    entry.coalesce(1).write.json(f"{root}/manifest/{run}")
    return run


def read_files(spark: SparkSession, folders: list[str], schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(mode="FAILFAST", **TIMES).json(folders)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The entries of all runs that were published under root."""
    return spark.read.schema(ENTRY).json(f"{root}/manifest/*")


def read_published(spark: SparkSession, root: str, run: str | None = None) -> DataFrame:
    """The rows of all published runs, or of one, by the schema that they were written with; runs of different schemas are an error."""
    entries = manifest(spark, root)
    found = (entries.where(F.col("run") == run) if run else entries).orderBy("run").collect()
    schemas = {e["schema"] for e in found}
    if len(schemas) != 1:
        raise ValueError(f"{len(schemas)} schemas under {root}: one is needed")
    import json

    return read_files(spark, [e.folder for e in found], T.StructType.fromJson(json.loads(schemas.pop())))


def verify(spark: SparkSession, root: str) -> DataFrame:
    """(run, rows, found): rows of each entry, and rows that its files hold now."""
    entries = manifest(spark, root)
    runs = F.regexp_extract(F.input_file_name(), "/runs/([0-9a-f]+)/", 1)
    lines = spark.read.text(f"{root}/runs/*").select(runs.alias("run")).groupBy("run").agg(F.count("*").alias("found"))
    return entries.select("run", "rows").join(lines, "run", "left").withColumn("found", F.coalesce("found", F.lit(0)))
