"""The registry of machine-text engines, and the outcome of each for every document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: (engine, kind, region) in the order of a report. The local engine always runs; a model engine needs its predictions,
# an external one a key; experimental ones are named and never called; the last is for a person to use
REGISTRY = (
    ("local", "local", "built in"),
    ("transformers", "model", "both"),
    ("watermark", "experimental", "international"),
    ("external-en", "external", "international"),
    ("external-zh", "external", "domestic"),
    ("manual", "manual", "domestic"),
)


def outcomes(local: DataFrame, model: DataFrame | None = None, external: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, place, engine, region, status, rate): the outcome of every engine for each document of ``local`` (doc_id, total_rate).

    ``model`` (doc_id, probability) and ``external`` (doc_id, engine,
    probability) hold answers of engines that were called: ok with a rate, or
    error where a document has none or a null one. Without them, and for
    external engines not among ``keys``, the status is not_configured.
    """
    spark = local.sparkSession
    registry = spark.createDataFrame([(k, *r) for k, r in enumerate(REGISTRY)], "place int, engine string, kind string, region string")
    # a row per engine: as many rows as the registry has
    rows = local.crossJoin(F.broadcast(registry))
    none = spark.createDataFrame([], "doc_id string, engine string, probability double").withColumn("doc_id", F.col("doc_id").cast(local.schema["doc_id"].dataType))
    answers = none if model is None else model.select("doc_id", F.lit("transformers").alias("engine"), "probability")
    answers = answers.unionByName(none if external is None else external.select("doc_id", "engine", "probability"))
    rows = rows.join(answers, ["doc_id", "engine"], "left")
    called = ((F.col("kind") == "model") & F.lit(model is not None)) | ((F.col("kind") == "external") & F.lit(external is not None) & F.col("engine").isin(*keys))
    status = F.when(F.col("kind") == "local", "ok").when(F.col("kind").isin("experimental", "manual"), F.col("kind"))
    status = status.when(~called, "not_configured").when(F.col("probability").isNull(), "error").otherwise("ok")
    rate = F.when(F.col("kind") == "local", F.col("total_rate")).when(called, F.floor(F.col("probability") * 1000 + 0.5) / 10)
    return rows.select("doc_id", "place", "engine", "region", status.alias("status"), rate.alias("rate"))
