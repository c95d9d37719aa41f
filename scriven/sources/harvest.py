"""Records of open-access APIs as documents, from their stored JSON or XML answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shortest abstract that is kept.
MIN_ABSTRACT = 80

#: Least number of documents a job may ask for.
MIN_TARGET = 20
# fixed values: (key, name, region, languages, default query, greatest target) of the sources
SOURCES = (
    ("arxiv", "arXiv", "international", "en", "cat:cs.CL OR cat:cs.AI", 5000),
    ("openalex-en", "OpenAlex", "international", "en", "", 20000),
    ("openalex-zh", "OpenAlex", "domestic", "zh", "", 20000),
    ("doaj", "DOAJ", "international and domestic", "many", "*", 10000),
    ("europepmc", "Europe PMC", "international", "en", "", 10000),
)
_MOST = {s[0]: s[5] for s in SOURCES}


def sources(spark: SparkSession) -> DataFrame:
    """(key, name, region, langs, default_query, max_target) of the sources that can be harvested."""
    return spark.createDataFrame(list(SOURCES), "key string, name string, region string, langs string, default_query string, max_target int")


def clamp_target(source: str, target: int) -> int:
    return max(MIN_TARGET, min(_MOST[source], target))


def clamped(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """``jobs`` (source, target_count, ...) with ``target``: within the limits of the source; jobs of other sources have none."""
    most = registry.select(F.col("key").alias("source"), "max_target")
    target = F.greatest(F.lit(MIN_TARGET), F.least("max_target", "target_count"))
    return jobs.join(F.broadcast(most), "source", "left").withColumn("target", F.when(F.col("max_target").isNotNull(), target)).drop("max_target")


def seeds(spark: SparkSession, path: str, library: DataFrame) -> DataFrame:
    """(title, content, is_builtin, origin): the seed documents of JSON arrays [{title, content}] under ``path``, if the library is empty.

    ``origin`` is the file's name; entries without content are left out.
    """
    rows = spark.read.schema("title string, content string").option("multiLine", True).json(path)
    rows = rows.select("title", "content", F.lit(1).alias("is_builtin"), F.element_at(F.split(F.input_file_name(), "/"), -1).alias("origin"))
    rows = rows.where(F.length("content") > 0)
    return rows if library.limit(1).count() == 0 else rows.limit(0)


def _squeeze(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def openalex(answers: DataFrame) -> DataFrame:
    """(title, content, url) from OpenAlex works (json): the inverted abstract is put in order again."""
    kind = "id STRING, title STRING, abstract_inverted_index MAP<STRING, ARRAY<INT>>"
    w = answers.select(F.from_json("json", kind).alias("w")).select("w.*").where("title IS NOT NULL")
    pairs = F.flatten(F.transform(F.map_entries("abstract_inverted_index"), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    text = F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
    return w.select(_squeeze("title").alias("title"), text.alias("content"), F.col("id").alias("url")).where(F.length("content") >= MIN_ABSTRACT)


def arxiv(answers: DataFrame) -> DataFrame:
    """(title, content, url) from Atom feeds (xml)."""
    plain = F.regexp_replace("xml", r'\sxmlns(:\w+)?="[^"]*"', "")
    entries = answers.select(F.explode(F.regexp_extract_all(plain, F.lit(r"(?s)<entry>.*?</entry>"), F.lit(0))).alias("e"))
    part = lambda p: F.xpath_string("e", F.lit(f"entry/{p}"))
    e = entries.select(part("title").alias("t"), part("summary").alias("s"), part("id").alias("url"))
    return e.select(_squeeze("t").alias("title"), _squeeze("s").alias("content"), "url").where((F.length("content") >= MIN_ABSTRACT) & (F.length("title") > 0))


def doaj(answers: DataFrame) -> DataFrame:
    """(title, content, url) from DOAJ articles (json): the first full-text link."""
    kind = "bibjson STRUCT<title: STRING, abstract: STRING, link: ARRAY<STRUCT<type: STRING, url: STRING>>>"
    b = answers.select(F.from_json("json", kind)["bibjson"].alias("b")).select("b.*").where("title IS NOT NULL")
    full = F.get(F.filter("link", lambda x: x["type"] == "fulltext"), F.lit(0))["url"]
    return b.select(_squeeze("title").alias("title"), _squeeze("abstract").alias("content"), F.coalesce(full, F.lit("")).alias("url")).where(F.length("content") >= MIN_ABSTRACT)


def europepmc(answers: DataFrame) -> DataFrame:
    """(title, content, url) from Europe PMC results (json): tags away; by DOI, else by source and id."""
    kind = "id STRING, source STRING, doi STRING, title STRING, abstractText STRING"
    r = answers.select(F.from_json("json", kind).alias("r")).select("r.*").where("title IS NOT NULL")
    plain = lambda c: _squeeze(F.regexp_replace(c, "<[^>]+>", " "))
    url = F.when(F.length("doi") > 0, F.concat(F.lit("https://doi.org/"), "doi")).when(F.col("source").isNotNull() & F.col("id").isNotNull(), F.concat(F.lit("https://europepmc.org/article/"), "source", F.lit("/"), "id")).otherwise("")
    return r.select(plain("title").alias("title"), plain("abstractText").alias("content"), url.alias("url")).where(F.length("content") >= MIN_ABSTRACT)


#: Adapters by source.
ADAPTERS = {"arxiv": arxiv, "openalex-en": openalex, "openalex-zh": openalex, "doaj": doaj, "europepmc": europepmc}
