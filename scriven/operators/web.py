"""Verification of unmatched sentences against pages: selection, queries, matching and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import stored
from . import overlap
from .index import explode_shingles, norm_id, sentences, with_shingles


def web_query(norm: Column, kind: Column) -> Column:
    """The first 16 characters, or the first ten words."""
    return F.when(kind == "zh", F.substring(norm, 1, 16)).otherwise(F.array_join(F.slice(F.split(norm, " "), 1, 10), " "))


def web_candidates(results: DataFrame, count: int = K.WEB_COUNT) -> DataFrame:
    """Unmatched sentences of at least 12 characters (Chinese) or 8 words, the longest ``count`` (3 to 30) of each paper: the selection is the feature."""
    count = max(3, min(30, count))
    enough = F.when(F.col("kind") == "zh", F.length("norm") >= K.WEB_MIN_CHARS).otherwise(F.col("units") >= K.WEB_MIN_WORDS)
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("units"), "idx"))
    picked = results.where(~F.col("matched") & enough).withColumn("place", nth).where(F.col("place") <= count)
    return picked.select("doc_id", "idx", "place", "kind", "norm", "units", web_query(F.col("norm"), F.col("kind")).alias("query"))


def web_matches(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, idx, page_id, sim): pages (doc_id, text) that hold a candidate, or a sentence like it.

    A page whose normal form holds the candidate whole counts 1; otherwise the
    best containment among its sentences of the same kind and at least six
    units, if it reaches the threshold. Both meet on shingles: a contained text
    shares all of its own with the page.
    """
    cut = pages.select("doc_id", F.substring("text", 1, K.WEB_PAGE_CHARS).alias("text"))
    q = candidates.select(norm_id(F.col("kind"), F.col("norm")).alias("qid"), "kind", "norm", "units").distinct()
    qs = q.withColumn("shingles", T.shingles(F.col("norm"), F.col("kind"), F.col("units"), 4))
    qs = explode_shingles(qs, "qid", "kind", F.size("shingles").alias("nq"))
    sents = with_shingles(sentences(cut).where("units >= 6"))
    ps = explode_shingles(sents, F.col("doc_id").alias("page_id"), F.col("idx").alias("page_idx"), "kind", F.size("shingles").alias("nc"))
    met = qs.join(ps, ["shingle", "kind"]).groupBy("qid", "kind", "page_id", "page_idx").agg(F.count("*").alias("hits"), F.max("nq").alias("nq"), F.max("nc").alias("nc"))
    by_sentence = met.withColumn("sim", T.rounded(F.col("hits") / F.least("nq", "nc"), 4)).where(F.col("sim") >= T.threshold(F.col("kind"))).groupBy("qid", "page_id").agg(F.max("sim").alias("sim"))
    kinds = F.array(F.lit("zh"), F.lit("en"))
    whole = cut.select(F.col("doc_id").alias("page_id"), "text", F.explode(kinds).alias("kind"))
    whole = whole.withColumn("page_norm", T.normalize(F.col("text"), F.col("kind"))).drop("text")
    lead = whole.withColumn("shingles", T.shingles(F.col("page_norm"), F.col("kind"), T.units(F.col("page_norm"), F.col("kind")), 4))
    lead = stored(explode_shingles(lead, "page_id", "kind"))
    # a page that holds a candidate holds all its shingles, but for the first and last where words are cut there; the rarest of the
    # inner ones finds the pages, and only their texts are looked through
    inner = q.withColumn("shingles", T.shingles(F.col("norm"), F.col("kind"), F.col("units"), 4))
    inner = inner.withColumn("shingles", F.when(F.size("shingles") > 2, F.slice("shingles", F.lit(2), F.size("shingles") - 2)).otherwise(F.col("shingles")))
    inner = explode_shingles(inner, "qid", "kind", F.size("shingles").alias("n"))
    pages_of = lead.groupBy("kind", "shingle").agg(F.count("*").alias("pages"))
    rarest = inner.join(pages_of, ["kind", "shingle"]).groupBy("qid", "kind", "n").agg(F.count("*").alias("known"), F.min_by("shingle", F.struct("pages", "shingle")).alias("shingle"))
    pairs = rarest.where("known = n").join(lead, ["kind", "shingle"]).select("qid", "kind", "page_id")
    norms = q.where(F.length("norm") >= K.WEB_MIN_CHARS).select("qid", "norm")
    held = pairs.join(norms, "qid").join(whole, ["page_id", "kind"]).where(F.contains("page_norm", "norm")).select("qid", "page_id", F.lit(1.0).alias("sim"))
    best = by_sentence.unionByName(held).groupBy("qid", "page_id").agg(F.max("sim").alias("sim"))
    own = candidates.select("doc_id", "idx", norm_id(F.col("kind"), F.col("norm")).alias("qid"))
    return own.join(best, "qid").select("doc_id", "idx", "page_id", "sim")


def best_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """Of ``web_matches`` the best page of each candidate, the lower id on a tie: neither shingles of pages nor pairs are written."""
    cut = pages.select("doc_id", F.substring("text", 1, K.WEB_PAGE_CHARS).alias("text"))
    q = stored(candidates.select(norm_id(F.col("kind"), F.col("norm")).alias("qid"), "kind", "norm", "units").dropDuplicates(["qid"]))
    near = overlap.nearest_pages(q, sentences(cut).where("units >= 6"))
    whole = cut.select(F.col("doc_id").alias("page_id"), "text", F.explode(F.array(F.lit("zh"), F.lit("en"))).alias("kind"))
    held = overlap.holding_pages(q, whole.select("page_id", "kind", T.normalize(F.col("text"), F.col("kind")).alias("page_norm")))
    best = near.unionByName(held).groupBy("qid").agg(F.max(F.struct("sim", (-F.col("page_id")).alias("page"))).alias("b"))
    own = candidates.select("doc_id", "idx", norm_id(F.col("kind"), F.col("norm")).alias("qid"))
    return own.join(best, "qid").select("doc_id", "idx", (-F.col("b.page")).alias("page_id"), F.col("b.sim").alias("sim"))


def web_sources(candidates: DataFrame, matches: DataFrame, results: DataFrame) -> DataFrame:
    """(doc_id, page_id, units, hits, rate): each sentence counts for its best page, the lower id on a tie."""
    best = matches.groupBy("doc_id", "idx").agg(F.max_by("page_id", F.struct("sim", -F.col("page_id"))).alias("page_id"))
    total = results.groupBy("doc_id").agg(F.sum("units").alias("total_units"))
    by = best.join(candidates.select("doc_id", "idx", "units"), ["doc_id", "idx"]).groupBy("doc_id", "page_id").agg(F.sum("units").alias("units"), F.count("*").alias("hits"))
    return by.join(total, "doc_id").withColumn("rate", T.rounded(F.col("units") / F.greatest("total_units", F.lit(1)) * 100, 1)).drop("total_units")
