"""The similarity report of papers: matched sentences, rates, sources and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def quoted(sents: DataFrame) -> DataFrame:
    """``sents`` with their quoted units."""
    return sents.withColumn("quote_units", T.quoted_units(F.col("text"), F.col("kind")))


def sentence_results(papers: DataFrame, matches: DataFrame) -> DataFrame:
    """Sentences of papers with their best source (null where unmatched) and quoted units, which ``papers`` may have already."""
    best = matches.where("place = 1").select(F.col("paper_id").alias("doc_id"), "idx", F.col("doc_id").alias("source_id"), "sent_idx", "sim")
    told = papers if "quote_units" in papers.columns else quoted(papers)
    return told.join(best, ["doc_id", "idx"], "left").withColumn("matched", F.col("source_id").isNotNull())


def rates(results: DataFrame) -> DataFrame:
    """(doc_id, total_units, dup_units, quote_units, total_rate, quote_rate, sentence_count, matched_sentences).

    A matched sentence of which at least 60 % is quoted counts as a citation,
    not as duplication; other matched sentences add their quoted units up to
    their size, unmatched ones add theirs whole.
    """
    cited = F.col("matched") & (F.col("quote_units") >= K.QUOTE_SHARE * F.greatest("units", F.lit(1)))
    quote = F.when(cited, F.col("units")).when(F.col("matched"), F.least("quote_units", "units")).otherwise(F.col("quote_units"))
    out = results.groupBy("doc_id").agg(
        F.sum("units").alias("total_units"),
        F.sum(F.when(F.col("matched") & ~cited, F.col("units")).otherwise(0)).alias("dup_units"),
        F.sum(quote).alias("quote_units"),
        F.count("*").alias("sentence_count"),
        F.sum(F.col("matched").cast("int")).alias("matched_sentences"),
    )
    rate = lambda c: F.when(F.col("total_units") > 0, T.rounded(F.col(c) / F.col("total_units") * 100, 1)).otherwise(0.0)
    return out.withColumn("total_rate", rate("dup_units")).withColumn("quote_rate", rate("quote_units"))


def source_totals(results: DataFrame) -> DataFrame:
    """(doc_id, source_id, dup_units, hits, rate) of each best source of a paper, citations included."""
    total = results.groupBy("doc_id").agg(F.sum("units").alias("total_units"))
    by = results.where("matched").groupBy("doc_id", "source_id").agg(F.sum("units").alias("dup_units"), F.count("*").alias("hits"))
    rate = F.when(F.col("total_units") > 0, T.rounded(F.col("dup_units") / F.col("total_units") * 100, 1)).otherwise(0.0)
    return by.join(total, "doc_id").withColumn("rate", rate).drop("total_units")


def source_counts(matches: DataFrame) -> DataFrame:
    """(paper_id, doc_id, hits): how often each document is among the best three."""
    return matches.groupBy("paper_id", "doc_id").agg(F.count("*").alias("hits"))


def source_variants(totals: DataFrame, counts: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """(doc_id, source_id, variant_id, hits): near copies of a paper's sources among the documents it met.

    A variant differs from the source in at most 12 bits of the fingerprint
    and is listed once, under the source with most duplicated units. Only the
    documents one paper met are compared with each other.
    """
    f = fingerprints.select(F.col("doc_id").alias("source_id"), "fingerprint")
    main = totals.select("doc_id", "source_id", "dup_units").join(f, "source_id")
    other = counts.select(F.col("paper_id").alias("doc_id"), F.col("doc_id").alias("source_id"), "hits").join(f, "source_id")
    other = other.select("doc_id", F.col("source_id").alias("variant_id"), "hits", F.col("fingerprint").alias("variant_print"))
    near = main.join(other, "doc_id").where("source_id <> variant_id").where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("variant_print"))) <= K.VARIANT_BITS)
    once = F.row_number().over(Window.partitionBy("doc_id", "variant_id").orderBy(F.desc("dup_units"), "source_id"))
    return near.withColumn("nth", once).where("nth = 1").select("doc_id", "source_id", "variant_id", "hits")


def listed_results(sents: DataFrame, matches: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """(doc_id, sents): every paper's ``sentence_results`` in an array, in order, with their machine-text level (null without ``levels``).

    Texts are moved once, to their paper; matches and levels join them there as maps.
    """
    entry = lambda df, key, value, name: df.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
    best = matches.where("place = 1").select(F.col("paper_id").alias("doc_id"), "idx", F.struct(F.col("doc_id").alias("source_id"), "sim").alias("b"))
    by = sents.groupBy("doc_id").agg(F.collect_list(F.struct("start_pos", "idx", "end_pos", "text", "units")).alias("s")).join(entry(best, "idx", "b", "best"), "doc_id", "left")
    if levels is not None:
        by = by.join(entry(levels.select("doc_id", "start_pos", "level"), "start_pos", "level", "levels"), "doc_id", "left")

    def row(x: Column) -> Column:
        b = F.try_element_at("best", x["idx"])
        level = F.lit(None).cast("string") if levels is None else F.try_element_at("levels", x["start_pos"])
        parts = [x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), x["text"].alias("text"), x["units"].alias("units")]
        return F.struct(*parts, b.isNotNull().alias("matched"), b["source_id"].alias("source_id"), b["sim"].alias("sim"), level.alias("level"))

    return by.select("doc_id", F.transform(F.array_sort("s"), row).alias("sents"))


def fragments(results: DataFrame, sents: DataFrame | None = None) -> DataFrame:
    """(doc_id, fragment, start_pos, end_pos, text, dup_units, rate, source_id, sim) of neighbouring matched sentences.

    Up to one unmatched sentence may lie between two; its text belongs to the
    fragment, its units do not. The source is the one with most units, the
    earlier on a tie, with the similarity of its first sentence. Texts are those
    of ``sents``, which need no matches, or else of ``results``.
    """
    by_idx = Window.partitionBy("doc_id").orderBy("idx")
    total = results.groupBy("doc_id").agg(F.sum("units").alias("total_units"))
    hit = results.where("matched")
    new = (F.col("idx") - F.lag("idx").over(by_idx) > K.FRAGMENT_GAP + 1).cast("int")
    hit = hit.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("fragment", F.sum("new").over(by_idx))
    by = hit.groupBy("doc_id", "fragment", "source_id").agg(
        F.sum("units").alias("u"), F.min("idx").alias("met"), F.max("idx").alias("last"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.min_by("sim", "idx").alias("sim")
    )
    spans = by.groupBy("doc_id", "fragment").agg(
        F.min("met").alias("first_idx"), F.max("last").alias("last_idx"), F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.sum("u").alias("dup_units"),
        F.max_by(F.struct("source_id", "sim"), F.struct("u", -F.col("met"))).alias("top"),
    )
    texts = (results if sents is None else sents).select("doc_id", "idx", "text").join(spans.select("doc_id", "fragment", "first_idx", "last_idx"), "doc_id").where("idx BETWEEN first_idx AND last_idx")
    # the sentences of one fragment: bounded by the paper
    joined = texts.groupBy("doc_id", "fragment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda s: s["text"]), "").alias("text"))
    out = spans.join(joined, ["doc_id", "fragment"]).join(total, "doc_id")
    rate = F.when(F.col("total_units") > 0, T.rounded(F.col("dup_units") / F.col("total_units") * 100, 1)).otherwise(0.0)
    return out.select("doc_id", "fragment", "start_pos", "end_pos", "text", "dup_units", rate.alias("rate"), "top.source_id", "top.sim")


def fragment_sources(results: DataFrame, matches: DataFrame) -> DataFrame:
    """(doc_id, fragment, place, source_id, hits, sim): every document among the best three of a fragment's matched sentences.

    In order of hits, then of where it is met first; ``sim`` is its greatest.
    """
    by_idx = Window.partitionBy("doc_id").orderBy("idx")
    hit = results.where("matched").select("doc_id", "idx")
    new = F.coalesce((F.col("idx") - F.lag("idx").over(by_idx) > K.FRAGMENT_GAP + 1).cast("int"), F.lit(0))
    hit = hit.withColumn("new", new).withColumn("fragment", F.sum("new").over(by_idx))
    met = matches.select(F.col("paper_id").alias("doc_id"), "idx", F.col("place").alias("p"), F.col("doc_id").alias("source_id"), "sim")
    by = hit.join(met, ["doc_id", "idx"]).groupBy("doc_id", "fragment", "source_id")
    by = by.agg(F.count("*").alias("hits"), F.max("sim").alias("sim"), F.min(F.struct("idx", "p")).alias("met"))
    place = F.row_number().over(Window.partitionBy("doc_id", "fragment").orderBy(F.desc("hits"), "met"))
    return by.select("doc_id", "fragment", place.alias("place"), "source_id", "hits", "sim")


def machine_band(rate: str) -> Column:
    """low, middle or high for a machine-text rate."""
    return F.when(F.col(rate) < 30, "low").when(F.col(rate) < 60, "middle").otherwise("high")


def rate_band(rate: str) -> Column:
    """low, middle or high for a duplication rate."""
    return F.when(F.col(rate) < 10, "low").when(F.col(rate) < 25, "middle").otherwise("high")
