"""Machine-text scores: features of a document, scores of its sentences and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from .index import norm_id


def _phrases(text: Column, lang: Column, zh: tuple[str, ...], en: tuple[str, ...]) -> Column:
    return F.when(lang == "zh", T.phrase_hits(text, zh)).otherwise(T.phrase_hits(F.lower(text), en))


def kept_sentences(sents: DataFrame, docs: DataFrame) -> DataFrame:
    """Sentences of at least three units with their document's language."""
    lang = docs.select("doc_id", T.detect_language(F.col("text")).alias("lang"))
    return sents.where("units >= 3").join(lang, "doc_id")


def document_features(docs: DataFrame, kept: DataFrame, stats: DataFrame) -> DataFrame:
    """One row per document with a kept sentence: the eight features and what they come from."""
    d = docs.withColumn("lang", T.detect_language(F.col("text")))
    chars = F.regexp_extract_all(T.normalize(F.col("text"), F.lit("zh")), F.lit("(?s)."), F.lit(0))
    toks = F.when(F.col("lang") == "zh", chars).otherwise(T.words(F.col("text")))
    # list marks of the reference's table, the em dash twice there
    marks = F.regexp_extract_all(F.col("text"), F.lit("[,;:!?()【】《》“”‘’、—…]"), F.lit(0))
    whole = d.select(
        "doc_id",
        "lang",
        _phrases(F.col("text"), F.col("lang"), K.ZH_CONNECTORS, K.EN_CONNECTORS).alias("conn"),
        _phrases(F.col("text"), F.col("lang"), K.ZH_CLICHES, K.EN_CLICHES).alias("cliche"),
        F.greatest(F.lit(1), F.size(F.array_distinct(toks))).alias("types"),
        F.greatest(F.lit(1), F.size(toks)).alias("tokens"),
        F.size(F.array_distinct(marks)).alias("marks"),
    )
    # texts are not moved
    own = kept.select("doc_id", "units", F.substring("text", 1, 2).alias("head"), norm_id(F.col("kind"), F.col("norm")).alias("sid")).join(stats.select("sid", "ppl", "token_burst"), "sid", "left")
    per = own.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.avg("units").alias("mean_len"),
        F.stddev_pop("units").alias("sd_len"),
        F.countDistinct("head").alias("heads"),
        F.count("ppl").alias("ppls"),
        (F.stddev_pop("ppl") / F.avg("ppl")).alias("ppl_cv"),
        F.count("token_burst").alias("bursts"),
        F.avg("token_burst").alias("mean_burst"),
    )
    f = whole.join(per, "doc_id")
    share = T.clamp(1 - F.abs(F.col("types") / F.col("tokens") - F.when(F.col("lang") == "zh", 0.52).otherwise(0.42)) / F.when(F.col("lang") == "zh", 0.25).otherwise(0.30), 0, 1)
    f = f.select(
        "*",
        (F.col("sd_len") / F.col("mean_len")).alias("len_cv"),
        (F.col("conn") / F.col("n")).alias("conn_density"),
        (F.col("cliche") / F.col("n")).alias("cliche_density"),
        share.alias("ttr_score"),
        (1 - T.clamp(F.col("marks") / 12, 0, 1)).alias("punct_score"),
        (F.col("heads") / F.col("n")).alias("head_div"),
        F.when(F.col("ppls") >= 3, T.clamp(1 - F.col("ppl_cv") / K.SENTENCE_ANCHOR, 0, 1)).alias("sent_burst"),
        F.when(F.col("bursts") >= 2, T.clamp(1 - F.col("mean_burst") / K.TOKEN_ANCHOR, 0, 1)).alias("token_burst"),
    )
    z = (
        1.4 * (1 - T.clamp(F.col("len_cv") / 0.55, 0, 1))
        + 0.9 * T.clamp(F.col("conn_density") / 0.45, 0, 1.5)
        + 1.4 * T.clamp(F.col("cliche_density") / 0.35, 0, 1.5)
        + 0.7 * F.col("ttr_score")
        + 0.6 * F.col("punct_score")
        + 0.7 * (1 - T.clamp(F.col("head_div"), 0, 1)) / 0.6
        - 2.2
        + F.coalesce(0.8 * F.col("sent_burst"), F.lit(0.0))
        + F.coalesce(0.7 * F.col("token_burst"), F.lit(0.0))
    )
    return f.withColumn("doc_score", T.rounded(T.sigmoid(T.rounded(z * 1.05, 9)) * 100, 1))


#: Feature names of the report and their values from the columns of ``document_features``.
FEATURES = {
    "even_lengths": lambda: (1 - T.clamp(F.col("len_cv") / 0.55, 0, 1)) * 100,
    "cliches": lambda: T.clamp(F.col("cliche_density") / 0.35, 0, 1.5) * 66,
    "connectors": lambda: T.clamp(F.col("conn_density") / 0.45, 0, 1.5) * 66,
    "plain_words": lambda: F.col("ttr_score") * 100,
    "plain_marks": lambda: F.col("punct_score") * 100,
    "same_heads": lambda: (1 - T.clamp(F.col("head_div"), 0, 1)) * 100 / 0.6,
    "even_sentences": lambda: F.col("sent_burst") * 100,
    "even_tokens": lambda: F.col("token_burst") * 100,
}


def feature_rows(features: DataFrame) -> DataFrame:
    """(doc_id, feature, value): whole numbers from 5 to 100; what is not available has no row."""
    each = [F.struct(F.lit(n).alias("feature"), F.when(v().isNotNull(), T.clamp(T.rounded(T.rounded(v(), 6), 0), 5, 100)).cast("int").alias("value")) for n, v in FEATURES.items()]
    return features.select("doc_id", F.explode(F.array(*each)).alias("f")).select("doc_id", "f.feature", "f.value").where(F.col("value").isNotNull())


def sentence_scores(kept: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, idx, start_pos, end_pos, score, level) of every kept sentence.

    A formula opening is one that equals the first two characters of at least
    three sentences of the document; in English, where the opening is two words,
    that is rarely so.
    """
    doc = Window.partitionBy("doc_id")
    s = kept.withColumn("sid", norm_id(F.col("kind"), F.col("norm"))).join(stats.select("sid", "token_burst"), "sid", "left")
    low = F.lower("text")
    s = s.withColumn("head", F.substring("text", 1, 2))
    words = F.regexp_extract_all(low, F.lit(r"\S+"), F.lit(0))
    s = s.withColumn("opener", F.when(F.col("lang") == "zh", F.col("head")).otherwise(F.array_join(F.slice(words, 1, 2), " ")))
    often = s.groupBy("doc_id", F.col("head").alias("opener")).agg(F.count("*").alias("uses")).where("uses >= 3")
    s = s.join(often, ["doc_id", "opener"], "left")
    s = s.withColumn("mean_len", F.avg("units").over(doc)).withColumn("bursts", F.count("token_burst").over(doc))
    nth = F.row_number().over(doc.orderBy(F.col("token_burst").asc_nulls_last(), "idx"))
    s = s.withColumn("nth", nth).withColumn("median", F.max(F.when(F.col("nth") == F.floor(F.col("bursts") / 2) + 1, F.col("token_burst"))).over(doc))
    away = F.abs(F.col("units") - F.col("mean_len")) / F.col("mean_len")
    smooth = F.when(F.col("median") > 0, 0.5 * T.clamp((F.col("median") - F.col("token_burst")) / F.col("median") / 0.5, 0, 1.2))
    z = (
        1.5 * _phrases(F.col("text"), F.col("lang"), K.ZH_CLICHES, K.EN_CLICHES)
        + 0.6 * _phrases(F.col("text"), F.col("lang"), K.ZH_CONNECTORS, K.EN_CONNECTORS)
        + 0.8 * (1 - T.clamp(away / 0.7, 0, 1))
        + F.when(F.col("uses").isNotNull(), 0.5).otherwise(0.0)
        - 1.1
        + F.coalesce(smooth, F.lit(0.0))
    )
    s = s.withColumn("score", T.rounded(T.sigmoid(T.rounded(z * 1.4, 9)) * 100, 1))
    level = F.when(F.col("score") >= K.AIGC_HIGH, "high").when(F.col("score") >= K.AIGC_MID, "mid").otherwise("low")
    return s.select("doc_id", "idx", "start_pos", "end_pos", "score", level.alias("level"))


def final_scores(docs: DataFrame, features: DataFrame, scores: DataFrame) -> DataFrame:
    """(doc_id, total_rate): 0.6 of the length-weighted sentence score and 0.4 of the document score; 0 without kept sentences."""
    size = F.col("end_pos") - F.col("start_pos")
    mean = scores.groupBy("doc_id").agg((F.sum(F.col("score") * size) / F.sum(size)).alias("mean"))
    joined = docs.select("doc_id").join(features.select("doc_id", "doc_score"), "doc_id", "left").join(mean, "doc_id", "left")
    return joined.select("doc_id", F.coalesce(T.rounded(T.rounded(F.col("mean") * 0.6 + F.col("doc_score") * 0.4, 9), 1), F.lit(0.0)).alias("total_rate"))


def paragraphs(scores: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start_pos, end_pos, rate, high_count, sentences): sentences no more than 40 characters apart."""
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    new = F.coalesce((F.col("start_pos") - F.lag("end_pos").over(w) > K.PARAGRAPH_GAP).cast("int"), F.lit(0))
    s = scores.withColumn("new", new).withColumn("paragraph", F.sum("new").over(w))
    return s.groupBy("doc_id", "paragraph").agg(
        F.min("start_pos").alias("start_pos"),
        F.max("end_pos").alias("end_pos"),
        T.rounded(T.rounded(F.avg("score"), 9), 1).alias("rate"),
        F.sum((F.col("level") == "high").cast("int")).alias("high_count"),
        F.count("*").alias("sentences"),
    )
