"""Rule-based rewriting: substitutions, long sentences, connectors, and the text put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T


def swap_cliches(text: Column, kind: Column) -> Column:
    """Stock phrases replaced, longer ones first, each on the outcome of the one before."""

    def fold(table: dict[str, str]) -> Column:
        out = text
        for k in sorted(table, key=lambda k: -len(k)):
            out = F.replace(out, F.lit(k), F.lit(table[k]))
        return out

    return F.when(kind == "en", fold(K.CLICHE_EN)).otherwise(fold(K.CLICHE_ZH))


def swap_synonyms(text: Column, kind: Column) -> Column:
    """Chinese: words of the original replaced in turn. Otherwise whole words in one pass, case ignored.

    One pass is a sequence in which no outcome is replaced again: a word that
    another turns into comes before it.
    """
    zh = text
    for k, v in K.SYN_ZH.items():
        # an empty search replaces nothing: a word that only an earlier replacement made stays
        zh = F.replace(zh, F.when(F.contains(text, F.lit(k)), k).otherwise(""), F.lit(v))
    en = text
    for k in sorted(K.SYN_EN, key=lambda k: k not in K.SYN_EN.values()):
        en = F.regexp_replace(en, rf"(?i)\b{k}\b", K.SYN_EN[k])
    return F.when(kind == "en", en).otherwise(zh)


def split_long(text: Column, kind: Column) -> Column:
    """Chinese of 34 units and two commas: the comma nearest to 45 % becomes a full stop, unless at an edge. English of 26 words: the first semicolon does."""
    chars = F.split(text, "")
    n = F.length(text)
    commas = F.filter(F.transform(chars, lambda c, i: F.when(c == "，", i)), lambda i: i.isNotNull())
    best = F.array_min(F.transform(commas, lambda i: F.struct(F.abs(i - n * 0.45).alias("d"), i.alias("i"))))["i"]
    long_zh = (T.units(T.normalize(text, F.lit("zh")), F.lit("zh")) >= 34) & (F.size(commas) >= 2) & (best > 6) & (best < n - 6)
    zh = F.when(long_zh, F.concat(F.substring(text, F.lit(1), best), F.lit("。"), F.substring(text, best + 2, n))).otherwise(text)
    at = F.locate("; ", text)
    long_en = (F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))) >= 26) & (at > 0)
    en = F.when(long_en, F.concat(F.substring(text, F.lit(1), at - 1), F.lit(". "), F.substring(text, at + 2, n))).otherwise(text)
    return F.when(kind == "zh", zh).otherwise(en)


def opener(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for h in reversed(K.CONNECTOR_HEADS_ZH):
        out = F.when(F.startswith(text, F.lit(h)), F.lit(h)).otherwise(out)
    return out


def thin_connectors(sents: DataFrame, text: str = "text") -> DataFrame:
    """``sents`` (doc_id, idx, ...) with ``thinned``: stock openings stay at their first use in a document only."""
    s = sents.withColumn("opener", opener(F.col(text)))
    nth = F.row_number().over(Window.partitionBy("doc_id", "opener").orderBy("idx"))
    later = F.col("opener").isNotNull() & (nth > 1)
    cut = F.substring(F.col(text), F.length("opener") + 1, F.length(text))
    return s.withColumn("thinned", F.when(later, cut).otherwise(F.col(text))).drop("opener")


#: What a rewriting changes: copied sentences, machine-styled ones, or both.
MODES = ("dedup", "humanize", "both")


def rewrite(sents: DataFrame, matched: DataFrame, scores: DataFrame, mode: str = "both") -> DataFrame:
    """(doc_id, idx, start_pos, end_pos, orig, new, reasons): the changed sentences.

    Sentences of middle or high machine-text level lose stock phrases and
    repeated openings; matched ones get synonyms and are split when long. In
    the mode ``humanize`` machine-styled ones are split instead. ``reasons``
    names the steps that changed a sentence, in their order.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    never = F.lit(False)
    styled = scores.where(F.lit(mode != "dedup") & (F.col("level") != "low")).select("doc_id", "start_pos").withColumn("styled", F.lit(True))
    copied = matched.where(F.lit(mode != "humanize") & F.col("matched")).select("doc_id", "start_pos").withColumn("copied", F.lit(True))
    s = sents.join(styled, ["doc_id", "start_pos"], "left").join(copied, ["doc_id", "start_pos"], "left")
    s = s.withColumn("styled", F.coalesce("styled", never)).withColumn("copied", F.coalesce("copied", never))
    plain = s.where("styled").withColumn("t1", swap_cliches(F.col("text"), F.col("kind")))
    plain = thin_connectors(plain, "t1").select("doc_id", "idx", "t1", F.col("thinned").alias("t2"))
    s = s.where("styled OR copied").join(plain, ["doc_id", "idx"], "left")
    s = s.withColumn("t1", F.coalesce("t1", "text")).withColumn("t2", F.coalesce("t2", "text"))
    # each step is exploded: else the planner writes the steps before out into the filter behind, once for each use
    once = lambda s, name, c: s.select("*", F.explode(F.array(c)).alias(name))
    s = once(s, "t3", F.when(F.col("copied"), swap_synonyms(F.col("t2"), F.col("kind"))).otherwise(F.col("t2")))
    s = once(s, "t4", F.when(F.col("copied") | F.lit(mode == "humanize"), split_long(F.col("t3"), F.col("kind"))).otherwise(F.col("t3")))
    steps = (("stock phrase", "text", "t1"), ("repeated opening", "t1", "t2"), ("synonym", "t2", "t3"), ("long sentence", "t3", "t4"))
    reasons = F.filter(F.array(*[F.when(F.col(a) != F.col(b), F.lit(name)) for name, a, b in steps]), lambda r: r.isNotNull())
    blank = "^[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+|[\\s\\x{85}\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+$"
    s = once(s, "new", F.regexp_replace("t4", blank, "")).where((F.col("new") != "") & (F.col("new") != F.regexp_replace("text", blank, "")))
    return s.select("doc_id", "idx", "start_pos", "end_pos", F.col("text").alias("orig"), "new", reasons.alias("reasons"))


def full_text(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(doc_id, text): documents with their edits put in; what lies between edits stays."""
    # the edits of one document, in order; each carries the text from the last edit's end to its own
    w = Window.partitionBy("doc_id").orderBy("start_pos")
    e = edits.select("doc_id", "start_pos", "end_pos", "new").withColumn("from_", F.coalesce(F.lag("end_pos").over(w), F.lit(0)))
    listed = e.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_pos", "from_", "end_pos", "new"))).alias("e"))
    d = docs.select("doc_id", "text").join(listed, "doc_id", "left")
    parts = F.transform("e", lambda x: F.concat(F.substring(F.col("text"), x["from_"] + 1, x["start_pos"] - x["from_"]), x["new"]))
    rest = F.substring(F.col("text"), F.element_at("e", -1)["end_pos"] + 1, F.length("text"))
    return d.select("doc_id", F.when(F.col("e").isNull(), F.col("text")).otherwise(F.concat(F.array_join(parts, ""), rest)).alias("text"))
