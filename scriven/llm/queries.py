"""Queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, stored, table
from . import languages, leakage, lookalike, mixture, sentences, spans, subjects, terms, tokens


def _library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "library_docs").select("id", "content"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = spread(table(spark, sf_dir, "checks").select("id", "report"))
    return spans.texts_of(_library(spark, sf_dir), checks)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.shared_records(spans.shared_passages(_records(spark, sf_dir), fuzzy=False))


def p1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages shared by two records, exact or with small differences; of seeds in four or more rows, links to representatives (``p1_members`` has the others)."""
    return spans.shared_passages(_records(spark, sf_dir)).drop("runs")


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place of every record in the classes of shared windows and seeds of four or more rows, with the class's head."""
    return spans.shared_members(_records(spark, sf_dir))


def p1_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record stands verbatim in another record."""
    records = _records(spark, sf_dir)
    return spans.shared_share(spans.shared_passages(records, fuzzy=False), records)


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _library(spark, sf_dir)
    return terms.marked(terms.term_counts(docs, "id", "content"), docs, "id", "content").drop("n")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_terms(spark, sf_dir).where(F.col("mark").isNotNull()).select("term", "mark")


def p2_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N-grams of up to three terms that occur more than once."""
    return terms.term_counts(_library(spark, sf_dir), "id", "content", max_n=3).where("occurrences > 1")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _library(spark, sf_dir).withColumnRenamed("id", "doc_id")
    return sentences.sentence_offsets(docs, "doc_id", "content", sentences.fit_words(docs, "content"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _library(spark, sf_dir)
    return sentences.pieces_in_sentences(docs, table(spark, sf_dir, "sentences"), sentences.fit_words(docs, "content"))


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main language and further passages of every record, with confidences."""
    docs = spread(table(spark, sf_dir, "library_docs").select("id", "content", "lang"))
    checks = spread(table(spark, sf_dir, "checks").select("id", "language", "report"))
    machines = languages.fit(docs, "lang", "content")
    return languages.identify(languages.records(docs, checks), machines).drop("label").distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "library_docs").select("id", "content", "lang"))
    checks = spread(table(spark, sf_dir, "checks").select("id", "language", "report"))
    machines = languages.fit(docs, "lang", "content")
    return languages.wrong_or_further(languages.identify(languages.records(docs, checks), machines))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.look_pairs(_library(spark, sf_dir), "id", "content")


def p5_library_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct library text with its class and the class's one form."""
    found = lookalike.look_classes(_library(spark, sf_dir), "id", "content")
    return found.select(F.col("key").alias("doc_id"), F.col("class_key").alias("class_id"), "form")


def p5_sentence_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comparison string of ``sentences`` with its class and the class's one form."""
    rows = spread(table(spark, sf_dir, "sentences").select("doc_id", "idx", "norm"))
    found = lookalike.look_classes(rows.select(F.struct("doc_id", "idx").alias("at"), "norm"), "at", "norm")
    return found.select("key.doc_id", "key.idx", F.col("class_key.doc_id").alias("class_doc"), F.col("class_key.idx").alias("class_idx"), "form")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(_library(spark, sf_dir), "id", "content", table(spark, sf_dir, "aigc_eval"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_column(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    # documents of sources without a target are not encoded; the list of targets is a fixed table
    targets = table(spark, sf_dir, "mix_targets").select("source").distinct()
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").join(F.broadcast(targets), "source", "left_semi")
    sizes = tokens.encode_column(spread(docs.select(F.struct("doc_id", "source").alias("at"), "text")), "at", "text", lengths_only=True)
    return stored(sizes.select("at.doc_id", "at.source", "n_tokens"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training mix: documents and copies by position."""
    return mixture.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual shares of the mix by source."""
    docs, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixture.shares(mixture.mix(docs, targets), docs, targets)


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each document's sentences by subject, with the rules' confidence."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rules = subjects.fit(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas"))
    return subjects.score(docs, rules)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).where("share >= 0.2").select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by subject, and their share of all documents."""
    total = table(spark, sf_dir, "documents").agg(F.countDistinct("doc_id").alias("all_docs"))
    by = p9_found(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("docs"))
    return by.crossJoin(F.broadcast(total)).select("subject", "docs", (F.col("docs") / F.col("all_docs")).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p1_passages, p1_members, p1_shares, p2_found, p2_terms, p2_ngrams, p3_found, p3_pieces, p4_found, p4_languages, p5_found, p5_library_forms, p5_sentence_forms, p6_found, p7_ids, p8_mix, p8_shares, p9_found, p9_subjects, p9_composition]
    return {f.__name__: f for f in own}


_TERMS = """
WITH docs AS (SELECT DISTINCT id, content FROM library_docs WHERE content IS NOT NULL),
found AS (SELECT id, lower(unnest(regexp_extract_all(content, '[A-Za-z0-9]+|[一-鿿]'))) AS term FROM docs),
counts AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT id)::BIGINT AS records FROM found GROUP BY term),
marked AS (SELECT term, occurrences, records, CASE WHEN records <= 2 THEN 'rare'
    WHEN records >= 0.3 * (SELECT count(DISTINCT id) FROM docs) THEN 'common' END AS mark FROM counts)
"""


_NGRAMS = """
WITH docs AS (SELECT DISTINCT id, content FROM library_docs WHERE content IS NOT NULL),
lists AS (SELECT id, list_transform(regexp_extract_all(content, '[A-Za-z0-9]+|[一-鿿]'), lambda t: lower(t)) AS w FROM docs),
sizes AS (SELECT unnest([1, 2, 3]) AS n),
placed AS (SELECT id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM lists, sizes WHERE len(w) >= n),
grams AS (SELECT id, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS term FROM placed)
SELECT term, n::INTEGER AS n, count(*)::BIGINT AS occurrences, count(DISTINCT id)::BIGINT AS records FROM grams GROUP BY term, n HAVING count(*) > 1
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _TERMS + "SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p2_terms": _TERMS + "SELECT term, occurrences, records, mark FROM marked",
        "p2_ngrams": _NGRAMS,
    }
