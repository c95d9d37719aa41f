"""Similar library sentences: recall by shared shingles, the two gates, and the best three documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import overlap
from .index import doc_frequency, explode_shingles, norm_id, with_shingles


def candidates(query: DataFrame, library: DataFrame, documents: DataFrame, frequency: DataFrame | None = None) -> DataFrame:
    """(qid, cid, hits, containment, coverage) of the sentence classes that share a shingle.

    Sentences with equal normal forms are one class on either side, so a copied
    sentence is joined once, however often it was copied. Postings, document
    frequencies and query shingles all meet on the shingle. Coverage is the
    share of the query's shingle weight ln(1 + N / df) that the candidate has.
    """
    if frequency is None:
        frequency = doc_frequency(with_shingles(library))
    q = query.select(norm_id(F.col("kind"), F.col("norm")).alias("qid"), "kind", "norm", "units").distinct()
    c = library.select(norm_id(F.col("kind"), F.col("norm")).alias("cid"), "kind", "norm", "units").distinct()
    q = explode_shingles(with_shingles(q), "qid", F.size("shingles").alias("nq"))
    c = explode_shingles(with_shingles(c), "cid", F.size("shingles").alias("nc"))
    total = documents.agg(F.count("*").alias("n"))
    weighted = q.join(frequency, "shingle", "left").crossJoin(F.broadcast(total))  # one row
    weight = F.log(1 + F.greatest("n", F.lit(1)) / F.greatest(F.coalesce("df", F.lit(1)), F.lit(1)))
    weighted = weighted.select("qid", "nq", "shingle", weight.alias("w"))
    whole = weighted.groupBy("qid").agg(F.sum("w").alias("total_w"))
    met = weighted.join(c, "shingle").groupBy("qid", "cid").agg(
        F.count("*").alias("hits"), F.sum("w").alias("shared_w"), F.max("nq").alias("nq"), F.max("nc").alias("nc")
    )
    contained = F.col("hits") / F.least("nq", "nc")
    return met.join(whole, "qid").select("qid", "cid", "hits", contained.alias("containment"), T.rounded(F.col("shared_w") / F.col("total_w"), 9).alias("coverage"))


def best_documents(query: DataFrame, library: DataFrame, documents: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(qid, place, doc_id, sent_idx, sim): for each query class its up to three documents, best first.

    Candidate sentences are walked in the order of hits, then document and
    sentence; the first 200 are looked at, the first sentence of a document that
    passes both gates stands for it, and the first three documents stay.
    ``overlap`` does so without the table of pairs that ``candidates`` is.
    ``held`` is the library with its digests, stored, each document's sentences
    together; without it, it is made.
    """
    return overlap.best_documents(query, library, documents, held)


def find_similar(query: DataFrame, library: DataFrame, documents: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(paper_id, idx, place, doc_id, sent_idx, sim) of every query sentence with a similar library sentence."""
    best = best_documents(query, library, documents, held)
    own = query.select(F.col("doc_id").alias("paper_id"), "idx", norm_id(F.col("kind"), F.col("norm")).alias("qid"))
    return own.join(best, "qid").select("paper_id", "idx", "place", "doc_id", "sent_idx", "sim")
