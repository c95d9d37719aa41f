"""Greedy packing of sentences into chunks for a classifier, and its label probabilities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

#: Label names that stand for machine text.
MACHINE_LABELS = ("ai", "machine", "generated", "chatgpt", "label_1", "1")


def pack(sents: DataFrame, limit: int = K.CHUNK_UNITS) -> DataFrame:
    """(doc_id, chunk, units, sentences): a sentence opens a chunk when it would take the last one beyond ``limit`` units.

    A sequential fold over the sentences of each document; a longer sentence is a chunk of its own.
    """
    kind = sents.schema["doc_id"].dataType.simpleString()
    listed = sents.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "units"))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, s in zip(pdf["doc_id"], pdf["s"], strict=True):
                chunk, held, n = 0, 0, 0
                for x in s:
                    if n and held + x["units"] > limit:
                        out.append((doc, chunk, held, n))
                        chunk, held, n = chunk + 1, 0, 0
                    held, n = held + x["units"], n + 1
                out.append((doc, chunk, held, n))
            yield pd.DataFrame(out, columns=["doc_id", "chunk", "units", "sentences"])

    return listed.mapInPandas(run, f"doc_id {kind}, chunk int, units bigint, sentences int")


def machine_probability(predictions: Column) -> Column:
    """Highest score among the machine labels of an array of (label, score); 0 without one."""
    hit = F.filter(predictions, lambda p: F.lower(p["label"]).rlike("|".join(MACHINE_LABELS)))
    return F.coalesce(F.array_max(F.transform(hit, lambda p: p["score"])), F.lit(0.0))


def weighted_probability(scored: DataFrame) -> DataFrame:
    """(doc_id, probability) of chunks (doc_id, units, probability): the mean by units."""
    return scored.groupBy("doc_id").agg((F.sum(F.col("probability") * F.col("units")) / F.sum("units")).alias("probability"))
