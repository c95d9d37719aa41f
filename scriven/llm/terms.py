"""Frequencies of terms and n-grams by suffix arrays (problem 2).

A suffix array over the terms of a block of whole records is built by prefix
doubling. Suffixes that share their first n terms lie in one interval of it;
the interval's length is the occurrence count of that n-gram. The records of
the interval are its length less the neighbours, in the record's own suffix
order, that share those n terms: the within-record duplicate adjacencies.
Records are never split between blocks, so block counts add up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run of ASCII letters and digits, or one character of the CJK block.
TERM = re.compile("[A-Za-z0-9]+|[一-鿿]")
#: Terms in one suffix array; more text than that starts another.
BLOCK_TERMS = 1_500_000


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The suffixes of ``ids`` in order.

    Negative ids are ends of records: they are all different, so no common
    prefix runs over them. Prefix doubling; a suffix leaves when it is alone
    with its rank, so copied stretches alone take more rounds.
    """
    n = len(ids)
    _, rank = np.unique(np.where(ids < 0, -1 - np.arange(n), ids), return_inverse=True)
    # a rank is the number of suffixes that are smaller
    rank = (np.cumsum(np.bincount(rank)) - np.bincount(rank))[rank].astype(np.int64)
    reach = 1
    open_ = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(open_):
        behind = np.where(open_ + reach < n, rank[np.minimum(open_ + reach, n - 1)] + 1, 0)
        order = np.lexsort((behind, rank[open_]))
        at, group, behind = open_[order], rank[open_][order], behind[order]
        place = np.arange(len(at))
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new = new_group | np.concatenate([[True], behind[1:] != behind[:-1]])
        first_of_group = np.maximum.accumulate(np.where(new_group, place, 0))
        first_equal = np.maximum.accumulate(np.where(new, place, 0))
        rank[at] = group + first_equal - first_of_group
        alone = new & np.concatenate([new[1:], [True]])
        open_ = np.sort(at[~alone])
        reach *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


def prefix_lengths(ids: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, at most ``depth``."""
    n = len(ids)
    a, b = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    length = np.zeros(len(order), np.int64)
    same = np.ones(len(a), bool)
    for k in range(depth):
        x, y = np.minimum(a + k, n - 1), np.minimum(b + k, n - 1)
        same &= (ids[x] == ids[y]) & (ids[x] >= 0) & (a + k < n) & (b + k < n)
        length[1:] += same
    return length


def count_block(texts: list[str], max_n: int) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """(n-grams, n, occurrences, records) of whole records, for n = 1 .. max_n."""
    found = [TERM.findall(t) for t in texts]
    words = np.array([w.lower() for f in found for w in f], object)
    if not len(words):
        return
    code, names = pd.factorize(words)
    size = np.array([len(f) for f in found], np.int64)
    record = np.repeat(np.arange(len(found)), size + 1)
    ids = np.full(len(words) + len(found), -1, np.int64)
    keep = np.ones(len(ids), bool)
    keep[np.cumsum(size + 1) - 1] = False
    ids[keep] = code
    order = suffix_array(ids)
    order = order[ids[order] >= 0]
    common = prefix_lengths(ids, order, max_n)
    # the suffixes of each record in their own order: a stable sort of the array by record keeps it
    own = order[np.argsort(record[order], kind="stable")]
    twice = prefix_lengths(ids, own, max_n)
    twice[np.flatnonzero(np.diff(record[own], prepend=-1))] = 0
    repeats = np.zeros(len(ids), np.int64)
    repeats[own] = twice
    repeats = repeats[order]
    filled = keep.astype(np.int64)
    room = np.zeros(len(ids), np.int64)  # terms from here to the end of the record
    room[keep] = (np.repeat(np.cumsum(size + 1) - 1, size) - np.flatnonzero(filled)).astype(np.int64)
    for n in range(1, max_n + 1):
        new = common < n
        whole = room[order] >= n
        interval = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        occurs = np.bincount(interval, weights=whole, minlength=len(start)).astype(np.int64)
        records = occurs - np.bincount(interval, weights=(repeats >= n) & whole, minlength=len(start)).astype(np.int64)
        real = occurs > 0
        at = order[start[real]]
        grams = names[ids[at]]
        for k in range(1, n):
            grams = grams + " " + names[ids[at + k]]
        yield grams, n, occurs[real], records[real]


def term_counts(docs: DataFrame, key: str, text: str, max_n: int = 1) -> DataFrame:
    """(term, n, occurrences, records) of every n-gram up to ``max_n`` terms of the distinct records.

    Records are distinct (key, text) with a non-null text. Texts without a
    term add nothing. Counts of a block leave the map already summed, so a
    term that stands in every record is one row per block, not a hot key.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        chars = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for grams, n, occurs, records in count_block(held, max_n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams, pa.string()), pa.array(np.full(len(grams), n, np.int32)), pa.array(occurs), pa.array(records)],
                    ["term", "n", "occurrences", "records"],
                )

        for batch in batches:
            for t in batch.column("text").to_pylist():
                held.append(t)
                chars += len(t)
                if chars > BLOCK_TERMS * 2:
                    yield from counted()
                    held, chars = [], 0
        if held:
            yield from counted()

    blocks = rows.select("text").mapInArrow(run, "term string, n int, occurrences bigint, records bigint")
    return blocks.groupBy("term", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, docs: DataFrame, key: str, text: str, rare_records: int = 2, common_share: float = 0.3) -> DataFrame:
    """``counts`` with ``mark``: rare (at most ``rare_records`` records), common (at least ``common_share`` of them) or null.

    Where both hold, as in a collection of very few records, the term is rare.
    """
    total = docs.where(F.col(text).isNotNull()).agg(F.countDistinct(key).alias("all_records"))
    # one row: the count of the collection
    joined = counts.crossJoin(F.broadcast(total))
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") >= common_share * F.col("all_records"), "common")
    return joined.withColumn("mark", mark).drop("all_records")
