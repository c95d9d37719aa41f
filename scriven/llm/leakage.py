"""Evaluation texts that leaked into training texts (problem 6).

Both sides are reduced to letters and digits in one form. Windows of the size
of the shortest passage that counts, less the stride, are laid over every
document at a fixed stride and over every item at each offset, so that a
shared passage always holds one document window that equals an item window.
A window's 64-bit SimHash is looked up by its blocks: fingerprints within the
radius agree in at least one of radius + 1 blocks. Candidates are verified by
the exact weighted similarity of their shingles, and a passage counts when the
verified windows extend to a run of the required length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookalike import same_form

_KEPT = re.compile(r"[^\W_]+")
#: Characters of a run that counts, by language of the item.
RUN = {"en": 80, "zh": 30}
#: Characters of a shingle.
SHINGLE = 4
#: Differing bits allowed between the fingerprints of a window and of an item's window.
RADIUS = 3
#: Items compared in one pass; more items are taken block by block.
BLOCK_ITEMS = 2000


def kept(text: str | None) -> str:
    """Letters and digits of ``text`` in one form, case ignored."""
    return "".join(_KEPT.findall(same_form(text or "").lower()))


def layout(run: int) -> tuple[int, int]:
    """(shingles in a block, blocks in a window): the widest window that every run of ``run`` characters holds at a stride of one block."""
    most = run - SHINGLE + 2
    blocks = 4 if run >= 60 else 3
    return most // (blocks + 1), blocks


def shingle_hashes(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the shingle that starts at each place."""
    n = len(codes) - SHINGLE + 1
    h = np.zeros(max(0, n), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(SHINGLE):
            h = (h ^ codes[k : k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def fingerprints(hashes: np.ndarray, block: int, blocks: int, step: int) -> np.ndarray:
    """SimHash of each window of ``blocks`` times ``block`` shingles, one every ``step`` shingles (1 or ``block``)."""
    width = block * blocks
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    if step == block:
        n = len(hashes) // block
        bits = np.unpackbits(hashes[: n * block].astype("<u8").view(np.uint8).reshape(n, block, 8), axis=2, bitorder="little")
        # ones among a block's shingles, eight bit planes added at a time
        ones = bits.sum(1, dtype=np.uint8).astype(np.int16)
        window = ones[: n - blocks + 1].copy()
        for k in range(1, blocks):
            window += ones[k : n - blocks + 1 + k]
    else:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
        window = total[width:] - total[:-width]
    return np.packbits(window * 2 > width, axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


@dataclass
class Items:
    """Windows of the items of one language, found by blocks of their fingerprints (picklable)."""

    run: int
    ids: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)

    def build(self) -> Items:
        self.block, self.blocks = layout(self.run)
        width = self.block * self.blocks
        prints, item, place = [], [], []
        for k, t in enumerate(self.texts):
            f = fingerprints(shingle_hashes(np.array(list(map(ord, t)), np.uint32)), self.block, self.blocks, 1)
            prints.append(f)
            item.append(np.full(len(f), k))
            place.append(np.arange(len(f)))
        self.prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        self.place = np.concatenate(place) if place else np.zeros(0, np.int64)
        self.chars = width + SHINGLE - 1
        parts = RADIUS + 1
        edges = [64 * k // parts for k in range(parts + 1)]
        self.cuts = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.orders, self.starts = [], []
        for shift, mask in self.cuts:
            value = ((self.prints >> shift) & mask).astype(np.int64)
            order = np.argsort(value, kind="stable")
            self.orders.append(order.astype(np.int32))
            self.starts.append(np.searchsorted(value[order], np.arange(int(mask) + 2)).astype(np.int32))
        return self

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document window, item window) of all pairs within the radius, each once."""
        rows, cols = [], []
        for (shift, mask), order, starts in zip(self.cuts, self.orders, self.starts, strict=True):
            value = ((prints >> shift) & mask).astype(np.int64)
            low, count = starts[value], starts[value + 1] - starts[value]
            row = np.repeat(np.arange(len(prints)), count)
            if not len(row):
                continue
            at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
            col = order[at]
            near = np.bitwise_count(prints[row] ^ self.prints[col]) <= RADIUS
            rows.append(row[near])
            cols.append(col[near])
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(rows).astype(np.int64) * len(self.prints) + np.concatenate(cols))
        return both // len(self.prints), both % len(self.prints)


def similarity(a: str, b: str) -> float:
    """Weighted similarity of the shingles of two windows: shared over all occurrences."""
    if a == b:
        return 1.0
    x: dict[str, int] = {}
    for k in range(len(a) - SHINGLE + 1):
        x[a[k : k + SHINGLE]] = x.get(a[k : k + SHINGLE], 0) + 1
    y: dict[str, int] = {}
    for k in range(len(b) - SHINGLE + 1):
        y[b[k : k + SHINGLE]] = y.get(b[k : k + SHINGLE], 0) + 1
    shared = sum(min(n, y.get(s, 0)) for s, n in x.items())
    return shared / (sum(x.values()) + sum(y.values()) - shared)


def longest_run(doc: str, item: str, at: int, place: int, chars: int) -> int:
    """Longest run of equal characters on the diagonal of two windows that touches them."""
    best, n = 0, 0
    a, b = at, place
    while a > 0 and b > 0 and doc[a - 1] == item[b - 1]:
        a, b = a - 1, b - 1
    while a < len(doc) and b < len(item) and (a < at + chars or n):
        n = n + 1 if doc[a] == item[b] else 0
        best = max(best, n)
        a, b = a + 1, b + 1
    return best


def find_in(texts: list[str], items: Items, least_similarity: float = 0.8) -> set[tuple[int, int]]:
    """(text, item) of every passage: the run counts when it is at least ``items.run`` characters long."""
    found: set[tuple[int, int]] = set()
    if not len(items.prints):
        return found
    lengths = np.array([len(t) for t in texts], np.int64)
    block = items.block
    width = block * items.blocks
    # texts side by side, each padded to whole blocks, so that one pass makes all block sums
    padded = -(-lengths // block) * block
    starts = np.cumsum(padded) - padded
    codes = np.zeros(int(padded.sum()) + width + SHINGLE, np.uint32)
    flat = np.array(list(map(ord, "".join(texts))), np.uint32)
    codes[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))] = flat
    prints = fingerprints(shingle_hashes(codes), block, items.blocks, block)
    first = np.arange(len(prints)) * block
    owner = np.searchsorted(starts, first, side="right") - 1
    inside = first - starts[owner] + items.chars <= lengths[owner]
    where = np.flatnonzero(inside)
    row, col = items.candidates(prints[where])
    for r, c in zip(where[row].tolist(), col.tolist(), strict=True):
        t, i = int(owner[r]), int(items.item[c])
        if (t, i) in found:
            continue
        at, place = int(first[r] - starts[t]), int(items.place[c])
        doc, item = texts[t], items.texts[i]
        if similarity(doc[at : at + items.chars], item[place : place + items.chars]) < least_similarity:
            continue
        if longest_run(doc, item, at, place, items.chars) >= items.run:
            found.add((t, i))
    return found


def leaks(docs: DataFrame, key: str, text: str, evaluation: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every row of ``docs`` that holds a passage of an item of ``evaluation`` (item_id, lang, text).

    The items are the stated query set: they are read to the driver in blocks
    of ``BLOCK_ITEMS`` and each block is compared with all rows in one map; the
    documents are never shuffled. Items of a language without a run length, null
    texts, and items shorter than the run give nothing. Repeated rows give one.
    """
    items = evaluation.select("item_id", "lang", F.col("text").alias("text")).where(F.col("text").isNotNull()).distinct()
    blocks: list[list] = [[]]
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if len(blocks[-1]) == BLOCK_ITEMS:
            blocks.append([])
        blocks[-1].append(r)
    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    out = None
    for block in blocks:
        by_lang = {}
        for r in block:
            code = re.split("[-_]", (r.lang or "").strip().lower())[0]
            if code in RUN and len(t := kept(r.text)) >= RUN[code]:
                by_lang.setdefault(code, Items(RUN[code]))
                by_lang[code].ids.append(r.item_id)
                by_lang[code].texts.append(t)
        part = _leaks_of([x.build() for _, x in sorted(by_lang.items())], picked)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _leaks_of(sets: list[Items], docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [kept(t) for t in batch.column("text").to_pylist()]
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or chars + len(texts[end]) < 300_000):
                    chars += len(texts[end])
                    end += 1
                rows, ids = [], []
                for items in sets:
                    for t, i in sorted(find_in(texts[begin:end], items)):
                        rows.append(begin + t)
                        ids.append(items.ids[i])
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64())], ["doc_id", "item_id"])
                begin = end

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, item_id bigint")
