"""Encoding of texts with a public byte-level BPE vocabulary (problem 7).

Every pre-token is a row of a matrix of segment trees. A leaf holds the rank of
the pair that starts at its position, joined with the position, so the root of
a tree is the leftmost pair of lowest rank. A merge changes three leaves and
their ancestors. All trees of one size step together in numpy, until no root
names a pair.
"""

from __future__ import annotations

import importlib.util
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie, unless a caller names another folder.
VOCABULARIES = "/opt/tokenizers"
#: Pre-tokens kept encoded per Python worker. The store is emptied when it is full; results do not depend on it.
REMEMBERED = 400_000
_NONE = np.int64(2**62)


class Vocabulary:
    """Byte ids, pair ranks and split pattern of one byte-level BPE file (picklable, about 1 MB)."""

    def __init__(self, name: str = "byte_bpe_50k.json", folder: str | None = None):
        folder = folder or VOCABULARIES
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            model = json.load(f)["model"]
        spec = importlib.util.spec_from_file_location("_vocabulary_folder", os.path.join(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        self.pattern = module.PATTERN
        ids = model["vocab"]
        # the printable stand-ins of bytes: printable Latin-1 stands for itself, the rest follows from U+0100 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        hidden = [b for b in range(256) if b not in set(shown)]
        sign = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_id = np.array([ids[sign[b]] for b in range(256)], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(ids.values()) + 1
        pairs = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)  # by rank

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or a number beyond all ranks."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)


def merge_all(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """Ids of each pre-token (bytes, none empty)."""
    out: list[np.ndarray | None] = [None] * len(words)
    size_of = np.array([len(w) for w in words], np.int64)
    low = 1
    while low <= (size_of.max() if len(words) else 0):
        high = low * 2
        members = np.flatnonzero((size_of >= low) & (size_of < high))
        step = max(1, 4_000_000 // high)  # bounds the matrices of one call, whatever the lengths
        for k in range(0, len(members), step):
            part = members[k : k + step]
            for i, ids in zip(part, _merge_trees(vocabulary, [words[i] for i in part], high), strict=True):
                out[i] = ids
        low = high
    return out


def _merge_trees(vocabulary: Vocabulary, words: list[bytes], width: int) -> list[np.ndarray]:
    n = len(words)
    size = np.array([len(w) for w in words], np.int64)
    ids = np.full((n, width), -1, np.int64)
    ids[np.arange(width)[None, :] < size[:, None]] = vocabulary.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    shift = width.bit_length()
    place = np.arange(width, dtype=np.int64)
    # positions behind and before each live position; `width` is "none"
    after = np.where(place[None, :] + 1 < size[:, None], place + 1, width).astype(np.int32)
    before = np.broadcast_to(np.where(place > 0, place - 1, width), (n, width)).astype(np.int32)

    def leaf(left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = vocabulary.rank(left, right)
        return np.where(r < _NONE, (r << shift) | at, _NONE)

    tree = np.full((n, 2 * width), _NONE, np.int64)
    right = np.concatenate([ids[:, 1:], np.full((n, 1), -1, np.int64)], 1)
    tree[:, width:] = leaf(ids, right, place[None, :])
    k = width
    while k > 1:
        tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
        k //= 2
    live = np.flatnonzero(tree[:, 1] < _NONE)
    while len(live):
        root = tree[live, 1]
        at = root & ((1 << shift) - 1)
        gone = after[live, at].astype(np.int64)
        ids[live, at] = vocabulary.merged[root >> shift]
        ids[live, gone] = -1
        behind = after[live, gone].astype(np.int64)
        after[live, at] = behind
        has = behind < width
        before[live[has], behind[has]] = at[has]
        first = before[live, at].astype(np.int64)
        lead = first < width
        here = ids[live, at]
        tree[live, width + gone] = _NONE
        tree[live, width + at] = np.where(has, leaf(here, ids[live, np.minimum(behind, width - 1)], at), _NONE)
        tree[live[lead], width + first[lead]] = leaf(ids[live[lead], first[lead]], here[lead], first[lead])
        rows = np.concatenate([live, live, live[lead]])
        node = np.concatenate([at, gone, first[lead]]) + width
        for _ in range(shift - 1):
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        live = live[tree[live, 1] < _NONE]
    keep = ids >= 0
    return np.split(ids[keep], np.cumsum(keep.sum(1))[:-1])


class Encoder:
    """Encodes batches of texts; keeps distinct pre-tokens encoded."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.split = regex.compile(vocabulary.pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)

    def _learn(self, words: Iterable[str]) -> None:
        new = [w for w in words if w not in self.at]
        if not new:
            return
        ids = merge_all(self.vocabulary, [w.encode("utf-8", "replace") for w in new])
        count = np.array([len(x) for x in ids], np.int64)
        base = len(self.at)
        self.at.update(zip(new, range(base, base + len(new)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.concatenate(ids).astype(np.int32)])

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        if len(self.at) > REMEMBERED:
            self._clear()
        split = [self.split(t) if t else [] for t in texts]
        self._learn({w for words in split for w in words})
        at = self.at
        where = np.array([at[w] for words in split for w in words], np.int64)
        words_of = np.array([len(words) for words in split], np.int64)
        count = self.count[where]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        index = np.repeat(self.start[where] - (ends - count), count) + np.arange(total)
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(words_of)])]
        return self.flat[index], np.diff(edge)


def _pieces(batch: pa.RecordBatch, texts: str, rows: int) -> Iterator[tuple[int, list]]:
    """Slices of a batch small enough to hold their pre-tokens in memory, whatever the text lengths."""
    column, begin, held = batch.column(texts), 0, 0
    for i in range(batch.num_rows):
        held += len(column[i].as_py() or "") + 50
        if held > 2_000_000 or i + 1 - begin >= rows:
            yield begin, column.slice(begin, i + 1 - begin).to_pylist()
            begin, held = i + 1, 0
    if begin < batch.num_rows:
        yield begin, column.slice(begin).to_pylist()


def encode_column(
    docs: DataFrame, key: str, text: str, vocabulary: Vocabulary | None = None, lengths_only: bool = False
) -> DataFrame:
    """(key, ids) of each row, or (key, n_tokens) with ``lengths_only``.

    A map over the rows: no shuffle, no order needed. Null and empty texts give
    an empty list (0 tokens); special-token strings in a text are plain text;
    equal rows are encoded each; other columns are not read.
    """
    vocabulary = vocabulary or Vocabulary()
    kind = docs.schema[key].dataType.simpleString()
    name, out = ("n_tokens", "bigint") if lengths_only else ("ids", "array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for begin, texts in _pieces(batch, "text_", 2000):
                flat, count = encoder.encode(texts)
                keys = batch.column("key_").slice(begin, len(texts))
                if lengths_only:
                    made = pa.array(count, pa.int64())
                else:
                    made = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, made], ["key_", name])

    picked = docs.select(F.col(key).alias("key_"), F.col(text).alias("text_"))
    return picked.mapInArrow(run, f"key_ {kind}, {name} {out}").withColumnRenamed("key_", key)
