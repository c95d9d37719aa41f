"""The best three documents of every query sentence, in numpy: a block of queries against the library's digests, read file by file.

Pairs of sentences are counted where they arise and never written: they grow with
the product of both sides. Shingles in a large share of the library (parts of
templates) are not joined at all. Sentences that hold the same of them are a group,
and only pairs of groups are counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import stored
from .index import norm_id

#: Queries of one task, sentences of the library read at once, joined postings held at once.
QUERIES, SENTENCES, HITS = 25_000, 20_000, 4_000_000
#: Pairs handed on at once, and queries of a task that lists pairs: the writer's dictionary (1 MB) holds their normal forms.
LISTED, LISTING = 20_000, 6_000
#: A shingle in this share of the library's sentences, and in so many at least, is one of a template.
SHARE, LEAST = 0.002, 500

_U = np.uint64
#: An odd factor for each place of a shingle.
_ODD = [int(x) | 1 for x in np.random.default_rng(8).integers(1 << 62, 1 << 63, 16)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation (the finalizer of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _windows(marks: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all runs of ``n`` marks of each row, or of the whole row if that is shorter, and their rows."""
    starts = np.cumsum(sizes) - sizes
    runs = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
    row = np.repeat(np.arange(len(sizes)), runs)
    at = np.arange(len(row)) - np.repeat(np.cumsum(runs) - runs, runs) + starts[row]
    wide = np.minimum(sizes, n)[row]
    out = _mix(wide.astype(_U) + _U(n << 8))
    # each mark is mixed once; the odd factors tell places apart
    mixed = _mix(marks + _U(1 << 40))
    short = np.flatnonzero(wide < n)
    for k in range(n):
        inside = at + k
        inside[short[wide[short] <= k]] = 0
        part = mixed[inside] * _U(_ODD[k])
        part[short[wide[short] <= k]] = 0
        out += part
    return _mix(out), row


def _words(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the words of rows that end with a blank each, and how many a row has."""
    c = np.frombuffer(text, np.uint8)
    blanks = np.flatnonzero(c == 32)
    starts = np.concatenate([[0], blanks[:-1] + 1])
    word = np.repeat(np.arange(len(blanks)), blanks + 1 - starts)
    part = _mix(c.astype(_U) + ((np.arange(len(c)) - starts[word]).astype(_U) << _U(8)) + _U(1 << 60))
    return _mix(np.add.reduceat(part, starts)), np.diff(np.searchsorted(blanks, ends), prepend=0)


def digests(norms: list[str], kinds: list[str], units: np.ndarray, least: int = K.MIN_SENT_UNITS) -> tuple[np.ndarray, np.ndarray]:
    """(digests, sizes): what ``T.shingles`` gives, as 64-bit digests of each row in order, distinct."""
    some, rows = [], []
    enough = units >= least
    zh = np.array([k == "zh" for k in kinds], bool)
    if len(at := np.flatnonzero(enough & zh)):
        picked = [norms[i] for i in at]
        d, r = _windows(np.frombuffer("".join(picked).encode("utf-32-le"), np.uint32).astype(_U), np.array([len(x) for x in picked]), K.ZH_SHINGLE)
        some.append(d), rows.append(at[r])
    if len(at := np.flatnonzero(enough & ~zh)):
        picked = [norms[i].encode() + b" " for i in at]
        marks, sizes = _words(b"".join(picked), np.cumsum([len(x) for x in picked]))
        d, r = _windows(marks, sizes, K.EN_SHINGLE)
        some.append(d), rows.append(at[r])
    if not some:
        return np.zeros(0, np.int64), np.zeros(len(norms), np.int64)
    d, r = np.concatenate(some).view(np.int64), np.concatenate(rows)
    order = np.lexsort((d, r))
    d, r = d[order], r[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1])
    return d[new], np.bincount(r[new], minlength=len(norms))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d, sizes = digests(b["norm"].to_pylist(), b["kind"].to_pylist(), b["units"].to_numpy(zero_copy_only=False))
        ends = np.concatenate([[0], np.cumsum(sizes) * 8]).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(d))])
        yield pa.RecordBatch.from_arrays([*b.columns, held], [*b.schema.names, "shingles"])


def _told(library: DataFrame) -> DataFrame:
    return library.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("idx").cast("int").alias("idx"), "kind", "norm", "units")


def with_digests(library: DataFrame) -> DataFrame:
    """``library`` with the digests of each sentence's shingles, in whatever order it is."""
    told = _told(library)
    return told.mapInArrow(_digested, f"doc_id bigint, idx int, kind string, norm string, units {told.schema['units'].dataType.simpleString()}, shingles binary")


def digested(library: DataFrame) -> DataFrame:
    """(doc_id, idx, shingles), stored: a document's sentences follow each other, so that blocks cut at most those at their edges."""
    placed = _told(library).repartition("doc_id").sortWithinPartitions("doc_id", "idx")
    return stored(with_digests(placed).select("doc_id", "idx", "shingles"))


def folder_of(table: DataFrame) -> str:
    """The folder of a stored table's files, as all executors see it."""
    path = table.inputFiles()
    return path[0].rsplit("/", 1)[0] if path else ""


def _blocks(folder: str | list, *more: str) -> Iterator[tuple]:
    """(doc_id, idx, digests, sizes) of the library, some sentences at a time, and the columns ``more``; a list has such blocks already."""
    if isinstance(folder, list):
        yield from folder
        return
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                for b in pq.ParquetFile(file).iter_batches(SENTENCES, columns=["doc_id", "idx", "shingles", *more]):
                    held = b["shingles"]
                    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1].astype(np.int64)
                    d = np.frombuffer(held.buffers()[2], np.int64, (ends[-1] - ends[0]) // 8, ends[0]) if ends[-1] > ends[0] else np.zeros(0, np.int64)
                    yield b["doc_id"].to_numpy(), b["idx"].to_numpy(), d, np.diff(ends) // 8, *(b[c] for c in more)


def _leads(folder: str) -> np.ndarray:
    """Is a sentence of the library, in the order of ``_blocks``, the first of its class?"""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    files = [f.path for f in sorted(fs.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda f: f.path) if f.path.endswith(".parquet")]
    cids = np.concatenate([pq.read_table(fs.open_input_file(f), columns=["cid"])["cid"].to_numpy() for f in files])
    lead = np.zeros(len(cids), bool)
    lead[np.unique(cids, return_index=True)[1]] = True
    return lead


class _Lookup:
    """Places of digests among sorted ones; a table of bits spares most searches of those that are absent."""

    def __init__(self, known: np.ndarray):
        self.known, self.shift = known, _U(64 - max(10, min(25, int(len(known)).bit_length() + 3)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), bool)
        self.bits[(known.view(_U) >> self.shift).astype(np.int64)] = True
        # digests are evenly spread: a known one stands near where its upper bits begin
        self.upper = _U(64 - max(10, int(len(known)).bit_length()))
        first = (known.view(_U) >> self.upper).astype(np.int64)
        self.order = np.argsort(known.view(_U))
        self.start = np.searchsorted(first[self.order], np.arange((1 << (64 - int(self.upper))) + 1)).astype(np.int32)
        self.most = int(np.diff(self.start).max())

    def __call__(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of d are known, their places)"""
        some = np.flatnonzero(self.bits[(d.view(_U) >> self.shift).astype(np.int64)])
        wanted = d[some]
        at = self.start[(wanted.view(_U) >> self.upper).astype(np.int64)]
        out, left = np.full(len(some), -1), np.arange(len(some))
        for _ in range(self.most):
            left, at = left[at < len(self.known)], at[at < len(self.known)]
            place = self.order[at]
            hit = self.known[place] == wanted[left]
            out[left[hit]] = place[hit]
            more = ~hit & (self.known[place].view(_U) < wanted[left].view(_U))
            left, at = left[more], at[more] + 1
        return some[out >= 0], out[out >= 0]


def _first(order: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` of each group, of places sorted by group."""
    g = group[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    nth = np.arange(len(g)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(g)]])))
    return order[nth < most]


def _order(q: np.ndarray, hits: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """By query, most hits first, then by rank: one sort of packed numbers where they fit."""
    if not len(q):
        return np.zeros(0, np.int64)
    h, r = int(hits.max()), int(rank.max()).bit_length()
    if int(q.max()).bit_length() + h.bit_length() + r > 63:
        return np.lexsort((rank, -hits, q))
    return np.argsort(((q << h.bit_length() | h - hits) << r) | rank)


def _groups(row: np.ndarray, shingle: np.ndarray, rows: int, key: np.ndarray) -> np.ndarray:
    """A number for the set of shingles that each row holds."""
    out = np.zeros(rows, _U)
    np.add.at(out, row, key[shingle])
    return out


class _Queries:
    """A block of queries and the best sentences of the library met so far."""

    def __init__(self, ids, zh, d, sizes, documents: int):
        self.ids, self.nq, self.documents = ids, sizes, documents
        self.floor = np.where(zh, K.ZH_SIM_THRESHOLD, K.EN_SIM_THRESHOLD)
        self.row = np.repeat(np.arange(len(ids)), sizes)
        self.known, self.at = np.unique(d, return_inverse=True)
        self.lookup = _Lookup(self.known)

    def weigh(self, folder: str | list, least: float | None = None) -> None:
        """Counts documents and sentences of each shingle; documents are told apart by sorted numbers, so each pair counts once, in whatever block."""
        sentences, seen = np.zeros(len(self.known), np.int64), 0
        docs, open_, places = np.zeros(len(self.known), np.int64), {}, []
        for doc, idx, d, sizes in _blocks(folder):
            places.append((doc, idx))
            hit, at = self.lookup(d)
            of = np.repeat(np.arange(len(doc)), sizes)[hit]
            seen += len(doc)
            sentences += np.bincount(at, minlength=len(self.known))
            number, local = np.unique(doc, return_inverse=True)
            pair = np.sort(local[of] * len(self.known) + at)
            pair = pair[np.diff(pair, prepend=-1) > 0]
            docs += np.bincount(pair % len(self.known), minlength=len(self.known))
            # a document that is cut between blocks stands at the edge of one; what it held is kept until it has passed
            for edge in {int(doc[0]), int(doc[-1])} if len(doc) else ():
                own = pair[pair // len(self.known) == np.searchsorted(number, edge)] % len(self.known)
                if edge in open_:
                    docs[np.intersect1d(own, open_[edge])] -= 1
                    own = np.union1d(own, open_[edge])
                open_[edge] = own
        # the library's sentences, and the rank of each as documents and sentences are numbered
        self.doc, self.idx = (np.concatenate(x) for x in zip(*places, strict=True)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        self.sorted = np.lexsort((self.idx, self.doc))
        self.rank = np.empty(seen, np.int64)
        self.rank[self.sorted] = np.arange(seen)
        self.weight = np.log(1 + max(self.documents, 1) / np.maximum(docs, 1))
        self.total = np.bincount(self.row, self.weight[self.at], len(self.ids))
        template = sentences > max(LEAST if least is None else least, SHARE * seen)
        self.template = np.where(template, np.cumsum(template) - 1, -1)
        self.key = _mix(np.arange(1, template.sum() + 2, dtype=np.uint64))
        # queries by the template shingles they hold
        t = self.template[self.at]
        sets = _groups(self.row[t >= 0], t[t >= 0], len(self.ids), self.key)
        _, first, self.group = np.unique(sets, return_index=True, return_inverse=True)
        self.held = np.zeros((len(first), int(template.sum())), np.float64)
        one = np.isin(self.row, first) & (t >= 0)
        self.held[self.group[self.row[one]], t[one]] = 1
        self.heavy = self.weight[template]
        # postings without them, by shingle
        rest = np.flatnonzero(t < 0)
        rest = rest[np.argsort(self.at[rest], kind="stable")]
        self.post = self.row[rest]
        self.size = np.bincount(self.at[rest], minlength=len(self.known))
        self.start = np.cumsum(self.size) - self.size

    def passed(self, q, hits, shared, nc):
        """(similarity, or -1 where a gate is closed)"""
        coverage = np.floor(shared / self.total[q] * 10**9 + 0.5) / 10**9
        sim = self.similar(q, hits, shared, nc) / 10**4
        return np.where((coverage >= K.COVERAGE_FLOOR) & (sim >= self.floor[q]), sim, -1.0)

    def number(self, of, t, n: int, numbers: dict[int, int], sets: list[np.ndarray]):
        """(group of each of a block's ``n`` sentences, the first sentence of each group of the block, which of these each sentence is in); new groups join the others."""
        of, t = of[t >= 0], t[t >= 0]
        found = _groups(of, t, n, self.key)
        values, first, local = np.unique(found, return_index=True, return_inverse=True)
        # a sentence's shingles follow each other
        starts, ends = np.searchsorted(of, first), np.searchsorted(of, first, "right")
        for v, start, end in zip(values.tolist(), starts.tolist(), ends.tolist(), strict=True):
            if v not in numbers:
                numbers[v] = len(sets)
                row = np.zeros(self.held.shape[1])
                row[t[start:end]] = 1
                sets.append(row)
        return np.array([numbers[v] for v in values.tolist()], np.int64)[local], first, local

    def joined(self, at, of, sentences: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, sentence of a block, hits, weight) of the pairs that share one of the shingles ``at``, which stand in the sentences ``of``."""
        n = self.size[at]
        # sentences in portions of a bounded number of pairs; a sentence is whole in one
        cuts = np.cumsum(np.bincount(of, n, sentences)).astype(np.int64) // HITS
        for part in np.unique(cuts[of]) if len(of) else ():
            own = cuts[of] == part
            a, c, k = at[own], of[own], n[own]
            which = np.repeat(np.arange(len(a)), k)
            q = self.post[np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k) + self.start[a][which]]
            pair = q * sentences + c[which]
            order = np.argsort(pair)
            pair, w = pair[order], self.weight[a][which[order]]
            if not len(pair):
                continue
            starts = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            yield pair[starts] // sentences, pair[starts] % sentences, np.diff(np.concatenate([starts, [len(pair)]])), np.add.reduceat(w, starts)

    def similar(self, q, hits, shared, nc) -> np.ndarray:
        """Similarity in ten-thousandths, whatever the gates."""
        coverage = np.floor(shared / self.total[q] * 10**9 + 0.5) / 10**9
        return np.floor(np.minimum(hits / np.minimum(self.nq[q], nc), 0.5 + 0.5 * coverage) * 10**4 + 0.5).astype(np.int64)

    def counts(self, folder: str, lead: np.ndarray) -> np.ndarray:
        """How many of the library's sentences that ``lead`` marks have each similarity (in ten-thousandths) with the queries.

        All pairs are first taken to share their template shingles only, which
        is counted by groups; those that share others are then moved. Weights of
        template shingles are multiples of 2 ** -36, so that sums are exact and
        the same both times.
        """
        self.weigh(folder)
        heavy = np.rint(self.heavy * 2.0**36)
        out = np.zeros(10_001, np.int64)
        numbers: dict[int, int] = {}
        sets: list[np.ndarray] = []
        members: dict[tuple[int, int], int] = {}  # sentences by group and shingles
        seen = 0
        for doc, _, d, sizes in _blocks(folder):
            kept = lead[seen : seen + len(doc)]
            seen += len(doc)
            hit, at = self.lookup(d)
            of = np.repeat(np.arange(len(doc)), sizes)[hit]
            at, of = at[kept[of]], of[kept[of]]
            t = self.template[at]
            group, first, local = self.number(of, t, len(doc), numbers, sets)
            here = np.array(sets)[group[first]]
            both, both_w = self.held @ here.T, (self.held * heavy) @ here.T / 2.0**36
            alike, n = np.unique(np.stack([group[kept], sizes[kept]]), axis=1, return_counts=True)
            for g, nc, k in zip(*alike.tolist(), n.tolist(), strict=True):
                members[g, nc] = members.get((g, nc), 0) + k
            for q, c, hits, w in self.joined(at[t < 0], of[t < 0], len(doc)):
                hits_t, w_t = both[self.group[q], local[c]], both_w[self.group[q], local[c]]
                out += np.bincount(self.similar(q, hits + hits_t, w + w_t, sizes[c]), minlength=len(out))
                met = hits_t > 0
                out -= np.bincount(self.similar(q[met], hits_t[met], w_t[met], sizes[c[met]]), minlength=len(out))
        held = np.array(list(members), np.int64).reshape(-1, 2)
        many, sets = np.array(list(members.values()), np.int64), np.array(sets).reshape(len(sets), self.held.shape[1])
        both, both_w = self.held @ sets.T, (self.held * heavy) @ sets.T / 2.0**36
        by_group = np.argsort(self.group, kind="stable")
        for rows in np.split(by_group, np.flatnonzero(np.diff(self.group[by_group])) + 1):
            g = self.group[rows[0]]
            near = np.flatnonzero(both[g][held[:, 0]])
            for k in range(0, len(rows) if len(near) else 0, max(1, HITS // max(1, len(near)))):
                some = rows[k : k + max(1, HITS // len(near))]
                q, m = np.repeat(some, len(near)), np.tile(near, len(some))
                sim = self.similar(q, both[g][held[m, 0]], both_w[g][held[m, 0]], held[m, 1])
                out += np.rint(np.bincount(sim, many[m], len(out))).astype(np.int64)
        return out

    def pairs(self, folder: str, lead: np.ndarray, norms: pa.Array) -> Iterator[pa.RecordBatch]:
        """(query, candidate, hits, containment, coverage) of all pairs with the library's sentences that ``lead`` marks.

        A candidate's pairs follow each other: it is then one run in the column that would else be nearly all of the result's bytes.
        """
        self.weigh(folder, np.inf)
        seen = 0
        rounded = lambda x, digits: np.floor(x * 10**digits + 0.5) / 10**digits
        for doc, _, d, sizes, told in _blocks(folder, "norm"):
            kept = lead[seen : seen + len(doc)]
            seen += len(doc)
            hit, at = self.lookup(d)
            of = np.repeat(np.arange(len(doc)), sizes)[hit]
            for q, c, hits, shared in self.joined(at[kept[of]], of[kept[of]], len(doc)):
                order = np.argsort(c, kind="stable")
                for k in range(0, len(q), LISTED):
                    i, j, h, w = (x[order[k : k + LISTED]] for x in (q, c, hits, shared))
                    numbers = (h, rounded(h / np.minimum(self.nq[i], sizes[j]), 6), rounded(rounded(w / self.total[i], 9), 6))
                    yield pa.RecordBatch.from_arrays([norms.take(pa.array(i)), told.take(pa.array(j)), *map(pa.array, numbers)], ["query", "candidate", "hits", "containment", "coverage"])

    def nearest(self, blocks: list) -> tuple[np.ndarray, np.ndarray]:
        """(greatest containment in ten-thousandths, -1 where none reaches the floor; least document that has it) of each query."""
        self.weigh(blocks, LEAST // 5)
        best, page = np.full(len(self.ids), -1), np.full(len(self.ids), np.iinfo(np.int64).max)

        def take(q, hits, nc, doc) -> None:
            v = np.floor(hits / np.minimum(self.nq[q], nc) * 10**4 + 0.5).astype(np.int64)
            good = (v / 10**4 >= self.floor[q]) & (v >= best[q])
            q, v, doc = q[good], v[good], doc[good]
            first = _first(np.lexsort((doc, -v, q)), q, 1)
            q, v, doc = q[first], v[first], doc[first]
            better = (v > best[q]) | (doc < page[q])
            best[q[better]], page[q[better]] = v[better], doc[better]

        numbers: dict[int, int] = {}
        sets: list[np.ndarray] = []
        members: list[tuple[np.ndarray, np.ndarray]] = []  # (group and shingles, document)
        for doc, _, d, sizes in blocks:
            hit, at = self.lookup(d)
            of = np.repeat(np.arange(len(doc)), sizes)[hit]
            t = self.template[at]
            group, first, local = self.number(of, t, len(doc), numbers, sets)
            both = self.held @ np.array(sets)[group[first]].T
            members.append((group << 32 | sizes, doc))
            for q, c, hits, _ in self.joined(at[t < 0], of[t < 0], len(doc)):
                take(q, hits + both[self.group[q], local[c]], sizes[c], doc[c])
        if not members or not self.held.shape[1]:
            return best, page
        # those that share template shingles only, by groups; for the others it is no more than what they have
        key, doc = (np.concatenate(x) for x in zip(*members, strict=True))
        first = _first(np.lexsort((doc, key)), key, 1)
        group, nc, doc = key[first] >> 32, key[first] & 0xFFFFFFFF, doc[first]
        both = self.held @ np.array(sets).reshape(len(sets), self.held.shape[1]).T
        by_group = np.argsort(self.group, kind="stable")
        for rows in np.split(by_group, np.flatnonzero(np.diff(self.group[by_group])) + 1):
            hits = both[self.group[rows[0]]][group]
            near = np.flatnonzero(hits)
            for k in range(0, len(rows) if len(near) else 0, max(1, HITS // max(1, len(near)))):
                some = rows[k : k + max(1, HITS // len(near))]
                m = np.tile(near, len(some))
                take(np.repeat(some, len(near)), hits[m], nc[m], doc[m])
        return best, page

    def best(self, folder: str) -> pa.RecordBatch | None:
        self.weigh(folder)
        none = lambda *kinds: tuple(np.zeros(0, k) for k in kinds)
        state = none(np.int64, np.int64, np.int64, float)  # query, hits, rank, similarity
        least = np.zeros(len(self.ids), np.int64)  # hits of the last that counts
        members = none(np.int64, np.int64, np.int64)  # group, rank, shingles
        numbers: dict[int, int] = {}  # groups of the library by their set
        sets: list[np.ndarray] = []
        waiting, size, seen, lasting = [], 0, 0, 0
        for doc, _, d, sizes in _blocks(folder):
            rank = self.rank[seen : seen + len(doc)]
            seen += len(doc)
            hit, at = self.lookup(d)
            of = np.repeat(np.arange(len(doc)), sizes)[hit]
            t = self.template[at]
            group, first, local = self.number(of, t, len(doc), numbers, sets)
            # pairs of groups of this block
            here = np.array(sets)[group[first]]
            both, both_w = self.held @ here.T, (self.held * self.heavy) @ here.T
            some = np.flatnonzero(here.any(axis=1)[local])
            members = tuple(np.concatenate(x) for x in zip(members, (group[some], rank[some], sizes[some]), strict=True))
            if len(members[0]) > 2 * lasting + 5 * SENTENCES:
                first = _first(np.lexsort((members[1], members[0])), members[0], K.RECALL_CUT)
                members = tuple(x[first] for x in members)
                lasting = len(first)
            at, of = at[t < 0], of[t < 0]
            for q, c, hits, w in self.joined(at, of, len(doc)):
                hits = hits + both[self.group[q], local[c]].astype(np.int64)
                w = w + both_w[self.group[q], local[c]]
                good = hits >= least[q]
                q, c, hits, w = q[good], c[good], hits[good], w[good]
                waiting.append((q, hits, rank[c], self.passed(q, hits, w, sizes[c])))
                size += len(q)
                if size > HITS // 2:
                    state, least = self.cut([state, *waiting], least)
                    waiting, size = [], 0
        first = _first(np.lexsort((members[1], members[0])), members[0], K.RECALL_CUT)
        members = tuple(x[first] for x in members)
        state, least = self.cut([state, *waiting], least)
        return self.finish(state, least, members, np.array(sets).reshape(len(sets), self.held.shape[1]))

    def cut(self, parts: list, least: np.ndarray):
        """The first 200 of each query, by hits, document and sentence."""
        found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        kept = _first(_order(*found[:3]), found[0], K.RECALL_CUT)
        state = tuple(x[kept] for x in found)
        full = np.bincount(state[0], minlength=len(least)) >= K.RECALL_CUT
        lowest = np.full(len(least), np.iinfo(np.int64).max)
        np.minimum.at(lowest, state[0], state[1])
        return state, np.where(full, lowest, 0)

    def finish(self, state, least, members, sets) -> pa.RecordBatch | None:
        """Sentences met by template shingles alone join the others; ranks, gates and the best three documents."""
        both, both_w = self.held @ sets.T, (self.held * self.heavy) @ sets.T
        hopeful = np.zeros(len(self.ids), bool)
        hopeful[state[0][state[3] >= 0]] = True
        ends = np.searchsorted(state[0], np.arange(len(self.ids) + 1))
        out = []
        by_group = np.argsort(self.group, kind="stable")
        for rows in np.split(by_group, np.flatnonzero(np.diff(self.group[by_group])) + 1):
            g = self.group[rows[0]]
            hits = both[g][members[0]].astype(np.int64)
            near = np.flatnonzero(hits)
            near = near[np.lexsort((members[1][near], -hits[near]))[: K.RECALL_CUT]]
            hits, rank, nc, w = hits[near], members[1][near], members[2][near], both_w[g][members[0][near]]
            # what no sentence of the group can pass for, by the greatest weight and hits, needs no ranks
            bound = self.passed(rows, hits.max(), w.max() * (1 + 1e-9), nc.min()) >= 0 if len(near) else False
            rows = rows[hopeful[rows] | bound]
            for k in range(0, len(rows), 500):
                some = rows[k : k + 500]
                # without a sentence that passes, ranks do not matter
                qs, m = np.repeat(some, len(near)), np.tile(np.arange(len(near)), len(some))
                sim = self.passed(qs, hits[m], w[m], nc[m])
                own = hopeful[some] | (np.maximum.reduceat(sim, np.arange(len(some)) * len(near)) >= 0 if len(near) else False)
                some = some[own]
                if not len(some):
                    continue
                keep = np.isin(qs, some) & (hits[m] >= least[qs])
                n = ends[some + 1] - ends[some]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[some], n)
                found = [np.concatenate(x) for x in zip([x[at] for x in state], (qs[keep], hits[m[keep]], rank[m[keep]], sim[keep]), strict=True)]
                # a sentence that is met both ways has more hits where other shingles count too
                order = np.lexsort((-found[1], found[0] * len(self.rank) + found[2]))
                q, h, r, s = (x[order] for x in found)
                new = np.ones(len(q), bool)
                new[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
                q, h, r, s = (x[new] for x in (q, h, r, s))
                kept = _first(_order(q, h, r), q, K.RECALL_CUT)
                out.append([x[kept[s[kept] >= 0]] for x in (q, r, s)])
        if not out:
            return None
        q, r, s = (np.concatenate(x) for x in zip(*out, strict=True))
        d, i = self.doc[self.sorted[r]], self.idx[self.sorted[r]]
        order = np.lexsort((np.arange(len(q)), d, q))
        lead = np.ones(len(q), bool)
        lead[1:] = (q[order][1:] != q[order][:-1]) | (d[order][1:] != d[order][:-1])
        lead = np.sort(order[lead])
        lead = _first(lead[np.lexsort((lead, q[lead]))], q, K.TOP_SOURCES)
        lead = lead[np.lexsort((lead, -s[lead], q[lead]))]
        q, d, i, s = q[lead], d[lead], i[lead], s[lead]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(q)]]))) + 1
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(place.astype(np.int32)), pa.array(d), pa.array(i.astype(np.int32)), pa.array(s)], ["qid", "place", "doc_id", "sent_idx", "sim"])


def _classes(query: DataFrame, most: int = QUERIES) -> DataFrame:
    """(qid, kind, norm, units) of queries, equal ones in one task, which has about ``most`` at most."""
    parts = max(query.sparkSession.sparkContext.defaultParallelism, -(-query.count() // most))
    return query.select(norm_id(F.col("kind"), F.col("norm")).alias("qid"), "kind", "norm", "units").repartition(parts, "qid")


def _held(batches: Iterator[pa.RecordBatch], least: int = K.MIN_SENT_UNITS, norms: bool = False) -> Iterator[tuple]:
    """(qid, is it Chinese, digests, sizes) of a task's query classes with shingles, a block at a time, and their normal forms if asked for."""
    if not (batches := [b for b in batches if b.num_rows]):
        return
    t = pa.Table.from_batches(batches)
    t = t.take(np.unique(t["qid"].to_numpy(), return_index=True)[1])
    for k in range(0, t.num_rows, 2 * QUERIES):
        b = t.slice(k, 2 * QUERIES)
        kinds = b["kind"].to_pylist()
        d, sizes = digests(b["norm"].to_pylist(), kinds, b["units"].to_numpy(), least)
        some = sizes > 0
        if some.any():
            told = (b["norm"].combine_chunks().take(pa.array(np.flatnonzero(some))),) if norms else ()
            yield b["qid"].to_numpy()[some], np.array([x == "zh" for x in kinds])[some], d, sizes[some], *told


def best_documents(query: DataFrame, library: DataFrame, documents: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``similarity.best_documents``."""
    folder, n = folder_of(digested(library) if held is None else held), documents.count()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, zh, d, sizes in _held(batches) if folder else ():
            out = _Queries(ids, zh, d, sizes, n).best(folder)
            if out is not None:
                yield out

    return _classes(query).mapInArrow(found, "qid bigint, place int, doc_id bigint, sent_idx int, sim double")


def similarities(query: DataFrame, library: DataFrame, documents: DataFrame) -> DataFrame:
    """(sim, pairs): how many pairs of sentence classes that share a shingle have each blended similarity. Pairs are counted where they arise; a library's document has its sentences together."""
    classed = with_digests(library).select("doc_id", "idx", norm_id(F.col("kind"), F.col("norm")).alias("cid"), "shingles")
    folder, n = folder_of(stored(classed)), documents.count()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for ids, zh, d, sizes in _held(batches) if folder else ():
            lead = _leads(folder) if lead is None else lead
            pairs = _Queries(ids, zh, d, sizes, n).counts(folder, lead)
            some = np.flatnonzero(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(some / 10**4), pa.array(pairs[some])], ["sim", "pairs"])

    return _classes(query).mapInArrow(found, "sim double, pairs bigint").groupBy("sim").agg(F.sum("pairs").alias("pairs"))


def listed(query: DataFrame, library: DataFrame, documents: DataFrame) -> DataFrame:
    """(query, candidate, hits, containment, coverage): ``similarity.candidates`` by normal forms, rounded. Pairs leave their task as rows of the result; a library's document has its sentences together."""
    classed = with_digests(library).select("doc_id", "idx", norm_id(F.col("kind"), F.col("norm")).alias("cid"), "norm", "shingles")
    folder, n = folder_of(stored(classed)), documents.count()

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = None
        for ids, zh, d, sizes, norms in _held(batches, norms=True) if folder else ():
            lead = _leads(folder) if lead is None else lead
            yield from _Queries(ids, zh, d, sizes, n).pairs(folder, lead, norms)

    return _classes(query, LISTING).mapInArrow(found, "query string, candidate string, hits bigint, containment double, coverage double")


#: Sentences of pages, characters of their normal forms, that are looked through at once.
PAGE_SENTENCES, PAGE_CHARS = 200_000, 4_000_000


def _read(folder: str) -> Iterator[pa.RecordBatch]:
    """A stored table, some rows at a time."""
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    for info in sorted(fs.get_file_info(pyarrow.fs.FileSelector(path)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(QUERIES)


def _best(ids: np.ndarray, pages: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pages), pa.array(sims)], ["qid", "page_id", "sim"])


def nearest_pages(query: DataFrame, sents: DataFrame) -> DataFrame:
    """(qid, page_id, sim): the best containment of each class of ``query`` (qid, kind, norm, units), stored, among the sentences of pages
    (doc_id, kind, norm, units), with the least page that has it; some rows for each class. Every task counts its own pages' sentences, none are written."""
    folder = folder_of(query)

    def met(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for b in held:
            for k in range(0, b.num_rows, SENTENCES):
                x = b.slice(k, SENTENCES)
                d, sizes = digests(x["norm"].to_pylist(), x["kind"].to_pylist(), x["units"].to_numpy(zero_copy_only=False))
                blocks.append((x["doc_id"].to_numpy(), np.arange(x.num_rows), d, sizes))
        for block in _held(_read(folder), 4):
            best, page = (q := _Queries(*block, 1)).nearest(blocks)
            some = np.flatnonzero(best >= 0)
            yield _best(q.ids[some], page[some], best[some] / 10**4)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size > PAGE_SENTENCES:
                yield from met(held)
                held, size = [], 0
        if size:
            yield from met(held)

    told = sents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "kind", "norm", "units")
    return told.mapInArrow(found if folder else lambda _: iter(()), "qid bigint, page_id bigint, sim double")


class _Probes:
    """Query classes of one kind and the shingles that a page must have to hold them whole: where words are cut the first and the last may differ."""

    def __init__(self, ids: np.ndarray, norms: list[str], zh: bool):
        self.ids, self.norms, self.zh = ids, norms, zh
        inner = norms if zh else [" ".join(x.split(" ")[1:-1]) for x in norms]
        d, row = runs(inner, zh)
        enough = np.array([len(x) >= K.ZH_SHINGLE if zh else x.count(" ") >= K.EN_SHINGLE - 1 for x in inner], bool)
        d, row = d[enough[row]], row[enough[row]]
        self.bare = np.flatnonzero(~enough)
        self.known, self.at = np.unique(d, return_inverse=True)
        self.starts = np.flatnonzero(np.diff(row, prepend=-1))
        self.row = row[self.starts]
        self.lookup = _Lookup(self.known) if len(self.known) else None

    def holders(self, pages: np.ndarray, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(query, page) for all texts that hold a query's normal form. The shingle that is rarest in these texts names them."""
        for q in self.bare.tolist():
            yield from ((q, int(p)) for p, x in zip(pages, texts, strict=True) if self.norms[q] in x)
        if self.lookup is None:
            return
        d, row = runs(texts, self.zh)
        hit, at = self.lookup(d)
        count = np.bincount(at, minlength=len(self.known))
        rarest = np.minimum.reduceat(count[self.at] * len(self.known) + self.at, self.starts)
        some = np.flatnonzero(rarest >= len(self.known))  # all shingles are there
        probe, q = rarest[some] % len(self.known), self.row[some]
        order = np.argsort(probe, kind="stable")
        probe, q = probe[order], q[order]
        size = np.bincount(probe, minlength=len(self.known))
        n = size[at]
        of = np.repeat(row[hit], n)
        first = (np.cumsum(size) - size)[at]
        who = q[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
        for pair in np.unique(who * len(texts) + of).tolist():
            if self.norms[pair // len(texts)] in texts[pair % len(texts)]:
                yield pair // len(texts), int(pages[pair % len(texts)])


def runs(texts: list[str], zh: bool) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the shingles of normal forms, repeated ones too, and their rows."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if zh:
        d, row = _windows(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(_U), np.array([len(x) for x in texts]), K.ZH_SHINGLE)
    else:
        coded = [x.encode() + b" " for x in texts]
        d, row = _windows(*_words(b"".join(coded), np.cumsum([len(x) for x in coded])), K.EN_SHINGLE)
    return d.view(np.int64), row


def holding_pages(query: DataFrame, pages: DataFrame) -> DataFrame:
    """(qid, page_id, sim): 1 for the least page, of a task's share, whose normal form (page_id, kind, page_norm) holds a class of ``query`` (qid, kind, norm, units), stored, whole."""
    folder = folder_of(query)

    def asked() -> Iterator[_Probes]:
        for b in _read(folder):
            ids, kinds, norms = b["qid"].to_numpy(), b["kind"].to_pylist(), b["norm"].to_pylist()
            for kind in ("zh", "en"):
                own = [k for k, x in enumerate(norms) if kinds[k] == kind and len(x) >= K.WEB_MIN_CHARS]
                if own:
                    yield _Probes(ids[own], [norms[k] for k in own], kind == "zh")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probes = None
        for b in batches:
            ids, kinds, norms = b["page_id"].to_numpy(), b["kind"].to_pylist(), b["page_norm"].to_pylist()
            if probes is None:
                # more than one block of classes is made again for each batch
                first = [*zip(asked(), range(3), strict=False)]
                probes = [p for p, _ in first] if len(first) < 3 else []
            part = np.cumsum([len(x) for x in norms]) // PAGE_CHARS
            for p in probes or asked():
                least: dict[int, int] = {}
                for k in np.unique(part).tolist():
                    own = [i for i in np.flatnonzero(part == k).tolist() if (kinds[i] == "zh") == p.zh]
                    for q, page in p.holders(ids[own], [norms[i] for i in own]):
                        least[q] = min(page, least.get(q, page))
                if least:
                    q = np.array([*least])
                    yield _best(p.ids[q], np.array([*least.values()]), np.ones(len(q)))

    told = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "kind", "page_norm")
    return told.mapInArrow(found if folder else lambda _: iter(()), "qid bigint, page_id bigint, sim double")
