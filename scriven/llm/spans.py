"""Long exact spans shared between records (problem 1).

Seeds are k-mers picked by content: of every window of k-mers that a span of
the least length covers, the one of least hash. Two records that share such a
span share its seed. Records that share seeds are joined into pairs, the
matches of a pair are extended to maximal runs, ordered matches are chained
with gap costs through a Fenwick tree, and the gaps of each chain are aligned,
which gives exact runs and the fuzzy passages around them.

A seed that stands in two or three records names its pairs at once. A seed in
more records is refined: its records are classed by each whole window of the
least length around it, and every member of a class is paired with a
representative of the class. That is linear in the records of the seed and
every record's shared window has a partner that shares it too. The links
between other members of a class are not listed pair by pair, which would grow
with the square of its records: ``shared_members`` gives every place of every
member with the place in the class's head that it equals, and ``links`` makes
all pairs of that.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Least length of an exact span, and the length of a seed; a span of LEAST covers LEAST - SEED + 1 seeds.
LEAST, SEED = 160, 80
#: Members that a representative of a class stands for, on average: classes have as many representatives as that needs.
MEMBERS = 32
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_MOST = np.uint64(2**64 - 1)


def _inverse(root: int) -> int:
    return pow(root, -1, 2**64)


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(29))


_POWERS: list[np.ndarray] = []  # built once per process, longer ones when a longer text comes: powers of the root, and of its inverse


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(1 << 16, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            for k, root in enumerate((int(_ROOT), _inverse(int(_ROOT)))):
                powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, root, np.uint64)]), dtype=np.uint64)
                _POWERS[k : k + 1] = [powers]
    return _POWERS[0][: n + 1], _POWERS[1][: n + 1]


class Hashes:
    """Hashes of all substrings of fixed lengths of a row of characters."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        with np.errstate(over="ignore"):
            power, self.back = _powers(n)
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64)])

    def of(self, length: int, salt: int) -> np.ndarray:
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return _mix((self.sums[length:] - self.sums[:n]) * self.back[:n], salt)


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over each run of ``width`` values."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = pick(out[: len(out) - reach], out[reach:])
        reach *= 2
    rest = width - reach
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


class Windows:
    """Seeds and windows of texts laid side by side."""

    def __init__(self, texts: list[str], least: int = LEAST, seed: int = SEED):
        length = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(length) - length
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.hashes = Hashes(codes)
        h = self.hashes.of(seed, 1)
        width = least - seed + 1
        self.least = least
        count = len(codes) - least + 1  # windows, those that run over the end of a text included
        if count <= 0:
            self.seeds = self.minima = np.zeros(0, np.uint64)
            self.owner = self.places = np.zeros(0, np.int64)
            self.valid = np.zeros(0, bool)
            return
        self.minima = _sliding(h, width, np.minimum)
        text_of = np.repeat(np.arange(len(texts)), length)
        self.owner = text_of[:count]
        self.valid = text_of[:count] == text_of[least - 1 :]
        # a seed is picked when it is the least of some valid window over it: the greatest of their minima equals it
        low = np.where(self.valid, self.minima, np.uint64(0))
        around = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, np.maximum)
        self.places = np.flatnonzero(around[: len(h)] == h)
        self.seeds = h[self.places]
        self.seed_owner = text_of[self.places]


def shared_runs(a: str, b: str, least: int = LEAST, seed: int = SEED, short: bool = True) -> list[tuple[int, int, int]]:
    """Maximal exact runs (start in a, start in b, length): every stretch of either text that the other holds, with one place there.

    Whole windows of ``least`` characters are looked up first; with ``short``, then the
    picked seeds that no run covers. Of several places the one is taken whose
    diagonal is nearest to that of the run before, or the first if it reaches further. So runs and work are
    linear in the texts however often they repeat themselves.
    """
    w = Windows([a, b], least, seed) if short else None
    hashes = w.hashes if w else Hashes(np.frombuffer((a + b).encode("utf-32-le", "surrogatepass"), np.uint32))
    whole = hashes.of(least, 3)
    # without the windows that run from one text into the other
    x, y = whole[: max(0, len(a) - least + 1)], whole[len(a) :]
    runs: set[tuple[int, int, int]] = set()
    # what the first side finds nothing of, the second need not look for
    if _one_side(a, b, np.arange(len(x)), x, np.arange(len(y)), y, least, runs, False):
        _one_side(b, a, np.arange(len(y)), y, np.arange(len(x)), x, least, runs, True)
    if w and len(w.places):
        cut = np.searchsorted(w.places, len(a))
        p, q = w.places[:cut], w.places[cut:] - len(a)
        if _one_side(a, b, p, w.seeds[:cut], q, w.seeds[cut:], seed, runs, False):
            _one_side(b, a, q, w.seeds[cut:], p, w.seeds[:cut], seed, runs, True)
    return sorted(runs)


def _one_side(s: str, t: str, p: np.ndarray, hp: np.ndarray, q: np.ndarray, hq: np.ndarray, size: int, runs: set[tuple[int, int, int]], turned: bool) -> bool:
    """Adds a run for each stretch of ``size`` characters of s, at places p with hashes hp, that t holds at a place of q and no run of s covers.

    Whether the two have any hash in common.
    """
    if not len(p) or not len(q):
        return False
    order = np.argsort(hq, kind="stable")
    sorted_q, places = hq[order], q[order]
    low = np.searchsorted(sorted_q, hp)
    met = np.flatnonzero(sorted_q[np.minimum(low, len(sorted_q) - 1)] == hp)
    if not len(met):
        return False
    high = np.searchsorted(sorted_q, hp[met], "right")
    covers = sorted((j, j + n) if turned else (i, i + n) for i, j, n in runs)
    at, covered, diagonal, k = 0, -1, 0, 0
    place = p[met]
    while k < len(met):
        here = int(place[k])
        while at < len(covers) and covers[at][0] <= here:
            covered = max(covered, covers[at][1])
            at += 1
        if here + size <= covered:
            k = max(k + 1, int(np.searchsorted(place, covered - size + 1)))
            continue
        some = places[low[met[k]] : high[k]]
        near = int(np.searchsorted(some, here + diagonal))
        near = min((n for n in (near - 1, near) if 0 <= n < len(some)), key=lambda n: abs(int(some[n]) - here - diagonal))
        # the first place, which has most of the other text behind it, where it reaches further
        best = (0, 0)
        for there in dict.fromkeys((int(some[near]), int(some[0]))):
            if s[here : here + size] == t[there : there + size]:
                best = max(best, (size + _common(s, t, here + size, there + size, 1), there if there == int(some[near]) else -1 - there))
        if best[0]:
            n, there = best[0], best[1] if best[1] >= 0 else -1 - best[1]
            back = _common(s, t, here, there, -1)
            runs.add((there - back, here - back, back + n) if turned else (here - back, there - back, back + n))
            covered, diagonal = max(covered, here + n), there - here
        k += 1
    return True


def _common(a: str, b: str, p: int, q: int, way: int) -> int:
    """Length of the common stretch of a from p and b from q, forwards (way 1) or backwards (-1)."""
    most = min(len(a) - p, len(b) - q) if way > 0 else min(p, q)
    got, step = 0, 64
    while got < most:
        n = min(step, most - got)
        x, y = (a[p + got : p + got + n], b[q + got : q + got + n]) if way > 0 else (a[p - got - n : p - got], b[q - got - n : q - got])
        if x == y:
            got += n
            step *= 2
        elif n == 1:
            break
        else:
            step = max(1, n // 2)
            most = got + n  # the first difference lies in this stretch
    return got


def chains(runs: list[tuple[int, int, int]], gap_cost: float = 0.5) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of runs, best first; every run is in one chain.

    A run may follow another that ends before it in both texts. A chain scores
    its matched characters less ``gap_cost`` per skipped character of either
    text. Scores of ended runs sit in a Fenwick tree of maxima over their ends
    in the second text, so each run finds its best predecessor in log time.
    """
    ends = sorted({j + n for _, j, n in runs})
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (len(ends) + 1)
    score = [0.0] * len(runs)
    before = [-1] * len(runs)
    # at one place runs end before others start
    events = sorted([(i, 1, k) for k, (i, _, _) in enumerate(runs)] + [(i + n, 0, k) for k, (i, _, n) in enumerate(runs)])
    for _, starts, k in events:
        i, j, n = runs[k]
        if starts:
            at, best = bisect_left(ends, j + 1), (-1e18, -1)
            while at:
                best = max(best, tree[at])
                at &= at - 1
            value = best[0] - gap_cost * (i + j)
            score[k], before[k] = (n + value, best[1]) if value > 0 else (float(n), -1)
        else:
            entry = (score[k] + gap_cost * (i + n + j + n), k)
            at = bisect_left(ends, j + n) + 1
            while at < len(tree):
                tree[at] = max(tree[at], entry)
                at += at & -at
    used = [False] * len(runs)
    out = []
    for k in sorted(range(len(runs)), key=lambda k: (-score[k], k)):
        chain, at = [], k
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(runs[at])
            at = before[at]
        if chain:
            out.append(chain[::-1])
    return out


def _gap_matches(a: str, b: str) -> int:
    """Characters aligned as equal in the gap of a chain: its longest common subsequence."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return 0
    # bit-parallel: one integer holds a row of the alignment table
    mask: dict[str, int] = {}
    for k, c in enumerate(a):
        mask[c] = mask.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & mask.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def passages(a: str, b: str, fuzzy: bool = True) -> list[tuple[int, int, int, int, float, list[tuple[int, int, int]]]]:
    """(start_a, end_a, start_b, end_b, identity, runs) of each chain of two texts; without ``fuzzy``, of runs of ``LEAST`` characters, gaps not aligned."""
    out = []
    for chain in chains(shared_runs(a, b, short=fuzzy)):
        same = sum(n for _, _, n in chain)
        for (i, j, n), (k, m, _) in zip(chain, chain[1:], strict=False):
            same += _gap_matches(a[i + n : k], b[j + n : m]) if fuzzy else 0
        i, j, _ = chain[0]
        k, m, n = chain[-1]
        out.append((i, k + n, j, m + n, same / max(k + n - i, m + n - j), chain))
    return out


def texts_of(library: DataFrame, checks: DataFrame) -> DataFrame:
    """(tab, rec_id, text) of the records: library texts and stored reports, without nulls."""
    a = library.select(F.lit("library_docs").alias("tab"), F.col("id").cast("string").alias("rec_id"), F.col("content").alias("text"))
    b = checks.select(F.lit("checks").alias("tab"), F.col("id").alias("rec_id"), F.col("report").alias("text"))
    return a.unionByName(b).where(F.col("text").isNotNull())


def _blocks(batch: pa.RecordBatch, chars: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    texts = batch.column("text").to_pylist()
    begin, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > chars:
            yield begin, texts[begin : i + 1]
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, texts[begin:]


def _placed(numbers: np.ndarray, w: Windows, name: str, hashes: np.ndarray, owner: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    at = (places - w.start[owner]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(numbers[owner]), pa.array(at)], [name, "no", "place"])


def _seed_rows(batches: Iterator[pa.RecordBatch], placed: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column("no").to_numpy()
        for begin, texts in _blocks(batch):
            w = Windows(texts)
            if len(w.places) and placed:
                yield _placed(numbers[begin:], w, "seed", w.seeds, w.seed_owner, w.places)
            elif len(w.places):
                both = np.unique(np.stack([numbers[begin + w.seed_owner], w.seeds.view(np.int64)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], ["seed", "no"])


def _window_rows(batches: Iterator[pa.RecordBatch], placed: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers = batch.column("no").to_numpy()
        wanted = batch.column("seeds")
        for begin, texts in _blocks(batch):
            w = Windows(texts)
            if not len(w.places):
                continue
            part = wanted.slice(begin, len(texts))
            flat = part.flatten().to_numpy().view(np.uint64)
            # seeds wanted of one text may be plain in another: the owner is checked too
            owner = np.repeat(np.arange(len(texts)), np.diff(part.offsets.to_numpy()))
            pairs = set(zip(owner.tolist(), flat.tolist(), strict=True))
            near = np.flatnonzero(w.valid & np.isin(w.minima, flat))
            keep = [k for k, o, m in zip(near.tolist(), w.owner[near].tolist(), w.minima[near].tolist(), strict=True) if (o, m) in pairs]
            if keep and placed:
                kept = np.array(keep)
                yield _placed(numbers[begin:], w, "window", w.hashes.of(w.least, 2)[kept], w.owner[kept], kept)
            elif keep:
                whole = w.hashes.of(w.least, 2)[keep].view(np.int64)
                both = np.unique(np.stack([numbers[begin + w.owner[keep]], whole], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 1]), pa.array(both[:, 0])], ["window", "no"])


def record_pairs(texts: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(a, b), a < b: pairs of record numbers that between them show every shared span of every record.

    ``texts`` has (no, text); rows may repeat. Seeds are counted by
    aggregation; only seeds in four or more rows go through windows. No pair
    of a class is formed but those with a representative. With ``fuzzy``, such
    seeds are classes too, for records that share no whole window.
    """
    seeds = stored(texts.mapInArrow(_seed_rows, "seed bigint, no bigint"))
    counted = seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min("no").alias("low"), F.max("no").alias("high"), F.expr("bit_xor(no)").alias("all"))
    counted = stored(counted.where("low <> high"))
    # of three rows the third is what the least and the greatest leave of the sum
    middle = F.when(F.col("n") == 3, F.col("all").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))).otherwise(F.col("low"))
    ends = [("low", "high"), ("low", "mid"), ("mid", "high")]
    few = counted.where("n <= 3").withColumn("mid", middle)
    few = few.select(F.explode(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ends])).alias("p")).select("p.x", "p.y")
    wanted = seeds.join(counted.where("n > 3").select("seed"), "seed", "left_semi")
    # the seeds of one record: bounded by its length
    held = wanted.groupBy("no").agg(F.collect_set("seed").alias("seeds"))
    windows = stored(texts.join(held, "no").select("no", "seeds", "text").mapInArrow(_window_rows, "window bigint, no bigint"))
    if fuzzy:
        windows = windows.unionByName(wanted.select(F.col("seed").alias("window"), "no"))
    # most windows stand once: they leave before anything else is made of them. A hot window is one row here, and the join with it, which
    # goes to storage, is one whose skewed partitions the adaptive planner splits
    several = windows.groupBy("window").agg(F.count("*").alias("n"), F.min("no").alias("low"), F.max("no").alias("high")).where("low <> high")
    bucket = F.pmod(F.xxhash64("no"), F.ceil(F.col("n") / MEMBERS)).alias("bucket")
    members = stored(windows.join(several, "window").select("window", "no", "low", "high", bucket))
    heads = members.groupBy("window", "bucket").agg(F.min("no").alias("near"), F.max("no").alias("far"))
    joined = members.join(heads, ["window", "bucket"])
    # one that is alone in its bucket, which is rare beyond two buckets, is paired with an end of the class
    near, far, low = (F.when(F.col(c) != F.col("no"), F.col(c)) for c in ("near", "far", "low"))
    partner = F.coalesce(near, far, low, F.col("high"))
    many = joined.select(F.col("no").alias("x"), partner.alias("y"))
    return few.unionByName(many).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def shared_members(records: DataFrame) -> DataFrame:
    """(length, tab, rec_id, start_pos, end_pos, head_tab, head_id, head_start): the members of all classes of records (tab, rec_id, text).

    Classes are the seeds in four or more rows (length ``SEED``) and the whole
    windows around them (``LEAST``) that stand in several records; the head of
    a class is one place of it. ``text[start_pos:end_pos]`` of a member equals
    the head's text from ``head_start``; places next to each other whose heads
    are so too are one row, and every place of a record has its row, the
    head's own included. So two members of one length and head share what
    their stretches of the head have in common, where that is at least
    ``length``: rows are linear in the text, and with the pairs of
    ``shared_passages`` no link is missing. Classes go by 64-bit digests.
    """
    rows = records.select("tab", "rec_id", "text").where(F.length("text") >= LEAST).withColumn("no", F.xxhash64("tab", "rec_id"))
    texts = rows.select("no", "text")
    # a class is one row after partial aggregation; the joins with classes go to storage or another shuffle, so the adaptive planner may split hot ones
    seeds = texts.mapInArrow(partial(_seed_rows, placed=True), "seed bigint, no bigint, place int")
    counted = seeds.groupBy("seed").agg(F.count("*").alias("n"), F.min("no").alias("low"), F.max("no").alias("high"))
    wanted = stored(seeds.join(counted.where("n > 3 AND low <> high").select("seed"), "seed", "left_semi"))
    # the seeds of one record: bounded by its length
    held = wanted.groupBy("no").agg(F.collect_set("seed").alias("seeds"))
    windows = texts.join(held, "no").select("no", "seeds", "text").mapInArrow(partial(_window_rows, placed=True), "window bigint, no bigint, place int")
    placed = windows.withColumn("length", F.lit(LEAST)).unionByName(wanted.withColumnRenamed("seed", "window").withColumn("length", F.lit(SEED)))
    members = stored(placed)
    heads = members.groupBy("length", "window").agg(F.min(F.struct("no", "place")).alias("head"), F.max("no").alias("far"))
    joined = members.join(heads.where("head.no <> far"), ["length", "window"])
    joined = joined.select("length", "no", "place", F.col("head.no").alias("head"), (F.col("place") - F.col("head.place")).alias("off"))
    # places of one record against one head on one diagonal: bounded by the record's length; repeated rows have equal ranks
    step = Window.partitionBy("length", "no", "head", "off").orderBy("place")
    runs = joined.withColumn("run", F.col("place") - F.dense_rank().over(step)).groupBy("length", "no", "head", "off", "run")
    runs = runs.agg(F.min("place").alias("start_pos"), (F.max("place") + F.col("length")).alias("end_pos"))
    named = rows.select("no", "tab", "rec_id").distinct()
    heads_named = named.select(F.col("no").alias("head"), F.col("tab").alias("head_tab"), F.col("rec_id").alias("head_id"))
    out = runs.join(named, "no").join(heads_named, "head")
    return out.select("length", "tab", "rec_id", "start_pos", "end_pos", "head_tab", "head_id", (F.col("start_pos") - F.col("off")).alias("head_start"))


def links(members: DataFrame) -> DataFrame:
    """(length, tab, rec_id, start_pos, other_tab, other_id, other_start, chars): every link between different records of ``shared_members``.

    Once from each side. This grows with the square of a class's records: take the members of the records asked for.
    """
    head = ["length", "head_tab", "head_id"]
    own = members.withColumn("head_end", F.expr("head_start + end_pos - start_pos"))
    other = own.select(*head, *[F.col(c).alias("o_" + c) for c in ("tab", "rec_id", "start_pos", "head_start", "head_end")])
    both = own.join(other, head).where("tab <> o_tab OR rec_id <> o_rec_id").withColumn("from_", F.greatest("head_start", "o_head_start"))
    both = both.withColumn("chars", F.least("head_end", "o_head_end") - F.col("from_")).where("chars >= length")
    start, other_start = F.expr("start_pos + from_ - head_start").alias("start_pos"), F.expr("o_start_pos + from_ - o_head_start").alias("other_start")
    return both.select("length", "tab", "rec_id", start, F.col("o_tab").alias("other_tab"), F.col("o_rec_id").alias("other_id"), other_start, "chars")


_OUT = (
    "tab string, rec_id string, other_tab string, other_id string, start_pos int, end_pos int, other_start int, other_end int, "
    "identity double, longest int, runs array<struct<start_pos:int,end_pos:int>>"
)


def _passage_rows(batches: Iterator[pa.RecordBatch], fuzzy: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("tab", pa.string()), ("rec_id", pa.string()), ("other_tab", pa.string()), ("other_id", pa.string())]
        + [(c, pa.int32()) for c in ("start_pos", "end_pos", "other_start", "other_end")]
        + [("identity", pa.float64()), ("longest", pa.int32())]
        + [("runs", pa.list_(pa.struct([("start_pos", pa.int32()), ("end_pos", pa.int32())])))]
    )
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            for i, k, j, m, identity, runs in passages(r["text_a"], r["text_b"], fuzzy):
                longest = max(n for _, _, n in runs)
                a, b = (r["tab_a"], r["id_a"]), (r["tab_b"], r["id_b"])
                for me, it, x, y, u, v, side in ((a, b, i, k, j, m, 0), (b, a, j, m, i, k, 1)):
                    out.append(
                        {"tab": me[0], "rec_id": me[1], "other_tab": it[0], "other_id": it[1], "start_pos": x, "end_pos": y, "other_start": u}
                        | {"other_end": v, "identity": identity, "longest": longest}
                        | {"runs": [{"start_pos": run[side], "end_pos": run[side] + run[2]} for run in runs if run[2] >= LEAST]}
                    )
            if len(out) > 2000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def shared_passages(records: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Chained passages between records (tab, rec_id, text), once from each side.

    Columns: the record, the other record, offsets in both, identity, the
    longest exact run and all runs of at least ``LEAST`` characters. Repeated
    rows are one record; a record is never compared with itself; null and
    short texts have no passage. Records are numbered by a 64-bit digest.

    Pairs are all those that share a seed of at most three rows. Of seeds in
    more rows they are links to representatives: every record of a shared
    window, and with ``fuzzy`` of a shared seed, has one. ``shared_members``
    has the other links.
    """
    # read again where it is needed, which moves less than a table of distinct texts
    rows = records.select("tab", "rec_id", "text").where(F.length("text") >= LEAST)
    texts = rows.select(F.xxhash64("tab", "rec_id").alias("no"), "tab", "rec_id", "text")
    pairs = record_pairs(texts.select("no", "text"), fuzzy)

    def side(x: str) -> DataFrame:
        # repeated rows are one before texts are compared, in the shuffle that the join needs anyway
        one = texts.groupBy("no").agg(*[F.min(c).alias(c) for c in ("tab", "rec_id", "text")])
        return one.select(F.col("no").alias(x), F.col("tab").alias(f"tab_{x}"), F.col("rec_id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").drop("a", "b")
    return both.mapInArrow(partial(_passage_rows, fuzzy=fuzzy), _OUT)


def shared_records(found: DataFrame) -> DataFrame:
    """(tab, rec_id) of the records with an exact run of at least ``LEAST`` characters."""
    return found.where(F.col("longest") >= LEAST).select("tab", "rec_id").distinct()


def shared_share(found: DataFrame, records: DataFrame) -> DataFrame:
    """(tab, rec_id, spans, shared_chars, chars, share): how much of each record stands verbatim elsewhere.

    Runs from different partners overlap; their union is taken by the running
    maximum of ends in order of starts. Records that share nothing have 0 spans.
    """
    runs = found.select("tab", "rec_id", F.explode("runs").alias("r")).select("tab", "rec_id", "r.start_pos", "r.end_pos").distinct()
    before = F.expr("max(end_pos) OVER (PARTITION BY tab, rec_id ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    new = runs.withColumn("before", F.coalesce(before, F.lit(0)))
    part = new.groupBy("tab", "rec_id").agg(
        F.sum(F.when(F.col("start_pos") >= F.col("before"), 1).otherwise(0)).alias("spans"),
        F.sum(F.greatest(F.lit(0), F.col("end_pos") - F.greatest("start_pos", "before"))).alias("shared_chars"),
    )
    sizes = records.select("tab", "rec_id", F.length("text").alias("chars")).where(F.col("chars").isNotNull()).groupBy("tab", "rec_id").agg(F.max("chars").alias("chars"))
    joined = sizes.join(part, ["tab", "rec_id"], "left").na.fill(0, ["spans", "shared_chars"])
    return joined.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0)))
