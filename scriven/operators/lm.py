"""Trigram language model of a library, and the smoothness of sentences under it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..session import stored
from .index import norm_id
from .overlap import _mix, _windows, _words, folder_of

#: Characters of texts that are counted at once.
CHARACTERS = 4_000_000


def tokens(norm: Column, kind: Column) -> Column:
    """Characters of a Chinese normal form, words of another; empty for an empty form."""
    return F.when(kind == "zh", F.regexp_extract_all(norm, F.lit("(?s)."), F.lit(0))).otherwise(F.regexp_extract_all(norm, F.lit("[^ ]+"), F.lit(0)))


def library_tokens(library: DataFrame) -> DataFrame:
    """(doc_id, toks) of library documents of more than 100 characters in normal form.

    A document is Chinese if one of its first three sentences holds a CJK
    character; its sentences are joined by a blank, which is itself a token there.
    """
    # the sentences of one document
    d = library.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "norm"))), lambda s: s["norm"]), " ").alias("norm"),
        F.max(((F.col("idx") < 3) & F.col("norm").rlike("[一-鿿]")).cast("int")).alias("zh"),
    )
    return d.where(F.length("norm") > 100).select("doc_id", tokens(F.col("norm"), F.when(F.col("zh") == 1, "zh").otherwise("en")).alias("toks"))


def ngrams(toks: DataFrame, n: int) -> DataFrame:
    """(g1 .. gn, n): counts of token n-grams, summed on the map side first."""
    places = F.when(F.size("toks") >= n, F.sequence(F.lit(1), F.size("toks") - (n - 1))).otherwise(F.array().cast("array<int>"))
    each = F.transform(places, lambda i: F.struct(*[F.element_at("toks", i + k).alias(f"g{k + 1}") for k in range(n)]))
    return toks.select(F.explode(each).alias("g")).groupBy(*[f"g.g{k + 1}" for k in range(n)]).agg(F.count("*").alias("n"))


def model_size(uni: DataFrame, tri: DataFrame) -> DataFrame:
    """One row (v, total): distinct tokens, and trigrams."""
    return uni.agg(F.count("*").alias("v")).crossJoin(tri.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))  # one row each


def _signs() -> np.ndarray:
    """The digest of each character as a token, as ``_words`` gives it for a word of one character."""
    points = [c for c in range(1 << 16) if not 0xD800 <= c < 0xE000 and c != 32]
    each = [chr(c).encode() + b" " for c in points]
    out = np.zeros(1 << 16, np.uint64)
    out[points] = _words(b"".join(each), np.cumsum([len(x) for x in each]))[0]
    out[32] = _mix(_mix(np.array([32 + (1 << 60)], np.uint64)))[0]
    return out


def _marks(texts: list[str], zh: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digests of the tokens, how many a text has, which text it is): Chinese texts come first. Texts are not empty."""
    marks, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    first, last = np.flatnonzero(zh), np.flatnonzero(~zh)
    if len(first):
        marks.append(signs[np.frombuffer("".join([texts[i] for i in first]).encode("utf-16-le"), np.uint16)])
        sizes.append(np.array([len(texts[i]) for i in first]))
    if len(last):
        each = [texts[i].encode() + b" " for i in last]
        m, n = _words(b"".join(each), np.cumsum([len(x) for x in each]))
        marks.append(m), sizes.append(n)
    return np.concatenate(marks), np.concatenate(sizes), np.concatenate([first, last])


def _runs(marks: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Digests of all runs of ``n`` tokens; shorter texts have none."""
    enough = sizes >= n
    return _windows(marks[np.repeat(enough, sizes)], sizes[enough], n)[0]


def _parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, where each part of them begins and the last ends): parts are ranges of digests."""
    return keys, np.searchsorted(keys >> np.uint64(32), (np.arange(parts + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(parts))


def _files(folder: str) -> list[str]:
    fs, path = pyarrow.fs.FileSystem.from_uri(folder) if ":/" in folder else (pyarrow.fs.LocalFileSystem(), folder)
    return sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet"))


def _read(folder: str, path: str, columns: list[str]) -> pa.Table:
    fs = pyarrow.fs.FileSystem.from_uri(folder)[0] if ":/" in folder else pyarrow.fs.LocalFileSystem()
    with fs.open_input_file(path) as f:
        return pq.read_table(f, columns=columns)


def _documents(t: pa.Table) -> Iterator[tuple[list[str], np.ndarray]]:
    """(texts, is it Chinese) of the documents of ``library_tokens``, some at a time; ``t`` has all sentences of its documents."""
    doc, idx, norm = np.unique(t["doc_id"].to_pylist(), return_inverse=True)[1], t["idx"].to_numpy(), t["norm"].to_pylist()
    order = np.lexsort((idx, doc))
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    texts, zh, size = [], [], 0
    for own in np.split(order, cuts) if len(order) else ():
        text = " ".join([norm[i] for i in own])
        if len(text) <= 100:
            continue
        texts.append(text)
        zh.append(any("一" <= c <= "鿿" for i in own[:3] if idx[i] < 3 for c in norm[i]))
        size += len(text)
        if size > CHARACTERS:
            yield texts, np.array(zh, bool)
            texts, zh, size = [], [], 0
    if texts:
        yield texts, np.array(zh, bool)


#: Rows that go to a part: the library's (file -1) have keys with their counts, how many runs of one token there are, and of three;
#: those of a file of sentences have the keys that it asks for. What comes back has counts for keys.
_ROW = "part int, file int, keys binary, counts binary, v bigint, total bigint"


class _Counts:
    """Counts of runs of one, two and three tokens of a library, looked up by digests.

    Files of the library's sentences and of those that ask are read where they
    are. Distinct digests, not tokens, go to the part of their range, with their
    counts once a file; counts come back to the file that asked.
    """

    def __init__(self, library: DataFrame):
        """``library`` is stored, with all sentences of a document in one file."""
        self.folder, self.spark = folder_of(library), library.sparkSession

    def stats(self, sents: DataFrame) -> DataFrame:
        """``Model.sentence_stats``."""
        spark, folder, schema = self.spark, self.folder, "sid bigint, ppl double, burst double, token_burst double"
        width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        parts = 4 * width
        asking = stored(sents.select(norm_id(F.col("kind"), F.col("norm")).alias("sid"), "kind", "norm").repartition(width, "sid"))
        own = folder_of(asking)
        if not folder or not own:
            return spark.createDataFrame([], schema)

        def row(part: int, file: int, keys, counts, v: int, total: int) -> pa.RecordBatch:
            values = [[part], [file], [keys.tobytes()], [counts.tobytes()], [v], [total]]
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds, strict=True)], ["part", "file", "keys", "counts", "v", "total"])

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signs, files = _signs(), _files(folder)
            for path in (files[i] for b in batches for i in b["id"].to_pylist()):
                for texts, zh in _documents(_read(folder, path, ["doc_id", "idx", "norm"])):
                    marks, sizes, _ = _marks(texts, zh, signs)
                    for n in (1, 2, 3):
                        keys, counts = np.unique(_runs(marks, sizes, n), return_counts=True)
                        keys, at = _parts(keys, parts)
                        for k in np.flatnonzero(np.diff(at)).tolist():
                            c = counts[at[k] : at[k + 1]]
                            yield row(k, -n, keys[at[k] : at[k + 1]], c.astype(np.int32), 0, int(c.sum()) if n == 3 else 0)

        def sentences(path: str, signs: np.ndarray):
            """(sid, tokens of each, digests of its runs of one token from the third on, of two, of three)"""
            t = _read(own, path, ["sid", "kind", "norm"])
            t = t.take(np.unique(t["sid"].to_numpy(), return_index=True)[1])
            norm, kind = t["norm"].to_pylist(), t["kind"].to_pylist()
            some = np.flatnonzero([x != "" for x in norm])
            marks, sizes, which = _marks([norm[i] for i in some], np.array([kind[i] == "zh" for i in some], bool), signs)
            enough = sizes >= K.MIN_LM_TOKENS
            marks, sid, sizes = marks[np.repeat(enough, sizes)], t["sid"].to_numpy()[some[which[enough]]], sizes[enough]
            ends = np.cumsum(sizes)
            first = np.ones(len(marks), bool)
            first[ends - sizes] = first[ends - sizes + 1] = False
            inner = np.ones(len(marks) - len(sizes), bool)
            inner[np.cumsum(sizes - 1) - 1] = False
            return sid, sizes, _runs(marks, sizes, 1)[first], _runs(marks, sizes, 2)[inner], _runs(marks, sizes, 3)

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            signs, files = _signs(), _files(own)
            for i in (i for b in batches for i in b["id"].to_pylist()):
                keys, at = _parts(np.unique(np.concatenate(sentences(files[i], signs)[2:])), parts)
                for k in np.flatnonzero(np.diff(at)).tolist():
                    yield row(k, i, keys[at[k] : at[k + 1]], np.zeros(0, np.int32), 0, 0)

        def met(t: pa.Table) -> pa.Table:
            file, keys, counts = t["file"].to_pylist(), t["keys"].to_pylist(), t["counts"].to_pylist()
            held = [i for i, f in enumerate(file) if f < 0]
            k = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(keys[i], np.uint64) for i in held]])
            known, at = np.unique(k, return_inverse=True)
            n = np.bincount(at, np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(counts[i], np.int32) for i in held]]), len(known)).astype(np.int64)
            one = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(keys[i], np.uint64) for i in held if file[i] == -1]]))
            part = t["part"][0].as_py()
            out = [row(part, -1, one[:0], n[:0], len(one), sum(t["total"].to_pylist()))]
            for i, f in enumerate(file):
                if f >= 0:
                    wanted = np.frombuffer(keys[i], np.uint64)
                    place = np.minimum(np.searchsorted(known, wanted), max(0, len(known) - 1))
                    answer = np.where(known[place] == wanted, n[place], 0) if len(known) else np.zeros(len(wanted), np.int64)
                    out.append(row(part, f, one[:0], answer, 0, 0))
            return pa.Table.from_batches(out)

        numbers = lambda folder: spark.range(0, n, 1, n) if (n := len(_files(folder))) else spark.range(0)
        rows = numbers(folder).mapInArrow(counted, _ROW).unionByName(numbers(own).mapInArrow(asked, _ROW))
        answers = stored(rows.groupBy("part").applyInArrow(met, _ROW))
        size = answers.where("file = -1").agg(F.sum("v").alias("v"), F.sum("total").alias("total")).collect()[0]  # one row
        v, total = size.v or 0, size.total or 0
        if total <= 1000:
            return spark.createDataFrame([], schema)

        def scored(t: pa.Table) -> pa.Table:
            order = np.argsort(t["part"].to_numpy())
            answer = t["counts"].to_pylist()
            n = np.concatenate([np.frombuffer(answer[i], np.int64) for i in order])
            sid, sizes, *runs = sentences(_files(own)[t["file"][0].as_py()], _signs())
            known = np.unique(np.concatenate(runs))
            n1, n2, n3 = (n[np.searchsorted(known, x)] for x in runs)
            p3 = np.where(n2 > 0, (n3 + K.ADD_K) / (n2 + K.ADD_K * v), 0.0)
            p1 = (n1 + K.ADD_K) / (total + K.ADD_K * max(v, 1))
            lp = np.log(np.maximum(0.6 * p3 + 0.4 * p1, 1e-12))
            # relative to a sentence's first one, so that equal ones deviate by nothing
            count = sizes - 2
            starts = np.cumsum(count) - count
            away = lp - np.repeat(lp[starts], count)
            mean = np.add.reduceat(away, starts) / count
            sd = np.sqrt(np.add.reduceat((away - np.repeat(mean, count)) ** 2, starts) / count)
            m = lp[starts] + mean
            ratio = np.divide(sd, np.abs(m), out=np.zeros_like(sd), where=m != 0)
            return pa.table([sid, np.exp(-m), sd, ratio], names=["sid", "ppl", "burst", "token_burst"])

        return answers.where("file >= 0").groupBy("file").applyInArrow(scored, schema)


class Model:
    """Counts of one, two and three tokens, of a library's sentences or as a snapshot has them; ``size`` has one row (v, total)."""

    def __init__(self, library: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, whole: bool = False):
        """``whole`` says that ``library`` is stored with all sentences of a document in one file."""
        self.counts = None
        if tables is not None:
            self.uni, self.bi, self.tri, self.size = (tables[t] for t in ("one", "two", "three", "size"))
            return
        self.counts = _Counts(library if whole else stored(library.select("doc_id", "idx", "norm").repartition("doc_id")))
        toks = library_tokens(library)
        self.uni, self.bi, self.tri = ngrams(toks, 1), ngrams(toks, 2), ngrams(toks, 3)
        self.size = model_size(self.uni, self.tri)

    def token_logs(self, sents: DataFrame) -> DataFrame:
        """(sid, place, lp): log-probability of every token after two others, per class of equal sentences.

        Sentences of fewer than eight tokens have none.
        """
        s = sents.select(norm_id(F.col("kind"), F.col("norm")).alias("sid"), "kind", "norm").distinct()
        s = s.select("sid", tokens(F.col("norm"), F.col("kind")).alias("toks")).where(F.size("toks") >= K.MIN_LM_TOKENS)
        each = F.transform(F.sequence(F.lit(1), F.size("toks") - 2), lambda i: F.struct(*[F.element_at("toks", i + k).alias(f"g{k + 1}") for k in range(3)]))
        t = s.select("sid", F.posexplode(each).alias("place", "g")).select("sid", "place", "g.g1", "g.g2", "g.g3")
        bi = self.bi.withColumnRenamed("n", "n2")
        tri = self.tri.withColumnRenamed("n", "n3")
        uni = self.uni.select(F.col("g1").alias("g3"), F.col("n").alias("n1"))
        # each different trigram is looked up once; the tokens then meet it in one join
        k = K.ADD_K
        d = t.select("g1", "g2", "g3").distinct()
        d = d.join(tri, ["g1", "g2", "g3"], "left").join(bi, ["g1", "g2"], "left").join(uni, "g3", "left")
        d = d.crossJoin(F.broadcast(self.size)).na.fill(0, ["n1", "n2", "n3"])  # one row
        p3 = F.when(F.col("n2") > 0, (F.col("n3") + k) / (F.col("n2") + k * F.col("v"))).otherwise(0.0)
        p1 = (F.col("n1") + k) / (F.col("total") + k * F.greatest("v", F.lit(1)))
        d = d.select("g1", "g2", "g3", F.log(F.greatest(0.6 * p3 + 0.4 * p1, F.lit(1e-12))).alias("lp"))
        return t.join(d, ["g1", "g2", "g3"]).select("sid", "place", "lp")

    def sentence_stats(self, sents: DataFrame) -> DataFrame:
        """(sid, ppl, burst, token_burst): perplexity, deviation of the logs, and that over their mean.

        Nothing unless the model has seen more than 1000 trigrams.
        """
        if self.counts:
            return self.counts.stats(sents)
        ready = self.size.where("total > 1000").select("total")
        s = self.token_logs(sents).groupBy("sid").agg(F.avg("lp").alias("m"), F.stddev_pop("lp").alias("sd"), F.count("*").alias("n"))
        s = s.join(F.broadcast(ready)).select("sid", F.exp(-F.col("m")).alias("ppl"), F.when(F.col("n") >= 3, F.col("sd")).otherwise(0.0).alias("burst"), F.when((F.col("n") >= 3) & (F.col("m") != 0), F.col("sd") / F.abs("m")).alias("token_burst"))
        return s


def doc_burst(sents: DataFrame, stats: DataFrame) -> DataFrame:
    """(doc_id, doc_burst): variation of the sentences' perplexities, of at least three."""
    s = sents.select("doc_id", norm_id(F.col("kind"), F.col("norm")).alias("sid")).join(stats, "sid")
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), (F.stddev_pop("ppl") / F.avg("ppl")).alias("doc_burst")).where("n >= 3").select("doc_id", "doc_burst")

