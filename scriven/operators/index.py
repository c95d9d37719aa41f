"""Sentences, shingle postings, document frequencies and fingerprints of a collection of (doc_id, text)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as T
from ..session import stored


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, start_pos, end_pos, text, kind, norm, units) of every sentence that is not blank.

    One regular expression cuts the text; offsets are running sums over a
    document's tiles. Null texts have no sentence.
    """
    # the outer form, as in explode_shingles; the tile of a text without any is null and leaves with the blank ones
    tiled = docs.select("doc_id", F.posexplode_outer(T.tiles(F.col("text"))).alias("k", "tile"))
    size = F.length("tile")
    start = F.sum(size).over(Window.partitionBy("doc_id").orderBy("k")) - size
    # a line end is no part of its sentence, but inside an open quotation it is
    quotes = F.length(F.regexp_replace("tile", f"[^{T.QUOTES}]++", ""))
    raw = F.when(F.col("tile").endswith("\n") & (quotes % 2 == 0), F.substring("tile", F.lit(1), size - 1)).otherwise(F.col("tile"))
    cut = tiled.select("doc_id", start.cast("int").alias("start_pos"), raw.alias("text")).where(F.col("text").rlike(T.SOLID))
    cut = cut.withColumn("kind", T.detect_language(F.col("text")))
    cut = cut.withColumn("norm", T.normalize(F.col("text"), F.col("kind"))).withColumn("units", T.units(F.col("norm"), F.col("kind")))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("start_pos")) - 1
    return cut.select("doc_id", idx.alias("idx"), "start_pos", (F.col("start_pos") + F.length("text")).alias("end_pos"), "text", "kind", "norm", "units")


def library_sentences(sents: DataFrame) -> DataFrame:
    """Sentences that a library keeps, numbered anew.

    The filter comes after the window: below it, the planner would write the
    whole chain of expressions behind ``units`` out into the condition.
    """
    keep = F.col("units") >= K.MIN_LIBRARY_UNITS
    idx = F.sum(F.when(keep, 1).otherwise(0)).over(Window.partitionBy("doc_id").orderBy("start_pos")) - 1
    return sents.withColumn("idx", idx.cast("int")).where(keep)


def with_shingles(sents: DataFrame) -> DataFrame:
    return sents.withColumn("shingles", T.shingles(F.col("norm"), F.col("kind"), F.col("units")))


def explode_shingles(shingled: DataFrame, *columns: str | Column) -> DataFrame:
    """``columns`` and each shingle of every row.

    The outer form, since for the inner one the planner infers a filter that
    works every array out once more.
    """
    return shingled.select(*columns, F.explode_outer("shingles").alias("shingle")).where("shingle IS NOT NULL")


def norm_id(kind: Column, norm: Column) -> Column:
    """Equal sentences are one class; its number is a 64-bit digest."""
    return F.xxhash64(kind, norm)


def doc_frequency(shingled: DataFrame) -> DataFrame:
    """(shingle, df): documents that hold each shingle. Distinct pairs leave the map side."""
    pairs = explode_shingles(shingled, "doc_id").distinct()
    return pairs.groupBy("shingle").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """One row: documents, builtin documents, kept sentences and their units."""
    d = docs.agg(F.count("*").alias("documents"), F.sum("is_builtin").cast("bigint").alias("builtin_documents"))
    s = kept.agg(F.count("*").alias("sentences"), F.coalesce(F.sum("units"), F.lit(0)).alias("units"))
    return d.crossJoin(s)  # one row each


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): 64-bit SimHash of four-character or four-word grams of the normal form.

    Each gram weighs its occurrences; a bit is set where the weighted sum is
    positive. 64 partial sums per document leave the map.
    """
    kind = T.detect_language(F.col("text"))
    d = docs.where(F.col("text").isNotNull()).select("doc_id", kind.alias("kind"), T.normalize(F.col("text"), kind).alias("norm"))
    g = d.select("doc_id", F.explode(T.grams(F.col("norm"), F.col("kind"), 4, 4)).alias("gram"))
    h = F.conv(F.substring(F.md5("gram"), 1, 16), 16, -10).cast("bigint")
    hashed = g.select("doc_id", h.alias("h"))
    sums = [F.sum(F.getbit("h", F.lit(b)).cast("int") * 2 - 1).alias(f"b{b}") for b in range(64)]
    bits = hashed.groupBy("doc_id").agg(*sums)
    word = F.lit(0).cast("bigint")
    for b in range(64):
        word = word.bitwiseOR(F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return bits.select("doc_id", word.alias("fingerprint"))


def simhash_classes(prints: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents of one fingerprint are a class, named after the least id."""
    return prints.join(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "fingerprint").select("doc_id", "class_id")


def _near(ids: np.ndarray, prints: np.ndarray, own: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(id_a, id_b, distance) of the rows ``own`` with all later ones, ids in order, as far as they are near."""
    held = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.int32),)]
    size = 0
    for i in own.tolist():
        distance = np.bitwise_count(prints[i + 1 :] ^ prints[i])
        at = np.flatnonzero(distance <= most)
        held.append((np.full(len(at), ids[i]), ids[i + 1 :][at], distance[at].astype(np.int32)))
        size += len(at)
        if size > 100_000:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = held[:1], 0
    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def simhash_pairs(prints: DataFrame, most: int = K.VARIANT_BITS) -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b: classes of ``simhash_classes`` whose fingerprints differ in at most ``most`` (12 to 15) bits.

    Every pair is compared, by a few machine instructions: of fingerprints in
    which 12 of 64 bits may differ, the pairs that agree nearly in one block are
    still 4 % of all, and gathering those took longer. Each task reads all
    fingerprints, 16 bytes each; none but results are written.
    """
    if most > 15:
        raise ValueError("at most 15 different bits")
    reps = stored(prints.groupBy("fingerprint").agg(F.min("doc_id").cast("bigint").alias("id")).select("id", "fingerprint"))
    path, kind = reps.inputFiles(), prints.schema["doc_id"].dataType
    spark, folder = prints.sparkSession, path[0].rsplit("/", 1)[0] if path else ""
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [i for b in batches for i in b["id"].to_pylist()]
        if not mine or not folder:
            return
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        read = [pq.read_table(fs.open_input_file(f.path)) for f in sorted(fs.get_file_info(pyarrow.fs.FileSelector(at)), key=lambda f: f.path) if f.path.endswith(".parquet")]
        table = pa.concat_tables(read)
        ids, words = table["id"].to_numpy(), table["fingerprint"].to_numpy().view(np.uint64)
        order = np.argsort(ids)
        ids, words = ids[order], words[order]
        for part in mine:
            for a, b, d in _near(ids, words, np.arange(part, len(ids), parts), most):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["id_a", "id_b", "distance"])

    pairs = spark.range(0, parts, 1, parts).mapInArrow(found, "id_a bigint, id_b bigint, distance int")
    return pairs.select(F.col("id_a").cast(kind), F.col("id_b").cast(kind), "distance")


def state_hash(docs: DataFrame) -> DataFrame:
    """One row: a digest of the collection that changes with any id, title or content.

    Rows are digested where they are; their digests are added up, which no
    order changes and partial sums can do: three sums of 64-bit numbers out of each.
    """
    row = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256)), 256)
    # 60 bits of a digest each, in sums wide enough for any number of rows
    sums = [F.sum(F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(3)]
    return docs.agg(F.count("*").alias("documents"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), *sums), 256).alias("state"))


def remove_documents(df: DataFrame, shingled: DataFrame, removed: DataFrame) -> DataFrame:
    """Document frequencies after some documents left: their counts are taken off, not counted anew."""
    gone = doc_frequency(shingled.join(removed, "doc_id", "left_semi")).select("shingle", (-F.col("df")).alias("df"))
    return df.unionByName(gone).groupBy("shingle").agg(F.sum("df").alias("df")).where("df > 0")
