"""A stored index of a collection: made once for a state of it, read while the state stays the same."""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import index, lm

#: Changes when the tables of a snapshot change in kind.
VERSION = 1
TABLES = ("sentences", "frequency", "fingerprints", "one", "two", "three", "size")


def _made(docs: DataFrame) -> dict:
    """How each table is made; those that others read are read back from the snapshot itself."""
    return {
        "sentences": lambda t: index.library_sentences(index.sentences(docs)),
        "frequency": lambda t: index.doc_frequency(index.with_shingles(t["sentences"])),
        "fingerprints": lambda t: index.simhash(docs),
        "one": lambda t: lm.ngrams(lm.library_tokens(t["sentences"]), 1),
        "two": lambda t: lm.ngrams(lm.library_tokens(t["sentences"]), 2),
        "three": lambda t: lm.ngrams(lm.library_tokens(t["sentences"]), 3),
        "size": lambda t: lm.model_size(t["one"], t["three"]),
    }


def snapshot(docs: DataFrame, root: str) -> dict[str, DataFrame]:
    """The tables of an index of ``docs`` (doc_id, title, text), under ``root``.

    The folder is named after the state of the collection, a digest of every
    id, title and text, so a changed collection never meets an old index. The
    tables are written beside it and renamed when all are there: a job that
    dies half-way leaves nothing that is read. Older states are removed.
    """
    spark = docs.sparkSession
    state = index.state_hash(docs).collect()[0].state
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    name = f"{VERSION}-{state}"
    there, half = f"{root}/{name}", f"{root}/half-{name}"
    fs = path(root).getFileSystem(conf)
    if not fs.exists(path(there)):
        fs.delete(path(half), True)
        tables: dict[str, DataFrame] = {}
        for table, make in _made(docs).items():
            make(tables).write.parquet(f"{half}/{table}")
            tables[table] = spark.read.parquet(f"{half}/{table}")
        if not fs.rename(path(half), path(there)):
            raise OSError(f"cannot rename {half}")
        for old in fs.listStatus(path(root)):
            if old.getPath().getName() != name:
                fs.delete(old.getPath(), True)
    return {table: spark.read.parquet(f"{there}/{table}") for table in TABLES}
