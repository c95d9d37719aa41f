"""One form for text that looks the same (problem 5).

Each string is mapped character by character: compatibility decomposition,
look-alike letters to their Latin twins, every kind of blank to a plain one,
invisible characters away, composition last. The look-alikes are those of the
Unicode skeleton table that comes with Spark's collation library, read once by
the driver. The mapped strings are then grouped in SQL under the accent- and
case-sensitive Unicode collation; the member with the smallest key stands for
its class and is joined back. Equal strings meet by their digests, so only
those of equal letters and digits that still differ are collated.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored

# fixed values: common letters of other scripts that print like Latin ones (after Unicode TR39); where there is a session, ``skeleton_table`` has all
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "І": "I", "Ј": "J", "Ѕ": "S", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I",
    "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ν": "v", "ο": "o", "ρ": "p", "ɑ": "a", "ɡ": "g",
}
_ALIKE = str.maketrans(LOOK_ALIKES | {"‐": "-", "‑": "-"})
_HAS_ALIKE = re.compile("[" + "".join(LOOK_ALIKES) + "‐‑]")
#: Format characters and marks that print nothing.
INVISIBLE = re.compile(
    r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff"
    r"\U000e0000-\U000e0fff\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]"
)
_BLANK = re.compile(r"[\t\x0b\x0c\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]")
_LINE = re.compile(r"\r\n|[\r\x85\u2028\u2029]")
_DIRTY_ASCII = re.compile(r"[\x00-\x08\t\x0b-\x1f\x7f]")


def skeleton_table(spark: SparkSession) -> dict[int, str]:
    """Letters beyond ASCII (code points) that the skeleton table maps to the look of an ASCII letter of the same case.

    One call to the library on the driver; a session without it has ``LOOK_ALIKES``.
    """
    table = {ord(a): b for a, b in LOOK_ALIKES.items()}
    try:
        skeleton = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton
        letters = [c for c in map(chr, range(0x80, 0x1F000)) if unicodedata.category(c) in ("Lu", "Ll") and unicodedata.normalize("NFKD", c) == c]
        looks = skeleton("\x01".join([*string.ascii_letters, *letters])).split("\x01")
    except Exception:  # no Java session, or another library: what it throws is py4j's
        return table
    latin: dict[tuple[str, str], str] = {}
    for c, look in zip([*string.ascii_letters, *letters], looks, strict=True):
        if c.isascii():
            latin.setdefault((look, unicodedata.category(c)), c)
        elif (look, unicodedata.category(c)) in latin:
            table.setdefault(ord(c), latin[look, unicodedata.category(c)])
    return table


def same_form(text: str | None, table: dict[int, str] | None = None) -> str | None:
    """The one form of ``text``, by ``LOOK_ALIKES`` and further letters of ``table``; null stays null, empty stays empty."""
    if not text or text.isascii() and not _DIRTY_ASCII.search(text):
        return text
    text = INVISIBLE.sub("", text)
    text = _BLANK.sub(" ", _LINE.sub("\n", text))
    text = unicodedata.normalize("NFKD", text)
    if table is not None:
        text = text.translate(table)
    if _HAS_ALIKE.search(text):
        text = text.translate(_ALIKE)
    return unicodedata.normalize("NFC", text)


def with_form(df: DataFrame, text: str, form: str = "form") -> DataFrame:
    """``df`` with the one form of column ``text`` added as ``form`` (an Arrow map, no shuffle)."""
    table = skeleton_table(df.sparkSession)

    def forms(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: same_form(t, table), na_action="ignore")

    return df.withColumn(form, F.pandas_udf(forms, "string")(F.col(text)))


def _mapped(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stored, form_md5, letters_md5, form) of every row with a text: written once, read where it is needed."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    # characters that are neither letter nor digit are all that the collation passes over
    letters = F.md5(F.regexp_replace("form", r"[^\p{L}\p{N}]+", ""))
    return stored(with_form(rows, "text").select("key", F.md5("text").alias("stored"), F.md5("form").alias("form_md5"), letters.alias("letters_md5"), "form"))


def _class_keys(rows: DataFrame) -> DataFrame:
    """(form_md5, class_key, class_md5): the class of each form of ``rows`` and the form of its smallest key."""
    forms = rows.groupBy("form_md5", "letters_md5").agg(F.min("key").alias("first_key"))
    alike = forms.groupBy("letters_md5").agg(F.min("form_md5").alias("low"), F.max("form_md5").alias("high")).where("low <> high")
    differ = stored(forms.join(alike.select("letters_md5"), "letters_md5", "left_semi"))
    texts = rows.join(differ.select("form_md5"), "form_md5", "left_semi").groupBy("form_md5").agg(F.min("form").alias("form"))
    texts = stored(differ.join(texts, "form_md5"))
    spark = rows.sparkSession
    classes = spark.sql(
        """SELECT collate(form, 'UNICODE') AS look, min_by(form_md5, first_key) AS class_md5, min(first_key) AS class_key
           FROM {texts} GROUP BY collate(form, 'UNICODE')""",
        texts=texts,
    )
    named = spark.sql(
        "SELECT t.form_md5, c.class_key, c.class_md5 FROM {texts} t JOIN {classes} c ON collate(t.form, 'UNICODE') = c.look",
        texts=texts,
        classes=classes,
    )
    alone = forms.join(alike.select("letters_md5"), "letters_md5", "left_anti")
    return alone.select("form_md5", F.col("first_key").alias("class_key"), F.col("form_md5").alias("class_md5")).unionByName(named)


def look_classes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, stored, class_key, form): each row's class of equal-looking texts.

    ``stored`` is a digest of the text as stored, ``class_key`` the smallest
    key of the class, ``form`` that member's mapped text. Null texts give no
    row; repeated rows give one; an empty table gives an empty result. Classes
    are told by digests, so texts are moved only where they are collated and
    for the result, and the class of a hot group is a partial minimum: no
    group is ever gathered in one task.
    """
    rows = _mapped(df, key, text)
    named = _class_keys(rows)
    forms = rows.groupBy(F.col("form_md5").alias("class_md5")).agg(F.min("form").alias("form"))
    members = rows.select("key", "stored", "form_md5").distinct()
    return members.join(named, "form_md5").join(forms, "class_md5").select("key", "stored", "class_key", "form")


def look_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: rows that look the same but are stored differently.

    Blank and null texts give no pair. Pairs are formed between the different
    stored strings of a class and only then between their records: records
    that store the same string are never compared.
    """
    marked = df.where(F.col(text).rlike(r"[^\s\u0085\u00a0\u1680\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]"))
    rows = _mapped(marked, key, text)
    members = rows.select("key", "stored", "form_md5").distinct().join(_class_keys(rows), "form_md5")
    members = stored(members.select("key", "stored", "class_key"))
    variants = members.select("class_key", "stored").distinct()
    mixed = variants.groupBy("class_key").agg(F.min("stored").alias("least"), F.max("stored").alias("most"))
    mixed = mixed.where("least <> most").select("class_key")
    members = stored(members.join(mixed, "class_key"))
    variants = members.select("class_key", "stored").distinct()
    a = variants.select("class_key", F.col("stored").alias("stored_a"))
    b = variants.select("class_key", F.col("stored").alias("stored_b"))
    pairs = a.join(b, "class_key").where("stored_a < stored_b")
    left = members.select("class_key", F.col("stored").alias("stored_a"), F.col("key").alias("x"))
    right = members.select("class_key", F.col("stored").alias("stored_b"), F.col("key").alias("y"))
    both = pairs.join(left, ["class_key", "stored_a"]).join(right, ["class_key", "stored_b"])
    # a record stored under two strings of the class is no pair with itself
    return both.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
