"""Column functions over text: language, normal form, sentence tiles, shingles, phrase counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

QUOTES = '“”"‘’'
ENDS = "。！？；!?;"
#: A sentence and its terminator: plain runs (the usual characters first, which are told apart faster), whole quotations, dots inside words; then a terminator, a line end or the end.
TILE = rf"(?s)(?:[一-鿿，A-Za-z0-9 ,]++|[^{QUOTES}{ENDS}.\n]++|[{QUOTES}][^{QUOTES}]*+(?:[{QUOTES}]|\z)|\.(?=[\p{{L}}\p{{N}}]))*+(?:[{ENDS}.\n]|\z)"
#: Any character that is no white space.
SOLID = r"[^\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding by plain arithmetic, so that every engine gives the same bits."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def detect_language(text: Column) -> Column:
    """``zh`` if the CJK characters are at least as many as the ASCII letters, else ``en``; null for null."""
    no_zh = F.length(F.regexp_replace(text, "[一-鿿]++", ""))
    no_en = F.length(F.regexp_replace(text, "[A-Za-z]++", ""))
    return F.when(no_en >= no_zh, "zh").when(text.isNotNull(), "en")


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9']+"), F.lit(0))


def normalize(text: Column, kind: Column) -> Column:
    """Chinese: CJK characters, letters and digits kept; otherwise the words joined by blanks."""
    return F.when(kind == "zh", F.regexp_replace(text, "[^一-鿿A-Za-z0-9]++", "")).otherwise(F.array_join(words(text), " "))


def units(norm: Column, kind: Column) -> Column:
    """Characters of a Chinese normal form, words of another."""
    return F.when(kind == "zh", F.length(norm)).when(norm == "", 0).otherwise(F.size(F.split(norm, " ")))


def tiles(text: Column) -> Column:
    """The text cut behind every terminator outside quotations; joined, the tiles give the text again."""
    return F.regexp_extract_all(text, F.lit(TILE), F.lit(0))


def quoted_units(text: Column, kind: Column) -> Column:
    """Units inside quotation marks: characters in Chinese, blank-separated words otherwise."""
    spans = F.regexp_extract_all(text, F.lit("“[^”]*”|\"[^\"]*\"|‘[^’]*’"), F.lit(0))

    def inner(s: Column) -> Column:
        inside = F.substring(s, F.lit(2), F.length(s) - 2)
        return F.when(kind == "zh", F.length(inside)).otherwise(F.size(F.regexp_extract_all(inside, F.lit(r"\S+"), F.lit(0))))

    return F.coalesce(F.aggregate(F.transform(spans, inner), F.lit(0), lambda a, b: a + b), F.lit(0))


def grams(norm: Column, kind: Column, zh: int, en: int) -> Column:
    """All runs of ``zh`` characters or ``en`` words of a normal form, or the whole if that is shorter.

    A look-ahead that matches at every place captures them in one pass of the
    expression, as a normal form holds single characters, or words between blanks.
    """
    each = F.when(kind == "zh", F.regexp_extract_all(norm, F.lit(f"(?=(.{{{zh}}}))"), F.lit(1)))
    each = each.otherwise(F.regexp_extract_all(norm, F.lit(f"(?<![^ ])(?=([^ ]+(?: [^ ]+){{{en - 1}}}))"), F.lit(1)))
    return F.when(F.size(each) > 0, each).otherwise(F.array(norm))


def shingles(norm: Column, kind: Column, n: Column, least: int = K.MIN_SENT_UNITS) -> Column:
    """Distinct shingles of a normal form of ``n`` units: 8 characters or 6 words, or the whole if that is shorter.

    Below ``least`` units there are none.
    """
    some = grams(norm, kind, K.ZH_SHINGLE, K.EN_SHINGLE)
    return F.array_distinct(F.when(n >= least, some).otherwise(F.array().cast("array<string>")))


def phrase_hits(text: Column, phrases: Iterable[str]) -> Column:
    """Occurrences of all phrases, each counted without overlaps of its own."""
    out = F.lit(0.0)
    for p in phrases:
        out = out + (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
    return F.round(out).cast("int")


def threshold(kind: Column) -> Column:
    return F.when(kind == "zh", K.ZH_SIM_THRESHOLD).otherwise(K.EN_SIM_THRESHOLD)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def strip_references(text: Column) -> Column:
    """The text before the last line that is only a title of references or thanks."""
    title = r"(?ms)\A(.*)^\s*(?:参考文献|参\s*考\s*文\s*献|致\s*谢|References|REFERENCES|Bibliography)\s*$"
    return F.when(text.rlike(title), F.regexp_extract(text, title, 1)).otherwise(text)


def word_count(text: Column) -> Column:
    """Length without blanks and line ends."""
    return F.length(F.translate(text, " \n", ""))


def short_title(text: Column, title: Column | None = None) -> Column:
    """The given title, at most 120 characters, or else the first line, at most 60."""
    first = F.substring(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), 1, 60)
    given = F.trim(title) if title is not None else F.lit("")
    return F.when(F.length(given) > 0, F.substring(given, 1, 120)).when(F.length(first) > 0, first).otherwise("untitled")


# fixed values: named character references that are decoded; the ampersand is last, so that nothing is decoded twice
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&hellip;", "…"),
            ("&ndash;", "–"), ("&mdash;", "—"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&times;", "×"), ("&deg;", "°"), ("&amp;", "&"))


def unescape(text: Column) -> Column:
    """Numeric character references, decimal and hexadecimal, and those of ``ENTITIES`` decoded; others stay."""
    # each different number of a text once
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(1)))

    def decoded(out: Column, n: Column) -> Column:
        code = F.when(F.lower(F.substring(n, 1, 1)) == "x", F.conv(F.substring(n, 2, 8), 16, 10)).otherwise(n).cast("int")
        sign = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        known = ((code >= 1) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        return F.replace(out, F.concat(F.lit("&#"), n, F.lit(";")), F.when(known, sign).otherwise(F.lit("\ufffd")))

    out = F.aggregate(numbers, text, decoded)
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return out


def strip_tags(text: Column) -> Column:
    """Tags away, character references decoded, blanks at the ends away."""
    return F.regexp_replace(unescape(F.regexp_replace(text, "<[^>]+>", "")), r"^\s+|\s+$", "")


SKIPPED = "script|style|noscript|svg|head"


def submit_title(text: Column, title: Column, file: Column) -> Column:
    """Title of a submitted text: the given one, else the file's name without its ending, else the first line, at most 40 characters."""
    stem = F.regexp_replace(F.regexp_replace(file, r"^.*[/\\\\]", ""), r"(?<=.)\.[^.]*$", "")
    first = F.substring(F.split_part(F.trim(text), F.lit("\n"), F.lit(1)), 1, 40)
    return F.when(F.length(F.trim(title)) > 0, F.trim(title)).when(F.length(stem) > 0, stem).when(F.length(first) > 0, first).otherwise("untitled")


def safe_url(url: Column) -> Column:
    """The address if it is one of the web, else empty."""
    return F.when(url.rlike("(?i)^https?://"), url).otherwise("")


def html_text(html: Column) -> Column:
    """Visible text: skipped elements and tags away, entities decoded, blanks squeezed.

    Scripts and styles end at their own end tag, or never. For the others a
    counter of open skipped elements runs over tags and texts, so nested ones
    and ones that are never closed hide what they hold.
    """
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\z)", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?(?:-->|\z)", " ")
    parts = F.regexp_extract_all(out, F.lit(r"(?s)</?[A-Za-z][^>]*>|<![^>]*>|[^<]+|<"), F.lit(0))
    start = F.struct(F.lit(0).alias("deep"), F.lit("").alias("text"))

    def step(held: Column, part: Column) -> Column:
        opens, closes = part.rlike(rf"(?i)^<(?:{SKIPPED})\b"), part.rlike(rf"(?i)^</(?:{SKIPPED})\b")
        tag = part.rlike("^<[/!A-Za-z]")
        deep = F.when(opens, held["deep"] + 1).when(closes, F.greatest(F.lit(0), held["deep"] - 1)).otherwise(held["deep"])
        text = F.when(tag, F.concat(held["text"], F.lit(" "))).when(held["deep"] > 0, held["text"]).otherwise(F.concat(held["text"], part))
        return F.struct(deep.alias("deep"), text.alias("text"))

    text = unescape(F.aggregate(parts, start, step)["text"])
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x{A0}]+", " "))


def escape_html(text: Column) -> Column:
    out = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out
