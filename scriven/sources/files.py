"""Uploaded files as a DataFrame of texts."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Largest file that is parsed, and the endings that can be.
MAX_BYTES, ENDINGS = 15 * 1024 * 1024, (".txt", ".md", ".text", ".docx", ".pdf")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decode(data: bytes) -> str | None:
    """UTF-8, else GB 18030, else UTF-16; null if none fits."""
    for name in ("utf-8-sig", "gb18030", "utf-16"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return None


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word file, one a line; tables and headers are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    lines = []
    for p in body.findall(f"{_W}p"):
        parts = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        lines.append("".join(parts[e.tag](e) for e in p.iter() if e.tag in parts))
    return "\n".join(lines)


def parse(name: str, data: bytes) -> tuple[str | None, str | None]:
    """(text, error) of one file."""
    ending = (re.search(r"\.[^./\\]+$", name.lower()) or [""])[0]
    if len(data) > MAX_BYTES:
        return None, "file too large"
    if ending not in ENDINGS:
        return None, "unsupported format"
    if ending == ".pdf":
        return None, "no PDF reader is installed"
    try:
        text = docx_text(data) if ending == ".docx" else decode(data)
    except Exception as e:  # noqa: BLE001 - a broken file is a row with an error, not a failed job
        return None, f"unreadable: {type(e).__name__}"
    return (text, None) if text is not None else (None, "unknown encoding")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of every file under ``path``; files beyond the size limit are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse(p, d) for p, d in zip(pdf["path"], pdf["content"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "text": [t for t, _ in parsed], "error": [e for _, e in parsed]})

    small = files.where(f"length <= {MAX_BYTES}").select("path", "content").mapInPandas(run, "path string, text string, error string")
    large = files.where(f"length > {MAX_BYTES}").selectExpr("path", "CAST(NULL AS string) AS text", "'file too large' AS error")
    return small.unionByName(large)
