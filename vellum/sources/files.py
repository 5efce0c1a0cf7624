"""Readers of document files: text, Word, PDF and chart tables, from any path Spark can read."""

from __future__ import annotations

import importlib.util
import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vellum.functions.text import WS
from vellum.sources.pdf import pages_of
from vellum.sources.shared import bounded_batches

#: Fixed value: the namespace of Word's markup.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def decoded(content: Column) -> Column:
    """Strict UTF-8, else Latin-1; a byte order mark stays."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def _paragraph(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag in (W + "tab", W + "br", W + "cr"):
            out.append("\t" if x.tag == W + "tab" else "\n")
    return "".join(out)


def word_text(content: bytes) -> str:
    """The non-empty paragraphs of the body, then the rows of its tables, cells parted by a bar."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(W + "body")
    parts = [t for p in body.findall(W + "p") if (t := _paragraph(p).strip())]
    for row in (r for table in body.findall(W + "tbl") for r in table.findall(W + "tr")):
        cells = []
        for c in row.findall(W + "tc"):  # a cell over several columns counts for each of them
            span = c.find(f"{W}tcPr/{W}gridSpan")
            cells += ["\n".join(_paragraph(p) for p in c.findall(W + "p")).strip()] * (int(span.get(W + "val", "1")) if span is not None else 1)
        if any(cells):
            parts.append(" | ".join(c for c in cells if c))
    return "\n".join(parts)


def pdf_text(content: bytes) -> str:
    """Pages with text, each under its number; by an optional library where there is one, else by the small reader."""
    name = next((m for m in ("fitz", "pypdf") if importlib.util.find_spec(m)), None)
    if not name:
        pages = pages_of(content)
    elif name == "fitz":
        import fitz

        with fitz.open(stream=content, filetype="pdf") as pdf:
            pages = [page.get_text() for page in pdf]
    else:
        import pypdf

        pages = [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(content)).pages]
    return "\n\n".join(f"--- Page {i} ---\n{t.strip()}" for i, t in enumerate(pages, 1) if t.strip())


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("error_message", StringType())]))
def _binary_text(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = []
    for p, c in zip(path, content, strict=True):
        if c is None:
            rows.append((None, None))
            continue
        try:
            rows.append(((word_text if p.lower().endswith(".docx") else pdf_text)(c), None))
        except Exception as e:  # noqa: BLE001  one bad file must not end a corpus job
            rows.append((None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=["text", "error_message"])


#: Fixed value: what is said of a file of another kind, and of one without text.
UNSUPPORTED, NO_TEXT = "Unsupported file type: TXT, DOCX or PDF is needed.", "No readable text was found: the file may be empty or hold scanned images."
_BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def kind_of(path: str) -> str:
    """The ending of a file's name, lower-case."""
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_file(path: str, content: bytes) -> dict[str, str | None]:
    """text, error_code and error_message of one file, by the rules of ``documents_of``."""
    kind = kind_of(path)
    if kind not in ("txt", "docx", "pdf"):
        return {"text": None, "error_code": "BAD_FILE", "error_message": UNSUPPORTED}
    try:
        if kind == "txt":
            try:
                text = content.decode()
            except UnicodeDecodeError:
                text = content.decode("latin-1")
        else:
            text = (word_text if kind == "docx" else pdf_text)(content)
    except Exception as e:  # noqa: BLE001  one bad file must not end a corpus job
        return {"text": None, "error_code": "BAD_FILE", "error_message": f"{type(e).__name__}: {e}"}
    text = text.strip(_BLANK)
    return {"text": text or None, "error_code": None if text else "NO_TEXT", "error_message": None if text else NO_TEXT}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text, error_code, error_message) of all files under a path."""
    return documents_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def documents_of(files: DataFrame) -> DataFrame:
    """The same for rows of (path, content)."""
    bounded_batches(files.sparkSession)
    low = F.lower("path")
    is_text, is_binary = low.endswith(".txt"), low.endswith(".docx") | low.endswith(".pdf")
    read = _binary_text("path", F.when(is_binary, F.col("content")))  # one pass over the files; only these bytes go to Python
    text = F.when(is_text, decoded(F.col("content"))).otherwise(F.col("r.text"))
    wrong = F.when(~(is_text | is_binary), UNSUPPORTED).when(~is_text, F.col("r.error_message"))
    rows = files.withColumn("r", read).select("path", F.regexp_replace(text, rf"^{WS}+|{WS}+$", "").alias("text"), wrong.alias("error_message"))
    code = F.when(F.col("error_message").isNotNull(), "BAD_FILE").when(F.col("text") == "", "NO_TEXT")
    message = F.coalesce("error_message", F.when(F.col("text") == "", NO_TEXT))
    return rows.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.when(code.isNull(), F.col("text")).alias("text"), code.alias("error_code"), message.alias("error_message"))


def chart_texts_of(files: DataFrame) -> DataFrame:
    """(path, data_text, error_code) of chart tables: UTF-8 only, without a byte order mark."""
    ok = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(ok, F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "")).alias("data_text"), F.when(~ok, "BAD_FILE").alias("error_code"))


#: Fixed value: the name of a text that has none.
PASTED = "Manually entered text"


def named(texts: DataFrame, name: str = "name", instead: str = PASTED) -> DataFrame:
    """The texts with a name each."""
    return texts.withColumn(name, F.coalesce(F.col(name), F.lit(instead)))


def pasted(spark: SparkSession, texts: list[tuple[str | None, str]]) -> DataFrame:
    """(name, text) of texts given by hand."""
    return named(spark.createDataFrame(texts, "name string, text string"))
