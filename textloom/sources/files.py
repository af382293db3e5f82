"""File sources: text, Markdown, DOCX and (where a library is there) PDF files as document rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.text import INDONESIAN_STOPWORDS, clean_lines, looks_indonesian, preprocess_indonesian

# Fixed value: the namespace of text in DOCX files.
DOCX_TEXT = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
KINDS = ["txt", "md", "pdf", "docx"]
MAX_UPLOAD = 10 * 1024 * 1024


def docx_text(content: bytes) -> str:
    """Paragraphs with other than white space, one a line."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    paras = ("".join(t.text or "" for t in p.iter(f"{DOCX_TEXT}t")) for p in root.iter(f"{DOCX_TEXT}p"))
    return "\n".join(p for p in paras if p.strip())


def pdf_text(content: bytes) -> str:
    import fitz  # optional; without it a PDF file is an error of its own row

    with fitz.open(stream=content, filetype="pdf") as doc:
        return "\n".join(page.get_text() for page in doc)


PARSERS = {"txt": lambda b: b.decode("utf-8", "ignore"), "md": lambda b: b.decode("utf-8", "ignore"), "docx": docx_text, "pdf": pdf_text}


def _parse(batches):
    for batch in batches:
        texts, errors = [], []
        for kind, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            text, error = None, None
            try:
                if kind not in PARSERS:
                    raise ValueError(f"Unsupported file type: .{kind}")
                text = PARSERS[kind](content)
            except Exception as e:  # one bad file is a row with an error, not a failed job
                error = f"{type(e).__name__}: {e}"
            texts.append(text)
            errors.append(error)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["path", "kind", "text", "error"])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, text, error): every file below ``folder``, cleaned; files whose names start with ``_`` or ``.`` are hidden to Spark."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("kind"), "content")
    parsed = rows.mapInArrow(_parse, "path string, kind string, text string, error string")
    return parsed.withColumn("text", clean_lines(F.col("text")))


def document_columns(path: Column, folder: str, text: Column) -> dict[str, Column]:
    """Columns of a document row made from a file."""
    relative = F.regexp_replace(path, r"^.*?" + _quoted(folder.rstrip("/")) + "/", "")
    return {
        "doc_id": F.concat(F.lit("local:"), relative),
        "title": F.regexp_replace(F.regexp_replace(relative, r"^.*/", ""), r"\.[^.]*$", ""),
        "source": F.lit("local"),
        "url": path,
        "language": F.when(looks_indonesian(text), "id").otherwise("en"),
    }


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in text)


def upload_text(content: Column) -> Column:
    """Bytes of a plain text upload as text: UTF-8 where they are that, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def load_corpus(spark: SparkSession, folder: str, preprocess: bool = True, stopwords: Sequence[str] = INDONESIAN_STOPWORDS) -> DataFrame:
    """Document rows of all files that can be read and have text. ``stopwords`` beyond the built-in ones are the caller's."""
    rows = read_files(spark, folder).where(F.col("kind").isin(KINDS) & F.col("error").isNull() & (F.col("text") != ""))
    rows = rows.withColumns(document_columns(F.col("path"), folder, F.col("text")))
    if preprocess:
        rows = rows.withColumn("text", preprocess_indonesian(F.col("text"), stopwords))
    return rows.select("doc_id", "title", "text", "source", "url", "language", F.lit(preprocess).alias("preprocessed"))


def upload_problem(name: Column, length: Column, head: Column) -> Column:
    """Why an upload is refused, or null: its ending, its size, or first bytes that do not fit the ending."""
    kind = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    magic = F.when(kind == "pdf", F.startswith(head, F.lit(b"%PDF-"))).when(kind == "docx", F.startswith(head, F.lit(b"PK\x03\x04"))).otherwise(True)
    return F.when(~kind.isin("pdf", "docx", "txt"), "kind").when(length > MAX_UPLOAD, "size").when(~magic, "content")
