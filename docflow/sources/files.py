"""Readers for JSON documents, person records and DOCX guideline files."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_whole_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``file, content``: one row per text file."""
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def _parsed(files: DataFrame) -> DataFrame:
    return files.withColumn("v", F.try_parse_json(F.regexp_replace("content", r"^\uFEFF", "")))


def json_documents(files: DataFrame) -> DataFrame:
    """``file, idx, doc``: a file holds one JSON object or a list of them; unreadable files give no row."""
    many = F.try_variant_get("v", "$", "array<variant>")
    docs = _parsed(files).where(F.col("v").isNotNull()).select(
        "file", F.posexplode(F.coalesce(many, F.array("v"))).alias("idx", "d")
    )
    return docs.select("file", "idx", F.to_json("d").alias("doc"))


def unreadable_files(files: DataFrame) -> DataFrame:
    """Files that hold no valid JSON."""
    return _parsed(files).where(F.col("v").isNull()).select("file")


def patient_records(files: DataFrame) -> DataFrame:
    """``file, json``: one record per file, without a byte-order mark; unreadable files are left out."""
    return _parsed(files).where(F.col("v").isNotNull()).select("file", F.regexp_replace("content", r"^\uFEFF", "").alias("json"))


def _paragraphs(content: bytes) -> list[str] | None:
    """Non-blank body paragraphs of a DOCX file, None when it is damaged, encrypted or packed in an unknown way."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, zlib.error, KeyError, EOFError, OSError, RuntimeError, ElementTree.ParseError):
        return None
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    texts = (
        "".join(n.text or "" if n.tag == f"{_W}t" else marks.get(n.tag, "") for n in p.iter())
        for p in ([] if body is None else body.findall(f"{_W}p"))
    )
    return [t.strip() for t in texts if t.strip()]


@F.pandas_udf(T.ArrayType(T.StringType()))
def docx_paragraphs(content: pd.Series) -> pd.Series:
    return content.map(_paragraphs, na_action="ignore")


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``file, content`` of every DOCX below a folder, or of one file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "content")


def docx_texts(files: DataFrame) -> DataFrame:
    """``file, text``: paragraphs joined by line breaks; unreadable files are left out."""
    rows = files.select("file", docx_paragraphs("content").alias("p")).where(F.col("p").isNotNull())
    return rows.select("file", F.array_join("p", "\n").alias("text"))


def unreadable_docx(files: DataFrame) -> DataFrame:
    """Files that ``docx_texts`` leaves out."""
    return files.where(docx_paragraphs("content").isNull()).select("file")


def file_inventory(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``folder, n_files, n_bytes`` by folder relative to ``path``, which has its own name; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    below = F.substring_index(F.concat(parent, F.lit("/")), path.rstrip("/") + "/", -1)
    own = path.rstrip("/").rpartition("/")[2]
    folder = F.coalesce(F.nullif(F.rtrim(below, F.lit("/")), F.lit("")), F.lit(own))
    return files.select(folder.alias("folder"), "length").groupBy("folder").agg(
        F.count("*").alias("n_files"), F.sum("length").alias("n_bytes")
    )
