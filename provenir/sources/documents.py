"""Documents from files: text, markup and word-processor packages."""

from __future__ import annotations

import io
import re
import zipfile
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from provenir.functions import text as T
from provenir.operators.matching import numbered


@F.pandas_udf(StringType())
def package_text(content: pd.Series) -> pd.Series:
    """Paragraphs of a word-processor package; anything else is decoded as UTF-8."""

    def one(data: bytes) -> str:
        try:
            xml = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode("utf-8", "replace")
        except (zipfile.BadZipFile, KeyError):
            return data.decode("utf-8", "replace")
        return unescape(re.sub(r"<[^>]+>", "", re.sub(r"</w:p>|<w:br\b[^>]*>", "\n", xml)))

    return content.map(lambda x: None if x is None else one(bytes(x)))


def parse(raw: DataFrame) -> DataFrame:
    """Rows of (name, mime, content binary) to parsed documents with a reference by content."""
    kind = T.detect_format("name", "mime")
    plain = F.decode("content", "UTF-8")
    body = F.when(kind == "html", T.strip_tags(plain)).when(kind == "docx", package_text("content")).otherwise(plain)
    out = raw.withColumn("format", kind).withColumn("text", T.normalize_whitespace(body))
    return out.select("name", "format", "text", T.content_ref("text").alias("ref"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("content_hash"))


def upload(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files (``ord``, ``name``, ``mime``, ``data`` in base64) to sources with ids of their own, and parsed texts by those ids."""
    raw = files.withColumn("content", F.unbase64("data"))
    own = numbered(raw.select("ord", "name", "mime", F.octet_length("content").alias("size")), F.concat(F.lit("doc:"), T.slugify("name")), "ord", "id", "-")
    text = parse(raw.select(F.col("ord").cast("string").alias("name"), "content", F.coalesce(F.nullif("mime", F.lit("")), T.detect_format("name", F.lit(""))).alias("mime")))
    both = own.join(text.select(F.col("name").cast("bigint").alias("ord"), "format", "text", "ref", "content_hash"), "ord")
    return both.select("id", "name", "mime", "size", "format", "ref", "content_hash"), both.select("ref", F.col("id").alias("document_id"), "text")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Every file of a folder, parsed; files that are one executor's share are read there."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return parse(raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("mime"), "content"))


def page_map(pages: DataFrame, doc: str = "document_id", page: str = "page", text: str = "text") -> DataFrame:
    """Offsets of normalised pages in a text joined by blank lines."""
    from pyspark.sql import Window

    own = pages.withColumn("_n", F.length(T.normalize_whitespace(text)))
    before = F.coalesce(F.sum(F.col("_n") + 2).over(Window.partitionBy(doc).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.withColumn("page_start", before).withColumn("page_end", F.col("page_start") + F.col("_n")).select(doc, page, "page_start", "page_end")


def redact(message):
    """No credentials in a driver's message."""
    m = F.regexp_replace(T.col(message), r"(?i)(\w+://[^:/@\s]+):[^@\s]+@", "$1:***@")
    return F.regexp_replace(m, r"(?i)\b(password|pwd|secret|token)\s*[=:]\s*\S+", "$1=***")
