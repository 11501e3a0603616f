"""Files as documents: a recursive scan by glob, and PDF text where a library is installed."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.errors import SourceError
from siftwell.functions import text as X
from siftwell.sources.items import item_columns

#: Folders that a scan never enters.
EXCLUDED = ("node_modules", ".git", ".cache", "vendor", "dist", "build", "__pycache__", ".venv", "target")


def scan(spark: SparkSession, root: str, pattern: str = "**/*.md", exclude_hidden: bool = True) -> DataFrame:
    """``path`` (relative), ``modified_at``, ``raw`` bytes of the files under ``root`` that match a glob."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    plain = F.regexp_replace("path", "^file:/+", "/") if base.startswith("/") else F.col("path")
    relative = F.substring(plain, len(base) + 2, 1 << 30)
    rows = files.select(relative.alias("path"), F.col("modificationTime").alias("modified_at"), F.col("content").alias("raw"))
    rows = rows.where(F.col("path").rlike(X.glob_regex(pattern)))
    rows = rows.where(~F.exists(F.split("path", "/"), lambda p: p.isin(*EXCLUDED)))
    return rows.where(~F.exists(F.split("path", "/"), lambda p: p.startswith("."))) if exclude_hidden else rows


def load_files(spark: SparkSession, options: dict) -> DataFrame:
    """Items of text files; options path, pattern, exclude_hidden. Files that aren't UTF-8 are skipped."""
    rows = scan(spark, options["path"], options.get("pattern", "**/*.md"), str(options.get("exclude_hidden", "true")).lower() == "true")
    text = F.decode("raw", "utf-8")
    rows = rows.where(F.is_valid_utf8(F.col("raw").cast("string"))).withColumn("text", text)
    uri = F.concat(F.lit(options["path"].rstrip("/") + "/"), "path")
    return rows.select(*item_columns(uri, X.heading_title(F.col("text"), F.col("path")), F.col("text"), "file", F.create_map(F.lit("path"), F.col("path"), F.lit("modified_at"), F.col("modified_at").cast("string"))))


def load_pdf(spark: SparkSession, options: dict) -> DataFrame:
    """Items of PDF files with text; raises if no PDF library is installed."""
    try:
        import pypdf  # noqa: F401
    except ImportError as e:
        raise SourceError("reading PDF files needs the pypdf package") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        import pypdf as library

        for b in batches:
            texts = ["\n".join(page.extract_text() or "" for page in library.PdfReader(io.BytesIO(raw)).pages) for raw in b["raw"]]
            yield pd.DataFrame({"path": b["path"], "text": texts})

    rows = scan(spark, options["path"], options.get("pattern", "**/*.pdf")).select("path", "raw").mapInPandas(run, "path string, text string").where(F.trim("text") != "")
    line = F.element_at(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    title = F.when(F.octet_length(line) < 200, F.trim(line)).otherwise(stem)
    return rows.select(*item_columns(F.concat(F.lit("pdf://"), "path"), title, F.col("text"), "pdf"))
