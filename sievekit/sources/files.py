"""Files as documents (S1, S11, S12): one row a file, and a reason where a file can't be one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.functions.text import file_extension, generated_source_id

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's rules (stated together): suffixes read as text.
# ---------------------------------------------------------------------------
TEXT_EXTENSIONS = [".txt", ".md"]


def file_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, source_id, n_bytes, text, reason) of every file below a folder.

    Bytes are read whole and must be UTF-8; a broken file or one of another type has no text but a reason. Spark's reader passes
    over files without a byte, so these give no row. It holds a file in a row and refuses those of 2 GB and more. Source ids come from the name. Paths may be on any file system that Spark reads.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    readable = file_extension("path").isin(TEXT_EXTENSIONS)
    text = F.when(readable, F.try_validate_utf8(F.col("content").cast("string")))
    reason = F.when(~readable, F.concat(F.lit("unsupported file type: "), file_extension("path"))).when(text.isNull(), F.lit("not UTF-8"))
    return files.select(F.col("path").alias("name"), generated_source_id("path").alias("source_id"), F.col("length").alias("n_bytes"), text.alias("text"), reason.alias("reason"))
