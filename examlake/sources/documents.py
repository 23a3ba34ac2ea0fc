"""Document sources: files or pasted text to decoded, routed and de-duplicated rows, and their blocks."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from examlake.functions.text import collapse, title_of_file

#: Extensions that are text already, those that a converter would have to read, and the largest file taken.
PLAIN = ("txt", "text", "csv", "rst", "json", "md", "markdown")
CONVERTED = ("pdf", "docx", "pptx", "xlsx", "html", "htm", "epub", "png", "jpg", "jpeg", "tiff", "gif", "doc", "ppt", "xls", "odt", "rtf")
MOST_BYTES = 64 << 20

UPLOADS = "name string, extension string, title string, size_bytes long, digest string, content binary"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 or UTF-16 by their mark, UTF-8 without one; a run of bad bytes is one U+FFFD; line ends are line feeds."""
    head2, head3 = F.hex(F.substring(content, 1, 2)), F.hex(F.substring(content, 1, 3))
    raw = F.when(head3 == "EFBBBF", F.substring(content, 4, 1 << 30)).otherwise(content).cast("string")
    utf8 = F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "�+", "�"))
    text = F.when(head2.isin("FFFE", "FEFF"), F.decode(content, "UTF-16")).otherwise(utf8)
    return F.regexp_replace(text, "\r\n?", "\n")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file under ``path``, columns as in UPLOADS; files beyond MOST_BYTES keep their row without content.

    The reader passes over files without a byte, so those come from its listing.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    plain = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").withColumn("at", plain)
    empty = listed.join(files.select(plain.alias("at")), "at", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    files = files.union(empty)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    content = F.when(F.col("length") <= MOST_BYTES, F.col("content"))
    return files.select(name.alias("name"), extension(name).alias("extension"), title_of_file(name).alias("title"), F.col("length").alias("size_bytes"), F.sha2(content, 256).alias("digest"), content.alias("content"))


def outcomes(uploads: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Add ``outcome``: empty, too_large, unsupported, duplicate (of a held digest or of an earlier name), stored or converted.

    Digests meet digests; contents are not part of the join.
    """
    keys = uploads.select("digest", "name").where("digest is not null")
    first = keys.groupBy("digest").agg(F.min("name").alias("first"))
    if held is not None:
        first = first.join(held.select("digest", F.lit(True).alias("held")).distinct(), "digest", "left")
    else:
        first = first.withColumn("held", F.lit(None).cast("boolean"))
    met = uploads.join(first, "digest", "left")
    outcome = (
        F.when(F.col("size_bytes") == 0, "empty")
        .when(F.col("size_bytes") > MOST_BYTES, "too_large")
        .when(~F.col("extension").isin(*PLAIN, *CONVERTED), "unsupported")
        .when(F.col("held") | (F.col("name") > F.col("first")), "duplicate")
        .when(F.col("extension").isin(*PLAIN), "stored")
        .otherwise("to_convert")
    )
    return met.select(*uploads.columns, outcome.alias("outcome"))


def texts(stored: DataFrame) -> DataFrame:
    """``name, title, text`` of stored plain-text files."""
    return stored.where("outcome = 'stored'").select("name", "title", decoded(F.col("content")).alias("text"))


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, order_index, text, size_bytes``: a block for each line that is not blank, in order."""
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: collapse(x) != "")
    rows = docs.select(key, F.posexplode(lines).alias("order_index", "text"))
    return rows.withColumn("size_bytes", F.octet_length("text"))


def year_of(text: Column) -> Column:
    """The first plausible year in a text, between 1800 and 2200, or null."""
    found = F.regexp_extract(text, r"(?:^|[^0-9])((?:18|19|20|21)[0-9]{2})(?:[^0-9]|\z)", 1)
    return F.nullif(found, F.lit("")).cast("int")
