"""Readers and writers. Text tables are read as text: coercion is up to the query."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.text import strip_tags
from ledgerline.operators.quality import require_header

CSV = {"header": True, "escape": '"', "quote": '"', "multiLine": True}


def read_csv(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    """All-text CSV with quoted commas, doubled quotes and line ends. expected: the header must be exactly this."""
    df = spark.read.options(**CSV).csv(path)
    return df if expected is None else require_header(df, expected)


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the columns it lacks as NULL text."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def csv_rows(spark: SparkSession, text: str) -> DataFrame:
    """A literal CSV with a header as an all-text table."""
    import csv

    rows = list(csv.reader(io.StringIO(text.strip())))
    width = len(rows[0])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in rows[0]])
    return spark.createDataFrame([tuple((r + [None] * width)[:width]) for r in rows[1:] if r], schema)


def wrong_width(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Lines of an unquoted-newline CSV whose number of cells is not width: a header check cannot see them."""
    lines = spark.read.text(path)
    cells = F.size(F.split(F.regexp_replace("value", '"([^"]|"")*"', "q"), ",", -1))
    return lines.withColumn("cells", cells).filter((F.col("value") != "") & (F.col("cells") != width))


def append_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Rows appended with quoting; the columns must be the table's, in order."""
    require_header(df, columns).write.mode("append").options(**{k: v for k, v in CSV.items() if k != "multiLine"}).csv(path)


def fixed(c: str, places: int = 3):
    """A number with so many decimals; the binary value is rounded, ties to even."""
    exact = F.format_number(F.col(c).cast("double"), places)
    return F.replace(exact, F.lit(","), F.lit("")).alias(c)


def read_document(spark: SparkSession, path: str, explode: str | None = None) -> DataFrame:
    """One JSON document a file; explode: the array of records in it."""
    df = spark.read.json(path, multiLine=True)
    return df.select(F.explode(explode).alias("r")).select("r.*") if explode else df


def write_document(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines and broken records are left out."""
    parsed = F.from_json("value", schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    return rows.filter(F.col("_broken").isNull()).drop("_broken")


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """path, value: a row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def file_index(spark: SparkSession, path: str, skip: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> DataFrame:
    """name, paths and bytes of every file below path; only listings are read."""
    inside = "|".join(re.escape(s) for s in skip)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    named = files.filter(~F.col("path").rlike(f"/({inside})/")).withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.groupBy("name").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sum("length").alias("bytes"))


def stored_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """path, text of word-processor files; a file that cannot be opened has NULL text. Unzipping alone runs in Python."""

    def body(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for raw in f["content"]:
                try:
                    out.append(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml").decode("utf-8", "replace"))
                except (zipfile.BadZipFile, KeyError):
                    out.append(None)
            yield pd.DataFrame({"path": f["path"], "xml": out})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(body, "path string, xml string").select("path", F.regexp_replace(strip_tags(F.col("xml")), r"^\s+|\s+$", "").alias("text"))


def read_pairs(spark: SparkSession, path: str, app_column: str = "app") -> DataFrame:
    """app, label, price from a JSON object of arrays of [label, price]; members of another shape give a row with NULL price."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias(app_column, "raw"))
    got = F.from_json("raw", "array<string>")
    rows = whole.select(app_column, F.explode(got).alias("item"))
    pair = F.from_json("item", "array<string>")
    return rows.select(app_column, F.coalesce(F.get(pair, F.lit(0)), "item").alias("label"), F.regexp_replace(F.get(pair, F.lit(1)), "[$,]", "").try_cast("decimal(10,2)").alias("price"))


def report(df: DataFrame, title: str) -> str:
    """A result as a markdown table, all rows."""
    head = f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in row) + " |\n" for row in df.toLocalIterator())


def land(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with status, events) of raw requests (method, path, body) as a collector leaves them in its landing folder: 204 for an event,
    404 for another method or path, 400 for a body that is no JSON object. Fields an event lacks are NULL."""
    parsed = F.from_json("body", "arm string, sid string, event string, extra map<string,string>, _broken string", {"columnNameOfCorruptRecord": "_broken"})
    read = requests.withColumn("__e", parsed)
    known = (F.col("method") == "POST") & (F.col("path") == "/event")
    good = F.col("__e").isNotNull() & F.col("__e._broken").isNull() & F.trim("body").startswith("{")
    marked = read.withColumn("status", F.when(~F.coalesce(known, F.lit(False)), 404).when(F.coalesce(good, F.lit(False)), 204).otherwise(400))
    events = marked.filter("status = 204").select(*(c for c in requests.columns if c not in ("method", "path", "body")), "__e.arm", "__e.sid", "__e.event", "__e.extra")
    return marked.drop("__e"), events
