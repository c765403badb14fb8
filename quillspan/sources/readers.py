"""Sources: JSON lines (strict, tolerant, repaired), polymorphic JSON, CSV with a byte-order mark, binary files with
format detection and text extraction, ontologies, benchmarks. Sinks that keep order or split by a column."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What files of a format begin with, in hex.
MAGIC = {"pdf": "25504446", "ole": "D0CF11E0A1B11AE1", "rtf": "7B5C727466", "jpg": "FFD8FF", "zip": "504B0304"}
_INSIDE = {"word/document.xml": "docx", "xl/workbook.xml": "xlsx", "ppt/presentation.xml": "pptx"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Strict: blank lines are skipped, any other line must be an object of the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that can't be read."""
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    rows = spark.read.schema(kind.add("_corrupt_record", "string")).json(path).persist()
    return rows.filter("_corrupt_record IS NULL").drop("_corrupt_record"), rows.filter("_corrupt_record IS NOT NULL").select("_corrupt_record")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """position (from 0), value: the lines of one text file in order. For files small enough for one task; line numbers
    of larger ones aren't needed anywhere."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("position", "value"))


def repaired_tail(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file whose last line may be cut off; a broken line elsewhere raises ValueError."""
    lines = numbered_lines(spark, path).filter("trim(value) <> ''").withColumn("row", F.from_json("value", schema)).withColumn("ok", F.try_parse_json("value").isNotNull()).persist()
    last = lines.agg(F.max("position")).first()[0]
    if bad := lines.filter(~F.col("ok") & (F.col("position") != F.lit(last))).head(1):
        raise ValueError(f"line {bad[0]['position'] + 1} is broken")
    return lines.filter("ok").select("position", "row.*")


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines for .jsonl, else one JSON array or object."""
    return spark.read.schema(schema).option("multiLine", not path.endswith(".jsonl")).json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 with or without a byte-order mark, header, strings only."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content, sha256, actual_format of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "content", F.sha2("content", 256).alias("sha256"), actual_format("content", "path").alias("actual_format"))


def actual_format(content: str, path: str) -> Column:
    """By the first bytes; what a zip archive holds by its members' names; else the suffix."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.decode(F.col(content), "ISO-8859-1")
    inside = F.lit("zip")
    for name, kind in _INSIDE.items():
        inside = F.when(F.contains(text, F.lit(name)), kind).otherwise(inside)
    whole = F.contains(text, F.lit("PK\x05\x06"))
    ole = F.when(F.lower(path).endswith(".doc"), "doc").otherwise("ole")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(suffix == "", "unknown").otherwise(suffix)
    for kind, magic in MAGIC.items():
        value = ole if kind == "ole" else F.when(whole, inside).otherwise("invalid_zip") if kind == "zip" else F.lit(kind)
        out = F.when(head.startswith(magic), value).otherwise(out)
    return out


def decode_text(raw: bytes) -> str:
    """UTF-8 (byte-order mark dropped), GB 18030, UTF-16, in this order, else UTF-8 with replacements."""
    for name in ("utf-8-sig", "gb18030", "utf-16"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")


def docx_paragraphs(raw: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return ["".join((x.text or "") if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter()) for p in root.iter(f"{_W}p")]


def pdf_pages(raw: bytes) -> list[str]:
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages]


EXTRACTORS: dict[str, tuple[str, Callable[[bytes], list[str]]]] = {
    "pdf": ("page", pdf_pages),
    "docx": ("paragraph", docx_paragraphs),
    "txt": ("paragraph", lambda raw: decode_text(raw).split("\n\n")),
}


def extract_parts(files: DataFrame) -> DataFrame:
    """path, status (success, failed, unsupported), error (500 characters at most), parts (type, page, text). A file
    that breaks is a row with its error, not the end of the job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, raw, kind in zip(f["path"], f["content"], f["actual_format"], strict=True):
                if kind not in EXTRACTORS:
                    rows.append((path, "unsupported", f"no extractor for {kind}", []))
                    continue
                name, extract = EXTRACTORS[kind]
                try:
                    parts = [{"type": name, "page": k if name == "page" else None, "text": t} for k, t in enumerate(extract(bytes(raw)), 1)]
                    rows.append((path, "success", None, parts))
                except Exception as e:  # noqa: BLE001
                    rows.append((path, "failed", f"{type(e).__name__}: {e}"[:500], []))
            yield pd.DataFrame(rows, columns=["path", "status", "error", "parts"])

    return files.select("path", "content", "actual_format").mapInPandas(run, "path string, status string, error string, parts array<struct<type:string,page:int,text:string>>")


def ontology_tables(spark: SparkSession, ontology: dict) -> tuple[DataFrame, list[str]]:
    """Signatures (relation, source_type, target_type) and claim statuses of a parsed ontology."""
    rows = [(r, a, b) for r, s in ontology["allowed_relation_signatures"].items() for a in s["source"] for b in s["target"]]
    return spark.createDataFrame(rows, "relation string, source_type string, target_type string"), list(ontology["claim_statuses"])


def load_ontology(text: str) -> dict:
    """YAML if its reader is installed, else JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Token-level rows: orig_id, text (tokens joined by spaces), entities with character spans, relations."""
    kind = "orig_id string, tokens array<string>, entities array<struct<type:string,start:int,end:int>>, relations array<struct<type:string,head:int,tail:int>>"
    rows = spark.read.schema(kind).option("multiLine", True).json(path)
    at = lambda k: F.length(F.array_join(F.slice("tokens", F.lit(1), k), " "))
    spans = F.transform("entities", lambda e: F.struct(e["type"].alias("type"), (at(e["start"]) + F.when(e["start"] > 0, 1).otherwise(0)).alias("start"), at(e["end"]).alias("end")))
    return rows.withColumn("text", F.array_join("tokens", " ")).withColumn("entities", spans)


def triples(rows: DataFrame, ident: str, path: str) -> DataFrame:
    """subject, relation, object of a nested list of lists; others than triples are left out."""
    return rows.select(ident, F.explode(F.filter(path, lambda t: F.size(t) == 3)).alias("t")).select(ident, F.col("t")[0].alias("subject"), F.col("t")[1].alias("relation"), F.col("t")[2].alias("object"))


def read_checked(spark: SparkSession, path: str, sha256: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """read(path), if the file has the digest; ValueError else."""
    got = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if got != sha256:
        raise ValueError(f"{path} has SHA-256 {got}")
    return read(path)


def map_provider(jobs: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows that a model or service makes of jobs, batch by batch: the place for inference, which isn't included."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(provider, frames)

    return jobs.mapInPandas(run, schema)


def write_jsonl(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def write_ordered(rows: DataFrame, jobs: DataFrame, key: str, path: str, position: str = "position") -> None:
    """JSON lines in the jobs' order: range-partitioned by position, sorted within files."""
    rows.join(jobs.select(key, position), key).repartitionByRange(position).sortWithinPartitions(position).drop(position).write.json(path)


def write_split(rows: DataFrame, path: str, split: str = "split", order: str = "job_id") -> None:
    """One folder for each split, with each row's record_index in it."""
    w = Window.partitionBy(split).orderBy(order)
    rows.withColumn("record_index", F.row_number().over(w) - 1).write.partitionBy(split).json(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.option("header", True).option("sep", "\t").csv(path)


def plain_text(html: Column | str) -> Column:
    """Text of a web page: no scripts, styles, comments or tags, white space as single spaces."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def safe_path(path: str, forbidden: str = r"(^|[/_.-])test([/_.-]|$)") -> str:
    """The path; ValueError if it lies in a sealed part of the data."""
    if re.search(forbidden, path.lower()):
        raise ValueError(f"sealed path: {path}")
    return path
