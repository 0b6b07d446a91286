"""Pages, indexed editions, keyword files, dictionaries, decisions and configs read from files."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..numbering import dense_ids

INDEXED = T.StructType([
    T.StructField(name, T.StringType())
    for name in ("book_title", "inbook_section_id", "inbook_document_id", "scan_page", "section_type", "section_date", "palatinate", "convent_location", "created_location", "author", "paragraph", "pertinence")
])


def pages(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(edition, file_name, page_n, text): whole text files whose names begin with the pattern, numbered from 0 by name within a directory."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", "_metadata.file_path", "_metadata.file_name")
    kept = raw.where(F.col("file_name").rlike(f"^(?:{prefix})")).withColumn("edition", F.regexp_extract("file_path", "^(.*)/[^/]*$", 1))
    order = Window.partitionBy("edition").orderBy("file_name")
    return kept.select("edition", "file_name", (F.row_number().over(order) - 1).alias("page_n"), F.col("value").alias("text"))


def indexed_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an indexed edition as written by sinks.indexed_csv: no header, quotes doubled, line breaks within fields.

    An edition is one file, or a folder of several, read in the order of their names; place is that of the row in
    all of them. Numbers that are none are null, a document id that is no number stays a string in
    inbook_document_id alone.
    """
    raw = spark.read.schema(INDEXED).csv(path, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    placed = dense_ids(raw.select(*INDEXED.names, at.alias("_place")), "_place", "place")
    return (
        placed.withColumn("file", F.col("_place.file")).drop("_place")
        .withColumns({"inbook_section_id": F.col("inbook_section_id").try_cast("int"), "scan_page": F.col("scan_page").try_cast("int"), "document_number": F.col("inbook_document_id").try_cast("int")})
        .withColumn("pertinent", F.coalesce(F.col("pertinence") == "True", F.lit(False)))
    )


def editions(frames: Sequence[DataFrame]) -> DataFrame:
    """Several editions as one, in their order."""
    out = None
    for k, frame in enumerate(frames):
        one = frame.withColumn("edition_ord", F.lit(k))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no editions given")
    return out


def keyword_files(spark: SparkSession, path: str) -> DataFrame:
    """(keyword_category, group_n, lemma_n, lemma): a line is a group, the file's name the category; names that begin with _ are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="[!_]*.txt").select("value", "_metadata.file_name")
    lines = raw.select(F.regexp_replace("file_name", r"\.txt$", "").alias("keyword_category"), F.posexplode(F.split(F.regexp_replace("value", r"\n$", ""), "\n")).alias("group_n", "line"))
    lemmas = lines.select("keyword_category", "group_n", F.posexplode(F.filter(F.split("line", r"\s+"), lambda w: w != "")).alias("lemma_n", "lemma"))
    return lemmas


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(form, interps) from JSON lines; never evaluated."""
    return spark.read.schema("form string, interps array<string>").json(path)


def config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


DECISION = T.StructType([
    T.StructField("decision_n", T.IntegerType()), T.StructField("decision_type", T.StringType()), T.StructField("pagenum", T.IntegerType()),
    T.StructField("from_title", T.StringType()), T.StructField("to_title", T.StringType()), T.StructField("preceding_fragm", T.StringType()), T.StructField("following_fragm", T.StringType()),
    T.StructField("new_section_type", T.StringType()), T.StructField("section_type", T.StringType()), T.StructField("pertinence_status", T.BooleanType()),
    T.StructField("date", T.StructType([T.StructField(x, T.IntegerType()) for x in ("day", "month", "year")])),
])


def decisions(spark: SparkSession, path: str) -> DataFrame:
    """Manual decisions, numbered in file order, from a JSON list, or from a plain YAML list of mappings of scalars.

    Only data are read: tags that would build objects are rejected. A date is three numbers, d, m, y.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    items = json.loads(text) if text.lstrip().startswith("[") else _plain_yaml(text)
    rows = []
    for n, item in enumerate(items):
        date = item.get("date")
        row = {name: item.get(name) for name in DECISION.names}
        row |= {"decision_n": n, "date": dict(zip(("day", "month", "year"), map(int, date))) if date else None}
        rows.append(tuple(row[name] for name in DECISION.names))
    return spark.createDataFrame(rows, DECISION)


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"[" and text:
        return json.loads(text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def _plain_yaml(text: str) -> list[dict]:
    out: list[dict] = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if "!!" in line.split("#")[0] or line.lstrip("- ").startswith("!"):
            raise ValueError("objects are not read from decisions")
        if line.startswith("- "):
            out.append({})
            line = line[2:]
        key, _, value = line.strip().partition(":")
        if not out or not key:
            raise ValueError(f"not a list of decisions: {line}")
        out[-1][key] = _scalar(value)
    return out


def yaml_of(items: Sequence[dict]) -> str:
    """The text that decisions() reads back."""
    return "".join("- " + "\n  ".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in item.items()) + "\n" for item in items)
