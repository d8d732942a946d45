"""Strict readers: every record keeps its 1-based line, and what can't be read stays as an error of that line."""

from __future__ import annotations

import os
import sys
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import fail
from ..schema import MATCH_COLUMNS, TRIAL_COLUMNS
from .quoted import records
from .scratch import shared_folder

_NUMBERS = ("baseline", "candidate")


def resolve_format(path: str, explicit: str | None = None) -> str:
    return explicit or ("csv" if path.lower().endswith(".csv") else "jsonl")


def stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path))[0]


def read(spark: SparkSession, path: str, *, fmt: str | None = None, match: bool = False) -> DataFrame:
    """Records of a JSONL or CSV file, of standard input (``-``) or of a Parquet table."""
    if path == "-":
        path = _spooled(spark)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return _scan(spark, [path], resolve_format(path, fmt), match)


def _spooled(spark: SparkSession) -> str:
    """Standard input as a file of the shared folder, which goes with the session; a piece at a time passes through the driver."""
    jvm = spark.sparkContext._jvm
    path = f"{shared_folder(spark)}/stdin-{uuid.uuid4().hex}.records"
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(place)
    while piece := sys.stdin.buffer.read(1 << 20):
        out.write(piece)
    out.close()
    fs.deleteOnExit(place)
    return path


def _scan(spark: SparkSession, paths: list[str], kind: str, match: bool) -> DataFrame:
    try:
        return (read_csv if kind == "csv" else read_jsonl)(spark, paths, match)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            fail("Io", f"can't read {', '.join(paths)}")
        raise


@dataclass(frozen=True)
class Files:
    """Records of many files: the files' names in order, and one table in which ``of_file`` gives a record's file by its number."""

    names: list[str]
    rows: DataFrame


def read_files(spark: SparkSession, paths: list[str], fmt: str | None = None, match: bool = False) -> Files:
    """Records of many files or folders by the stem of their name, which must differ. Files of one format are one scan.

    A record's file is the last part of its path that is one of the names read, so a folder's files are one.
    """
    names = [stem(p.rstrip("/")) for p in paths]
    if len(set(names)) < len(names):
        fail("InvalidThreshold", "two files have the same name")
    parts = []
    for kind in dict.fromkeys(resolve_format(p, fmt) for p in paths):
        own = [i for i, p in enumerate(paths) if resolve_format(p, fmt) == kind]
        known = F.create_map(*(F.lit(x) for i in own for x in (os.path.basename(paths[i].rstrip("/")), i)))
        steps = F.split(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))), "/")
        number = F.element_at(F.filter(F.transform(steps, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()), -1)
        parts.append(_scan(spark, [paths[i] for i in own], kind, match).withColumn("of_file", number).drop("file"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return Files(names, rows)


def _numbered(rows: DataFrame, first: int) -> DataFrame:
    """The rows of files with their ``file`` and their ``line``, counted from ``first`` in each file.

    Rows are numbered within the blocks that files are read in; what stands before a block is the sum of the counts of
    the blocks before it. So a file of many blocks is numbered where it lies; joined in is one row for each block.
    """
    at = {"__file": F.col("_metadata.file_path"), "__start": F.col("_metadata.file_block_start"), "__id": F.monotonically_increasing_id()}
    placed = rows.select("*", *(c.alias(n) for n, c in at.items()))
    blocks = placed.groupBy("__file", "__start").agg(F.count("*").alias("n"), F.min("__id").alias("least"))
    before = F.sum("n").over(Window.partitionBy("__file").orderBy("__start").rowsBetween(Window.unboundedPreceding, -1))
    shift = blocks.select("__file", "__start", (F.coalesce(before, F.lit(0)) - F.col("least") + first).alias("__shift"))
    return placed.join(shift, ["__file", "__start"]).select(*rows.columns, F.col("__file").alias("file"), (F.col("__id") + F.col("__shift")).alias("line"))


def read_jsonl(spark: SparkSession, path: str | list[str], match: bool = False) -> DataFrame:
    """One JSON object a line; blank lines count but hold no record. Unknown keys are passed over, wrong types are errors.

    Spark's variant parser rejects repeated keys and malformed numbers; that nothing follows the object is
    checked by parsing it inside brackets, too.
    """
    names = MATCH_COLUMNS if match else TRIAL_COLUMNS
    lines = _numbered(spark.read.text(path), 1).where(F.trim(F.regexp_replace("value", r"\s", " ")) != "")
    v = F.try_parse_json("value")
    whole = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]")))
    rows = lines.select("file", "line", "value", v.alias("v"), whole.alias("w"))
    single = F.schema_of_variant("v").startswith("OBJECT") & F.col("w").isNotNull() & F.try_variant_get("w", "$[1]", "variant").isNull()
    kinds = {c: F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant")) for c in names}
    typed: Column = F.lit(True)
    for c, kind in kinds.items():
        numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
        ok = numeric if c in _NUMBERS and not match else kind == "STRING"
        typed = typed & F.coalesce(ok | (kind == "VOID"), F.lit(True))
    good = F.coalesce(single, F.lit(False)) & typed
    values = [F.when(good, F.try_variant_get("v", f"$.{c}", "double" if c in _NUMBERS and not match else "string")).alias(c) for c in names]
    error = F.when(~good, F.concat(F.lit("InvalidJson:"), F.lit("not a record: "), F.substring("value", 1, 80)))
    return rows.select(*values, "file", "line", error.alias("_error"))


def read_csv(spark: SparkSession, path: str | list[str], match: bool = False) -> DataFrame:
    """CSV with a header in each file; an empty cell is null. The line of a record is its number and that of the header.

    A record with more or fewer cells than its header is an error, as is a number that can't be read.
    """
    names = MATCH_COLUMNS if match else TRIAL_COLUMNS
    df = records(spark, path)
    text = lambda c: F.nullif(F.try_element_at("cells", F.nullif(F.array_position("head", c), F.lit(0)).cast("int")), F.lit(""))
    values, bad = [], F.lit(False)
    for c in names:
        if c in _NUMBERS and not match:
            number = text(c).try_cast("double")
            bad = bad | (text(c).isNotNull() & number.isNull())
            values.append(number.alias(c))
        else:
            values.append(text(c).alias(c))
    uneven = F.concat(F.lit("InvalidCsv:"), F.col("n_cells").cast("string"), F.lit(" cells where the header has "), F.size("head").cast("string"))
    error = F.when(F.col("n_cells") != F.size("head"), uneven).when(bad, F.lit("InvalidCsv:a number can't be read"))
    return df.select(*values, "file", (F.col("number") + 1).alias("line"), error.alias("_error"))
