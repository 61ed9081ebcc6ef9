"""JSON and JSON-lines sources. Every reader gives DataFrames with a declared or merged schema."""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL = T.StructType(
    [
        T.StructField("video_id", T.StringType()),
        T.StructField("question_id", T.StringType()),
        T.StructField("question_category", T.StringType()),
        T.StructField("problem", T.StringType()),
        T.StructField("frames", T.ArrayType(T.StringType())),
        T.StructField("solution", T.StringType()),
    ]
)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    """One object per line; blank lines are skipped and a bad line fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def is_array_file(spark: SparkSession, path: str) -> bool:
    """Whether the first character that is not blank opens an array."""
    first = in_file_order(spark, path).filter(F.trim("value") != "").orderBy("file", "block", "ordinal").limit(1).collect()
    return bool(first) and first[0].value.lstrip().startswith("[")


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character. An empty file gives no rows."""
    reader = spark.read.option("mode", "FAILFAST")
    if schema is not None:
        reader = reader.schema(schema)
    if not is_array_file(spark, path):
        return reader.json(path)
    return reader.option("multiLine", True).json(path)


def read_by_suffix(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Dispatch on .json (an array) or .jsonl; anything else is an error."""
    low = path.lower().rstrip("/")
    if low.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if low.endswith(".json"):
        df = read_records(spark, path, schema)
        if not is_array_file(spark, path) and spark.read.text(path).filter(F.trim("value") != "").limit(1).count():
            raise ValueError(f"{path} holds no JSON array")
        return df
    raise ValueError(f"{path} is neither .json nor .jsonl")


def read_many(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Rows of several files by column name, with ``source_path`` and ``source_dir`` of each row.

    One job tells arrays from lines for all files, then each of the two shapes is one scan with one schema.
    """
    if not paths:
        raise ValueError("no files are given")
    opens = in_file_order(spark, list(paths)).filter(F.trim("value") != "").groupBy("file").agg(F.min_by(F.substring(F.trim("value"), 1, 1), F.struct("block", "ordinal")).alias("c"))
    arrays = {r.file for r in opens.filter("c = '['").collect()}
    plain = lambda p: re.sub(r"^file:/*", "/", p)
    known = {plain(unquote(f)) for f in arrays}
    parts = [[p for p in paths if plain(p) in known], [p for p in paths if plain(p) not in known]]
    out: DataFrame | None = None
    for own, multi in zip(parts, (True, False), strict=True):
        if own:
            df = spark.read.option("mode", "FAILFAST").option("multiLine", multi).json(own).withColumn("source_path", F.col("_metadata.file_path"))
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.withColumn("source_dir", F.regexp_replace("source_path", r"/[^/]*$", ""))


def in_file_order(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block, ordinal) of all lines: files by name, the blocks of a file by where they start, lines as they stand in a block."""
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("ordinal")]
    return spark.read.text(path).select("value", *at)


def read_prefix(spark: SparkSession, path: str | list[str], n: int | None, schema: T.StructType | str) -> DataFrame:
    """The first ``n`` lines in file order, parsed; a blank or bad line among them is an error."""
    lines = in_file_order(spark, path)
    if n is not None:
        lines = lines.orderBy("file", "block", "ordinal").limit(n)
    parsed = lines.select(F.from_json(F.when(F.trim("value") == "", F.raise_error(F.lit("blank line"))).otherwise(F.col("value")), schema if isinstance(schema, str) else schema.simpleString(), {"mode": "FAILFAST"}).alias("r"))
    return parsed.select("r.*")


def is_object(line: Column) -> Column:
    """Whether a line is exactly one JSON object, with nothing after it."""
    v = F.try_parse_json(line)
    whole = F.try_parse_json(F.concat(F.lit('{"w":'), line, F.lit("}"))).isNotNull()
    single = F.size(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))), "$", "array<variant>")) == 1
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")) & whole & single, F.lit(False))


def tolerant_lines(lines: DataFrame) -> DataFrame:
    """Add ``status``: blank, unparsable, not_object or ok, for a table of lines in ``value``."""
    parsed = F.try_parse_json(F.col("value")).isNotNull() & F.try_parse_json(F.concat(F.lit('{"w":'), "value", F.lit("}"))).isNotNull()
    return lines.withColumn("status", F.when(F.trim("value") == "", "blank").when(is_object(F.col("value")), "ok").when(~F.coalesce(parsed, F.lit(False)), "unparsable").otherwise("not_object"))


def read_configs(tables: dict[str, DataFrame], tag: str = "source_subset") -> DataFrame:
    """Union of several configurations of one data set, each row tagged with its name."""
    out: DataFrame | None = None
    for name, df in tables.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no configurations are given")
    return out


def to_canonical(df: DataFrame) -> DataFrame:
    """The six canonical columns, missing ones as NULL, cast to the declared types."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL.fields])
