"""Readers with explicit schemas: no inference, missing markers become null at the boundary."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from decant.operators.prefix import prefix
from decant.session import materialise
from decant.sources import digests

ITEM_SCHEMA = (
    "item_id bigint, split string, category string, lang string, context string, question string, candidates array<string>, "
    "gold int, variant_of bigint, variant string, gen_seed bigint, source string, extra string"
)


def decode_items(raw: DataFrame) -> DataFrame:
    """Items whose candidates are stored as JSON text."""
    return raw.withColumn("candidates", F.from_json("candidates", "array<string>"))


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object per non-blank line; a bad line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Like ``jsonl`` but a damaged line is dropped and a missing file is empty."""
    try:
        raw = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return raw.filter("_corrupt_record is null").drop("_corrupt_record")


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated file or folder of files, each with a header row and an optional byte-order mark.

    Adds the row index ``_idx`` over all files in the order of their names. Rows are numbered inside their file block
    and offset by the blocks before it, so nothing is pulled together.
    """
    raw = spark.read.text(path).filter("value <> ''").select(
        "value", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")).alias("block"), F.monotonically_increasing_id().alias("mid"))
    # written before it is numbered: row order inside a block comes from the read itself
    raw = materialise(raw, "tsv")
    lines = prefix(raw, ["mid"], F.col("block"), rank="n")
    heads = lines.groupBy("block.file").agg(F.min("n").alias("head"), F.count("*").alias("rows"))
    before = Window.orderBy("head").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row per file
    heads = heads.select(F.col("file").alias("_file"), "head", F.count("*").over(before).alias("heads"))
    r = F.from_csv("value", schema, {"sep": "\t", "mode": "PERMISSIVE"})
    d = lines.join(heads, F.col("block.file") == F.col("_file")).filter(F.col("n") > F.col("head"))
    return d.select(r.alias("r"), (F.col("n") - F.col("heads") - 1).alias("_idx")).select("r.*", "_idx")


def csv_nullable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV log where blanks and NaN both mean missing."""
    d = spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return d.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])


def fnum(text: str | Column) -> Column:
    """Text as a number; garbage, blanks and NaN become null."""
    v = (F.col(text) if isinstance(text, str) else text).try_cast("double")
    return F.when(~F.isnan(v), v)


def with_defaults(parts: Sequence[DataFrame], defaults: dict[str, str]) -> DataFrame:
    """Union of old and new layouts; columns an old layout lacks take their default."""
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p, allowMissingColumns=True)
    return d.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def nested(doc: str | Column, path: str, kind: str = "double", default=None) -> Column:
    """Value at a dotted path of a JSON document, or the default."""
    v = F.get_json_object(doc, "$." + path).try_cast(kind)
    return v if default is None else F.coalesce(v, F.lit(default))


def file_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Bytes and sha256 per file. Files of a slice at most are hashed where they are read, longer ones slice by slice, save
    packed ones, which Spark reads as a whole only.
    """
    files = spark.read.format("binaryFile")
    d = files.option("pathGlobFilter", pattern).load(folder)
    short, long = F.col("length") <= digests.SLICE, F.col("length") > digests.SLICE  # bare, so that the reader skips by them
    found = [tuple(r) for r in d.filter(long).select("path", "length").collect()]
    sliced = [f for f in found if not f[0].lower().endswith(digests.PACKED)]
    hashed = [(path, size, sha256) for (path, size), sha256 in zip(sliced, digests.sha256_in_slices(spark, sliced), strict=True)]
    whole = [d.filter(short)] + [files.load(digests.exact(path)) for path, _ in found if path.lower().endswith(digests.PACKED)]
    each = [w.select("path", "length", F.sha2("content", 256).alias("sha256")) for w in whole]
    if hashed:
        each.append(spark.createDataFrame(hashed, "path string, length bigint, sha256 string"))
    return reduce(DataFrame.unionByName, each).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256")


def file_rows(spark: SparkSession, paths: Sequence[str], kind: str) -> DataFrame:
    """Rows of every file below ``paths`` by its format: records of ``parquet``, lines that are not blank of ``jsonl``, and
    those of ``tsv`` without the header. Files of one call share a schema; files without rows have a row with 0 if they
    hold a line at all.

    Nothing but counts leaves a task, and parquet counts come from the files' footers where they are whole.
    """
    name = F.col("_metadata.file_name").alias("file")
    if kind == "parquet":
        return spark.read.parquet(*paths).groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
    if kind not in ("jsonl", "tsv"):
        raise ValueError(f"unknown format {kind}")
    lines = spark.read.text(list(paths)).groupBy(name).agg(F.count_if(F.trim(F.regexp_replace("value", "[\\t\\r\ufeff]", " ")) != "").alias("rows"))
    return lines.select("file", F.greatest(F.col("rows") - (1 if kind == "tsv" else 0), F.lit(0)).cast("bigint").alias("rows"))


def label_mismatch(observed: DataFrame, expected: DataFrame, col: str) -> DataFrame:
    """Names on only one side; an empty result means the constant table is right."""
    o, e = observed.select(col).distinct(), expected.select(col).distinct()
    return (o.join(e, col, "left_anti").withColumn("only_in", F.lit("data"))
            .unionByName(e.join(o, col, "left_anti").withColumn("only_in", F.lit("table"))))
