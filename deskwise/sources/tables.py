"""Reading and writing message tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deskwise.functions.text import na_to_null, to_number
from deskwise.session import materialize


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; available: {df.columns}")
    return df


def select_present(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def tokens_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing-value tokens of text columns become null, as a data-frame CSV reader does."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wanted = [c for c in (columns or texts) if c in texts]
    return df.withColumns({c: na_to_null(c) for c in wanted})


def coerce_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(c) for c in columns})


def read_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    fmt: str = "csv",
    na_tokens: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """Read a message table; CSV columns are strings.

    ``escape='"'`` accepts doubled quotes, ``multi_line`` quoted line breaks. A multi-line CSV
    file cannot be split, so switch it off for large files without such breaks, or import many
    smaller files once and keep parquet from then on.
    """
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        return df.select(*columns) if columns else df
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    df = strip_headers(reader.option("inferSchema", False).csv(path))
    if columns:
        df = require_columns(df, columns).select(*columns)
    return tokens_to_null(df) if na_tokens else df


def read_checked(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected records) of CSV files with typed columns.

    A record is rejected if its number of fields is not the schema's or a field is not of its column's type. Rejects
    have ``file``, ``split_start`` (bytes), ``record`` (its text) and ``reason``. One scan that keeps every record; both
    sides read what it stored, so a record is on exactly one of them. Works on streams' batches too.
    """
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    raw = spark.read.schema(T.StructType([*texts, T.StructField(MALFORMED, T.StringType())])).option("header", header).option("escape", '"')
    raw = raw.option("multiLine", multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED).option("enforceSchema", True)
    rows = raw.csv(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
    return split_typed(materialize(rows, "csv-records"), schema)


def split_typed(rows: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(typed rows, rejects) of text columns; a column that does not parse names itself in the reason."""
    typed = {f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema}
    bad = [F.when(F.col(f"`{n}`").isNotNull() & c.isNull(), F.lit(f"{n} is not {schema[n].dataType.simpleString()}")) for n, c in typed.items()]
    wrong = F.concat_ws("; ", F.when(F.col(MALFORMED).isNotNull(), F.lit("number of fields")), *bad)
    judged = rows.withColumn("reason", wrong)
    fields = F.to_json(F.struct(*[F.col(f"`{n}`") for n in typed]))
    good = judged.where("reason = ''").select(*[c.alias(n) for n, c in typed.items()])
    rejects = judged.where("reason <> ''").select(
        F.col("__file").alias("file"), F.col("__start").alias("split_start"), F.coalesce(MALFORMED, fields).alias("record"), "reason"
    )
    return good, rejects


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy text work to every core when a freshly read table has too few splits.

    A table of one small file is read by one task. Such a table is cheap to shuffle; a table with at
    least as many splits as the cluster has cores comes back as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


BOM = "\ufeff"
MALFORMED = "__malformed"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", bom: bool = False) -> None:
    """Write a table. ``bom`` starts every CSV file with the UTF-8 byte order mark that spreadsheets look for.

    The mark is the first character of the header, so any file system that Spark writes to will do.
    """
    if fmt == "csv" and bom:
        df = df.toDF(BOM + df.columns[0], *df.columns[1:])
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer.format(fmt).save(path)


def by_source(df: DataFrame, source: str, column: str = "source") -> DataFrame:
    """Keep one brand of a multi-brand table; the equality reaches the parquet scan."""
    return df.where(F.col(column) == source)
