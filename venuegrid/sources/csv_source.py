"""Reading place tables from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cleaning import rename_by_position
from ..schema import ID, SOURCE_HEADERS, missing_columns

# Texts that stand for a missing value in a source file.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

OFFSET_BITS = 40
ROW_BITS = 33
LISTED_FILES = 200_000
MOST_FILES = 1 << (63 - OFFSET_BITS)


def with_row_id(df: DataFrame, id_col: str = ID) -> DataFrame:
    """Number rows in file order, whatever the partitioning, without reading the
    data twice. Must follow a file scan directly.

    Within a file, the byte offset of a block plus the row's number in its
    partition increases: blocks of full size fill a partition of their own, and a
    row has at least one byte. Only last blocks share partitions, and nothing in
    their file follows them (as long as ``spark.sql.files.maxPartitionNum`` is not
    set). Files are ranked by path, from the scan's listing.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    position = F.col("_metadata.file_block_start") + row
    files = sorted(df.inputFiles())
    if len(files) > MOST_FILES:
        raise ValueError(f"row ids have room for {MOST_FILES} files, not for {len(files)}")
    if len(files) == 1:
        return df.select(*columns, position.alias(id_col))
    # Listing and scan write local paths with a different number of slashes.
    plain = lambda c: F.regexp_replace(c, "^([a-z0-9+.-]+):/+", "$1:/")
    ranks = df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), "path string, rank long")
    ranks = ranks.select(plain("path").alias("__file"), F.col("rank").alias("__rank"))
    listed = F.broadcast(ranks) if len(files) <= LISTED_FILES else ranks
    scan = df.select(*columns, plain(F.col("_metadata.file_path")).alias("__file"), position.alias("__position"))
    unlisted = F.raise_error(F.concat(F.lit("file missing from the listing: "), F.col("__file")))
    rank = F.when(F.col("__rank").isNull(), unlisted.cast("long")).otherwise(F.col("__rank"))
    too_long = F.raise_error(F.concat(F.lit("too large a file for row ids: "), F.col("__file")))
    inside = F.when(F.col("__position") >= 1 << OFFSET_BITS, too_long.cast("long")).otherwise(F.col("__position"))
    number = F.shiftleft(rank, OFFSET_BITS) + inside
    return scan.join(listed, "__file", "left").select(*columns, number.alias(id_col))


def nullify_tokens(df: DataFrame) -> DataFrame:
    """Texts that mean "missing" become null."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(*MISSING_TOKENS), F.col(f"`{c}`")) for c in texts})


def read_places(
    spark: SparkSession,
    path: str,
    *,
    headers: dict[str, str] | None = None,
    positional: bool = False,
    multiline: bool = False,
    row_id: bool = True,
) -> DataFrame:
    """Rows of a CSV file or folder, all columns as text, missing values as
    null. A missing path or required header is an error, and so are files whose
    headers differ in names or order. ``multiline`` allows
    line breaks in quoted fields but makes files unsplittable."""
    raw = (
        spark.read.option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        # Without this the header of one file would name the columns of all.
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    absent = [] if positional else missing_columns(raw, tuple(headers or SOURCE_HEADERS))
    if absent:
        raise ValueError(f"missing columns: {absent}")
    columns = raw.columns
    numbered = with_row_id(raw) if row_id else raw
    out = nullify_tokens(numbered)
    if positional:
        named = rename_by_position(out.select(*[F.col(f"`{c}`") for c in columns]))
        return named if not row_id else out.toDF(*named.columns, ID)
    return out
