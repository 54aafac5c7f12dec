"""Layouts of a published table that answer searches, lookups and deep pages without a scan.

``write_indexes`` writes, beside the table itself:

* ``by_id``: the rows in ranges of ids, sorted, so that a lookup reads the row groups whose
  bounds hold the id;
* ``name_grams``: for every three characters in a row of a lower-case name, the rows that
  have them, in ranges of grams, and how many each gram has. A search reads the rows of
  its rarest gram and verifies them on the name;
* ``by_rating``: the rows in ranges of the rating order, each in a folder of its own. A
  page counts rows by range, and sorts only the ranges that it touches.

Every exchange is a range partitioning on values that no single key fills: ids, grams with
ids, ratings with ids. Its partitions are few and large, as Spark draws their bounds from a
sample of some hundred rows for each, which goes to the driver. A partition of the rating
order is cut into ranges where it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import contains_text
from ..operators.filters import listing_filter
from ..operators.paging import PAGE_SIZE
from ..operators.ranking import DEFAULT_LIMIT, capped, order_for, top
from ..schema import ID, result_rows

GRAM = 3
BY_ID, GRAMS, GRAM_COUNTS, BY_RATING = "by_id", "name_grams", "name_gram_counts", "by_rating"
#: Rows of one range of the rating order.
RANGE_ROWS = 100_000
#: A layout has up to so many files of a range each; more rows go to files of so many rows.
FEW_FILES = 64
FILE_ROWS = 100_000
FILE_POSTINGS = 500_000
#: Ranges that one partition of the rating order can have.
PARTITION_RANGES = 1 << 31
#: Rows of a Parquet page, so that a reader can pass over most of a row group.
PAGE_ROWS = 2_000


def _files(rows: int, ranges: int, file_rows: int) -> int:
    """Files of a layout: one for each range, unless these are many and small."""
    return max(1, min(ranges, max(FEW_FILES, -(-rows // file_rows))))


def write_indexes(df: DataFrame, store: str, range_rows: int = RANGE_ROWS) -> None:
    """Write all layouts of a table of places below ``store``."""
    lower = F.lower("name")
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.length(lower) - (GRAM - 1), F.lit(0))), F.lit(0))).first()
    ranges = -(-n // range_rows)
    parts = _files(n, ranges, FILE_ROWS)
    sorted_rows = df.repartitionByRange(parts, ID).sortWithinPartitions(ID)
    sorted_rows.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).option(f"parquet.bloom.filter.enabled#{ID}", "true").parquet(f"{store}/{BY_ID}")

    places = F.sequence(F.lit(1), F.length(lower) - (GRAM - 1))
    grams = F.array_distinct(F.transform(places, lambda at: F.substring(lower, at, GRAM)))
    postings = df.where(F.length(lower) >= GRAM).select(F.explode(grams).alias("gram"), ID, "name", "rating", "distance")
    ordered = postings.repartitionByRange(_files(held, 8 * ranges, FILE_POSTINGS), "gram", ID).sortWithinPartitions("gram", ID)
    ordered.write.mode("overwrite").option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{store}/{GRAMS}")
    counts = df.sparkSession.read.parquet(f"{store}/{GRAMS}").groupBy("gram").agg(F.count("*").alias("rows"))
    counts.repartitionByRange(1 + parts // 64, "gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{store}/{GRAM_COUNTS}")

    order = order_for("rating")
    # The number of a sorted row is its partition's, and below bit 33 its place there.
    number = F.monotonically_increasing_id()
    place = number.bitwiseAND(F.lit((1 << 33) - 1))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        "*", (F.shiftright(number, 33) * PARTITION_RANGES + F.floor(place / range_rows)).alias("range")
    )
    ranged.sortWithinPartitions("range", *order).write.mode("overwrite").partitionBy("range").parquet(f"{store}/{BY_RATING}")


def lookup(spark: SparkSession, store: str, *ids: int) -> DataFrame:
    """The rows with these ids (few, as they become part of the filter)."""
    return spark.read.parquet(f"{store}/{BY_ID}").where(F.col(ID).isin(*ids))


def grams_of(query: str) -> list[str]:
    lower = query.lower()
    return sorted({lower[at : at + GRAM] for at in range(len(lower) - GRAM + 1)})


def search(spark: SparkSession, store: str, query: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """Places whose name contains the query, best rated first: as ``recommend.search``, from
    the rows of the query's rarest gram. A query shorter than a gram is looked for by a scan.
    """
    query = (query or "").strip()
    if not query:
        raise ValueError("a search needs some text")
    limit = capped(limit)
    if len(query.lower()) < GRAM:
        table = spark.read.parquet(f"{store}/{BY_ID}")
        return result_rows(top(table.where(contains_text("name", query)), "rating", limit))
    grams = grams_of(query)
    known = {r["gram"]: r["rows"] for r in spark.read.parquet(f"{store}/{GRAM_COUNTS}").where(F.col("gram").isin(*grams)).collect()}
    rarest = min(grams, key=lambda g: (known.get(g, 0), g))
    found = matches(spark, store, rarest).where(contains_text("name", query))
    # At most ``limit`` ids, which the lookup passes to the reader as a filter.
    best = [r[ID] for r in top(found, "rating", limit).select(ID).collect()]
    return result_rows(top(lookup(spark, store, *best), "rating", limit))


def matches(spark: SparkSession, store: str, gram: str) -> DataFrame:
    """The rows whose names have a gram: its part of the postings."""
    return spark.read.parquet(f"{store}/{GRAMS}").where(F.col("gram") == F.lit(gram)).drop("gram")


def page(spark: SparkSession, store: str, number: int = 1, size: int = PAGE_SIZE, **criteria) -> DataFrame:
    """A page of the listing with each row's list position as ``index``: as ``paging.page``,
    but only the ranges that hold the page's rows are read whole and sorted. Where they begin is
    known from a count by range, which needs only the columns of ``criteria``.
    """
    table = listing_filter(spark.read.parquet(f"{store}/{BY_RATING}"), **criteria)
    start, end = max((number - 1) * size, 0), max(number * size, 0)
    counts = sorted((r["range"], r["rows"]) for r in table.groupBy("range").agg(F.count("*").alias("rows")).collect())
    touched, before, first = [], 0, 0
    for part, rows in counts:
        if before + rows > start and before < end:
            first = first if touched else before
            touched.append(part)
        before += rows
    order = order_for("rating")
    rows = table.where(F.col("range").isin(*touched) if touched else F.lit(False)).orderBy(*order).offset(max(start - first, 0)).limit(end - start)
    return rows.withColumn("index", F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)).drop("range")
