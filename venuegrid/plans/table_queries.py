"""Catalog: ingestion, cleaning, statistics, quality and display."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import display, numbers, text
from ..functions.rules import Rule
from ..operators import cleaning, impute, quality, statistics
from ..runtime import scratch_folder
from ..sources import tables
from ..sources.csv_source import read_places
from .registry import query, rounded
from .views import view


@query(
    "summary_stats",
    "lines",
    check="""SELECT count(*) AS total, round(avg(price), 6) AS avg_price, round(avg(rating), 6) AS avg_rating,
             round(avg(distance), 6) AS avg_distance FROM lines""",
)
def summary_stats(spark, folder) -> DataFrame:
    return rounded(statistics.summary_stats(view(spark, folder, "lines")))


FIVE = """round(min({c}), 6) AS {c}_min, round(max({c}), 6) AS {c}_max, round(avg({c}), 6) AS {c}_mean,
          round(median({c}), 6) AS {c}_median, round(stddev_samp({c}), 6) AS {c}_std"""


@query(
    "data_summary",
    "lines",
    check="SELECT count(*) AS total, count(DISTINCT type) AS unique_types, "
    + ", ".join(FIVE.format(c=c) for c in ("price", "rating", "distance"))
    + " FROM lines",
)
def data_summary(spark, folder) -> DataFrame:
    return rounded(statistics.data_summary(view(spark, folder, "lines")))


@query("percentile_stats", "lines", check="SELECT round(quantile_cont(price, 0.9), 6) AS percentile FROM lines")
def percentile_stats(spark, folder) -> DataFrame:
    return rounded(statistics.percentile_of(view(spark, folder, "lines"), "price", 90))


DESCRIBE = """SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
    min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50,
    round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lines"""


@query("describe", "lines", check=" UNION ALL ".join(DESCRIBE.format(c=c) for c in ("price", "rating", "distance")))
def describe(spark, folder) -> DataFrame:
    return rounded(statistics.describe(view(spark, folder, "lines")))


@query(
    "rule_violations",
    "raw_offers",
    check="""SELECT count_if(try_cast(price AS DOUBLE) IS NULL) AS invalid_price,
    count_if(try_cast(price AS DOUBLE) < 0) AS negative_price, count_if(try_cast(rating AS DOUBLE) IS NULL) AS invalid_rating,
    count_if(try_cast(rating AS DOUBLE) < 1 OR try_cast(rating AS DOUBLE) > 5) AS rating_out_of_range,
    count_if(try_cast(distance AS DOUBLE) IS NULL) AS invalid_distance,
    count_if(try_cast(distance AS DOUBLE) < 0) AS negative_distance FROM raw_offers""",
)
def rule_violations(spark, folder) -> DataFrame:
    return quality.rule_violations(view(spark, folder, "raw_offers"))


@query(
    "validate_schema_stats",
    "raw_offers",
    check="""WITH t AS (SELECT name, type, price, rating, location, distance FROM raw_offers),
    n AS (SELECT count(*) AS total_rows FROM t), d AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM t))
    SELECT total_rows, 6 AS total_columns, total_rows - k AS duplicate_rows, "column", missing FROM n, d,
    (SELECT unnest(['name', 'type', 'price', 'rating', 'location', 'distance']) AS "column",
            unnest([count_if(name IS NULL), count_if(type IS NULL), count_if(price IS NULL), count_if(rating IS NULL),
                    count_if(location IS NULL), count_if(distance IS NULL)]) AS missing FROM t)""",
)
def validate_schema_stats(spark, folder) -> DataFrame:
    profile = quality.table_profile(view(spark, folder, "raw_offers").drop("place_id"))
    return profile.select(
        "total_rows", "total_columns", "duplicate_rows", F.explode("missing").alias("column", "missing")
    )


@query(
    "validate_report",
    "raw_offers",
    check="""WITH c AS (SELECT count_if(try_cast(price AS DOUBLE) IS NULL) AS a,
    count_if(try_cast(price AS DOUBLE) < 0) AS b, count_if(try_cast(rating AS DOUBLE) IS NULL) AS c,
    count_if(try_cast(rating AS DOUBLE) < 1 OR try_cast(rating AS DOUBLE) > 5) AS d,
    count_if(try_cast(distance AS DOUBLE) IS NULL) AS e,
    count_if(try_cast(distance AS DOUBLE) < 0) AS f, count(*) AS n FROM raw_offers)
    SELECT true AS is_valid, '' AS errors, n AS total_rows, concat_ws('; ',
      CASE WHEN a > 0 THEN a || ' rows with an invalid price' END, CASE WHEN b > 0 THEN b || ' rows with a negative price' END,
      CASE WHEN c > 0 THEN c || ' rows with an invalid rating' END, CASE WHEN d > 0 THEN d || ' rows with a rating outside 1-5' END,
      CASE WHEN e > 0 THEN e || ' rows with an invalid distance' END,
      CASE WHEN f > 0 THEN f || ' rows with a negative distance' END) AS warnings FROM c""",
)
def validate_report(spark, folder) -> DataFrame:
    raw = view(spark, folder, "raw_offers").withColumnsRenamed({v: k for k, v in cleaning.SOURCE_HEADERS.items()})
    report = quality.validate(raw)
    return report.select(
        "is_valid", F.concat_ws("; ", "errors").alias("errors"), "total_rows", F.concat_ws("; ", "warnings").alias("warnings")
    )


@query(
    "missing_pct",
    "gaps",
    check=" UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 2) AS missing_pct,"
        f" round(avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) * 100, 2) > 10 AS flagged FROM gaps"
        for c in ("place_id", "type", "price", "rating", "location")
    ),
)
def missing_pct(spark, folder) -> DataFrame:
    return quality.missing_percentages(view(spark, folder, "gaps"))


RULES = [
    Rule("price", "float", min_value=1000, max_value=400000),
    Rule("rating", "int", required=True, max_value=5),
    Rule("location", "string", required=True),
    Rule("name", "string", min_length=12, max_length=13, pattern="[A-Z][a-z]+ [0-9]"),
]


@query(
    "value_rules",
    "raw_offers",
    check="""WITH v AS (SELECT unnest([
      CASE WHEN price IS NULL THEN NULL WHEN try_cast(price AS DOUBLE) IS NULL THEN 'price: Invalid float value'
           WHEN CAST(price AS DOUBLE) < 1000 THEN 'price: Value must be at least 1000'
           WHEN CAST(price AS DOUBLE) > 400000 THEN 'price: Value must be at most 400000' END,
      CASE WHEN rating IS NULL THEN 'rating: Value is required' WHEN CAST(rating AS DOUBLE) > 5 THEN 'rating: Value must be at most 5' END,
      CASE WHEN location IS NULL THEN 'location: Value is required' END,
      CASE WHEN length(trim(name)) < 12 THEN 'name: String must be at least 12 characters'
           WHEN length(trim(name)) > 13 THEN 'name: String must be at most 13 characters' END]) AS violation FROM
      (SELECT * REPLACE (CASE WHEN price = 'n/a' THEN 'x' ELSE price END AS price) FROM raw_offers))
    SELECT violation, count(*) AS rows FROM v WHERE violation IS NOT NULL GROUP BY violation""",
)
def value_rules(spark, folder) -> DataFrame:
    return quality.rule_counts(view(spark, folder, "raw_offers"), RULES)


@query(
    "value_rules_lists",
    "raw_offers",
    check="""WITH t AS (SELECT string_split(name, ' ') AS words, trim(name) AS name, place_id FROM raw_offers)
    SELECT violation, count(*) AS rows FROM (SELECT unnest([
      CASE WHEN len(words) > 5 THEN 'words: List must have at most 5 items' END,
      CASE WHEN NOT regexp_matches(name, '^Customer [0-9]*[02468]$') THEN 'name: String format is invalid' END,
      CASE WHEN place_id < 10 THEN 'place_id: Value must be at least 10' END]) AS violation FROM t)
    WHERE violation IS NOT NULL GROUP BY violation""",
)
def value_rules_lists(spark, folder) -> DataFrame:
    """Rules on lists, on a pattern that some texts break, and on a typed number."""
    rows = view(spark, folder, "raw_offers").withColumn("words", F.split("name", " "))
    rules = [
        Rule("words", "list", required=True, min_length=1, max_length=5),
        Rule("name", "string", pattern="Customer [0-9]*[02468]$"),
        Rule("place_id", "int", min_value=10),
    ]
    return quality.rule_counts(rows, rules)


@query(
    "validate_missing",
    "raw_offers",
    check="""SELECT false AS is_valid, 'missing columns: Rating Tempat Makan, Lokasi (maps)' AS errors, count(*) AS total_rows,
    '' AS warnings FROM raw_offers""",
)
def validate_missing(spark, folder) -> DataFrame:
    """A table without two of the required columns."""
    raw = view(spark, folder, "raw_offers").drop("rating", "location")
    report = quality.validate(raw.withColumnsRenamed({v: k for k, v in cleaning.SOURCE_HEADERS.items()}))
    return report.select(
        "is_valid", F.concat_ws("; ", "errors").alias("errors"), "total_rows", F.concat_ws("; ", "warnings").alias("warnings")
    )


@query(
    "rename_positional",
    "raw_offers",
    check="SELECT name, type, price, rating, location, distance, place_id AS extra FROM raw_offers",
)
def rename_positional(spark, folder) -> DataFrame:
    """Columns named by their place, whatever their headers."""
    columns = ("name", "type", "price", "rating", "location", "distance", "place_id")
    return cleaning.rename_by_position(view(spark, folder, "raw_offers").select(*[F.col(c).alias(f"header {k}") for k, c in enumerate(columns)]))


@query("link_test", "links", check="SELECT place_id, starts_with(location, 'http') AS is_link FROM links")
def link_test(spark, folder) -> DataFrame:
    return view(spark, folder, "links").select("place_id", text.is_link("location").alias("is_link"))


TYPE_CASE = "replace(replace(trim(type), 'warung', 'Warung'), 'CAFE', 'Cafe')"


@query(
    "clean_ingest",
    "raw_offers",
    check=f"""SELECT place_id, trim(name) AS name, {TYPE_CASE} AS type, CAST(price AS DOUBLE) AS price,
    CAST(rating AS DOUBLE) AS rating, location, CAST(distance AS DOUBLE) AS distance FROM raw_offers
    WHERE try_cast(price AS DOUBLE) > 0 AND try_cast(rating AS DOUBLE) BETWEEN 1 AND 5 AND try_cast(distance AS DOUBLE) >= 0""",
)
def clean_ingest(spark, folder) -> DataFrame:
    raw = view(spark, folder, "raw_offers").withColumnsRenamed({v: k for k, v in cleaning.SOURCE_HEADERS.items()})
    return cleaning.clean_places(raw)


@query(
    "csv_ingest",
    "raw_offers",
    check=f"""SELECT place_id, trim(name) AS name, {TYPE_CASE} AS type, CAST(price AS DOUBLE) AS price,
    CAST(rating AS DOUBLE) AS rating, location, CAST(distance AS DOUBLE) AS distance FROM raw_offers
    WHERE try_cast(price AS DOUBLE) > 0 AND try_cast(rating AS DOUBLE) BETWEEN 1 AND 5 AND try_cast(distance AS DOUBLE) >= 0""",
)
def csv_ingest(spark, folder) -> DataFrame:
    """Write raw offers as CSV with the source's headers, read and clean them."""
    path = scratch_folder(spark) + "/raw"
    raw = view(spark, folder, "raw_offers").withColumnsRenamed({v: k for k, v in cleaning.SOURCE_HEADERS.items()})
    tables.export(raw, path, "csv")
    read = read_places(spark, path, row_id=False)
    return cleaning.clean_places(read.withColumn("place_id", F.col("place_id").cast("long")))


@query(
    "drop_missing",
    "gaps",
    check="SELECT * FROM gaps WHERE type IS NOT NULL AND price IS NOT NULL AND rating IS NOT NULL AND location IS NOT NULL",
)
def drop_missing(spark, folder) -> DataFrame:
    return impute.handle_missing(view(spark, folder, "gaps"), "drop")


MODE = "(SELECT {c} FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@query(
    "impute_mean",
    "gaps",
    check=f"""SELECT place_id, coalesce(type, {MODE.format(c='type')}) AS type,
    round(coalesce(price, (SELECT avg(price) FROM gaps)), 6) AS price,
    round(coalesce(rating, (SELECT avg(rating) FROM gaps)), 6) AS rating,
    coalesce(location, {MODE.format(c='location')}) AS location FROM gaps""",
)
def impute_mean(spark, folder) -> DataFrame:
    return rounded(impute.handle_missing(view(spark, folder, "gaps"), "fill_mean"))


@query(
    "impute_median",
    "gaps",
    check="""SELECT place_id, type, round(coalesce(price, (SELECT median(price) FROM gaps)), 6) AS price,
    round(coalesce(rating, (SELECT median(rating) FROM gaps)), 6) AS rating, location FROM gaps""",
)
def impute_median(spark, folder) -> DataFrame:
    return rounded(impute.handle_missing(view(spark, folder, "gaps"), "fill_median"))


@query(
    "iqr_outliers",
    "lines",
    check="""WITH pq AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM lines),
    p AS (SELECT lines.* FROM lines, pq WHERE price BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)),
    dq AS (SELECT quantile_cont(distance, 0.25) AS a, quantile_cont(distance, 0.75) AS b FROM p),
    d AS (SELECT p.* FROM p, dq WHERE distance BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
    SELECT type, count(*) AS n, round(min(price), 6) AS low, round(max(price), 6) AS high, round(avg(price), 6) AS mean
    FROM d WHERE rating BETWEEN 1 AND 5 AND price > 0 AND distance > 0 GROUP BY type""",
)
def iqr_outliers(spark, folder) -> DataFrame:
    inside, _ = cleaning.drop_outliers(view(spark, folder, "lines").na.drop("any"))
    usable = cleaning.usable_for_clustering(inside)
    return rounded(
        usable.groupBy("type").agg(
            F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean")
        )
    )


PUNCTUATION = """[.,;:!?()\\[\\]{}"''\\-]"""
GENERIC = r"(^|[^\p{L}\p{N}_])(restoran|warung|cafe|kedai|rumah makan|rm|depot)([^\p{L}\p{N}_]|$)"
BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _key_sql(c: str) -> str:
    """The match key. The word pattern consumes its neighbours, hence twice."""
    base = f"regexp_replace(trim(regexp_replace(lower({c}), '{BLANKS}', ' ', 'g')), '{PUNCTUATION}', '', 'g')"
    once = f"regexp_replace({base}, '{GENERIC}', '\\1\\3', 'g')"
    twice = f"regexp_replace({once}, '{GENERIC}', '\\1\\3', 'g')"
    return f"trim(regexp_replace({twice}, '{BLANKS}', ' ', 'g'))"


@query("normalize_key", "texts", check=f"SELECT place_id, {_key_sql('name')} AS match_key FROM texts")
def normalize_key(spark, folder) -> DataFrame:
    return view(spark, folder, "texts").select("place_id", text.match_key("name").alias("match_key"))


@query(
    "clean_text",
    "texts",
    check=f"""SELECT place_id, regexp_replace(trim(regexp_replace(name, '{BLANKS}', ' ', 'g')),
    '[^\\p{{L}}\\p{{N}}_ .,!?()\\-]', '', 'g') AS cleaned FROM texts""",
)
def clean_text(spark, folder) -> DataFrame:
    return view(spark, folder, "texts").select("place_id", text.clean_text("name").alias("cleaned"))


@query(
    "present_columns",
    "offers",
    check="""SELECT place_id,
    CASE WHEN price >= 1000000 THEN 'Rp ' || printf('%.1f', price / 1e6) || 'M'
         WHEN price >= 1000 THEN 'Rp ' || printf('%.0f', price / 1e3) || 'K' ELSE 'Rp ' || printf('%.0f', price) END AS price_text,
    CASE WHEN distance < 1 THEN printf('%.0f', distance * 1000) || ' m' ELSE printf('%.1f', distance) || ' km' END AS distance_text,
    printf('%.1f', rating) || '/5 ' || repeat('★', CAST(rating AS INT)) || repeat('☆', 5 - CAST(rating AS INT)) AS rating_text,
    starts_with(location, 'http') AS is_link FROM offers""",
)
def present_columns(spark, folder) -> DataFrame:
    return view(spark, folder, "offers").select(
        "place_id",
        display.format_currency("price").alias("price_text"),
        display.format_distance("distance").alias("distance_text"),
        display.format_rating("rating").alias("rating_text"),
        text.is_link("location").alias("is_link"),
    )


@query(
    "foreign_currency",
    "lines",
    check="""SELECT 'USD ' || format('{:,.2f}', price) AS price_text, printf('%.1f', rating) || ' mi' AS distance_text,
    count(*) AS n FROM lines GROUP BY ALL""",
)
def foreign_currency(spark, folder) -> DataFrame:
    lines = view(spark, folder, "lines")
    return lines.groupBy(
        display.format_currency("price", "USD").alias("price_text"), display.format_distance("rating", "mi").alias("distance_text")
    ).agg(F.count("*").alias("n"))


@query(
    "bands",
    "offers",
    check="""SELECT CASE WHEN price <= 25000 THEN 'Budget' WHEN price <= 50000 THEN 'Moderate' WHEN price <= 100000 THEN 'Expensive'
      ELSE 'Premium' END AS price_band,
    CASE WHEN distance <= 1 THEN 'Very Close' WHEN distance <= 3 THEN 'Close' WHEN distance <= 5 THEN 'Moderate'
      WHEN distance <= 10 THEN 'Far' ELSE 'Very Far' END AS distance_band,
    CASE WHEN rating >= 4.5 THEN 'Excellent' WHEN rating >= 4 THEN 'Very Good' WHEN rating >= 3.5 THEN 'Good'
      WHEN rating >= 3 THEN 'Average' WHEN rating >= 2 THEN 'Below Average' ELSE 'Poor' END AS rating_band,
    CASE WHEN rating * 20 >= 90 THEN 'Sangat Baik' WHEN rating * 20 >= 70 THEN 'Baik' WHEN rating * 20 >= 50 THEN 'Cukup'
      ELSE 'Perlu Perbaikan' END AS quality_band,
    CASE WHEN distance / 5 > 0.5 THEN 'Good' WHEN distance / 5 > 0.3 THEN 'Fair' ELSE 'Poor' END AS silhouette_band,
    count(*) AS n FROM offers GROUP BY ALL""",
)
def bands(spark, folder) -> DataFrame:
    offers = view(spark, folder, "offers")
    return offers.groupBy(
        numbers.price_band("price").alias("price_band"),
        numbers.distance_band("distance").alias("distance_band"),
        numbers.rating_band("rating").alias("rating_band"),
        numbers.quality_band(F.col("rating") * 20).alias("quality_band"),
        numbers.silhouette_band(F.col("distance") / 5).alias("silhouette_band"),
    ).agg(F.count("*").alias("n"))


@query(
    "safe_math",
    "gaps",
    check="""SELECT place_id, round(coalesce(price / nullif(rating - 1, 0), -1), 6) AS quotient,
    CASE WHEN price IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, (price - 50000) / 300000)) END AS position,
    CASE WHEN price IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS flat FROM gaps""",
)
def safe_math(spark, folder) -> DataFrame:
    return view(spark, folder, "gaps").select(
        "place_id",
        F.round(numbers.safe_divide("price", F.col("rating") - 1, -1), 6).alias("quotient"),
        numbers.normalise("price", F.lit(50000), F.lit(350000)).alias("position"),
        numbers.normalise("price", F.lit(7), F.lit(7)).alias("flat"),
    )


EXPORTED = "SELECT place_id, name, type, price, rating, location, distance, cluster FROM places"
PLACES = "place_id long, name string, type string, price double, rating double, location string, distance double, cluster int"


@query("export_csv", "places", check=EXPORTED)
def export_csv(spark, folder) -> DataFrame:
    path = scratch_folder(spark) + "/csv"
    tables.export(view(spark, folder, "places"), path, "csv")
    return spark.read.schema(PLACES).option("header", True).option("escape", '"').csv(path)


@query("export_json", "places", check=EXPORTED)
def export_json(spark, folder) -> DataFrame:
    path = scratch_folder(spark) + "/json"
    tables.export(view(spark, folder, "places"), path, "JSON")
    return spark.read.schema(PLACES).json(path)


@query("publish_and_filter", "places", check=EXPORTED + " WHERE price <= 1000 AND cluster = 2")
def publish_and_filter(spark, folder) -> DataFrame:
    store = scratch_folder(spark)
    places = view(spark, folder, "places")
    tables.publish(places.drop("cluster"), store, tables.CLEANED)
    tables.publish(places, store, tables.CLUSTERED)
    latest = tables.read_published(spark, store, {"max_price": 1000})
    return latest.where(F.col("cluster") == 2).select(*places.columns)
