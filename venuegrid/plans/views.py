"""Place-shaped views of the given tables.

The expressions are valid in Spark and in ANSI engines alike, so the catalog and
its check queries read the very same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str]]] = {
    # Few names and types, moderate prices.
    "places": (
        "part",
        [
            "p_partkey AS place_id",
            "p_name AS name",
            "p_type AS type",
            "p_retailprice AS price",
            "CAST(1 + p_size % 5 AS DOUBLE) AS rating",
            "p_brand AS location",
            "CAST(p_size AS DOUBLE) / 10 AS distance",
            "CAST(p_partkey % 3 AS INT) AS cluster",
        ],
    ),
    # Many names, wide prices; clusters are price bands.
    "offers": (
        "orders",
        [
            "o_orderkey AS place_id",
            "concat('Customer ', CAST(o_custkey AS VARCHAR(20)), ' ', o_orderpriority) AS name",
            "o_orderpriority AS type",
            "o_totalprice AS price",
            "CAST(1 + o_orderkey % 5 AS DOUBLE) AS rating",
            "o_orderstatus AS location",
            "CAST(o_custkey % 50 AS DOUBLE) / 10 AS distance",
            "CAST(least(2, floor(o_totalprice / 170000)) AS INT) AS cluster",
        ],
    ),
    # Offers as a careless source delivers them: texts, gaps, values out of range.
    "raw_offers": (
        "orders",
        [
            "o_orderkey AS place_id",
            "concat('  Customer ', CAST(o_custkey AS VARCHAR(20)), ' ') AS name",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat(o_orderpriority, ' warung & CAFE ') END AS type",
            "CASE WHEN o_totalprice > 490000 THEN 'n/a' WHEN o_totalprice < 5000 THEN concat('-', CAST(o_totalprice AS VARCHAR(20)))"
            " ELSE CAST(o_totalprice AS VARCHAR(20)) END AS price",
            "CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'O' THEN NULL"
            " ELSE CAST(1 + o_orderkey % 6 AS VARCHAR(20)) END AS rating",
            "NULLIF(o_orderstatus, 'F') AS location",
            "CAST(CAST(o_custkey % 50 - 2 AS DOUBLE) / 10 AS VARCHAR(20)) AS distance",
        ],
    ),
    # The same gaps in typed columns.
    "gaps": (
        "orders",
        [
            "o_orderkey AS place_id",
            "CASE WHEN o_orderpriority = '2-HIGH' THEN NULL ELSE o_orderpriority END AS type",
            "CASE WHEN o_totalprice > 450000 THEN NULL ELSE o_totalprice END AS price",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(1 + o_orderkey % 5 AS DOUBLE) END AS rating",
            "NULLIF(o_orderstatus, 'F') AS location",
        ],
    ),
    # Offers with the names of their clusters.
    "named": (
        "orders",
        [
            "o_orderkey AS place_id",
            "o_totalprice AS price",
            "CASE WHEN o_totalprice < 170000 THEN 'Ekonomis' WHEN o_totalprice < 340000 THEN 'Menengah' ELSE 'Premium' END AS cluster_name",
        ],
    ),
    # Pages by address, some of them without one.
    "links": (
        "pages",
        [
            "page_id AS place_id",
            "CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN concat(' ', url) ELSE url END AS location",
        ],
    ),
    # Offers of which some have no rating, some no distance, some neither.
    "unrated": (
        "orders",
        [
            "o_orderkey AS place_id",
            "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(1 + o_orderkey % 5 AS DOUBLE) END AS rating",
            "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 30 AS DOUBLE) / 10 END AS distance",
        ],
    ),
    # Whole documents: long texts with exact copies.
    "texts": (
        "documents",
        [
            "doc_id AS place_id",
            "text AS name",
            "lang AS type",
            "CAST(n_chars AS DOUBLE) AS price",
            "CAST(1 + doc_id % 5 AS DOUBLE) AS rating",
            "lang AS location",
            "CAST(doc_id % 30 AS DOUBLE) / 10 AS distance",
        ],
    ),
    # Web pages as places: title and address, with near copies.
    "listings": (
        "pages",
        [
            "page_id AS place_id",
            "regexp_extract(html, '<title>(.*?)</title>', 1) AS name",
            "regexp_extract(url, '[.](com|org|net)/', 1) AS type",
            "CAST(length(html) AS DOUBLE) AS price",
            "CAST(1 + page_id % 5 AS DOUBLE) AS rating",
            "url AS location",
            "CAST(page_id % 30 + 1 AS DOUBLE) / 10 AS distance",
        ],
    ),
    # Every order line as a measurement.
    "lines": (
        "lineitem",
        [
            "l_orderkey AS place_id",
            "l_returnflag AS type",
            "l_extendedprice AS price",
            "l_quantity AS rating",
            "l_tax AS distance",
        ],
    ),
    # Points with given clusters.
    "vectors": (
        "embeddings",
        ["vec_id AS place_id", "embedding", "label AS cluster"],
    ),
}


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Rows of a view; only the columns a query uses are read."""
    table, columns = VIEWS[name]
    spark_sql = [c.replace("VARCHAR(20)", "STRING") for c in columns]
    return spark.read.parquet(f"{folder}/{table}.parquet").selectExpr(*spark_sql)


def with_views(sql: str, *names: str) -> str:
    """The SQL with the views it names defined in front."""
    parts = [f"{n} AS (SELECT {', '.join(VIEWS[n][1])} FROM {VIEWS[n][0]})" for n in names]
    body, start = sql.strip(), "WITH "
    for opening in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(opening):
            body, start = ", " + body[len(opening) :], opening
            break
    return start + ", ".join(parts) + ("" if body.startswith(",") else " ") + body
