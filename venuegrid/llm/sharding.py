"""Sharding by a k-d tree over metadata, with distributed weighted medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A position on a dimension has this many low bits of a row's hash, so that rows which
#: agree in the metadata can still be told apart and a hot value can be split.
_TIE_BITS = 39
#: Candidate cuts of a pass, and passes for each level: the cut is then off the wanted
#: weight by about 1 / 255 ** 2 of the node, or one row.
CANDIDATES = 255
REFINEMENTS = 2
ROWS_PER_RANK_GROUP = 10_000

_VALUE_MOST = (1 << (62 - _TIE_BITS)) - 1


def category(column: Column) -> Column:
    """A category has no order of its own: its place is its hash. Null is one as well."""
    return F.xxhash64(F.coalesce(column.cast("string"), F.lit("\x00"))).bitwiseAND(F.lit(_VALUE_MOST))


def magnitude(column: Column) -> Column:
    """A count's place is its logarithm; null and negative values are as zero."""
    return F.least(F.lit(_VALUE_MOST), F.log2(1 + F.greatest(F.coalesce(column, F.lit(0)), F.lit(0))) * (1 << 17)).cast("long")


def default_dimensions() -> dict[str, Column]:
    return {"lang": category(F.col("lang")), "source": category(F.col("source")), "length": magnitude(F.col("n_chars"))}


def metadata(docs: DataFrame, dimensions: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, size (UTF-8 bytes and one), text_crc32 and one position ``x_*`` for each
    dimension. All are functions of the row alone, so that the tree can be applied to
    the documents again when they are written."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tie = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(F.shiftleft(v, _TIE_BITS).bitwiseOR(tie).alias(f"x_{k}") for k, v in (dimensions or default_dimensions()).items()),
    )


def _total(column: Column) -> Column:
    return F.sum(column.cast("decimal(38,0)")).cast("double")


def _cuts(rows: DataFrame, names: list[str]) -> DataFrame:
    """One level: ``node`` (its first shard), ``n`` (its shards), ``dim`` and ``cut`` for
    each node of two shards or more; what lies below the cut is the left child.

    The dimension is the one on which the node spreads over the largest part of the whole
    table's range. The cut is where the left child's share of the shards has its share
    of the bytes: quantile sketches propose cuts, an exact weighing picks the interval,
    and the next pass proposes cuts inside that.
    """
    spans = [f"x_{n}" for n in names]
    whole = rows.agg(*((F.max(s).cast("double") - F.min(s)).alias(s) for s in spans)).first()
    nodes = rows.groupBy("node", "n").agg(
        _total(F.col("size")).alias("total"), *(F.max(s).alias(f"max_{s}") for s in spans), *(F.min(s).alias(f"min_{s}") for s in spans)
    )
    width = [
        F.struct(
            ((F.col(f"max_{s}").cast("double") - F.col(f"min_{s}")) / F.lit(whole[s] or 1.0)).alias("width"),
            F.lit(-k).alias("rank"), F.lit(k).alias("dim"), F.col(f"min_{s}").alias("low"), F.col(f"max_{s}").alias("high"),
        )
        for k, s in enumerate(spans)
    ]
    best = F.array_max(F.array(*width))
    left = F.floor(F.col("n") / 2).cast("int")
    state = written(
        nodes.withColumn("best", best).select(
            "node", "n", left.alias("left"), F.col("best.dim").alias("dim"), F.col("best.low").alias("low"), (F.col("best.high") + 1).alias("high"),
            (F.col("total") * left / F.col("n")).alias("wanted"),
        ),
        "kd-nodes",
    )
    for _ in range(REFINEMENTS):
        at = _position(names)
        inside = rows.join(state.drop("n"), "node").withColumn("at", at).where("at >= low AND at < high")
        grid = [k / CANDIDATES for k in range(1, CANDIDATES)]
        sketch = inside.groupBy("node").agg(F.percentile_approx("at", grid, 4 * CANDIDATES).alias("c"))
        proposed = written(
            state.join(sketch, "node").withColumn(
                "cuts", F.array_sort(F.array_distinct(F.filter(F.concat(F.array("low", "high"), "c"), lambda c: (c >= F.col("low")) & (c <= F.col("high")))))
            ).drop("c"),
            "kd-cuts",
        )
        placed = rows.join(proposed.select("node", "dim", "low", "high", "cuts"), "node").withColumn("at", at).where("at >= low AND at < high")
        interval = F.size(F.filter("cuts", lambda c: c <= F.col("at")))
        weights = placed.groupBy("node", interval.alias("k")).agg(_total(F.col("size")).alias("weight"))
        order = Window.partitionBy("node").orderBy("k")
        sums = weights.withColumn("upto", F.sum("weight").over(order)).withColumn("before", F.col("upto") - F.col("weight"))
        hit = (
            sums.join(proposed.select("node", "wanted"), "node")
            .groupBy("node")
            .agg(
                F.min(F.when(F.col("upto") >= F.col("wanted"), F.struct("k", "before", "weight"))).alias("hit"),
            )
        )
        state = written(
            proposed.join(hit, "node").select(
                "node", "n", "left", "dim", F.get("cuts", F.col("hit.k") - 1).alias("low"), F.get("cuts", F.col("hit.k")).alias("high"),
                (F.col("wanted") - F.col("hit.before")).alias("wanted"), F.col("hit.weight").alias("rest"),
            ),
            "kd-state",
        )
    nearer = F.when(F.col("wanted") * 2 < F.col("rest"), F.col("low")).otherwise(F.col("high"))
    return state.select("node", "left", "dim", nearer.alias("cut"))


def _position(names: list[str]) -> Column:
    at = F.col(f"x_{names[0]}")
    for k, name in enumerate(names[1:], 1):
        at = F.when(F.col("dim") == k, F.col(f"x_{name}")).otherwise(at)
    return at


def _descend(rows: DataFrame, cuts: DataFrame, names: list[str]) -> DataFrame:
    """Each row's node one level down."""
    right = F.coalesce(_position(names) >= F.col("cut"), F.lit(False))
    return (
        rows.join(cuts, "node", "left")
        .withColumn("n", F.when(F.col("left").isNull(), F.col("n")).when(right, F.col("n") - F.col("left")).otherwise(F.col("left")))
        .withColumn("node", F.when(right, F.col("node") + F.col("left")).otherwise(F.col("node")))
        .drop("left", "dim", "cut")
    )


class KdTree:
    """The cuts of each level, as tables of a row for each node."""

    def __init__(self, shards: int, levels: list[DataFrame], dimensions: dict[str, Column]):
        self.shards, self.levels, self.dimensions = shards, levels, dimensions

    def assign(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of ``metadata``, or any with its columns) and their ``shard``."""
        at = rows.withColumns({"node": F.lit(0), "n": F.lit(self.shards)})
        for cuts in self.levels:
            at = _descend(at, cuts, list(self.dimensions))
        return at.withColumnRenamed("node", "shard").drop("n")


def build_tree(rows: DataFrame, shards: int | None = None, target_bytes: int | None = None, dimensions: dict[str, Column] | None = None) -> KdTree:
    """Split until the leaves reach ``target_bytes``, or into ``shards`` leaves.

    The bytes of the leaves are near equal whatever the metadata: a value that many rows
    share is split by the rows' hashes. Only rows that agree in doc_id and text cannot
    be told apart and stay together. Every pass is a partially aggregated sum or sketch
    by node over narrow rows. An empty table has a tree without cuts.
    """
    own = dimensions or default_dimensions()
    if shards is None:
        total = rows.agg(_total(F.col("size"))).first()[0] or 0
        shards = max(1, round(total / target_bytes))
    levels: list[DataFrame] = []
    at, widest = rows.withColumns({"node": F.lit(0), "n": F.lit(shards)}), shards
    while widest > 1:
        levels.append(_cuts(at.where("n > 1"), list(own)))
        at = written(_descend(at, levels[-1], list(own)), "kd-rows")
        widest = -(-widest // 2)
    return KdTree(shards, levels, own)


def with_slots(rows: DataFrame) -> DataFrame:
    """Number each shard's rows from 0 without a gap. Rows are ranked in hashed groups of
    some thousands, and a group starts where the groups before it end, so no task sorts
    a shard. Rows that agree in everything have any order among themselves."""
    kept = written(rows, "kd-shards")
    groups = max(1, kept.count() // ROWS_PER_RANK_GROUP)
    dealt = kept.withColumn("_group", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(groups)))
    counts = dealt.groupBy("shard", "_group").agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy("shard").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_group", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_group").orderBy("doc_id", "text_crc32", "size"))
    ranked = dealt.withColumn("_rank", rank)
    return ranked.join(starts, ["shard", "_group"]).withColumn("slot", F.col("_before") + F.col("_rank") - 1).drop("_group", "_before", "_rank")


def shard_documents(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is
    ``bytes``) of every document.

    A null text has no bytes and the CRC-32 of nothing; null metadata are values of their
    own; repeated rows lie together; an empty table gives no rows; extra columns are
    ignored.
    """
    rows = written(metadata(docs), "kd-metadata")
    assigned = build_tree(rows, shards, target_bytes).assign(rows)
    return with_slots(assigned.select("doc_id", "size", "text_crc32", "shard")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, tree: KdTree, path: str) -> None:
    """Write whole documents below ``path`` by shard. The tree is applied to the rows as
    they are read, so texts are not shuffled; each task appends to the shards it meets."""
    own = metadata(docs, tree.dimensions).columns[3:]
    tie = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << _TIE_BITS) - 1))
    positions = {f"x_{k}": F.shiftleft(v, _TIE_BITS).bitwiseOR(tie) for k, v in tree.dimensions.items()}
    whole = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), *(v.alias(k) for k, v in positions.items()))
    tree.assign(whole).drop(*own).select("row.*", "shard").write.partitionBy("shard").parquet(path)
