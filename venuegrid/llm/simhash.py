"""SimHash near-duplicates, found by tables of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices
from .components import components
from .jaccard import deal_units

#: Words of a shingle, and the seed of its hash.
WORDS, SEED = 4, 42
#: Fingerprints link if at most so many bits differ.
NEAR = 4
#: Reference fingerprints of a distance table.
PIVOTS = 32
#: Fingerprints that agree in the bits of one table: about this many are expected, and with
#: more than RUN of them the work is split.
EXPECTED, RUN = 64, 4096
#: Entries of the tables that one task holds, and fingerprints of a block of a long run.
TASK_ENTRIES, BLOCK = 500_000, 8192
#: Shingles that are hashed together.
_CHUNK = 1 << 16


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """n of the 64 Walsh words: bit j of word i is the parity of i & j. Any two differ in 32
    bits, so distances to them say as little as can be about each other."""
    i, j = np.arange(n, dtype=np.uint64)[:, None], np.arange(64, dtype=np.uint64)[None, :]
    return ((np.bitwise_count(i & j) & 1).astype(np.uint64) << j).sum(axis=1, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    """The SimHash of a text as an unsigned number: a bit is 1 if it is set in over half of the
    hashes of the word shingles, repeats included. Without a word it is 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    digest = partial(xxhash.xxh64_intdigest, seed=SEED)
    joined = b" ".join(words)
    n = len(words) - WORDS + 1
    if n < 1:
        return digest(joined)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        upto = min(n, at + _CHUNK)
        pairs = zip(starts[at:upto].tolist(), ends[at + WORDS - 1 : upto + WORDS - 1].tolist(), strict=True)
        hashes = np.fromiter(map(digest, [joined[a:b] for a, b in pairs]), "<u8", upto - at)
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text; fp holds the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            known: dict[str | None, int] = {}
            out = []
            for text in batch.column(1).to_pylist():
                if text not in known:
                    known[text] = fingerprint(text)
                out.append(known[text])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def band_masks(n: int, near: int = NEAR, expected: int = EXPECTED) -> list[int]:
    """The bits that each table keeps, for n different fingerprints.

    The 64 bits are cut into k bands. Two fingerprints within ``near`` bits agree in at least
    k - near whole bands, so with a table for each choice of k - near bands they agree in
    one of the tables. k is the smallest for which about ``expected`` of n even fingerprints
    agree in a table's bits.
    """
    for k in range(near + 1, min(64, near + 8) + 1):
        if n <= expected * 2 ** (64 * (k - near) / k):
            break
    edges = [64 * b // k for b in range(k + 1)]
    bands = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(bands[b] for b in kept) for kept in combinations(range(k), k - near)]
    assert len(masks) == comb(k, near)
    return masks


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _entries(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """(run, fp): an entry in each table; fingerprints that agree in its bits are a run."""
    runs = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)])
    return nodes.select(F.explode(runs).alias("run"), "fp")


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the smallest known node of each node's component) with links a - b added."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def pivot_links(fps: np.ndarray, runs: np.ndarray, near: int = NEAR, groups: np.ndarray | None = None, sides: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of fingerprints of one run that connect all that are within ``near`` bits.

    The distance table is computed first. By the triangle inequality fingerprints within
    ``near`` bits differ by at most that in every coordinate. Runs are ordered by the
    coordinate that varies most, so partners lie in a window; those that another
    coordinate parts are discarded; what survives is compared bit by bit. Pairs that
    earlier links connect (or that share one of ``groups``) are not looked at, and with
    ``sides`` only pairs across count.
    """
    nodes, node = np.unique(fps, return_inverse=True)
    table = np.bitwise_count(fps[:, None] ^ reference_fingerprints()[None, :]).astype(np.int8)
    spread = table.var(axis=0)
    by = np.argsort(-spread)
    order = np.lexsort((table[:, by[0]], runs))
    fps, runs, node, table = fps[order], runs[order], node[order], table[order][:, by]
    root = np.arange(len(nodes))
    if groups is not None:
        _, first, code = np.unique(groups[order], return_index=True, return_inverse=True)
        root = _unite(root, node, node[first][code])
    side = None if sides is None else sides[order]
    lead = table[:, 0]
    found_a, found_b = [], []
    left, step = np.arange(len(fps) - 1), 1
    while len(left):
        right = left + step
        inside = (runs[left] == runs[right]) & (lead[right] - lead[left] <= near)
        left, right = left[inside], right[inside]
        apart = root[node[left]] != root[node[right]]
        if side is not None:
            apart &= side[left] != side[right]
        x, y = left[apart], right[apart]
        for coordinate in range(1, table.shape[1]):
            if not len(x):
                break
            close = np.abs(table[x, coordinate] - table[y, coordinate]) <= near
            x, y = x[close], y[close]
        if len(x):
            linked = np.bitwise_count(fps[x] ^ fps[y]) <= near
            x, y = x[linked], y[linked]
            if len(x):
                root = _unite(root, node[x], node[y])
                found_a.append(fps[x])
                found_b.append(fps[y])
        step += 1
        left = left[left + step < len(fps)]
    nothing = np.zeros(0, np.uint64)
    return np.concatenate([nothing, *found_a]), np.concatenate([nothing, *found_b])


def _meet(batches: Iterator[pa.RecordBatch], near: int, most: int) -> Iterator[pa.RecordBatch]:
    """Links of a task's runs (run null). Runs that may go on in another task, and those of
    more than ``most``, are handed on as they are (b null)."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    runs, fps = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    _, code, size = np.unique(runs, return_inverse=True, return_counts=True)
    whole = (runs != runs[0]) & (runs != runs[-1]) & (size[code] <= most)
    some = whole & (size[code] > 1)
    a, b = pivot_links(fps[some].view(np.uint64), code[some], near)
    yield _rows(None, a.view(np.int64), b.view(np.int64))
    yield _rows(runs[~whole], fps[~whole], None)


def _rows(run: np.ndarray | None, a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([none if run is None else pa.array(run), pa.array(a), none if b is None else pa.array(b)], names=["run", "a", "b"])


def near_links(nodes: DataFrame, near: int = NEAR, run: int = RUN, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) that connect all of the different fingerprints ``nodes`` (fp) within
    ``near`` bits of each other.

    The tables' entries are dealt in ranges of (run, fingerprint), so a run of any length is
    spread evenly. Runs inside a task are settled there; a long run's members are first
    linked to references of their own (members drawn by a hash), which mostly makes
    them one component without forming their pairs; then blocks of what is still apart
    meet each other, each pair of blocks in one task.
    """
    scratch = scratch or Scratch(nodes.sparkSession, "simhash")
    masks = band_masks(nodes.count(), near)
    n_tasks = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() * len(masks) // TASK_ENTRIES))
    dealt = _entries(nodes, masks).repartitionByRange(n_tasks, "run", "fp").sortWithinPartitions("run", "fp")
    met = scratch.written(dealt.mapInArrow(partial(_meet, near=near, most=run), "run long, a long, b long"), "met")
    links = met.where("run IS NULL").select("a", "b")
    rest = scratch.written(met.where("run IS NOT NULL").select("run", F.col("a").alias("fp")), "rest")
    sizes = scratch.written(rest.groupBy("run").agg(F.count(F.lit(1)).alias("n"), *[F.min_by("fp", F.xxhash64("fp", F.lit(k))).alias(f"hub_{k}") for k in (1, 2)]).where("n > 1"), "runs")
    sized = rest.join(sizes, "run")
    hubs = F.explode(F.array("hub_1", "hub_2"))
    starred = sized.where(F.col("n") > run).select("fp", hubs.alias("hub")).where(F.col("fp") != F.col("hub")).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub"))) <= near)
    stars = scratch.written(starred.select(F.greatest("fp", "hub").alias("a"), F.least("fp", "hub").alias("b")).distinct(), "stars")
    parts = scratch.written(components(stars, "star", scratch), "parts").withColumnsRenamed({"node": "fp", "component": "part"})
    # A part of one run is its own: the blocks of a run meet inside it only.
    members = sized.join(parts, "fp", "left").select("run", "fp", F.xxhash64("run", F.coalesce("part", "fp")).alias("part"))
    members = scratch.written(members, "members")
    place = F.xxhash64("run", "fp")
    units = deal_units(members.select(place.alias("key"), F.col("run").alias("cluster"), "part", F.lit(1).cast("long").alias("weight")), block, scratch)
    work = units.join(members.withColumn("key", place), "key").select("unit", "side", "run", "part", "fp")

    def join_unit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = rows["side"].to_numpy()
        fps = rows["fp"].to_numpy().view(np.uint64)
        runs, groups = (np.unique(rows[c].to_numpy(), return_inverse=True)[1] for c in ("run", "part"))
        a, b = pivot_links(fps, runs, near, groups, sides if sides.any() else None)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return links.unionByName(stars).unionByName(work.groupBy("unit").applyInPandas(join_unit, "a long, b long"))


def _hex(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, near: int = NEAR, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links of
    at most ``near`` differing bits reach.

    Exact. Equal fingerprints are one from the start; the different ones meet in tables
    (``near_links``).

    Null and empty texts, and those without a word, have the fingerprint zero and are linked
    like any other; very long texts are hashed in pieces; repeated rows and ties of ids
    have one component; a null doc_id belongs to its component but does not name it (one
    with null ids only has none); extra columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.written(fingerprints(docs), "fingerprints")
    nodes = scratch.written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = scratch.written(near_links(nodes.select("fp"), near, run, block, scratch), "links")
    scratch.keep_only(rows, nodes, links)
    joined = scratch.written(components(links, "component", scratch), "components").withColumnsRenamed({"node": "fp", "component": "class"})
    named = scratch.written(nodes.join(joined, "fp", "left").select("fp", "least", F.coalesce("class", "fp").alias("class")), "named")
    names = scratch.written(named.groupBy("class").agg(F.min("least").alias("component_id")), "names")
    by_fp = scratch.written(named.join(names, "class").select("fp", "component_id"), "by-fingerprint")
    scratch.keep_only(rows, by_fp)
    return rows.join(by_fp, "fp").select("doc_id", _hex("fp").alias("fingerprint"), "component_id")
