"""Exact Jaccard self-join on 5-word shingles, with adaptive multi-match prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, give_back, lean, lean_group, only, row_key, slices, without
from .components import components

WORDS = 5
#: Two documents link when their shingle sets' Jaccard similarity is at least this, in percent.
PERCENT = 75
#: Text whose shingles are cut up together, and shingles for each bucket of them.
SLICE_BYTES = 6 << 20
BUCKET_SHINGLES = 1_000_000
#: A shingle in this share of all texts (and in this many at least) is not looked up but
#: known to all tasks; there are at most (mean set size / share) such.
HOT_SHARE, HOT_TEXTS = 0.005, 1000
#: The most shared prefix shingles that a text may ask for.
MOST_MATCHES = 8
#: Cost of a verification over that of reading a list entry.
VERIFY_COST = 4.0
#: Shingles of the texts that one task joins.
UNIT_SHINGLES = 300_000

_KEEP = np.uint64((1 << 48) - 1)


def _required(n):
    """Shared shingles that a set of size n needs with any partner."""
    return -(-PERCENT * n // 100)


class Shingler:
    """Shingle sets of texts as sorted 64-bit hashes, and a key for each word sequence."""

    def __init__(self) -> None:
        self.hashes: dict[bytes, int] = {}

    def words(self, text: str | None) -> list[bytes]:
        return (text or "").encode().lower().split()

    def key(self, words: list[bytes]) -> int:
        return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)

    def shingles(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < WORDS:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        known = self.hashes
        if len(known) > 250_000:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        flat = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = len(words) - WORDS + 1
        mixed = np.zeros(n, np.uint64)
        for k in range(WORDS):
            mixed = (mixed ^ flat[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key("text").alias("text_hash"))


_KEYS = "doc_id long, key long, n long, shingle long, texts long, text_hash long"


def _keys(docs: DataFrame) -> DataFrame:
    """A row for each document (shingle null), and one for each shingle that is frequent
    among the texts of a slice (doc_id and key null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in slices(batches, "text", SLICE_BYTES):
            keys, sizes, own = [], [], {}
            for text in batch.column(1).to_pylist():
                words = shingler.words(text)
                key = shingler.key(words)
                if key not in own:
                    own[key] = shingler.shingles(words)
                keys.append(key)
                sizes.append(len(own[key]))
            values, counts = np.unique(np.concatenate(list(own.values())) & _KEEP, return_counts=True)
            often = counts >= max(8, len(own) // 200)
            k = int(often.sum())
            doc_ids = pa.concat_arrays([batch.column(0), pa.nulls(k, pa.int64())])
            yield pa.RecordBatch.from_arrays(
                [
                    doc_ids,
                    pa.array(keys + [None] * k, pa.int64()),
                    pa.array(sizes + [None] * k, pa.int64()),
                    pa.array([None] * len(keys) + values[often].astype(np.int64).tolist(), pa.int64()),
                    pa.array([None] * len(keys) + counts[often].tolist(), pa.int64()),
                    pa.concat_arrays([batch.column(2), pa.nulls(k, pa.int64())]),
                ],
                names=["doc_id", "key", "n", "shingle", "texts", "text_hash"],
            )

    return _texts(docs).mapInArrow(lean(run), _KEYS)


def _planes(values: np.ndarray) -> bytes:
    """Sorted 48-bit values, their bytes apart, so that the leading ones compress well."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    out = np.zeros((len(planes) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(planes, np.uint8).reshape(6, -1).T
    return out.reshape(-1).view("<u8")


_POSTINGS = "bucket int, shingles binary, owners binary, texts binary, counts binary"
_HELD = "part int, shingles binary, owners binary, texts binary, counts binary"


def _posting_row(bucket: int, shingles: np.ndarray, owners: np.ndarray, keys: np.ndarray, counts: np.ndarray | None) -> tuple:
    """Postings of one slice and bucket: owners are places among the row's texts."""
    used, places = np.unique(owners, return_inverse=True)
    kind = "<u2" if len(used) <= 1 << 16 else "<u4"
    return bucket, _planes(shingles), places.astype(kind).tobytes(), keys[used].tobytes(), b"" if counts is None else counts.astype("<u4").tobytes()


def _read_rows(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    shingles, texts, counts = [], [], []
    for s, o, t, c in zip(rows["shingles"], rows["owners"], rows["texts"], rows["counts"], strict=True):
        own = _values(s)
        shingles.append(own)
        texts.append(np.frombuffer(t, "<i8")[np.frombuffer(o, "<u2" if len(o) == 2 * len(own) else "<u4")])
        counts.append(np.frombuffer(c, "<u4") if c else np.zeros(len(own), "<u4"))
    return np.concatenate(shingles), np.concatenate(texts), np.concatenate(counts)


def _dealt(rows: DataFrame, by: str, least: int) -> DataFrame:
    """Rows dealt by a column to ``least`` partitions, or the session's number of them if that
    is more, so that a task's share does not grow with the data."""
    return rows.repartition(max(least, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), by)


def _shared_shingles(docs: DataFrame, hot: np.ndarray, hot_counts: np.ndarray, buckets: int, parts: int) -> DataFrame:
    """The postings of all shingles that two different texts have, dealt by text.

    Shingles are dealt in ranges to buckets, where those of one text only are dropped:
    they can match nothing. Hot shingles pass by that; their rows go to salted buckets.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, number = Shingler(), 0
        for batch in slices(batches, "text", SLICE_BYTES):
            own = {}
            for text in batch.column(1).to_pylist():
                words = shingler.words(text)
                if words and (key := shingler.key(words)) not in own:
                    own[key] = shingler.shingles(words) & _KEEP
            if not own:
                continue
            keys = np.fromiter(own, np.int64, len(own))
            flat = np.concatenate(list(own.values()))
            owners = np.repeat(np.arange(len(own)), [len(v) for v in own.values()])
            order = np.argsort(flat, kind="stable")
            flat, owners = flat[order], owners[order]
            out = []
            if len(hot):
                at = np.minimum(np.searchsorted(hot, flat), len(hot) - 1)
                is_hot = hot[at] == flat
                if is_hot.any():
                    number += 1
                    salt = -1 - xxhash.xxh3_64_intdigest(keys[:64].tobytes(), seed=number) % buckets
                    out.append(_posting_row(salt, flat[is_hot], owners[is_hot], keys, hot_counts[at[is_hot]]))
                    flat, owners = flat[~is_hot], owners[~is_hot]
            width = (1 << 48) // buckets + 1
            borders = np.searchsorted(flat, (np.arange(buckets + 1, dtype=np.uint64) * np.uint64(width)))
            for b in np.flatnonzero(np.diff(borders)).tolist():
                part = slice(borders[b], borders[b + 1])
                out.append(_posting_row(b, flat[part], owners[part], keys, None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int32()] + [pa.binary()] * 4, strict=True)],
                names=["bucket", "shingles", "owners", "texts", "counts"],
            )

    def keep_shared(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shingles, texts, counts = _read_rows(rows)
        if key[0] >= 0:
            order = np.argsort(shingles, kind="stable")
            shingles, texts = shingles[order], texts[order]
            again = shingles[1:] == shingles[:-1]
            repeated = np.append(again, False) | np.append(False, again)
            shingles, texts = shingles[repeated], texts[repeated]
            order = np.lexsort((texts, shingles))
            shingles, texts = shingles[order], texts[order]
            new = np.append(True, (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1]))[: len(shingles)]
            shingles, texts = shingles[new], texts[new]
            _, inverse, n = np.unique(shingles, return_inverse=True, return_counts=True)
            counts = n[inverse]
            shared = counts > 1
            shingles, texts, counts = shingles[shared], texts[shared], counts[shared]
        part = (texts.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        shingles, texts, counts, part = shingles[order], texts[order], counts[order], part[order]
        out = []
        for p, a, b in zip(*_runs(part), strict=True):
            keys, owners = np.unique(texts[a:b], return_inverse=True)
            out.append(_posting_row(p, shingles[a:b], owners, keys, counts[a:b]))
        return pd.DataFrame(out, columns=["part", "shingles", "owners", "texts", "counts"])

    postings = _texts(docs).drop("text_hash").mapInArrow(lean(cut), _POSTINGS)
    return _dealt(postings, "bucket", 2 * buckets).groupBy("bucket").applyInPandas(lean_group(keep_shared), _HELD)


def _runs(sorted_values: np.ndarray) -> tuple[list, list, list]:
    """Value, start and end of each run of equal values."""
    if not len(sorted_values):
        return [], [], []
    starts = np.append(0, np.flatnonzero(np.diff(sorted_values)) + 1)
    return sorted_values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_values)]


def prefix_plan(n: int, counts: np.ndarray) -> tuple[int, int]:
    """(matches, length) for a set of n shingles, of which those with ``counts`` (how many
    texts have each, rarest first) are shared at all.

    A partner that shares enough shingles shares at least l of the n - required + l
    rarest, for every l. A longer prefix reads more list entries, a higher l verifies
    fewer candidates: about the entries by l. The cheapest l is taken. Two texts meet
    if they share as many prefix shingles as the smaller of their l.
    """
    alone = n - len(counts)
    sums = np.cumsum(counts, dtype=np.float64)
    best = None
    for l in range(1, min(MOST_MATCHES, _required(n)) + 1):  # noqa: E741
        length = n - _required(n) + l - alone
        entries = sums[length - 1]
        cost = entries + length + VERIFY_COST * entries / l
        if best is None or cost < best[0]:
            best = (cost, l, length)
    return best[1], best[2]


_CANDIDATES = "key long, n long, matches int, prefix array<long>, shingles binary"


def _candidates(held: DataFrame, sizes: DataFrame, parts: int) -> DataFrame:
    """Texts that share enough of their shingles to have a partner, with their plan, their
    prefix and their shared shingles, rarest first."""

    def run(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(own):
            shingles, texts, counts = _read_rows(rows)
            order = np.lexsort((shingles, counts, texts))
            shingles, texts, counts = shingles[order], texts[order], counts[order]
            # A hot shingle of a text comes once from each slice that has a copy of it.
            new = np.append(True, (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1]))
            shingles, texts, counts = shingles[new], texts[new], counts[new]
            size = dict(zip(own["key"].tolist(), own["n"].tolist(), strict=True))
            for text, a, b in zip(*_runs(texts), strict=True):
                n = size[text]
                if b - a >= _required(n):
                    matches, length = prefix_plan(n, counts[a:b])
                    some = shingles[a:b].astype(np.int64)
                    out.append((text, n, matches, some[:length].tolist(), some.tobytes()))
            del rows, shingles, texts, counts, order, new
            give_back()
        return pd.DataFrame(out, columns=["key", "n", "matches", "prefix", "shingles"])

    both = (_dealt(side, "part", 2 * parts).groupBy("part") for side in (held, sizes))
    return next(both).cogroup(next(both)).applyInPandas(run, _CANDIDATES)


def _linked(shared, n, m):
    return 100 * shared >= PERCENT * (n + m - shared)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link; both sets meet in a row."""
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    near = (F.least("n_a", "n_b") * 100) >= F.greatest("n_a", "n_b") * PERCENT
    both = pairs.join(left.drop("s_a"), "a").join(right.drop("s_b"), "b").where(near).select("a", "b").join(left, "a").join(right, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                _linked(len(np.intersect1d(np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), assume_unique=True)), n, m)
                for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "s_a", "s_b")), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(lean(run), "a long, b long")


def local_links(keys: np.ndarray, sizes: np.ndarray, matches: np.ndarray, prefixes: list[np.ndarray], sets: list[np.ndarray], groups: np.ndarray, sides: np.ndarray | None = None, every: bool = False) -> list[tuple[int, ...]]:
    """Links that join the texts' groups, as pairs of keys; pairs inside a group that
    earlier links have made are not looked at. With ``sides`` only pairs across count.

    Texts come in order of size and look up the smaller ones in their prefixes' lists.
    Candidates of the length and with the matches needed are verified on the whole sets:
    first the best of each group, then all whose group is not joined yet. With ``every``
    all are verified whatever their group, and links come with their shared shingles.
    """
    order = np.argsort(sizes, kind="stable")
    lengths = np.array([len(prefixes[i]) for i in order])
    owners = np.repeat(np.arange(len(order)), lengths)
    flat = np.concatenate([prefixes[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    by_token = np.argsort(flat, kind="stable")
    token = flat[by_token]
    lists = owners[by_token]
    first = np.searchsorted(token, flat)
    place = np.empty(len(flat), np.int64)
    place[by_token] = np.arange(len(flat))
    n, need = sizes[order], matches[order]
    group, side = groups[order].copy(), None if sides is None else sides[order]
    starts = np.append(0, np.cumsum(lengths))
    links = []

    def verify(d: int, some: np.ndarray) -> np.ndarray:
        own = np.sort(sets[order[d]])
        common = np.zeros(len(some), np.int64)
        at = 0
        while at < len(some):
            end, total = at, 0
            while end < len(some) and (end == at or total < 1 << 20):
                total += len(sets[order[some[end]]])
                end += 1
            theirs = [sets[order[c]] for c in some[at:end]]
            values = np.concatenate(theirs)
            found = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            common[at:end] = np.add.reduceat(found.astype(np.int64), np.append(0, np.cumsum([len(t) for t in theirs])[:-1]))
            at = end
        return common

    def linked(d: int, some: np.ndarray) -> np.ndarray:
        return some[_linked(verify(d, some), n[d], n[some])]

    def unite(d: int, some: np.ndarray) -> None:
        for c in some.tolist():
            if group[c] != group[d]:
                links.append((int(keys[order[d]]), int(keys[order[c]])))
                group[group == group[c]] = group[d]

    for d in range(len(order)):
        met = [lists[first[t] : place[t]] for t in range(starts[d], starts[d + 1]) if place[t] > first[t]]
        if not met:
            continue
        some, shared = np.unique(np.concatenate(met), return_counts=True)
        fits = (every | (group[some] != group[d])) & (n[some] * 100 >= PERCENT * n[d]) & (shared >= np.minimum(need[some], need[d]))
        if side is not None:
            fits &= side[some] != side[d]
        some, shared = some[fits], shared[fits]
        if not len(some):
            continue
        if every:
            common = verify(d, some)
            for k in np.flatnonzero(_linked(common, n[d], n[some])).tolist():
                links.append((int(keys[order[d]]), int(keys[order[some[k]]]), int(common[k])))
            continue
        best = np.lexsort((-shared, group[some]))
        best = best[np.append(True, np.diff(group[some[best]]) != 0)]
        tried = some[best]
        unite(d, linked(d, tried))
        rest = np.setdiff1d(some, tried)
        rest = rest[group[rest] != group[d]]
        if len(rest):
            unite(d, linked(d, rest))
    return links


def _hub_links(postings: DataFrame, sets: DataFrame, seed: int, scratch: Scratch) -> DataFrame:
    """Links of texts with the first text, by a hash, of each of their prefix lists. Hubs are
    written first, so that the rows of a long list can be split in the join with them."""
    hubs = scratch.written(postings.groupBy("token").agg(F.min_by("key", F.xxhash64("key", F.lit(seed))).alias("hub")), "join-hubs")
    pairs = postings.join(hubs, "token").select(F.greatest("key", "hub").alias("a"), F.least("key", "hub").alias("b")).where("a <> b").distinct()
    return _verified(pairs, sets)


def deal_units(members: DataFrame, unit: int, scratch: Scratch) -> DataFrame:
    """Deal texts (key, cluster, part, weight) to units of work: (key, unit, side).

    Small clusters share units, side 0. A larger one is cut into blocks of about ``unit``
    shingles, large parts (texts known to be connected) into blocks of their own, and
    every two blocks that are not of one part are a unit, sides 1 and 2; a block with
    several parts is also a unit by itself.
    """
    totals = members.groupBy("cluster").agg(F.sum("weight").alias("total"))
    parts = members.groupBy("cluster", "part").agg(F.sum("weight").alias("own"))
    rest = parts.where(F.col("own") <= unit).groupBy("cluster").agg(F.sum("own").alias("rest"))
    sized = scratch.written(
        parts.join(totals, "cluster")
        .join(rest, "cluster", "left")
        .select(
            "cluster", "part", "total", F.ceil(F.col("total") / unit).alias("n"), (F.col("own") > unit).alias("large"),
            F.ceil(F.col("own") / unit).alias("n_own"), F.greatest(F.ceil(F.coalesce("rest", F.lit(0)) / unit), F.lit(1)).alias("n_rest"),
        ),
        "join-parts",
    )
    whole = sized.agg(F.sum(F.lit(1))).first()[0]
    if not whole:
        return members.select("key", F.lit(0).cast("long").alias("unit"), F.lit(0).alias("side"))
    work = totals.where(F.col("total") <= unit).agg(F.sum("total")).first()[0] or 0
    small_units = max(1, -(-int(work) // unit)) * 4
    placed = members.join(sized, ["cluster", "part"])
    small = placed.where(F.col("total") <= unit).select("key", F.pmod(F.xxhash64("cluster"), F.lit(small_units)).alias("unit"), F.lit(0).alias("side"))
    block = F.when(F.col("large"), F.xxhash64("part", F.pmod(F.xxhash64("key"), F.col("n_own")))).otherwise(F.xxhash64("cluster", F.pmod(F.xxhash64("part"), F.col("n_rest"))))
    cut = scratch.written(placed.where(F.col("total") > unit).select("key", "cluster", block.alias("block"), F.when(F.col("large"), F.col("part")).alias("only")), "join-blocks")
    blocks = cut.select("cluster", "block", "only").distinct()
    other = blocks.select("cluster", F.col("block").alias("block_2"), F.col("only").alias("only_2"))
    pairs = blocks.join(other, "cluster").where("block <= block_2 AND coalesce(only <> only_2, true)").where("block < block_2 OR only IS NULL")
    named = scratch.written(pairs.select("block", "block_2", F.xxhash64("cluster", "block", "block_2").alias("unit")), "join-units")
    sides = named.where("block < block_2").select(F.col("block_2").alias("block"), "unit", F.lit(2).alias("side"))
    ones = named.select("block", "unit", F.when(F.col("block") < F.col("block_2"), 1).otherwise(0).alias("side"))
    return small.unionByName(cut.join(ones.unionByName(sides), "block").select("key", "unit", "side"))


def _joinable(docs: DataFrame, hot_share: float, hot_texts: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A row for each document (see ``_documents``); the different texts; those that may have a partner, with
    their prefixes; and these with their clusters of candidates."""
    keyed = scratch.written(_keys(docs), "join-keys")
    rows = _documents(keyed)
    texts = scratch.written(rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.min("doc_id").alias("least")), "join-texts")
    n_texts, n_shingles = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = keyed.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= max(hot_texts, hot_share * n_texts))
    found = sorted((r["shingle"], r["texts"]) for r in frequent.collect())
    hot = np.array([s for s, _ in found], np.uint64)
    hot_counts = np.array([min(c, (1 << 32) - 1) for _, c in found], np.uint32)
    buckets = max(8, -(-n_shingles // BUCKET_SHINGLES))
    held = _shared_shingles(docs, hot, hot_counts, buckets, buckets)
    signed = F.col("key")
    part = F.pmod(F.pmod(signed.cast("decimal(20,0)"), F.lit("18446744073709551616").cast("decimal(20,0)")), F.lit(buckets)).cast("int")
    sets = scratch.written(_candidates(held, texts.select("key", "n", part.alias("part")), buckets), "join-sets")
    postings = sets.select("key", F.explode("prefix").alias("token"))
    least = postings.groupBy("token").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("entries")).where("entries > 1")
    stars = postings.join(least, "token").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    clusters = scratch.written(components(stars, "join-star", scratch), "join-clusters")
    members = scratch.written(
        sets.select("key", (F.octet_length("shingles") / 8).cast("long").alias("weight")).join(clusters.withColumnsRenamed({"node": "key", "component": "cluster"}), "key"), "join-members"
    )
    scratch.keep_only(keyed, texts, sets, members)
    return keyed, texts, sets, members


def _documents(keyed: DataFrame) -> DataFrame:
    return keyed.where("key IS NOT NULL").select("doc_id", "key", "n", "text_hash")


def near_duplicates(docs: DataFrame, unit: int = UNIT_SHINGLES, hot_share: float = HOT_SHARE, hot_texts: int = HOT_TEXTS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, group_id (equal for linked documents, whatever
    their ids; null without shingles) and text_hash (of the whole text).

    Exact: every pair of different texts at or above the threshold connects its
    documents. Equal word sequences are one text from the start. Shingles of one text
    only are dropped, then texts that share too few of theirs; what is left is indexed
    by adaptive prefixes. Texts that the index lists connect are clusters of candidates;
    small clusters are joined in one task each. In a cluster too large for one, texts are
    first linked to hubs of their lists, which mostly makes it one component without
    forming its pairs, and then blocks of what is still apart meet each other.

    Null and empty texts, and those without a word, have no shingles and are linked with
    nothing; ties of ids do not matter; repeated rows have one component; a null doc_id
    belongs to its component but does not name it; extra columns are ignored; an empty
    table gives no rows.
    """
    scratch = scratch or Scratch(docs.sparkSession, "join")
    keyed, texts, sets, members = _joinable(docs, hot_share, hot_texts, scratch)
    size = members.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    large = members.groupBy("cluster").agg(F.sum("weight").alias("total")).where(F.col("total") > unit).select("cluster")
    dense = scratch.written(members.join(large, "cluster").select("key").join(sets, "key"), "join-dense")
    links = None
    parts = None
    if not dense.isEmpty():
        lists = dense.select("key", F.explode("prefix").alias("token"))
        links = scratch.written(_hub_links(lists, dense, 1, scratch).unionByName(_hub_links(lists, dense, 2, scratch)), "join-hub-links")
        parts = scratch.written(components(links, "join-part", scratch), "join-parts").withColumnsRenamed({"node": "key", "component": "part"})
        members = scratch.written(members.join(parts, "key", "left").withColumn("part", F.coalesce("part", "key")), "join-members")
    else:
        members = members.withColumn("part", F.col("key"))
    dealt = deal_units(members, unit, scratch).join(members.select("key", "part"), "key").join(sets, "key")

    def join_unit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = rows["side"].to_numpy()
        codes = np.unique(rows["part"].to_numpy(), return_inverse=True)[1]
        values = [np.frombuffer(x, "<i8") for x in rows["shingles"]]
        prefixes = [np.asarray(x, np.int64) for x in rows["prefix"]]
        got = local_links(rows["key"].to_numpy(), rows["n"].to_numpy(), rows["matches"].to_numpy(), prefixes, values, codes, sides if sides.any() else None)
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    local = _dealt(dealt, "unit", 4 * size // unit).groupBy("unit").applyInPandas(lean_group(join_unit), "a long, b long")
    every = scratch.written(local if links is None else local.unionByName(links), "join-links")
    scratch.keep_only(keyed, texts, every)
    joined = components(every, "join-component", scratch).withColumnsRenamed({"node": "key", "component": "class"})
    named = texts.join(joined, "key", "left").select("key", "least", F.coalesce("class", "key").alias("class"))
    named = scratch.written(named, "join-named")
    names = scratch.written(named.groupBy("class").agg(F.min("least").alias("component_id")), "join-classes")
    by_text = scratch.written(named.join(names, "class").select("key", "component_id", F.col("class").alias("group_id")), "join-names")
    scratch.keep_only(keyed, by_text)
    name = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _documents(keyed).join(by_text, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), name.alias("component_id"), "group_id", "text_hash")


def linked_texts(docs: DataFrame, unit: int = UNIT_SHINGLES, hot_share: float = HOT_SHARE, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """Every pair of different texts at or above the threshold: text_1 < text_2 (keys of
    word sequences), n_shingles_1, n_shingles_2, shared, jaccard, least_1, least_2 (the
    smallest doc_id of each), copies_1, copies_2 (documents of each) and document_pairs,
    the pairs of documents that the row stands for.

    Exact, and all of the join: unlike in ``near_duplicates`` no pair is passed over
    because others connect its texts already. All candidates of a cluster are verified,
    in blocks by size that each meet each other once. Pairs of equal texts are not
    formed; ``link_counts`` has them.
    """
    return _linked_texts(docs, unit, hot_share, hot_texts)[1]


def _linked_texts(docs: DataFrame, unit: int, hot_share: float, hot_texts: int) -> tuple[DataFrame, DataFrame]:
    scratch = Scratch(docs.sparkSession, "join")
    keyed, texts, sets, members = _joinable(docs, hot_share, hot_texts, scratch)
    rows = _documents(keyed)
    size = members.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    members = members.withColumn("part", F.col("key"))
    dealt = deal_units(members, unit, scratch).join(sets, "key")

    def join_unit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sides = rows["side"].to_numpy()
        values = [np.frombuffer(x, "<i8") for x in rows["shingles"]]
        prefixes = [np.asarray(x, np.int64) for x in rows["prefix"]]
        got = local_links(
            rows["key"].to_numpy(), rows["n"].to_numpy(), rows["matches"].to_numpy(), prefixes, values, np.arange(len(rows)), sides if sides.any() else None, True
        )
        return pd.DataFrame(got, columns=["a", "b", "shared"], dtype="int64")

    links = scratch.written(_dealt(dealt, "unit", 4 * size // unit).groupBy("unit").applyInPandas(lean_group(join_unit), "a long, b long, shared long"), "join-pairs")
    copies = rows.where("n > 0").groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    known = scratch.written(texts.join(copies, "key"), "join-copies")
    scratch.keep_only(keyed, links, known)
    side = lambda i: known.select(
        F.col("key").alias(f"text_{i}"), F.col("n").alias(f"n_shingles_{i}"), F.col("least").alias(f"least_{i}"), F.col("copies").alias(f"copies_{i}")
    )
    named = links.select(F.least("a", "b").alias("text_1"), F.greatest("a", "b").alias("text_2"), "shared").join(side(1), "text_1").join(side(2), "text_2")
    return rows.join(known.select("key", "copies"), "key", "left"), named.select(
        "text_1", "text_2", "n_shingles_1", "n_shingles_2", "shared", (F.col("shared") / (F.col("n_shingles_1") + F.col("n_shingles_2") - F.col("shared"))).alias("jaccard"),
        "least_1", "least_2", "copies_1", "copies_2", (F.col("copies_1") * F.col("copies_2")).alias("document_pairs"),
    )


def link_counts(docs: DataFrame, unit: int = UNIT_SHINGLES, hot_share: float = HOT_SHARE, hot_texts: int = HOT_TEXTS) -> DataFrame:
    """doc_id, text_hash and n_links, the number of other documents that each document
    links with: copies, counted by arithmetic, and the documents of all linked texts.
    Documents without shingles have none."""
    rows, pairs = _linked_texts(docs, unit, hot_share, hot_texts)
    ends = F.inline(F.array(*[F.struct(F.col(f"text_{i}").alias("key"), F.col(f"copies_{3 - i}").alias("others")) for i in (1, 2)]))
    others = pairs.select(ends).groupBy("key").agg(F.sum("others").alias("others"))
    n_links = F.when(F.col("n") > 0, F.col("copies") - 1 + F.coalesce("others", F.lit(0))).otherwise(0)
    return rows.join(others, "key", "left").select("doc_id", "text_hash", n_links.cast("long").alias("n_links"))


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the
    smallest id (null after all others), then the smallest hash of its text.

    Documents without shingles (null or empty texts, or no word) are linked with nothing
    and stay, however often they are there. Of rows with a word that agree in id and text
    one stays; if their other columns differ, which one is left open. Texts of any length
    are compared whole; columns stay as they were, whatever their names; an empty table
    gives no rows.

    Which rows go is found on narrow rows, and their texts do not move unless a row of
    the same hash goes.
    """
    scratch = Scratch(docs.sparkSession, "near")
    found = near_duplicates(docs, scratch=scratch).where("n_shingles > 0").select("doc_id", "group_id", F.col("text_hash").alias("hash"))
    found = scratch.written(found.groupBy("doc_id", "group_id", "hash").agg(F.count(F.lit(1)).alias("rows")), "near-found")
    place = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "hash")
    first = scratch.written(found.groupBy("group_id").agg(F.min(place).alias("first")), "near-first")
    judged = found.join(first, "group_id").select("doc_id", "hash", "rows", place.eqNullSafe(F.col("first")).alias("stays"))
    judged = scratch.written(judged.where("NOT stays OR rows > 1"), "near-judged")
    scratch.keep_only(judged)
    kept = without(docs, judged, "text")
    repeated = judged.where("stays")
    return kept if repeated.isEmpty() else kept.unionByName(only(docs, repeated, "text").dropDuplicates(["doc_id", "text"]))
