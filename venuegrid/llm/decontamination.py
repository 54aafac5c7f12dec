"""Benchmark decontamination by templates: numbers, names and units become slots."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, row_key, slices, without, written

#: Tokens of a template window; items that are shorter are one window each, but items
#: below LEAST tokens are no evidence and are not searched.
WINDOW = 8
LEAST = 4
#: Literal tokens that a window needs (a shorter one in proportion) so that its template
#: alone is evidence. With fewer, its slots have to hold the item's own values, or the
#: whole alignment has to be evidence, where SLOTS consistent slots weigh as one literal.
LITERALS = 5
SLOTS = 4
#: Share of an item's tokens that consistent windows have to cover, and share of the slots
#: that have to agree.
COVERAGE = 0.5
CONSISTENCY = 0.8
#: Bits of the map of window hashes that all tasks know.
MAP_BITS = 24
#: Text whose words are held together: each of them takes some thirty times its bytes.
SLICE_BYTES = 1 << 20

#: Units of measure and of money, and numbers in words.
UNITS = set(
    "km m cm mm mi mile miles yard yards foot feet ft inch inches in kg g mg lb lbs oz pound pounds gram grams ton tons l ml litre litres liter liters "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years kmh mph percent % $ € £ dollar dollars cent cents "
    "euro euros degree degrees °c °f w kw v a hz mb gb kb j n pa".split()
)
NUMBERS = set("zero one two three four five six seven eight nine ten eleven twelve thirteen twenty thirty forty fifty hundred thousand million billion".split())

_LITERAL, _NUMBER, _NAME, _UNIT = range(4)
#: An item's first word that is read as a name but is none elsewhere in the item: only the
#: same word may stand for it.
_SAME = 4
_KIND_HASH = np.array([0, 0xA5B85C5E198ED849, 0x8D51E9C7A3F2B16D, 0xC2B2AE3D27D4EB4F], np.uint64)
_EDGE = re.compile(r"^[^\w%$€£°]+|[^\w%$€£°]+$")
_DIGITS = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*")
_NUMBER_UNIT = re.compile(r"([$€£]?[+-]?\d[\d.,:/]*)([^\W\d]+|%|°[cCfF])")


def core(word: str) -> str:
    """A word without the marks around it; a word of marks only stays."""
    return _EDGE.sub("", word).strip("_") or word


class Templates(dict):
    """Numbers words and keeps what each is: the kind it has inside a sentence and at its
    start, and its literal hash; whether it ends a sentence, and whether it may be a unit."""

    MOST = 300_000

    def __init__(self) -> None:
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.inside = np.zeros(1024, np.int8)
        self.first = np.zeros(1024, np.int8)
        self.ends = np.zeros(1024, bool)
        self.unit = np.zeros(1024, bool)
        self.hashes = np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.ends):
            for name in ("inside", "first", "ends", "unit", "hashes"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        own = core(word)
        lower = own.lower()
        plain = own.casefold()
        kind = first = _LITERAL
        if _DIGITS.fullmatch(own) or lower in NUMBERS or _NUMBER_UNIT.fullmatch(own):
            kind = first = _NUMBER
            if pair := _NUMBER_UNIT.fullmatch(own):
                plain = "\x00" + ("\x01" if pair[2].lower() in UNITS else pair[2].lower())
        elif own[0].isupper():
            kind = _NAME
        self.inside[at], self.first[at] = kind, first
        self.ends[at] = word.rstrip("\"')]»”’").endswith((".", "!", "?", ":", "…"))
        self.unit[at] = lower in UNITS
        self.hashes[at] = xxhash.xxh3_64_intdigest(plain)
        self[word] = at
        return at

    def read(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds and template hashes of all words in a row, and the texts' lengths. A unit
        counts as one behind a number only, a capital as a name inside a sentence only."""
        kinds, hashes, _, _, lengths = self.readings(texts)
        return kinds, hashes, lengths

    def readings(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, template hashes, the words' own hashes, the kinds that hold if nothing
        is known of the word before, and lengths: a capital at a sentence's start may be a
        name, a unit behind a number a plain word."""
        if len(self) > self.MOST:
            self._reset()
        lengths = np.array([len(t) for t in texts], np.int64)
        at = np.fromiter((self[w] for t in texts for w in t), np.int64, int(lengths.sum()))
        start = np.append(True, self.ends[at][:-1])[: len(at)]
        start[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        inside = self.inside[at]
        kinds = np.where(start, self.first[at], inside)
        after = np.append(False, kinds[:-1] == _NUMBER)[: len(at)] & ~start
        unit = after & self.unit[at] & (kinds != _NUMBER)
        kinds = np.where(unit, _UNIT, kinds)
        other = np.where(unit, _LITERAL, inside)
        own = self.hashes[at]
        return kinds, np.where(kinds == _LITERAL, own, _KIND_HASH[kinds]), own, other, lengths


def _mix(size: int, n: int, column) -> np.ndarray:
    mixed = np.full(n, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ column(k)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def _windows(hashes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``size`` tokens inside one text, and where it starts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = _mix(size, n, lambda k: hashes[k : k + n])
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(hashes))
    inside = np.flatnonzero(left[:n] >= size)
    return mixed[inside], inside


def _all_windows(readings: tuple[np.ndarray, ...], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int | None]]:
    """Hashes, places and word kinds of the windows of each reading, and the kind of their
    first word if it is another: typed templates; the same with names as plain words of
    any case; and both with the other reading of the first word, which alone hangs on what
    stands before a copy."""
    kinds, hashes, own, other, lengths = readings
    typed, at = _windows(hashes, lengths, size)
    yield typed, at, kinds, None
    named = kinds == _NAME
    plain_kinds, plain = np.where(named, _LITERAL, kinds), np.where(named, own, hashes)
    if named.any():
        lower = _windows(plain, lengths, size)[0]
        differ = np.flatnonzero(lower != typed)
        yield lower[differ], at[differ], plain_kinds, None
    changed = at[kinds[at] != other[at]]
    for kind, words_, kinds_ in ((_NAME, hashes, kinds), (_LITERAL, plain, plain_kinds)):
        some = changed[other[changed] == kind]
        if len(some):
            first = np.full(len(some), _KIND_HASH[_NAME]) if kind == _NAME else own[some]
            yield _mix(size, len(some), lambda k, w=words_, s=some, f=first: w[s + k] if k else f), some, kinds_, kind


_ITEM_WINDOWS = "window long, size int, item_id long, item_tokens int, item_at int, item_slots string"


def _item_windows(items: DataFrame) -> DataFrame:
    """A row for each window of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or "").split()
                if len(words) < LEAST:
                    continue
                readings = templates.readings([words])
                size = min(WINDOW, len(words))
                names = {core(w).casefold() for w, k in zip(words, readings[0], strict=True) if k == _NAME}
                for found, places, kinds, first in _all_windows(readings, size):
                    for h, at in zip(found, places.tolist(), strict=True):
                        kind = _SAME if first == _NAME and core(words[at]).casefold() not in names else first
                        out.append((int(h.astype(np.int64)), size, item, len(words), at, _slots(words, kinds, at, size, kind, True)))
            if out:
                kinds_ = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_, strict=True)], names=_ITEM_WINDOWS.replace(",", "").split()[::2])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(lean(run), _ITEM_WINDOWS)


def _slots(words: list[str], kinds: np.ndarray, at: int, size: int, first: int | None = None, literals: bool = False) -> str:
    """The window's slots: kind and value, by tab; literals are empty unless asked for."""
    own = kinds[at : at + size].tolist()
    if first is not None:
        own[0] = first
    return "\t".join(f"{kind}{core(words[at + k]).casefold()}" if kind or literals else "" for k, kind in enumerate(own))


def _hash_map(windows: DataFrame) -> np.ndarray:
    """Which values the first MAP_BITS bits of the windows' hashes take: a map of a fixed
    size, put together from slices, that spares most windows of documents the join."""
    place = F.shiftrightunsigned("window", 64 - MAP_BITS)

    def fill(key, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(1 << 16, bool)
        bits[rows["place"].to_numpy() & 0xFFFF] = True
        return pd.DataFrame({"slice": [key[0]], "bits": [np.packbits(bits).tobytes()]})

    found = windows.select(place.alias("place")).distinct().withColumn("slice", F.shiftright("place", 16)).groupBy("slice").applyInPandas(fill, "slice long, bits binary")
    out = np.zeros((1 << MAP_BITS - 16, 1 << 13), np.uint8)
    for row in found.collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


_HITS = "doc_id long, text_hash long, window long, size int, doc_at int, doc_slots string"


def _finder(bits: np.ndarray, sizes: list[int]):
    """The windows of batches of doc_id, text and text_hash that the map knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in slices(batches, "text", SLICE_BYTES):
            ids, prints = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            texts = [(t or "").split() for t in batch.column(1).to_pylist()]
            readings = templates.readings(texts)
            lengths = readings[-1]
            starts = np.cumsum(lengths) - lengths
            out = []
            for size in sizes:
                for found, at, kinds, kind in _all_windows(readings, size):
                    place = (found >> np.uint64(64 - MAP_BITS)).astype(np.int64)
                    maybe = (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
                    for k in np.flatnonzero(maybe).tolist():
                        here = int(at[k])
                        d = int(np.searchsorted(starts, here, "right")) - 1
                        first = int(starts[d])
                        own = _slots(texts[d], kinds[first : first + len(texts[d])], here - first, size, kind)
                        out.append((ids[d], prints[d], int(found[k].astype(np.int64)), size, here - first, own))
            if out:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), types, strict=True)], names=_HITS.replace(",", "").split()[::2])

    return run


def _hits(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """The windows of whole documents that may be windows of items."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key("text").alias("text_hash"))
    return held.mapInArrow(lean(_finder(bits, sizes)), _HITS)


def _read_window(window: tuple[int, int, int, str, str]) -> tuple[int, int, int, list[tuple[str, str]], list[str]] | None:
    """The window with its pairs of slot values, empty for literals, and its literals;
    None if a word that has to be the same is another."""
    item_at, doc_at, size, own, other = window
    pairs, literals = [], []
    for a, b in zip(own.split("\t"), other.split("\t"), strict=True):
        if a.startswith(str(_SAME)) and a[1:] != b[1:]:
            return None
        if a[:1] in ("", str(_LITERAL), str(_SAME)):
            literals.append(a[1:])
            a = b = ""
        pairs.append((a, b))
    return item_at, doc_at, size, pairs, literals


def judge(windows: list[tuple[int, int, int, str, str]], item_tokens: int) -> tuple[float, float, int]:
    """(coverage, consistency, slots) of a document for an item.

    ``windows`` are (item place, document place, size, item slots, document slots). Each
    alignment of item and document is judged by itself and all together, if its windows
    as a whole are evidence: with as many different literals as one window needs, of
    which slots that follow the renaming may stand for up to half, four for one literal.
    Windows that are evidence by themselves, by literals or by the item's own slots, are
    also judged without the others. The best is returned: the share of the item's tokens
    that the windows cover, and the share of slot values that follow one renaming, of the
    item's values to the document's and back.
    """
    read = [r for w in windows if (r := _read_window(w))]
    good = [w for w in read if all(not a or a == b for a, b in w[3]) or sum(not a for a, _ in w[3]) >= -(-LITERALS * w[2] // WINDOW)]
    best = (0.0, 0.0, 0)
    for some, weighed in ((good, False), (read, True)):
        if weighed and len(good) == len(read):
            break
        aligned = defaultdict(list)
        for w in some:
            aligned[w[1] - w[0]].append(w)
        for group in [*aligned.values(), *([some] if len(aligned) > 1 else [])]:
            covered, places, literals = set(), {}, set()
            for item_at, doc_at, size, pairs, words in group:
                covered.update(range(item_at, item_at + size))
                literals.update(words)
                for k, (a, b) in enumerate(pairs):
                    if a:
                        places[item_at + k, doc_at + k] = (a, b)
            there, back = defaultdict(Counter), defaultdict(Counter)
            for a, b in places.values():
                there[a][b] += 1
                back[b][a] += 1
            agreed = min(sum(max(c.values()) for c in m.values()) for m in (there, back))
            share = agreed / len(places) if places else 1.0
            if weighed and len(literals) + min(len(literals), agreed / SLOTS) < LITERALS:
                continue
            best = max(best, (len(covered) / item_tokens if share >= CONSISTENCY else 0.0, share, len(places)))
    return best


_FOUND = "doc_id long, text_hash long, item_id long, coverage double, consistency double, n_slots long"


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, text_hash, item_id, coverage, consistency and n_slots of every document and
    benchmark item whose text, with other numbers, names and units perhaps, it holds.

    Windows of both sides' templates meet in a hash join; what the documents send to it is
    first held against a map of the items' hashes, of a fixed size, so that a document
    without a template of an item sends nothing. Then the windows of one document and item
    are judged together. Copies of a document with its id are told once. Null and empty
    texts hold nothing; items with a null id or below LEAST words are not searched; empty
    tables give no rows; other columns are ignored.
    """
    windows = written(_item_windows(items.where("item_id IS NOT NULL")).distinct(), "item-windows")
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    hits = _hits(docs, _hash_map(windows), sizes)
    met = hits.join(windows, ["window", "size"]).groupBy("doc_id", "text_hash", "item_id", "item_tokens").agg(
        F.collect_set(F.struct("item_at", "doc_at", "size", "item_slots", "doc_slots")).alias("windows")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [judge([tuple(w.values()) for w in ws], n) for n, ws in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            columns = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.int64()))]
            names = [f.split()[0] for f in _FOUND.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)

    return met.mapInArrow(lean(run), _FOUND).where(F.col("coverage") >= coverage)


def decontaminate(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``docs`` without the contaminated documents; rows and columns as they were."""
    bad = written(contaminated(docs, items, coverage).select("doc_id", F.col("text_hash").alias("hash")).distinct(), "contaminated")
    return without(docs, bad, "text")
