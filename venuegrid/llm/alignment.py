"""Alignment of the tokens of two tokenizers, by merging their ends in lockstep."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, per_process, slices
from .tokens import byte_characters

#: Tokens of A after which a long document goes on as another lane of the state vector.
LANE_TOKENS = 2048
#: Bytes of text that are aligned together, and different pairs of documents that are looked
#: up together.
BATCH_BYTES, SLICE_LINKS = 1 << 20, 1_000_000
#: Characters that are encoded at a time.
CHUNK_CHARACTERS = 1 << 20
#: Words that a worker remembers, in two generations of this many.
MEMO_WORDS = 100_000
#: White space at a text's ends or next to a space: elsewhere tokens never cross a space.
_IRREGULAR = re.compile(r"(?:\A| )(?:\s|\Z)")
#: Characters that every Unicode version classes alike; texts of these take the faster encoder.
_SETTLED = re.compile("[\x00-ɏ‐-‧‰-⁞€]*")
_NOTHING = np.zeros(0, np.int32)
#: Bits that an id takes in a number for a pair of ids.
_BITS = 20


class TokenPair:
    """Ids and byte lengths of texts by a byte-level BPE vocabulary (A, given a space before
    the text) and a sentencepiece model (B, which puts that space itself)."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(path_a) as file:
            model = json.load(file)["model"]
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        ranks = {b"".join(map(byte_of.__getitem__, token)): i for token, i in model["vocab"].items() if all(c in byte_of for c in token) and not token.startswith("<|")}
        merged = ("".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"])
        if any(model["vocab"][m] != 256 + k for k, m in enumerate(merged)):
            raise ValueError("needs a byte-level vocabulary numbered in the order of its merges")
        self.path_a, self._slow_a = path_a, None
        self.fast_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = (np.fromiter(map(len, t), np.int32, len(t)) for t in (self.bytes_a, self.bytes_b))
        self.marked_a, self.marked_b = _marked(len(self.bytes_a), ",;"), _marked(len(self.bytes_b), ",|")
        self.young: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})
        self.old: tuple[dict[str, bytes | None], dict[str, bytes | None]] = ({}, {})

    @classmethod
    def shared(cls, path_a: str, path_b: str) -> TokenPair:
        return per_process(f"pair_{path_a}_{path_b}", lambda: cls(path_a, path_b))

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none if it is null or empty, or the tokens of one do not
        give back its bytes.

        Between two words with a single space neither tokenizer has a token across it, so
        texts of such words are encoded word by word, and words are remembered. The memory
        is bounded: when a generation is full it becomes the old one.
        """
        if len(self.young[0]) > MEMO_WORDS:
            self.old, self.young = self.young, ({}, {})
        split = [t.split(" ") if t and not _IRREGULAR.search(t) else None for t in texts]
        self._learn(set().union(*filter(None, split)).difference(self.young[0]))
        known_a, known_b = (known.__getitem__ for known in self.young)
        out = []
        for text, words in zip(texts, split, strict=True):
            if words is None:
                out.append(self._whole(text) if text else (_NOTHING, _NOTHING))
                continue
            parts = list(map(known_b, words))
            if None in parts:
                out.append((_NOTHING, _NOTHING))
            else:
                out.append(tuple(np.frombuffer(b"".join(p), np.int32) for p in (map(known_a, words), parts)))
        return out

    def _learn(self, words: set[str]) -> None:
        """Remember the ids of words: all new ones are encoded as one text, which is then cut at
        its spaces; words that this can't serve are encoded by themselves."""
        new = [w for w in words if w not in self.old[0]]
        for w in words.difference(new):
            self.young[0][w], self.young[1][w] = self.old[0][w], self.old[1][w]
        settled = [w for w in new if _SETTLED.fullmatch(w)]
        text = " ".join(settled)
        whole = (" " + text).encode()
        ends = np.cumsum([len(w.encode()) + 1 for w in settled])
        sides = []
        for ids, table, lengths in ((self._encode_a(" " + text), self.bytes_a, self.lengths_a), (self.b.encode(text, num_threads=1), self.bytes_b, self.lengths_b)):
            ids = np.array(ids, np.int32)
            at = np.cumsum(lengths[ids])
            cuts = np.searchsorted(at, ends)
            if not settled or b"".join(map(table.__getitem__, ids.tolist())) != whole or (at[np.minimum(cuts, len(at) - 1)] != ends).any():
                break
            sides.append((ids.tobytes(), [0, *(4 * cuts + 4).tolist()]))
        else:
            for known, (ids, cuts) in zip(self.young, sides, strict=True):
                known.update(zip(settled, map(ids.__getitem__, map(slice, cuts, cuts[1:])), strict=False))
            new = [w for w in new if w not in self.young[0]]
        for w in new:
            ids_a, ids_b = self._whole(w)
            self.young[0][w], self.young[1][w] = ids_a.tobytes(), ids_b.tobytes() if len(ids_b) else None

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids_a: list[np.ndarray] = []
        ids_b: list[np.ndarray] = []
        for chunk in _chunks(text):
            whole = (" " + chunk).encode()
            for ids, found, table in ((self._encode_a(" " + chunk), ids_a, self.bytes_a), (self.b.encode(chunk, num_threads=1), ids_b, self.bytes_b)):
                if b"".join(map(table.__getitem__, ids)) != whole:
                    return _NOTHING, _NOTHING
                found.append(np.array(ids, np.int32))
        return np.concatenate(ids_a), np.concatenate(ids_b)

    def _encode_a(self, text: str) -> list[int]:
        if _SETTLED.fullmatch(text):
            return self.fast_a.encode_ordinary(text)
        if self._slow_a is None:
            from tokenizers import Tokenizer

            self._slow_a = Tokenizer.from_file(self.path_a)
            self._slow_a.encode_special_tokens = True
        return self._slow_a.encode(text, add_special_tokens=False).ids


def _chunks(text: str, most: int = CHUNK_CHARACTERS) -> Iterator[str]:
    """The text in parts whose tokens are those of the whole: cut at single spaces between
    ASCII letters, across which neither tokenizer has tokens. The space goes with the cut, as both put
    one before what they encode."""
    at = 0
    while len(text) - at > most:
        cut = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])").search(text, at + most - 1)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


def _marked(n: int, marks: str) -> np.ndarray:
    """The decimal numbers 0 to n - 1, with nothing before them, then with each of two marks."""
    return np.array([mark + b"%d" % i for mark in (b"", *(m.encode() for m in marks)) for i in range(n)], object)


class Aligned(NamedTuple):
    """A batch of documents: flat ids of both tokenizers, where each document's begin (and the
    last end), which tokens end a group, and all links as flat places."""

    ids_a: np.ndarray
    ids_b: np.ndarray
    from_a: np.ndarray
    from_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def _lanes(ends_a: np.ndarray, ends_b: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Places (of A, of B) where the lanes of one document start: the first one, and about
    every ``most`` tokens the next place at which tokens of both end."""
    if not len(ends_a):
        return
    yield 0, 0
    at = most
    while at < len(ends_a):
        window = 64
        while True:
            some = ends_a[at - 1 : at - 1 + window]
            met = np.searchsorted(ends_b, some)
            hits = np.flatnonzero(ends_b[np.minimum(met, len(ends_b) - 1)] == some)
            if len(hits):
                break
            at, window = at + window, 2 * window
        at += int(hits[0])
        if at < len(ends_a):
            yield at, int(met[hits[0]]) + 1
        at += most


def lockstep(ids_a: list[np.ndarray], ids_b: list[np.ndarray], lengths_a: np.ndarray, lengths_b: np.ndarray, lane_tokens: int = LANE_TOKENS) -> Aligned:
    """Align the tokens of all documents of a batch at once.

    Every document has a place in A and one in B in a state vector (a long one has several
    lanes, from ends that both share). Each step links the two tokens at the places, for
    all documents; the one that ends first is passed, both if they end together, which is
    a cut. Finished documents leave the vector.
    """
    flat_a, flat_b = (np.concatenate([_NOTHING, *lists]) for lists in (ids_a, ids_b))
    from_a, from_b = (np.append(0, np.cumsum([len(ids) for ids in lists])).astype(np.int64) for lists in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(lengths_a[flat_a], dtype=np.int64), np.cumsum(lengths_b[flat_b], dtype=np.int64)
    starts = [(d_a + a, d_b + b) for d_a, e_a, d_b, e_b in zip(from_a, from_a[1:], from_b, from_b[1:], strict=False) for a, b in _lanes(ends_a[d_a:e_a], ends_b[d_b:e_b], lane_tokens)]
    at_a, at_b = (np.array([s[k] for s in starts], np.int32) for k in (0, 1))
    upto = np.append(at_a[1:], np.int32(len(flat_a)))[: len(at_a)]
    cut_a, cut_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
    links_a, links_b = [], []
    while len(at_a):
        links_a.append(at_a)
        links_b.append(at_b)
        ahead = ends_a[at_a] - ends_b[at_b]
        both = ahead == 0
        cut_a[at_a[both]] = True
        cut_b[at_b[both]] = True
        at_a, at_b = at_a + (ahead <= 0), at_b + (ahead >= 0)
        on = at_a < upto
        if not on.all():
            at_a, at_b, upto = at_a[on], at_b[on], upto[on]
    return Aligned(flat_a, flat_b, from_a, from_b, cut_a, cut_b, np.concatenate([_NOTHING, *links_a]), np.concatenate([_NOTHING, *links_b]))


def _groups(cut: np.ndarray) -> np.ndarray:
    """The group of each token: how many tokens before it end one."""
    return np.cumsum(cut) - cut


def group_texts(x: Aligned, marked_a: np.ndarray, marked_b: np.ndarray) -> list[bytes]:
    """For each document its groups as ``a1,a2|b1;a3|b2,b3``."""
    group_a, group_b = _groups(x.cut_a), _groups(x.cut_b)
    n_groups = int(x.cut_a.sum())
    upto_a = np.cumsum(np.bincount(group_a, minlength=n_groups))
    upto_b = np.append(0, np.cumsum(np.bincount(group_b, minlength=n_groups)))
    place_a = np.arange(len(group_a)) + upto_b[group_a]
    place_b = np.arange(len(group_b)) + upto_a[group_b]
    out = np.empty(len(place_a) + len(place_b), object)
    starts = x.from_a + x.from_b
    for place, ids, marked, cut in ((place_a, x.ids_a, marked_a, x.cut_a), (place_b, x.ids_b, marked_b, x.cut_b)):
        first = np.append(True, cut[:-1])[: len(cut)]
        out[place] = marked[ids + (1 + first) * (len(marked) // 3)]
    # A document's first token has no mark.
    some = np.diff(x.from_a) > 0
    out[starts[:-1][some]] = marked_a[x.ids_a[x.from_a[:-1][some]]]
    parts, starts = out.tolist(), starts.tolist()
    return [b"".join(parts[a:b]) for a, b in zip(starts, starts[1:], strict=False)]


def _encoded(batches: Iterator[pa.RecordBatch], paths: tuple[str, str], batch_bytes: int) -> Iterator[tuple[pa.RecordBatch, Aligned, TokenPair]]:
    pair = TokenPair.shared(*paths)
    for batch in slices(batches, "text", batch_bytes):
        both = pair.encode(batch.column(1).to_pylist())
        yield batch, lockstep([b[0] for b in both], [b[1] for b in both], pair.lengths_a, pair.lengths_b), pair


def alignments(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """For each document doc_id, its ids_a and ids_b, cuts_a and cuts_b (the tokens up to each
    common end) and links_a and links_b (places of tokens whose bytes overlap).

    Texts that are null or empty, or that the tokens of one side do not give back, have
    empty arrays. Long texts are encoded in parts with the same tokens. Repeated rows,
    null ids and extra columns do not matter; an empty table gives no rows.
    """
    names = ["ids_a", "ids_b", "cuts_a", "cuts_b", "links_a", "links_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, _ in _encoded(batches, (path_a, path_b), BATCH_BYTES):
            order = np.argsort(x.link_a, kind="stable")
            link_a, link_b = x.link_a[order], x.link_b[order]
            from_links = np.searchsorted(link_a, x.from_a)
            columns = [_lists(x.ids_a, x.from_a), _lists(x.ids_b, x.from_b)]
            for cut, first in ((x.cut_a, x.from_a), (x.cut_b, x.from_b)):
                at = np.flatnonzero(cut)
                doc = np.searchsorted(first, at, side="right") - 1
                columns.append(_lists(at + 1 - first[doc], np.searchsorted(at, first)))
            for link, first in ((link_a, x.from_a), (link_b, x.from_b)):
                doc = np.searchsorted(x.from_a, link_a, side="right") - 1
                columns.append(_lists(link - first[doc], from_links))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])

    kinds = ", ".join(f"{n} array<int>" for n in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {kinds}")


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(values.astype(np.int32)))


_DOCUMENTS = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, asked binary, in_docs binary"
_NAMES = [c.split()[0] for c in _DOCUMENTS.split(", ")]


def _small(values: np.ndarray) -> bytes:
    """Numbers of one, two or four bytes, as the largest needs."""
    most = int(values.max(initial=0))
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4").tobytes()


def _numbers(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}") if n else np.zeros(0, np.uint8)


class _Part(NamedTuple):
    """What a slice keeps of a batch: columns of its documents, and the different linked
    pairs of each, with how often."""

    columns: list[pa.Array]
    owners: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def _part(batch: pa.RecordBatch, x: Aligned, pair: TokenPair) -> _Part:
    n = batch.num_rows
    doc = np.searchsorted(x.from_a, x.link_a, side="right") - 1
    linked = (doc << _BITS | x.ids_a[x.link_a]) << _BITS | x.ids_b[x.link_b]
    keys, times = np.unique(linked, return_counts=True)
    groups = np.diff(np.append(0, np.cumsum(x.cut_a))[x.from_a])
    numbers = [np.diff(x.from_a), np.diff(x.from_b), groups, np.bincount(doc, minlength=n)[:n]]
    texts = group_texts(x, pair.marked_a, pair.marked_b)
    digests = pa.array([hashlib.sha256(t).hexdigest() if t else "" for t in texts], pa.string())
    return _Part([batch.column(0), *(pa.array(c.astype(np.int64)) for c in numbers), digests], keys >> 2 * _BITS, keys & (1 << 2 * _BITS) - 1, times)


def _slice_rows(number: int, parts: list[_Part]) -> pa.RecordBatch:
    """A row for each document of a slice, with its linked id pairs as places in the slice's
    list of pairs, and one with that list and in how many documents each stands."""
    columns = [pa.concat_arrays([*some, pa.nulls(1, some[0].type)]) for some in zip(*(p.columns for p in parts), strict=True)]
    n = len(columns[0]) - 1
    asked, place = np.unique(np.concatenate([p.pairs for p in parts]), return_inverse=True)
    times = np.concatenate([p.times for p in parts])
    before = np.cumsum([0, *(len(p.columns[0]) for p in parts)])
    borders = np.searchsorted(np.concatenate([p.owners + b for p, b in zip(parts, before, strict=False)]), np.arange(n + 1))
    in_docs = np.bincount(place, minlength=len(asked))
    some = list(zip(borders, borders[1:], strict=False))
    columns = [
        pa.array(np.full(n + 1, number)),
        *columns,
        pa.array([_wide(place[a:b], len(asked)) for a, b in some] + [None], pa.binary()),
        pa.array([_small(times[a:b]) for a, b in some] + [None], pa.binary()),
        pa.array([None] * n + [asked.astype("<i8").tobytes()], pa.binary()),
        pa.array([None] * n + [in_docs.astype("<i8").tobytes()], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _wide(places: np.ndarray, n: int) -> bytes:
    return places.astype("<u2" if n <= 1 << 16 else "<u4").tobytes()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (slice, place, pair, n) of the slices' lists."""
    for batch in batches:
        for number, pairs, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "asked", "in_docs")), strict=True):
            pairs, n = np.frombuffer(pairs, "<i8"), np.frombuffer(n, "<i8")
            for at in range(0, len(pairs), 50_000):
                some = slice(at, at + 50_000)
                places = np.arange(at, at + len(pairs[some]), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), number)), pa.array(places), pa.array(pairs[some]), pa.array(n[some])], names=["slice", "place", "pair", "n"])


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, slice_links: int = SLICE_LINKS) -> DataFrame:
    """For each document doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose id
    pair is in as many documents as any pair of its A id), count_sum (documents that hold
    the pair, over the links) and groups_sha256 (of ``group_texts``; '' without tokens).

    The texts are encoded and aligned once, in slices. A slice asks for each of its
    different pairs once; the answers, joined by pair, come back to the slice's documents.
    The highest counts have a row for each id of A, so at most its vocabulary is broadcast.

    Texts that are null or empty, or that the tokens of one side do not give back, have
    zeros. Long texts are encoded in parts with the same tokens. Repeated rows are documents
    of their own; null ids and extra columns do not matter; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "alignment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, links = TaskContext.get().partitionId() << 32, 0
        parts: list[_Part] = []
        for batch, x, pair in _encoded(batches, (path_a, path_b), BATCH_BYTES):
            parts.append(_part(batch, x, pair))
            links += len(parts[-1].pairs)
            if links >= slice_links:
                yield _slice_rows(number, parts)
                number, links, parts = number + 1, 0, []
        if parts:
            yield _slice_rows(number, parts)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scratch.written(source.mapInArrow(run, _DOCUMENTS), "rows")
    asked = rows.where("asked IS NOT NULL").select("slice", "asked", "in_docs").mapInArrow(_asked, "slice long, place int, pair long, n long")
    counts = scratch.written(asked.groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    id_a = F.shiftright("pair", _BITS)
    highest = counts.groupBy(id_a.alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", id_a).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    answers = asked.drop("n").join(judged, "pair").select("slice", "place", "n", "best")
    # A null among longs would make them floating-point numbers in pandas.
    documents = rows.where("asked IS NULL").drop("asked", "in_docs").withColumn("no_id", F.isnull("doc_id")).na.fill(0, ["doc_id"])

    def look_up(key: tuple, own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("place")
        n, best = known["n"].to_numpy(), known["best"].to_numpy().astype(np.int64)
        sums, bests = [], []
        for places, times in zip(own["pairs"], own["times"], strict=True):
            places = np.frombuffer(places, "<u2" if len(n) <= 1 << 16 else "<u4")
            times = _numbers(times, len(places)).astype(np.int64)
            sums.append(int((n[places] * times).sum()))
            bests.append(int((best[places] * times).sum()))
        return own[["doc_id", "no_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].assign(n_best=bests, count_sum=sums)

    schema = "doc_id long, no_id boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    found = documents.groupBy("slice").cogroup(answers.groupBy("slice")).applyInPandas(look_up, schema)
    return found.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
