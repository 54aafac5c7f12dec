"""Packing documents into training sequences of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, lean, slices
from .tokens import Encoder

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
STEP_TOKENS = 32 * WINDOW
BUFFER_TOKENS = 1 << 20
_TASK_BITS = 33
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, size int"
)
_SCHEMA = pa.schema([(f.split()[0], pa.int32() if f.endswith("int") else pa.int64()) for f in PIECES.split(", ")])

#: A run of one document's ids that is not placed yet: (length, document, start).
Segment = tuple[int, int, int]


class Packer:
    """Packs one stream of documents; holds about ``BUFFER_TOKENS`` ids at a time.

    A document goes to the shortest tier that takes what is left of it after whole
    windows of the longest. Tiers are packed from the longest down: each window is
    opened by a segment of its own tier, its gap is filled by the longest segments of
    shorter tiers that fit, and at last by a cut of a shorter one, so that a closed window
    is exactly full. What cannot fill a window waits for more documents; at the end the
    rest is cut along the tiers, and below the shortest along powers of two, so that no
    sequence needs padding.
    """

    def __init__(self, first_sequence: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.sequence = tiers, first_sequence
        self.waiting: list[Segment] = []
        self.closed: list[tuple[int, list[Segment]]] = []

    def add(self, document: int, length: int) -> None:
        start, longest = 0, self.tiers[-1]
        while length - start >= longest:
            self.closed.append((longest, [(longest, document, start)]))
            start += longest
        if start < length:
            self.waiting.append((length - start, document, start))

    def pack(self, last: bool) -> None:
        """Fill windows from the waiting segments, longest tier first."""
        bounds = (0, *self.tiers)
        by_tier = [sorted(s for s in self.waiting if low < s[0] <= high) for low, high in zip(bounds, self.tiers, strict=False)]
        kept: list[Segment] = []
        for k in range(len(self.tiers) - 1, -1, -1):
            shorter = by_tier[:k]
            while by_tier[k]:
                room, window, before = self.tiers[k], [], kept
                segment = by_tier[k].pop()
                window.append(segment)
                room -= segment[0]
                while room:
                    pool = next((p for p in reversed([*shorter, by_tier[0]] if k == 0 else shorter) if p and p[0][0] <= room), None)
                    if pool is not None:
                        segment = pool.pop(bisect_right(pool, (room, 1 << 62, 0)) - 1)
                        window.append(segment)
                        room -= segment[0]
                        continue
                    pool = next((p for p in ([by_tier[0]] if k == 0 else shorter) if p), None)
                    if pool is None:
                        break
                    length, document, start = pool.pop(0)
                    window.append((room, document, start))
                    insort(by_tier[self._tier(length - room)], (length - room, document, start + room))
                    room = 0
                if room:
                    before.extend(window)
                else:
                    self.closed.append((self.tiers[k], window))
        self.waiting = kept
        if last or sum(s[0] for s in kept) > BUFFER_TOKENS // 2:
            self._join(last)

    def _tier(self, length: int) -> int:
        return next(k for k, t in enumerate(self.tiers) if length <= t)

    def _join(self, last: bool) -> None:
        """Cut the waiting segments, one after the other, into the longest windows that
        they fill; the rest waits on or, at the end, is cut along powers of two."""
        total = sum(s[0] for s in self.waiting)
        segments = self.waiting[::-1]
        self.waiting = []
        while segments:
            sizes = self.tiers if last else self.tiers[-1:]
            size = next((t for t in reversed(sizes) if t <= total), 0)
            if not size and not last:
                self.waiting = segments
                return
            size = size or 1 << total.bit_length() - 1
            window, room = [], size
            while room:
                length, document, start = segments.pop()
                taken = min(room, length)
                window.append((taken, document, start))
                if taken < length:
                    segments.append((length - taken, document, start + taken))
                room -= taken
            self.closed.append((next(t for t in self.tiers if size <= t), window))
            total -= size

    def sequences(self) -> Iterator[tuple[int, int, list[Segment]]]:
        """The closed windows as (sequence, tier, segments)."""
        closed, self.closed = self.closed, []
        for tier, window in closed:
            yield self.sequence, tier, window
            self.sequence += 1


def _step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """(sequence_id, step_group): sequences, the longest first, dealt in turn to as many groups
    as hold about ``step_tokens`` ids each.

    A sequence's place in that order is that of its task's sequences of its size, from a
    window over one row for each task and size (a tier or a power of two), and its place
    among them.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / step_tokens))
    task = F.shiftright("sequence_id", _TASK_BITS).alias("task")
    sequences = pieces.where("offset = 0").select("sequence_id", "size", task)
    order = Window.orderBy(F.desc("size"), "task").rowsBetween(Window.unboundedPreceding, -1)
    counts = sequences.groupBy("size", "task").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("size", "task", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("size", "task").orderBy("sequence_id")) - 1
    placed = sequences.withColumn("own", own).join(before, ["size", "task"])
    return placed.select("sequence_id", ((F.col("before") + F.col("own")) % groups).alias("step_group"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row for each piece of a document in a sequence.

    Every task encodes and packs the rows that it reads, in a stream: no text is
    shuffled, memory is bounded by the buffer, and nothing is padded: a sequence is
    exactly as long as its tier, or one of a task's last few, of a power of two. Sequence
    numbers start at the task's number times 2^33. Step groups are then dealt over the
    sequences of all tasks, so that each has its share of every tier.

    A null or empty text has the end id alone; a text of any length is cut into windows;
    rows with equal ids are packed each for itself; an empty table gives no pieces; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "packing")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << _TASK_BITS, tiers)
        codes: dict[int, tuple[int | None, bytes]] = {}
        count, held = 0, 0

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = []
            for sequence, tier, window in packer.sequences():
                at, size = 0, sum(s[0] for s in window)
                for length, document, start in window:
                    doc_id, code = codes[document]
                    crc = zlib.crc32(memoryview(code)[4 * start : 4 * (start + length)])
                    rows.append((doc_id, start, length, crc, len(code) // 4, sequence, at, tier, size))
                    at += length
            alive = {s[1] for s in packer.waiting}
            for document in [d for d in codes if d not in alive]:
                del codes[document]
            held = sum(s[0] for s in packer.waiting)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in slices(batches, "text", 1 << 20):
            ids = batch.column(0).to_pylist()
            for doc_id, code in zip(ids, Encoder.shared(tokenizer_path).encode(batch.column(1).to_pylist(), end_id), strict=True):
                codes[count] = (doc_id, code)
                packer.add(count, len(code) // 4)
                count, held = count + 1, held + len(code) // 4
            if held >= BUFFER_TOKENS:
                packer.pack(last=False)
                yield from emit()
        packer.pack(last=True)
        yield from emit()

    pieces = scratch.written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(lean(run), PIECES), "pieces")
    return pieces.join(_step_groups(pieces, step_tokens), "sequence_id").select(*[f.name for f in _SCHEMA if f.name != "size"], "step_group")
