"""Language-model scores: a unigram of subwords summed over all segmentations."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_process, slices, written

#: Text of a chunk (the documents whose words are counted together before anything is
#: shuffled), and of all documents for each bucket of words.
CHUNK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
#: Words longer than this are scored one at a time.
_LONG = 64
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15)
MARK = "▁"


class Lattice:
    """Forward and backward recursion, in log space, over the segmentations of words.

    Pieces come from an existing vocabulary. A word, with the mark of its start, is any
    sequence of pieces that spell it; a character that is no piece is spelled by an
    unknown piece. Words of one length go through the recursion together.
    """

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.unknown = len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            by_length.setdefault(len(piece), []).append(i)
        self.longest = max(by_length)
        self.tables = {}
        for n, ids in by_length.items():
            hashes = np.zeros(len(ids), np.uint64)
            codes = _codes([pieces[i] for i in ids], n)
            for k in range(n):
                hashes = hashes * _BASE + codes[:, k]
            order = np.argsort(hashes)
            self.tables[n] = (hashes[order], np.array(ids, np.int64)[order])

    def _ids(self, codes: np.ndarray) -> dict[int, np.ndarray]:
        """For each piece length the piece at each place, or one past the unknown."""
        length = codes.shape[1]
        none = self.unknown + 1
        out, hashes = {}, np.zeros(codes.shape, np.uint64)
        for n in range(1, min(self.longest, length) + 1):
            hashes = hashes[:, : length - n + 1] * _BASE + codes[:, n - 1 :]
            if n not in self.tables:
                continue
            known, ids = self.tables[n]
            at = np.searchsorted(known, hashes)
            at[at == len(known)] = 0
            found = known[at] == hashes
            if n > 1 and not found.any():
                continue
            out[n] = np.where(found, ids[at], self.unknown if n == 1 else none)
        return out

    def _forward(self, ids: dict[int, np.ndarray], scores: np.ndarray, rows: int, length: int) -> np.ndarray:
        alpha = np.full((rows, length + 1), -np.inf)
        alpha[:, 0] = 0
        for end in range(1, length + 1):
            for n, piece in ids.items():
                if n <= end:
                    alpha[:, end] = np.logaddexp(alpha[:, end], alpha[:, end - n] + scores[piece[:, end - n]])
        return alpha

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            n = int(lengths[group[0]])
            step = max(1, (8192 if n <= _LONG else 65536) // n)
            for at in range(0, len(group), step):
                some = group[at : at + step]
                yield some, _codes([MARK + words[i] for i in some], n)

    def log_likelihood(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Natural logarithm of each word's probability. ``scores`` has a value for each
        piece and one for the unknown piece."""
        out = np.zeros(len(words))
        if words:
            full = np.append(scores, -np.inf)
            for some, codes in self._groups(words):
                out[some] = self._forward(self._ids(codes), full, *codes.shape)[:, -1]
        return out

    def expected(self, words: list[str], counts: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``counts`` of the words."""
        total = np.zeros(self.unknown + 2)
        if words:
            full = np.append(scores, -np.inf)
            for some, codes in self._groups(words):
                rows, length = codes.shape
                ids = self._ids(codes)
                alpha = self._forward(ids, full, rows, length)
                beta = np.full((rows, length + 1), -np.inf)
                beta[:, length] = np.log(counts[some]) - alpha[:, length]
                for start in range(length - 1, -1, -1):
                    for n, piece in ids.items():
                        if start + n <= length:
                            beta[:, start] = np.logaddexp(beta[:, start], beta[:, start + n] + full[piece[:, start]])
                for n, piece in ids.items():
                    weight = np.exp(alpha[:, : length - n + 1] + full[piece] + beta[:, n:])
                    total += np.bincount(piece.ravel(), weight.ravel(), minlength=len(total))
        return total[:-1]


def _codes(words: list[str], length: int) -> np.ndarray:
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    return flat.reshape(len(words), length).astype(np.uint64) + np.uint64(1)


def vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece model and the logarithms of their starting weights.

    The model's scores give the pieces' order; a piece of rank r starts with a weight of
    1 / (r + 10), as frequencies fall with the rank. Control and byte pieces are left
    out; the unknown piece comes last.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    usable = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    usable.sort(key=lambda i: (-model.get_score(i), i))
    pieces = [model.id_to_piece(i) for i in usable]
    weights = 1.0 / (np.arange(len(pieces) + 1) + 10.0)
    return pieces, np.log(weights / weights.sum())


def _pack(array: np.ndarray) -> bytes:
    return zlib.compress(array.tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), dtype=kind)


def _bucket(word: bytes, buckets: int) -> int:
    return zlib.crc32(word) % buckets


class _Numbers(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


_CHUNKS = "chunk string, bucket int, rows long, words binary, counts binary"


def _chunks(docs: DataFrame, learn: Column, buckets: int) -> DataFrame:
    """Tables of chunks. For each chunk and bucket one row with the chunk's distinct words
    of that bucket (sorted) and how often its learning documents have them, and one row
    (bucket -1) with its documents: ids, lengths and the places of their words in the
    chunk's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        for batch in slices(batches, "text", CHUNK_BYTES):
            numbers = _Numbers()
            split = [(t or "").encode().lower().split() for t in batch.column(1).to_pylist()]
            flat = np.fromiter((numbers[w] for s in split for w in s), np.int64, sum(map(len, split)))
            lengths = np.array([len(s) for s in split], np.int64)
            taught = np.array(batch.column(2).to_pylist(), bool)
            counts = np.bincount(flat, np.repeat(taught, lengths), minlength=len(numbers)).astype(np.int64)
            known = sorted((_bucket(w, buckets), w) for w in numbers)
            order = np.fromiter((numbers[w] for _, w in known), np.int64, len(known))
            place = np.empty(len(known), np.uint32)
            place[order] = np.arange(len(known), dtype=np.uint32)
            counts = counts[order]
            chunk, out, start = uuid.uuid4().hex, [], 0
            borders = np.flatnonzero(np.diff([b for b, _ in known])) + 1
            for end in [*borders.tolist(), len(known)] if known else []:
                data = zlib.compress(b"\n".join(w for _, w in known[start:end]), 1)
                out.append((chunk, known[start][0], end - start, data, _pack(counts[start:end])))
                start = end
            ids = batch.column(0)
            meta = pa.BufferOutputStream()
            with pa.ipc.new_stream(meta, pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64())])) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(~taught), pa.array(lengths)], names=["doc_id", "held_out", "n"]))
            out.append((chunk, -1, int(taught.sum()), meta.getvalue().to_pybytes(), _pack(place[flat])))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_CHUNKS.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", learn.alias("learn")).mapInArrow(run, _CHUNKS)


def _merged(rows: pd.DataFrame) -> tuple[list[np.ndarray], list[bytes], np.ndarray]:
    """A bucket's distinct words with their counts, and each row's places among them."""
    numbers, places = _Numbers(), []
    for data in rows["words"]:
        own = zlib.decompress(data).split(b"\n")
        places.append(np.fromiter(map(numbers.__getitem__, own), np.int64, len(own)))
    counts = np.zeros(len(numbers), np.int64)
    for at, data in zip(places, rows["counts"], strict=True):
        counts[at] += _unpack(data, "<i8")
    return places, list(numbers), counts


def score_documents(docs: DataFrame, learn: Column, vocabulary_path: str, chunk_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every
    whole text; learned from the rows where ``learn`` is true.

    Words are counted in each chunk of documents, merged in buckets of words, and the
    answers (a word's count and probability) go back to the chunks that asked; a word
    is a row of each chunk that has it, however often. Nothing that grows with the
    vocabulary passes through the driver or one task: only the totals do, and the
    weights of the pieces, whose number is fixed. The pieces' weights start from the
    existing vocabulary's and take one step of expectation and maximisation over the
    learning documents' words; after that a word's probability is the sum over all of
    its segmentations, and a document's is the product over its words and of not ending
    before its end.

    Null and empty texts have the end token alone; a null ``learn`` is false; repeated
    rows count each; an empty table gives no rows. Without learning documents counts are
    zero and the pieces keep their starting weights.
    """
    taught = F.coalesce(learn, F.lit(False))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // chunk_bytes))
    chunks = written(_chunks(docs, taught, buckets), "lm-chunks")
    asked = chunks.where("bucket >= 0")

    def model() -> tuple[Lattice, np.ndarray]:
        def load():
            pieces, scores = vocabulary(vocabulary_path)
            return Lattice(pieces), scores

        return per_process(f"lattice_{vocabulary_path}", load)

    def learn_bucket(key, rows: pd.DataFrame) -> pd.DataFrame:
        lattice, start = model()
        _, words, counts = _merged(rows)
        known = np.flatnonzero(counts)
        expected = lattice.expected([words[i].decode() for i in known], counts[known], start)
        at = np.flatnonzero(expected)
        return pd.DataFrame({"piece": np.append(at, -1 - np.arange(2)), "weight": np.append(expected[at], [len(known), counts.sum()])})

    learned = asked.groupBy("bucket").applyInPandas(learn_bucket, "piece long, weight double").groupBy("piece").agg(F.sum("weight").alias("weight"))
    found = {r["piece"]: r["weight"] for r in learned.collect()}  # a row for each piece of the vocabulary
    documents = chunks.where("bucket < 0").agg(F.sum("rows")).first()[0] or 0
    distinct, words_seen = int(found.pop(-1, 0)) + (documents > 0), int(found.pop(-2, 0))
    total = words_seen + documents
    lattice, start = model()
    weights = np.exp(start)  # as one piece of evidence in all
    for piece, weight in found.items():
        weights[piece] += weight
    scores = np.log(weights / weights.sum())
    ends = (documents + 1) / (total + 2)
    divisor = np.log10(total + 1.0 * (distinct + 1))

    def answer(key, rows: pd.DataFrame) -> pd.DataFrame:
        places, words, counts = _merged(rows)
        chance = model()[0].log_likelihood([w.decode() for w in words], scores)
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "counts": [_pack(counts[p]) for p in places], "chances": [_pack(chance[p]) for p in places]})

    answers = asked.groupBy("bucket").applyInPandas(answer, "chunk string, bucket int, counts binary, chances binary")

    def finish(key, rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        replies = replies.sort_values("bucket")
        counts = np.concatenate([np.zeros(0, np.int64), *(_unpack(x, "<i8") for x in replies["counts"])])
        chances = np.concatenate([np.zeros(0), *(_unpack(x, "<f8") for x in replies["chances"])])
        base = np.log10(counts + 1.0) - divisor
        outs = []
        for meta, data in zip(rows["words"], rows["counts"], strict=True):
            table = pa.ipc.open_stream(meta).read_all()
            at, n = _unpack(data, "<u4"), table.column("n").to_numpy()
            owner = np.repeat(np.arange(len(n)), n)

            def sums(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner, values, minlength=len(n))  # noqa: B023

            outs.append(
                pd.DataFrame(
                    {
                        "doc_id": table.column("doc_id").to_pandas(types_mapper=pd.ArrowDtype),
                        "held_out": table.column("held_out").to_numpy(),
                        "n_tokens": n + 1,
                        "n_known": sums(counts[at] > 0).astype(np.int64) + (documents > 0),
                        "train_tokens": total,
                        "base_score": sums(base[at]) + np.log10(documents + 1.0) - divisor,
                        "score": (sums(chances[at]) + n * np.log1p(-ends) + np.log(ends)) / np.log(10),
                    }
                )
            )
        return pd.concat(outs) if outs else pd.DataFrame({k.split()[0]: [] for k in _SCORES.split(", ")})

    return (
        chunks.where("bucket < 0")
        .select("chunk", "words", "counts")
        .groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInPandas(finish, _SCORES)
    )


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
