import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from venuegrid.llm.packing import Packer, pack_documents
from venuegrid.llm.token_files import read_tokens, token_digest, write_tokens
from venuegrid.llm.tokens import Encoder
from document_tables import docs  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")
EDGES = [
    "", None, " ", "it's  I'LL 'tis  'S", "<|endoftext|> a<|startoftext|>b", "wörd, é é́ ́x ﬁ", "a\tb\r\nc\x0bd\x0ce\x1cf\x85g\xa0h i",
    "1234 ١٢ x9y?! ...,, a., b.. c! ,", "日本語 テキスト 😀😀", "İstanbul ΟΔΟΣ ẞ", "x" * 5000, "word " * 6000, "Hello, World. hello", "²³ ⅷ ªº·",
]


def truth(text):
    tokenizer = Tokenizer.from_file(PATH)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_the_library():
    rng = random.Random(5)
    alphabet = "abcXYZ éß,.;'s \n\t́İ<|>09日 "
    texts = EDGES + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)]
    encoder = Encoder(PATH, memo_words=50)
    tokenizer = Tokenizer.from_file(PATH)
    for text, code in zip(texts, encoder.encode(texts, 2), strict=True):
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(code, "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_round_trip(spark, docs, tmp_path, encoding):
    rows = [(i * 7 % 23 + 100, t) for i, t in enumerate(EDGES)] + [(None, "no id"), (100, "repeated id")]
    path = str(tmp_path / "out")
    write_tokens(docs(rows, extra=True), path, PATH, 2, encoding=encoding)
    got = {(r["doc_id"], r["n_tokens"], r["ids_crc32"]): r["start"] for r in token_digest(read_tokens(spark, path)).collect()}
    assert len(got) == len(rows)
    at = 0
    for (_, n, _), start in sorted(got.items(), key=lambda x: x[1]):
        assert start == at
        at += n
    ids = [k[0] for k, _ in sorted(got.items(), key=lambda x: x[1])]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    want = {(i, len(x := truth(t)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in rows}
    assert set(got) == want


def test_empty_table(spark, docs, tmp_path):
    write_tokens(docs([]), str(tmp_path / "out"), PATH, 2)
    assert token_digest(read_tokens(spark, str(tmp_path / "out"))).count() == 0
    assert pack_documents(docs([]), PATH, 2).count() == 0


def check_pieces(rows, want):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(want)
    for doc, pieces in by_doc.items():
        ids, at = want[doc], 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
        assert len({p["step_group"] for p in pieces}) == 1
    return padding


def test_pieces(spark, docs):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(EDGES)]
    rows += [(100 + i, " ".join(rng.choices(["alpha", "beta", "gamma,"], k=int(rng.paretovariate(0.6)) % 9000))) for i in range(150)]
    want = {i: truth(t) for i, t in rows}
    got = pack_documents(docs(rows, extra=True).repartition(3), PATH, 2).collect()
    assert check_pieces(got, want) == 0


def test_packer_fills_windows():
    rng = random.Random(1)
    packer, lengths = Packer(0), [rng.choice([1, 30, 700, 1500, 3000, 4095, 4096, 9000]) for _ in range(3000)]
    for k, n in enumerate(lengths):
        packer.add(k, n)
        if k % 500 == 499:
            packer.pack(last=False)
    packer.pack(last=True)
    taken, short = [0] * len(lengths), []
    for _, tier, window in packer.sequences():
        size = sum(s[0] for s in window)
        if size != tier:
            short.append(size)
        for n, k, _ in window:
            taken[k] += n
    assert taken == lengths and len(short) <= 9 and all(n & (n - 1) == 0 and n < 512 for n in short)


def test_step_groups_are_balanced_over_all_tasks(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma,"], k=int(rng.paretovariate(0.7) * 40) % 6000))) for i in range(900)]
    got = pack_documents(docs(rows).repartition(50), PATH, 2, step_tokens=1 << 15)
    rows = got.groupBy("step_group").agg({"length": "sum"}).collect()
    loads = [r[1] for r in rows]
    assert len(loads) == round(sum(loads) / (1 << 15)) > 5
    assert max(loads) - min(loads) <= 4096 < 0.15 * min(loads)
    parts = got.where("offset = 0").groupBy("step_group").agg({"sequence_id": "count"}).count()
    assert parts == len(loads)


def test_repeated_rows_are_packed_each(spark, docs):
    got = pack_documents(docs([(1, "a b"), (1, "a b")]), PATH, 2).collect()
    assert sum(r["length"] for r in got) == 2 * len(truth("a b"))


def test_ascii_words_and_marks_behind_them_need_no_pattern(monkeypatch):
    """Most words are such: they are told apart as bytes, and a piece is encoded once."""
    from venuegrid.llm import tokens

    monkeypatch.setattr(tokens, "_SIMPLE", None)
    monkeypatch.setattr(tokens, "_MARKED", None)
    encoder = Encoder(PATH)
    seen, piece = [], encoder._piece
    monkeypatch.setattr(encoder, "_piece", lambda p: seen.append(p) or piece(p))
    words = "hello hello, world. world! Hello;"
    assert np.frombuffer(encoder.encode([words], 2)[0], "<u4").tolist() == truth(words)
    assert len(seen) == len(set(seen)) == 6
