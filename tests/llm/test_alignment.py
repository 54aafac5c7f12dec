"""Cross-tokenizer alignment against a plain merge of byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from document_tables import docs  # noqa: F401
from venuegrid.llm import alignment
from venuegrid.llm.alignment import TokenPair, _chunks, alignment_counts, alignments, lockstep
from venuegrid.llm.queries import BYTE_PAIRS, PIECES
from venuegrid.llm.tokens import byte_characters

TEXTS = [
    None, "", " ", "  ", "a", "Hello world", "naïve café — 12,500 €", "tabs\tand\nlines\r\n", "<|endoftext|> <s> </s> <unk>", "▁odd", "東京 で 会う", "ﬁne ligature", "x  y   z    w", "é" * 50,
    "emoji 👩‍👩‍👧 done", " leading", "trailing ", " nbsp wide", "a\x00b", "The quick brown fox " * 400, "internationalisation" * 30,
]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(BYTE_PAIRS)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    byte_of = {c: bytes([n]) for n, c in enumerate(byte_characters())}

    def encode(text):
        if not text:
            return [], [], [], []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [b"".join(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
        if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            return [], [], [], []
        return ids_a, ids_b, np.cumsum([0, *map(len, bytes_a)]).tolist(), np.cumsum([0, *map(len, bytes_b)]).tolist()

    return encode


def merged(ids_a, ids_b, at_a, at_b):
    """Links and groups by comparing all byte ranges."""
    links = [(i, j) for i in range(len(ids_a)) for j in range(len(ids_b)) if at_a[i] < at_b[j + 1] and at_b[j] < at_a[i + 1]]
    ends = sorted(set(at_a[1:]) & set(at_b[1:]))
    groups, low = [], 0
    for end in ends:
        groups.append(([i for k, i in enumerate(ids_a) if low < at_a[k + 1] <= end], [i for k, i in enumerate(ids_b) if low < at_b[k + 1] <= end]))
        low = end
    return links, groups


def want(texts, plain):
    per = []
    for text in texts:
        ids_a, ids_b, at_a, at_b = plain(text)
        links, groups = merged(ids_a, ids_b, at_a, at_b) if ids_a else ([], [])
        per.append((ids_a, ids_b, links, groups))
    count = Counter(p for ids_a, ids_b, links, _ in per for p in {(ids_a[i], ids_b[j]) for i, j in links})
    most = {}
    for (a, _), n in count.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for k, (ids_a, ids_b, links, groups) in enumerate(per):
        pairs = [(ids_a[i], ids_b[j]) for i, j in links]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((k, len(ids_a), len(ids_b), len(groups), len(links), sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if ids_a else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize(("slice_links", "batch_bytes"), [(10**6, 1 << 20), (150, 300), (1, 1)])
def test_counts_equal_a_plain_merge(docs, plain, slice_links, batch_bytes, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch_bytes)
    rng = random.Random(2)
    texts = [t for t in TEXTS if t is None or len(t) < 1500] + [" ".join(rng.choice(["the", "Straße", "überall", "12", "\n", "façade", "re-do"]) for _ in range(rng.randrange(60))) for _ in range(30)]
    texts += texts[:12]
    got = alignment_counts(docs(list(enumerate(texts)), extra=True), BYTE_PAIRS, PIECES, slice_links)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got.collect()) == want(texts, plain)


def test_alignments_give_tokens_cuts_and_links(docs, plain):
    texts = [t for t in TEXTS if t is None or len(t) < 1500]
    rows = {r["doc_id"]: r for r in alignments(docs(list(enumerate(texts))), BYTE_PAIRS, PIECES).collect()}
    for k, text in enumerate(texts):
        ids_a, ids_b, at_a, at_b = plain(text)
        links, groups = merged(ids_a, ids_b, at_a, at_b) if ids_a else ([], [])
        r = rows[k]
        assert (r["ids_a"], r["ids_b"]) == (ids_a, ids_b)
        assert sorted(zip(r["links_a"], r["links_b"], strict=True)) == links
        assert r["cuts_a"] == np.cumsum([len(a) for a, _ in groups]).tolist() and r["cuts_b"] == np.cumsum([len(b) for _, b in groups]).tolist()


def test_ids_are_those_of_the_tokenizers(plain):
    pair = TokenPair(BYTE_PAIRS, PIECES)
    settled = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice(settled) for _ in range(40)) for _ in range(400)] + [f"a{c} {c}b  {c}" for c in settled]
    for text in texts:
        ids_a, ids_b, _, _ = plain(text)
        got = pair.encode([text])[0]
        assert (got[0].tolist(), got[1].tolist()) == (ids_a, ids_b), text


def test_forgotten_words_are_encoded_again(plain, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_WORDS", 20)
    pair = TokenPair(BYTE_PAIRS, PIECES)
    rng = random.Random(9)
    for _ in range(60):
        text = " ".join(f"wörd{rng.randrange(60)}" for _ in range(15))
        assert tuple(x.tolist() for x in pair.encode([text])[0]) == plain(text)[:2]
    assert len(pair.young[0]) + len(pair.old[0]) <= 80


def test_long_texts_in_parts(plain):
    rng = random.Random(4)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", " and", " the", "9"]) for _ in range(30_000))
    parts = list(_chunks(text, 5000))
    assert len(parts) > 10 and " ".join(parts) == text
    pair = TokenPair(BYTE_PAIRS, PIECES)
    ids_a, ids_b, _, _ = plain(text)
    got = pair.encode(parts)
    assert tuple(x.tolist() for x in pair._whole(text)) == (ids_a, ids_b)
    assert [i for a, _ in got for i in a] == ids_a and [i for _, b in got for i in b] == ids_b


@pytest.mark.parametrize("lane", [1, 3, 50, 10**6])
def test_lanes_do_not_change_anything(lane):
    rng = random.Random(lane)
    lengths = np.arange(1, 10)
    ids_a, ids_b = [], []
    for n in (0, 1, 5, 400, 3000):
        sides = []
        for _ in range(2):
            ids, left = [], n
            while left:
                size = min(left, rng.choice([1, 2, 3, 9]))
                ids.append(size - 1)
                left -= size
            sides.append(ids)
        ids_a.append(np.array(sides[0], np.int32))
        ids_b.append(np.array(sides[1], np.int32))
    x, y = lockstep(ids_a, ids_b, lengths, lengths, lane), lockstep(ids_a, ids_b, lengths, lengths)
    assert sorted(zip(x.link_a, x.link_b, strict=True)) == sorted(zip(y.link_a, y.link_b, strict=True))
    assert (x.cut_a == y.cut_a).all() and (x.cut_b == y.cut_b).all()
    assert x.cut_a.sum() == x.cut_b.sum()


def test_null_and_large_ids(docs, plain):
    got = alignment_counts(docs([(None, "some text"), ((1 << 60) + 1, "some text"), (None, None)]), BYTE_PAIRS, PIECES).collect()
    (_, *some), _, (_, *none) = want(["some text", "some text", None], plain)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=str) == sorted([(None, *some), ((1 << 60) + 1, *some), (None, *none)], key=str)


def test_empty_table(docs):
    assert alignment_counts(docs([]), BYTE_PAIRS, PIECES).count() == 0
