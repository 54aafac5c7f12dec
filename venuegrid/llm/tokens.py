"""Token ids of whole texts by a public tokenizer, inside tasks."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable

import numpy as np

from .common import per_process

#: The words that a worker remembers, in two generations of this many.
MEMO_WORDS = 300_000
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A run of (Latin-1) letters is one piece for the tokenizer, and so is a run of marks
#: after it. Other letters may turn into letters and combining marks in lower case.
_SIMPLE = re.compile(f"[{_LETTERS}]+")
_MARKS = ".,;:!?%*#$&()|<>=+/-"
_MARKED = re.compile(rf"([{_LETTERS}]+)([{_MARKS}]+)")
_MARK_BYTES = _MARKS.encode()


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it
    is printable in Latin-1, else the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Encoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    For a tokenizer whose pieces never cross a space, a text's ids are those of its
    space-separated words in a row, so each word is encoded once and remembered. The
    memory is bounded: when a generation is full it becomes the old one, and the one
    before it is forgotten.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if "Lowercase" not in str(self.tokenizer.normalizer) or "ByteLevel" not in str(self.tokenizer.pre_tokenizer):
            raise ValueError("needs a lower-casing byte-level tokenizer whose pieces end at spaces")
        self.model = self.tokenizer.model
        self.memo_words = memo_words
        self.characters = byte_characters()
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        return per_process(f"encoder_{path}", lambda: cls(path))

    def _learn(self, words: Iterable[bytes]) -> None:
        young, old = self.young, self.old
        rest = []
        for word in words:
            code = old.get(word)
            if code is None:
                stem = word.rstrip(_MARK_BYTES)
                # Without a decoder or a pattern where letters are ASCII.
                if stem.isalpha():
                    code = young.get(stem) or old.get(stem) or self._remembered(stem.decode())
                    if len(stem) < len(word):
                        marks = word[len(stem) :]
                        code += young.get(marks) or old.get(marks) or self._remembered(marks.decode())
                    young[word] = code
                    continue
                text = word.decode()
                if _SIMPLE.fullmatch(text):
                    code = self._piece(text)
                elif pair := _MARKED.fullmatch(text):
                    code = b"".join(young.get(p.encode()) or self._remembered(p) for p in pair.groups())
                else:
                    rest.append(word)
                    continue
            young[word] = code
        if rest:
            found = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
            young.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(rest, found, strict=True))

    def _remembered(self, piece: str) -> bytes:
        code = self.young[piece.encode()] = self._piece(piece)
        return code

    def _piece(self, piece: str) -> bytes:
        """A run of letters or marks by the library's model alone: what its normaliser
        and splitter would do to such a run is known."""
        lower = piece.lower()
        mapped = lower if lower.isascii() else "".join(map(self.characters.__getitem__, lower.encode()))
        return self._ids(mapped)

    def _ids(self, mapped: str) -> bytes:
        found = self.model.tokenize(mapped)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def encode(self, texts: list[str | None], end_id: int) -> list[bytes]:
        """For each text its ids and ``end_id``, as little-endian unsigned 32-bit integers."""
        end = struct.pack("<I", end_id)
        out = []
        for at in range(0, len(texts), 256):
            split = [self._words(t or "") for t in texts[at : at + 256]]
            if len(self.young) > self.memo_words:
                self.old, self.young = self.young, {b"": b""}
            self._learn(set().union(*split).difference(self.young))
            known = self.young.__getitem__
            out.extend(b"".join(map(known, words)) + end for words in split)
        return out

    @staticmethod
    def _words(text: str) -> list[bytes]:
        """Split at spaces and line ends. The tokenizer lower-cases, so words are remembered
        in (ASCII) lower case, unless the text may have a special token, which is found
        before that."""
        raw = text.encode()
        return (raw if b"<|" in raw else raw.lower()).replace(b"\n", b" ").split(b" ")
