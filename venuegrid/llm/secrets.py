"""Secret scans: fixed patterns, and literals that are assigned to sensitive names."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

#: (kind, start, end), in code points, end exclusive.
Span = tuple[str, int, int]

#: Order of kinds among spans with one start.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Parts of names that point to a secret, with their weight, and parts that
#: speak against one.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 0.9, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "cred": 0.7, "creds": 0.8, "auth": 0.6, "bearer": 0.7, "private": 0.5, "key": 0.5, "access": 0.4,
    "api": 0.4, "client": 0.2, "signing": 0.5, "encryption": 0.5, "session": 0.3, "cookie": 0.4, "dsn": 0.6, "connection": 0.3, "salt": 0.6, "webhook": 0.5,
}
HARMLESS = {
    "name": 0.6, "file": 0.6, "path": 0.6, "url": 0.4, "uri": 0.4, "id": 0.3, "length": 0.9, "size": 0.8, "count": 0.9, "type": 0.7, "field": 0.7,
    "label": 0.8, "hint": 0.8, "prompt": 0.8, "message": 0.7, "public": 0.8, "primary": 0.7, "foreign": 0.7, "expiry": 0.8, "ttl": 0.9, "regex": 0.7, "pattern": 0.6,
}
#: Literals that stand for a secret but are none.
PLACEHOLDERS = {"changeme", "change_me", "password", "secret", "example", "placeholder", "undefined", "none", "null", "true", "false", "your_password", "redacted", "default"}

#: Name and literal together have to reach this.
THRESHOLD = 1.3

_NAME_TAIL = re.compile(r"""[\w.$-]""")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_OPERATOR = re.compile(r"=>|:=|(?<![=!<>])=(?!=)|:(?![:/])")
_BLANK = re.compile(r"[ \t]*")
_TERM = re.compile(
    r""""((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|([A-Za-z_$][\w.$]*)(?=[ \t]*(?:[+;,)}\]\n#]|$))|([^\s"'`,;(){}\[\]]+)"""
)
_JOIN = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*(?=[\"'`A-Za-z_$@])")

#: What may stand before a quote, and strings that end at a mark of their own: raw ones
#: with # marks or with a delimiter and brackets, and triple-quoted ones.
_PREFIX = re.compile(r"(?:u8R?|[bBrRfFuUtTlLnNeEcC]{1,2}|[@$]{1,2})?(?=[\"'`])")
_HASHED = re.compile(r'(?:[bc]?r)?(#+)"')
_BRACKETED = re.compile(r'(?:u8|[uUL])?R"([^()\s\\"]{0,16})\(')
_TRIPLE = re.compile(r"\"\"\"|'''")
_VERBATIM = re.compile(r'@\$?"|\$@"')

# A type note: words with their generics or array marks, joined by | or &.
_INNER = r"[^\[\]<>(){}\n=]"
_GENERIC = _INNER
for _ in range(3):
    _GENERIC = rf"(?:[\[<(](?:{_INNER}|{_GENERIC})*[\]>)])"
_UNIT = (
    r"(?:[&*]+[ \t]*|'\w+[ \t]+|(?:mut|const|dyn|impl|readonly|unsigned|signed|volatile|static)[ \t]+)*"
    rf"(?:[A-Za-z_$][\w$]*(?:(?:\.|::)[A-Za-z_]\w*){{0,15}}{_GENERIC}{{0,7}}|{_GENERIC}{{1,7}})[?!*]{{0,3}}"
)
_TYPED = re.compile(rf"""[ \t]*(?:{_UNIT}(?:[ \t]*[|&][ \t]*{_UNIT}){{0,15}}|"[\w.\[\], |]+"|'[\w.\[\], |]+')[ \t]*(?==(?![=>]))""")
#: Blanks before a value; a value in quotes may also stand in parentheses or on the next line.
_OPENING = re.compile(r"[ \t]*(?:\\?\r?\n[ \t]*)?(?:\([ \t]*(?:\r?\n[ \t]*)?)?(?=[\"'`])|[ \t]*")
#: Calls that set a name to a value, and a name and its value as two attributes.
_CALL = re.compile(r"""\b(?:define|setenv|putenv|setProperty|set)[ \t]*\([ \t]*["']([\w.-]+)["'][ \t]*,""")
_PAIR = re.compile(r"""\b(?:key|name)[ \t]*=[ \t]*["']([\w.-]+)["'][ \t]+value[ \t]*=""")
_NAME_TERM = re.compile(r"[A-Za-z_$][\w.$]*(?=[ \t]*(?:[+;,)}\]\n#]|$))")
_DECLARED = re.compile(r"\b(?:var|const)[ \t]+([A-Za-z_]\w*)[ \t]+(?:\[\w*\]|\*)*[A-Za-z_][\w.]*[ \t]*$")


def name_score(name: str) -> float:
    """How much a target's name speaks for a secret: its last parts count in full."""
    parts = [p.lower() for p in _PART.findall(name)]
    weight = sum(SENSITIVE.get(p, 0.0) - HARMLESS.get(p, 0.0) for p in parts)
    joined = "".join(parts)
    return max(weight, 1.0 if joined.endswith(("apikey", "accesskey", "privatekey", "clientsecret")) else 0.0)


def literal_score(value: str, quoted: bool) -> float:
    """How much a literal looks like a secret: length, variety, kinds of characters."""
    return _score(value[:24], Counter(value), len(value), quoted)


def _score(head: str, counts: Counter[str], size: int, quoted: bool) -> float:
    """``literal_score`` from a literal's first characters and how often it has each."""
    if size < 6 or size < 24 and head.lower() in PLACEHOLDERS or re.match(r"\$\{|\{\{|<|%\(|\*{3}|x{4}", head, re.IGNORECASE):
        return 0.0
    present = "".join(counts)
    if not quoted and (size < 8 or not re.search(r"\d", present)):
        return 0.0
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    kinds = sum(bool(re.search(p, present)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^\w\s]"))
    blank = 0.6 if re.search(r"\s", present) else 0.0
    return min(entropy / 4, 1.0) * 0.6 + 0.15 * kinds - blank


class _Scores:
    """Scores of a text's literals, each computed once. Of literals that end at one place and
    start one after the other, as in a run of bare assignments, the characters are
    counted once: those between two starts leave the count."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.known: dict[tuple[int, int, bool], float] = {}
        self.start, self.end, self.counts = 0, -1, Counter()

    def __call__(self, start: int, end: int, quoted: bool) -> float:
        key = start, end, quoted
        if key not in self.known:
            if end != self.end or start < self.start:
                self.start, self.end, self.counts = start, end, Counter(self.text[start:end])
            elif start > self.start:
                self.counts -= Counter(self.text[self.start : start])
                self.start = start
            self.known[key] = _score(self.text[start : min(end, start + 24)], self.counts, end - start, quoted)
        return self.known[key]


def _name_before(text: str, at: int) -> str | None:
    """The name that ends before ``at``, which is an operator's place: an identifier, a
    quoted key or an index in brackets; blanks, and ? or ! before a type note, may stand
    between."""
    end = at
    while end and text[end - 1] in " \t":
        end -= 1
    if end and text[end - 1] in "?!" and text[at] == ":":
        end -= 1
    while end and text[end - 1] in "\"'`])":
        end -= 1
    start = end
    while start and _NAME_TAIL.match(text[start - 1]):
        start -= 1
    name = text[start:end]
    return name if re.search(r"[^\W\d]", name) else None


#: A term: ``literal`` or ``name``, start, end, whether it is quoted.
Term = tuple[str, int, int, bool]


def _closed(text: str, mark: str, at: int, escapes: bool, missing: set[str]) -> int:
    """Where ``mark`` next stands without an escape, -1 if nowhere; what is ``missing``
    once is not sought again."""
    while mark not in missing:
        end = text.find(mark, at)
        if end < 0:
            missing.add(mark)
            break
        if not escapes or (end - len(text[at:end].rstrip("\\")) - at) % 2 == 0:
            return end
        at = end + 1
    return -1


def _string(text: str, at: int, missing: set[str]) -> tuple[Term, int] | None:
    """The string with its own end mark that starts at ``at``, and where it ends."""
    if found := _HASHED.match(text, at):
        mark, escapes = '"' + found[1], False
    elif found := _BRACKETED.match(text, at):
        mark, escapes = f"){found[1]}\"", False
    elif found := _VERBATIM.match(text, at):
        end = found.end()
        while (end := _closed(text, '"', end, False, missing)) >= 0 and text.startswith('""', end):
            end += 2
        return (("literal", found.end(), end, True), end + 1) if end >= 0 else None
    elif found := _TRIPLE.match(text, at := _PREFIX.match(text, at).end() if _PREFIX.match(text, at) else at):
        mark, escapes = found[0], True
    else:
        return None
    end = _closed(text, mark, found.end(), escapes, missing)
    if end < 0:
        return None
    value = text[found.end() : end]
    start = found.end() + len(value) - len(value.lstrip())
    return ("literal", start, max(start, found.end() + len(value.rstrip())), True), end + len(mark)


def _terms(text: str, at: int, missing: set[str], bare: list[int]) -> tuple[list[Term], int]:
    """The terms of the value that starts at ``at``, and where it ends. ``bare`` is the place
    of the last bare literal: a value inside it ends where it does, and is not read again.
    """
    here, terms = _OPENING.match(text, at).end(), []
    while True:
        if bare[0] < here < bare[1]:
            found = _NAME_TERM.match(text, here)
            terms.append(("name", *found.span(), False) if found else ("literal", here, bare[1], False))
            here = terms[-1][2]
        elif own := _string(text, here, missing):
            terms.append(own[0])
            here = own[1]
        else:
            prefix = _PREFIX.match(text, here)
            term = _TERM.match(text, prefix.end() if prefix else here) or _TERM.match(text, here)
            if not term:
                break
            group = term.lastindex
            terms.append(("name" if group == 4 else "literal", *term.span(group), group < 4))
            here = term.end()
            if group == 5:
                bare[:] = term.span(group)
        more = _JOIN.match(text, here)
        if not more:
            break
        here = more.end()
    return terms, here


def assignments(text: str) -> Iterator[tuple[str, list[Term]]]:
    """Name and terms of every assignment. Terms are joined by ``+`` or ``..``. An
    assignment's value is read once: operators inside it start no assignment.

    Calls such as ``define("NAME", value)`` and attributes ``key="NAME" value=...`` come first.
    ``name : type = value`` assigns to the name, and to what stands right before ``=`` as
    well, as that is the target in ``if name: target = value``. With a bare value the
    type may itself be the value (``name: a=b``), so that reading is told, too.
    """
    at, missing, bare, before = 0, set(), [0, 0], 0
    for pattern in (_CALL, _PAIR):
        for call in pattern.finditer(text):
            terms, _ = _terms(text, call.end(), missing, [0, 0])
            if terms:
                yield call[1], terms
    while found := _OPERATOR.search(text, at):
        last, before = before, found.end()
        at = found.end()
        name = _name_before(text, found.start())
        if found[0] == ":" and name is not None and (note := _TYPED.match(text, at)):
            terms, here = _terms(text, note.end() + 1, missing, bare)
            if terms and terms[0][3]:
                at = here
                yield name, terms
                target = _name_before(text, note.end())
                if target is not None:
                    yield target, terms
                continue
            plain, _ = _terms(text, at, missing, bare)
            if plain:
                yield name, plain
            if terms:
                yield name, terms
            continue
        # A declaration has no operator, so it starts after the last one.
        declared = _DECLARED.search(text, last, found.start()) if found[0] == "=" else None
        if name is None and declared is None:
            continue
        terms, here = _terms(text, at, missing, bare)
        if terms:
            # A quoted literal is passed over; a bare one may hold a further assignment.
            at = max(at, here) if terms[0][3] or terms[0][0] == "name" else at
            if name is not None:
                yield name, terms
            if declared is not None:
                yield declared[1], terms


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, straight or through other names; of one that
    is joined from several, all parts.

    Assignments are followed in order: a name holds the literals of its last assignment,
    so a literal is scored by every name that it flows to.
    """
    if not _OPERATOR.search(text) and not _CALL.search(text):
        return []
    holds: dict[str, list[tuple[int, int, bool]]] = {}
    found: set[tuple[int, int]] = set()
    score = _Scores(text)
    for name, terms in assignments(text):
        values: list[tuple[int, int, bool]] = []
        for kind, start, end, quoted in terms:
            if kind == "literal":
                values.append((start, end, quoted))
            else:
                values.extend(holds.get(text[start:end]) or ([(start, end, False)] if len(terms) == 1 else []))
        values = list(dict.fromkeys(values))
        holds[name] = values
        weight = name_score(name)
        if weight < 0.5:
            continue
        parts = [v[:2] for v in values if v[2]]
        if len(parts) > 1 and (s := literal_score("".join(text[a:b] for a, b in parts), True)) > 0 and weight + s >= threshold:
            # A secret in parts: what they make together counts, and all of them are it.
            found.update(p for p in parts if p[0] < p[1])
        found.update(v[:2] for v in values if v[1] - v[0] >= 6 and (s := score(*v)) > 0 and weight + s >= threshold)
    return sorted(found)


def base_spans(text: str) -> list[Span]:
    spans = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return _ordered(spans)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def all_spans(text: str, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with the literals that no base span covers."""
    base = base_spans(text)
    starts = [s for _, s, _ in base]
    ends = list(accumulate((e for *_, e in base), max))
    more = []
    for a, b in literal_spans(text, threshold):
        before = bisect_right(starts, a)
        if not before or ends[before - 1] < b:
            more.append(("literal", a, b))
    return base, _ordered(base + more)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if start >= at:
            out.append(text[at:start] + "[SECRET]")
        at = max(at, end)
    return "".join(out) + text[at:]


_FIELDS = "n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, redact: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of every document.

    With ``redact`` all columns of ``docs`` come back instead, ``text`` without its
    secrets and ``n_chars``, if there is one, counted anew where the text changed.

    Works row by row without a shuffle. Null and empty texts have no spans (a null text
    stays null); repeated rows count each; an empty table gives no rows; extra columns
    are ignored or, with ``redact``, kept.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = all_spans(text or "", threshold)
                n = Counter(s[0] for s in spans)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = [pa.array(c, pa.int64() if k < 4 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f.split()[0] for f in _FIELDS.split(", "))])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            new = [t and redacted(t, all_spans(t, threshold)[1]) for t in texts]
            at = batch.schema.get_field_index("text")
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if "n_chars" in batch.schema.names:
                at = batch.schema.get_field_index("n_chars")
                sizes = [len(b) if a != b else n for a, b, n in zip(texts, new, batch.column(at).to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    if redact:
        return docs.mapInArrow(lean(clean), docs.schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(counts), "doc_id long, " + _FIELDS)
