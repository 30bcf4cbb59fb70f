"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a text: at-signs, plus-digit starts, digits, schemes and the cue words of
accounts and secrets. From each anchor a deterministic parser expands to the borders of the candidate and validates
it. The base kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their patterns, each checked
once; the kinds `account`, `secret` and `login` are added by cue and never replace a base span.

Offsets count code points, the end exclusive. Defined results: a null or empty text has no spans; spans of different
kinds may overlap; repeated rows are each searched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from farewise.llm.common import bounded_batches, released, whole

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "secret", "login")
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
VALUE = ALNUM | frozenset("_-+/.")
# Cue words, each as the start of a word in lower, upper and title case.
ACCOUNT_CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "access_key")
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "sk-")
KEY_LENGTH = 20
Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def anchors() -> ahocorasick.Automaton:
    """Anchor -> (kind of parser, length). Digits are anchors of ip and card."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("@", 1))
    found.add_word("://", ("login", 3))
    for d in DIGITS:
        found.add_word(d, ("digit", 1))
        found.add_word("+" + d, ("phone", 2))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            for word in {cue, cue.upper(), cue.title()}:
                found.add_word(word, (kind, len(word)))
    for start in KEY_STARTS:
        found.add_word(start, ("key", len(start)))
    found.make_automaton()
    return found


def run_of(text: str, at: int, allowed: frozenset) -> int:
    """End of the run of allowed characters that begins at `at`."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def iban_valid(code: str) -> bool:
    """ISO 13616 check: the number with its head moved behind leaves 1 modulo 97."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Finder:
    """Parsers over one text; each remembers where its kind's last match ended."""

    def __init__(self, text: str):
        self.text, self.spans = text, []
        self.email_end = self.ip_end = self.card_end = self.phone_end = self.cue_end = 0

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((kind, start, end))

    def email(self, at: int) -> None:
        text, start = self.text, at
        while start > self.email_end and text[start - 1] in LOCAL:
            start -= 1
        end = run_of(text, at + 1, LABEL)
        if start == at or end == at + 1:
            return
        labels = 0
        while end < len(text) and text[end] == ".":
            further = run_of(text, end + 1, LABEL)
            if further == end + 1:
                break
            end, labels = further, labels + 1
        if labels:
            self.email_end = end
            self.add("email", start, end)

    def ip(self, at: int) -> None:
        """A digit anchors a chain of dotted numbers; its matches are consecutive groups of four."""
        if at < self.ip_end:
            return
        text, runs, end = self.text, [], at
        while True:
            stop = run_of(text, end, DIGITS)
            runs.append((end, stop))
            end = stop
            if stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in DIGITS:
                end = stop + 1
                continue
            break
        self.ip_end = runs[-1][1]
        for i in range(0, len(runs) - 3, 4):
            four = runs[i : i + 4]
            if all(len(v := text[a:b].lstrip("0")) < 4 and int(v or 0) <= 255 for a, b in four):
                self.add("ip", four[0][0], four[3][1])

    def card(self, at: int) -> None:
        """The longest chain of digits with single blanks or hyphens between them."""
        if at < self.card_end:
            return
        text, end, n = self.text, at + 1, len(self.text)
        while end < n:
            if text[end] in DIGITS:
                end += 1
            elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
                end += 2
            else:
                break
        self.card_end = end
        if end - at >= 16:
            digits = text[at:end].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                self.add("card", at, end)

    def phone(self, plus: int) -> None:
        if plus < self.phone_end:
            return
        text = self.text
        end = run_of(text, plus + 2, PHONE)
        while end > plus + 3 and text[end - 1] not in DIGITS:
            end -= 1
        if end <= plus + 3:
            return
        self.phone_end = end
        if 8 <= sum(c in DIGITS for c in text[plus:end]) <= 15:
            self.add("phone", plus, end)

    def cued(self, kind: str, at: int, end: int) -> None:
        """A value after a cue word: separators, then an identifier that holds digits."""
        text = self.text
        if at < self.cue_end or (at and text[at - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
            return
        start = end
        while start < len(text) and text[start] in " :=#\"'":
            start += 1
        if start == end:
            return
        stop = run_of(text, start, VALUE)
        while stop > start and text[stop - 1] in ".-_/+":
            stop -= 1
        value = text[start:stop]
        digits = sum(c in DIGITS for c in value)
        if kind == "account":
            iban = len(value) >= 15 and value[:2].isalpha() and value[2:4].isdigit() and value.isalnum()
            good = iban_valid(value) if iban and value.isascii() else digits >= 6 and 2 * digits >= len(value)
        else:
            good = len(value) >= 8 and digits >= 2
        if good:
            self.cue_end = stop
            self.add(kind, start, stop)

    def key(self, at: int, end: int) -> None:
        """A key of a known form: its start, then letters and digits up to its length."""
        text = self.text
        stop = run_of(text, end, ALNUM)
        if stop - at >= KEY_LENGTH and not (at and text[at - 1] in ALNUM) and any(c in DIGITS for c in text[at:stop]):
            self.add("secret", at, stop)

    def login(self, at: int, end: int) -> None:
        """User and password before the at-sign of an address with a scheme."""
        text, stop = self.text, end
        while stop < len(text) and text[stop] not in "/?#@" and not text[stop].isspace():
            stop += 1
        if stop < len(text) and text[stop] == "@" and ":" in text[end:stop] and stop > end:
            self.add("login", end, stop)


def find(text: str) -> list[Span]:
    """All spans of a text, by kind and then start."""
    if not text:
        return []
    finder = Finder(text)
    for last, (kind, length) in anchors().iter(text):
        at = last - length + 1
        if kind == "digit":
            finder.ip(at)
            finder.card(at)
        elif kind == "@":
            finder.email(at)
        elif kind == "phone":
            finder.phone(at)
        elif kind == "login":
            finder.login(at, last + 1)
        elif kind == "key":
            finder.key(at, last + 1)
        else:
            finder.cued(kind, at, last + 1)
    return sorted(finder.spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named after the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, the number of spans of each base kind, base_sha256 and spans."""
    bounded_batches(docs.sparkSession)
    schema = "doc_id bigint, " + "".join(f"n_{k} bigint, " for k in BASE_KINDS) + "base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t) for t in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[0] in BASE_KINDS] for spans in found]
            counts = [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in BASE_KINDS]
            sums = [hashlib.sha256(shown(spans).encode()).hexdigest() for spans in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(sums, pa.string()), pa.array([shown(s) for s in found], pa.string())],
                names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"],
            )

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    return rows.mapInArrow(released(run), schema)


def redact_pii(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`docs` with spans replaced in the text (null stays null); `length`, where present, follows the new text."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text)
    if not isinstance(docs.schema[text].dataType, T.StringType):
        raise ValueError(f"{text} is no text column")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [t and redact(t, find(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(released(run), docs.schema)
    if length and length in docs.columns:
        out = out.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return out.select(*docs.columns)
