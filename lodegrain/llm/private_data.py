"""Personal data: patterns propose spans, checksums confirm them, nearby words move their score.

Every kind has a recogniser: a linear search that proposes spans, a validator that gives a span its score (or refuses it:
Luhn for cards, mod 97 for account numbers, area rules for social security numbers) and context words. A context word
within `window` characters raises the score, a word that speaks against the kind lowers it. The four base kinds (email, ip,
card, phone) stay whatever their score; the other kinds stay from `threshold` on, and only where they touch no base span
and no better one. One pass without a shuffle: a text's spans depend on that text alone.

The searches are linear in the text: a run of characters is looked at a bounded number of times, however long it is.

Defined cases: a null text is empty; empty texts have no spans; texts of any length are searched whole; offsets are code
points; a null doc_id and repeated rows are rows like any other; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, saved, shipped, small_batches, text_or_empty

BASE = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits fails or matches alike from each of its digits, so only its first is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?+[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,5}\) ?|0)[0-9][0-9 ()/-]{4,16}[0-9](?![\w-])")

Span = tuple[int, int]


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = "0246813579"
    return sum(int(c) if i % 2 == 0 else int(doubled[int(c)]) for i, c in enumerate(reversed(digits))) % 10 == 0


def mod97(account: str) -> bool:
    """An account number whose first four characters, moved to its end and with letters as 10 to 35, leave 1 modulo 97."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    """From each @, the run of local characters before it and the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (found := _DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def matches(pattern: re.Pattern) -> Callable[[str], Iterator[Span]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


def small_parts(s: str) -> float | None:
    parts = [p.lstrip("0") for p in s.split(".")]
    return 0.6 if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts) else None


def card_of(least: int, most: int, score: float) -> Callable[[str], float | None]:
    def check(s: str) -> float | None:
        digits = digits_of(s)
        return score if least <= len(digits) <= most and luhn(digits) else None

    return check


def digits_between(least: int, most: int, score: float) -> Callable[[str], float | None]:
    return lambda s: score if least <= len(digits_of(s)) <= most else None


def account(s: str) -> float | None:
    compact = s.replace(" ", "")
    return 0.95 if 15 <= len(compact) <= 34 and mod97(compact) else None


def social_security(s: str) -> float | None:
    return 0.5 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else None


@dataclass(frozen=True)
class Recogniser:
    kind: str
    propose: Callable[[str], Iterator[Span]]
    check: Callable[[str], float | None]
    for_it: str
    against: str = r"version|isbn|order no|serial"


RECOGNISERS = (
    Recogniser("email", emails, lambda s: 0.9, r"e-?mail|contact|write to"),
    Recogniser("ip", matches(_IP), small_parts, r"ip|address|host|server|login|client", "version|release|section"),
    Recogniser("card", matches(_DIGITS), card_of(16, 19, 0.8), r"card|visa|mastercard|credit|debit|payment|carte|karte|tarjeta"),
    Recogniser("phone", matches(_PHONE), digits_between(8, 15, 0.7), r"phone|tel|telephone|call|mobile|fax|whatsapp|sms|handy|teléfono|téléphone"),
    Recogniser("iban", matches(_IBAN), account, r"iban|account|bank|konto|compte|cuenta"),
    Recogniser("ssn", matches(_SSN), social_security, r"ssn|social security|tax id|taxpayer"),
    Recogniser("card_short", matches(_DIGITS), card_of(13, 15, 0.4), r"card|visa|amex|credit|debit|payment|carte|karte|tarjeta"),
    Recogniser("phone_local", matches(_LOCAL_PHONE), digits_between(7, 15, 0.4), r"phone|tel|telephone|call|mobile|fax|whatsapp|sms|handy|teléfono|téléphone"),
)

Found = tuple[str, int, int, float, bool]


class Searcher:
    def __init__(self, window: int, threshold: float, raise_by: float, lower_by: float) -> None:
        self.window, self.threshold, self.raise_by, self.lower_by = window, threshold, raise_by, lower_by
        word = lambda words: re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.IGNORECASE)
        self.words = {r.kind: (word(r.for_it), word(r.against)) for r in RECOGNISERS}

    def scored(self, text: str, r: Recogniser, start: int, end: int, score: float) -> float:
        near = f"{text[max(0, start - self.window) : start]} {text[end : end + self.window]}"
        speaks_for, against = self.words[r.kind]
        score += self.raise_by * bool(speaks_for.search(near)) - self.lower_by * bool(against.search(near))
        return round(min(1.0, max(0.0, score)), 2)

    def spans(self, text: str) -> list[Found]:
        """(kind, start, end, score, base) in the order of the recognisers, then start."""
        base, more = [], []
        for r in RECOGNISERS:
            own = r.kind in BASE
            for start, end in r.propose(text):
                if (score := r.check(text[start:end])) is not None:
                    score = self.scored(text, r, start, end, score)
                    if own or score >= self.threshold:
                        (base if own else more).append((r.kind, start, end, score, own))
        if not more:
            return base
        order = {r.kind: i for i, r in enumerate(RECOGNISERS)}
        return base + sorted(self.apart(base, more), key=lambda s: (order[s[0]], s[1]))

    @staticmethod
    def apart(base: list[Found], more: list[Found]) -> list[Found]:
        """Of the further spans those that touch no base span and no better one: higher score, then longer, then earlier.
        A sweep along the text joins what touches; a joined stretch holds the spans of one place, not of the text."""
        events = sorted([*base, *more], key=lambda s: (s[1], s[2]))
        kept, stretch, reach = [], [], -1

        def settle() -> None:
            taken = [s for s in stretch if s[4]]
            for s in sorted((s for s in stretch if not s[4]), key=lambda s: (-s[3], s[1] - s[2], s[1])):
                if all(s[2] <= t[1] or t[2] <= s[1] for t in taken):
                    taken.append(s)
                    kept.append(s)

        for s in events:
            if s[1] >= reach:
                settle()
                stretch = []
            stretch.append(s)
            reach = max(reach, s[2])
        settle()
        return kept


def personal_data(docs: DataFrame, text: str = "text", window: int = 40, threshold: float = 0.6, raise_by: float = 0.3,
                  lower_by: float = 0.3, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id and spans, an array of (kind, start, end, score, base); with_text adds `masked`, the
    text with every span as [KIND]."""
    shipped(docs.sparkSession)
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def masked(text: str, spans: list[Found]) -> str:
        out, at = [], 0
        for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], s[2])):
            if start >= at:
                out += [text[at:start], f"[{kind.upper()}]"]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(window, threshold, raise_by, lower_by)
        names = ("kind", "start", "end", "score", "base")
        for batch in small_batches(batches, "text"):
            texts = batch["text"].to_pylist()
            found = [searcher.spans(t) for t in texts]
            columns = [batch["doc_id"], pa.array([[dict(zip(names, s)) for s in spans] for spans in found], pa.list_(item))]
            if with_text:
                columns.append(pa.array(map(masked, texts, found), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "masked"][: len(columns)])

    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double, base: boolean>>" + ", masked string" * with_text
    with arrow_batches(docs.sparkSession):
        return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(search, schema), "spans")


def joined(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_data_summary(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans, from personal_data()."""
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
