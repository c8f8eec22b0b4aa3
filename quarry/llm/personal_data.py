"""Personal data in texts: patterns propose, checksums confirm, context words adjust.

Every kind has a pattern that proposes spans, a check that confirms them (Luhn
for cards, mod-97 for IBANs, ranges for addresses and numbers) and a score that
words nearby raise or lower. The base kinds (email, ip, card, phone) keep every
confirmed span whatever its score. Further kinds are taken from ``THRESHOLD``
on and never overlap a base span or a better one: IBANs, IPv6 addresses, cards
written one after another (whose digits together are no card number), social
security numbers and telephone numbers without a country code, the last two
only where a word nearby says what they are.

Scale: a text is read on its own, in one pass without a shuffle. Every pattern
is linear in the length of a text: runs are taken possessively, or a look
behind keeps a run from being tried again from its middle.

Cases: a null or empty text has no spans; very long texts are read whole; equal
spans at other places each count; rows that repeat count each; a null doc_id
stays null; other columns, whatever their names, are not read; a table without
rows gives none. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, blocks
from quarry.session import table

#: Kinds other than the base ones are taken from this score on.
THRESHOLD = 0.6
#: Code points before and behind a span in which words are looked for.
BEFORE, BEHIND = 48, 24

BASE = ("email", "ip", "card", "phone")

# Length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "XK": 20,
}

# A run of local characters is taken whole, with or without a domain behind it, so no run is read twice.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]){11,27}")
IPV6 = re.compile(r"(?<![A-Za-z0-9:.])[0-9A-Fa-f:]{6,39}(?![A-Za-z0-9:.])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])")
DIGITS = re.compile(r"[0-9]+")
DIGIT = re.compile(r"[^0-9]")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    """Whether the weighted sum of the digits ends in 0."""
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether letters and digits, the first four moved behind, leave 1 when divided by 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[Span]:
    return (m.span() for m in EMAIL.finditer(text) if m[1]) if "@" in text else iter(())


def ips(text: str) -> Iterator[Span]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    return (m.span() for m in PHONE.finditer(text) if 9 <= len(DIGIT.sub("", m[0])) <= 15) if "+" in text else iter(())


def ibans(text: str) -> Iterator[Span]:
    for m in IBAN.finditer(text):
        length, at, n = IBAN_LENGTH.get(m[1]), m.start(), 0
        while length and at < m.end() and n < length:
            n += text[at] != " "
            at += 1
        if length and n == length and not text[at : at + 1].isalnum() and mod97(text[m.start() : at].replace(" ", "")):
            yield m.start(), at


def ipv6s(text: str) -> Iterator[Span]:
    for m in IPV6.finditer(text):
        if m[0].count(":") >= 2 and sum(map(bool, m[0].split(":"))) >= 3:
            try:
                ipaddress.IPv6Address(m[0])
            except ValueError:
                continue
            yield m.span()


def split_cards(text: str) -> Iterator[Span]:
    """Card numbers in a run of digits that is too long for one: its unbroken groups that pass."""
    for m in CARD.finditer(text):
        if m.end() - m.start() > 24:
            for group in DIGITS.finditer(text, m.start(), m.end()):
                if 13 <= group.end() - group.start() <= 19 and luhn(group[0]):
                    yield group.span()


def ssns(text: str) -> Iterator[Span]:
    return (m.span() for m in SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000")


def local_phones(text: str) -> Iterator[Span]:
    return (m.span() for m in LOCAL_PHONE.finditer(text) if 7 <= len(DIGIT.sub("", m[0])) <= 12)


def _words(names: str) -> re.Pattern:
    return re.compile(rf"(?<!\w)(?:{'|'.join(names.split())})(?!\w)", re.I)


class Kind(NamedTuple):
    """What proposes and confirms spans, the score that stands for, and the words nearby that raise or lower it by 0.3."""

    name: str
    spans: Callable[[str], Iterator[Span]]
    score: float
    raising: re.Pattern
    lowering: re.Pattern


_TELEPHONE = _words("call phone telephone tel fax mobile cell sms whatsapp telefon handy anruf téléphone portable appelez teléfono móvil llame")
_NUMBERED = _words("order invoice isbn issn version serial part item sku ticket build release article nr no")
_ADDRESS = _words("ip ipv4 ipv6 host server address client login gateway adresse dirección")
_PAYMENT = _words("card credit debit visa mastercard amex payment pay karte kreditkarte carte tarjeta cvv expires")

KINDS = (
    Kind("email", emails, 0.8, _words("mail email e-mail contact write reply courriel correo kontakt"), _words("example noreply no-reply")),
    Kind("ip", ips, 0.6, _ADDRESS, _words("version release section chapter build")),
    Kind("card", cards, 0.7, _PAYMENT, _NUMBERED),
    Kind("phone", phones, 0.7, _TELEPHONE, _NUMBERED),
    Kind("iban", ibans, 0.9, _words("iban account bank konto compte cuenta bic swift"), _NUMBERED),
    Kind("ipv6", ipv6s, 0.7, _ADDRESS, _NUMBERED),
    Kind("split_card", split_cards, 0.7, _PAYMENT, _NUMBERED),
    Kind("ssn", ssns, 0.4, _words("ssn social security taxpayer tin"), _NUMBERED),
    Kind("local_phone", local_phones, 0.4, _TELEPHONE, _NUMBERED),
)


class Found(NamedTuple):
    start: int
    rank: int
    end: int
    score: float


def spans_of(text: str | None, threshold: float = THRESHOLD) -> list[Found]:
    """All spans of a text by start, then kind (``rank`` in KINDS)."""
    taken: list[Found] = []
    other: list[Found] = []
    for rank, kind in enumerate(KINDS):
        for start, end in kind.spans(text or ""):
            near = text[max(0, start - BEFORE) : start], text[end : end + BEHIND]
            score = kind.score + 0.3 * any(map(kind.raising.search, near)) - 0.3 * any(map(kind.lowering.search, near))
            found = Found(start, rank, end, round(min(max(score, 0.0), 1.0), 2))
            if rank < len(BASE):
                taken.append(found)
            elif found.score >= threshold:
                other.append(found)
    if other:
        taken = _apart(taken, other)
    return sorted(taken)


def _apart(base: list[Found], other: list[Found]) -> list[Found]:
    """Base spans, and the others that overlap none of them nor a better one (equal scores: the longer, then the first)."""
    import bisect

    free: list[Found] = []
    ends = sorted((f.start, f.end) for f in base)
    reach = [0]
    for _, end in ends:
        reach.append(max(reach[-1], end))
    for f in other:  # base spans of several kinds may overlap: reach is the last end so far
        if reach[bisect.bisect_left(ends, (f.end,))] <= f.start:
            free.append(f)
    chosen: list[Found] = []
    starts: list[int] = []
    for f in sorted(free, key=lambda f: (-f.score, f.start - f.end, f.start, f.rank)):
        at = bisect.bisect_left(starts, f.start)
        if (at and chosen[at - 1].end > f.start) or (at < len(starts) and starts[at] < f.end):
            continue
        starts.insert(at, f.start)
        chosen.insert(at, f)
    return base + chosen


SPANS = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text and ``spans``: kind, start, end, score and whether it is of a base kind, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [[(KINDS[f.rank].name, f.start, f.end, f.score, f.rank < len(BASE)) for f in spans_of(t, threshold)] for t in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in of] for of in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN)], names=["doc_id", "text", "spans"])

    rows = docs.select("doc_id", "text")
    return arrow_map(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, spans {SPANS}")


def masked(found: DataFrame) -> DataFrame:
    """doc_id and ``text`` with every span replaced by its kind in brackets; where spans overlap, the first stands for both."""
    kept = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda held, s: F.when(s["start"] < held["at"], F.struct(held["text"].alias("text"), F.greatest(held["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(held["text"], F.substring("text", held["at"] + 1, s["start"] - held["at"]), F.lit("["), s["kind"], F.lit("]")).alias("text"), s["end"].alias("at"))
        ),
    )
    return found.select("doc_id", "text", kept.alias("kept")).select("doc_id", F.concat("kept.text", F.substring("text", F.col("kept.at") + 1, F.length("text"))).alias("text"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(_listed(F.filter("spans", lambda s: s["base"])), 256)
    return found.select("doc_id", *map(count, BASE), base.alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
