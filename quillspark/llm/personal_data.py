"""Personal data in texts: regular expressions propose spans, checks confirm them, words nearby adjust their score.

Two layers. The plain layer takes e-mail addresses, IPv4 addresses, card and international phone numbers as their
patterns find them, leftmost and without overlap, and drops matches that their check refuses (parts up to 255, Luhn,
number of digits). The scored layer adds what the plain one can't reach: card and phone numbers that ran into other
digits, IBANs confirmed by mod-97, IPv6 addresses, social security numbers, national phone numbers and spelled-out
e-mail addresses. A candidate starts from the score of its form and check; words within CONTEXT characters raise or lower
it, and it counts from a threshold on. Plain spans always stay, their score is told all the same.

Every pattern runs in time linear in the text: a run that can't match is passed over once, so lines of any length do.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 40
KINDS = ("email", "ip", "card", "phone", "iban", "ip6", "ssn")
SCHEMA = "array<struct<kind:string,start:int,end:int,score:double,plain:boolean>>"
ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("plain", pa.bool_())]))

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TELLING = re.compile("[0-9@]|[([{] ?(?i:at) ?[)\\]}]")
GROUP = re.compile("[0-9]+")
# Spelled out: name [at] host [dot] com.
SPELLED_AT = re.compile(r" ?[(\[{] ?(?:at|AT|@) ?[)\]}] ?(?=([A-Za-z0-9-]{1,63}(?:(?: ?[(\[{] ?(?:dot|DOT|\.) ?[)\]}] ?|\.)[A-Za-z0-9-]{1,63}){1,8}))")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}|:)(?::{1,2}[0-9A-Fa-f]{1,4}){1,7}(?![0-9A-Za-z:])")
SSN = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.(-])(?:1[ .-]?)?(?:(\([0-9]{2,5}\))[ .-]?|(0)|(?=[2-9]))[0-9]{2,4}(?:[ ./-]?[0-9]{2,4}){1,4}(?![0-9A-Za-z-])")

# Length of an IBAN by its country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24,
    "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# Card numbers by issuer: first digits and lengths.
ISSUERS = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|35[0-9]{14}|6(?:011|5|4[4-9])[0-9]{12,17}")

NEAR = {
    "email": r"e-?mails?|mail|contact|correo|courriel",
    "ip": r"ip|server|host|login|client|adresse?|address|servidor|serveur",
    "card": r"cards?|visa|mastercard|amex|credit|debit|cvv|payment|karte|kreditkarte|carte|tarjeta",
    "phone": r"phone|tel|telephone|mobile|cell|call|fax|whatsapp|sms|contact|telefon|handy|rufnummer|téléphone|portable|appelez|teléfono|móvil|llame",
    "iban": r"iban|account|bank|bic|swift|konto|compte|virement|cuenta",
    "ssn": r"ssn|social security|security number",
}
FAR = {
    "ip": r"version|release|build|section|chapter",
    "card": r"isbn|order|tracking|serial|invoice|part|ref",
    "phone": r"isbn|order|tracking|serial|invoice|part|ref|version|pages?",
    "ssn": r"isbn|order|tracking|serial|invoice|part|ref|model",
}
NEAR["ip6"], FAR["ip6"] = NEAR["ip"], FAR["ip"]
_near, _far = ({k: re.compile(rf"(?<!\w)(?:{words})(?!\w)", re.I) for k, words in table.items()} for table in (NEAR, FAR))


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    plain: bool


def luhn(digits: str) -> bool:
    """Whether the check digit at the end is right."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1 modulo 97, its first four characters moved behind and letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def digits_of(s: str) -> str:
    return "".join(GROUP.findall(s))


def in_context(text: str, kind: str, start: int, end: int, score: float) -> float:
    """score, raised by a word of the kind nearby and lowered by one that speaks against it; within 0 and 1."""
    around = text[max(0, start - CONTEXT) : start] + " \n " + text[end : end + CONTEXT // 2]
    if kind in _near and _near[kind].search(around):
        score += 0.3
    if kind in _far and _far[kind].search(around):
        score -= 0.3
    return round(min(1.0, max(0.0, score)), 4)


def _plain(line: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the plain layer in one line; none of its patterns matches a line end."""
    done = 0
    for m in AT_DOMAIN.finditer(line):
        at = m.start()
        held = line[max(done, line.rfind("@", done, at) + 1) : at]
        if name := len(held) - len(held.rstrip(LOCAL)):
            yield "email", at - name, m.end()
            done = m.end()
    for m in IP.finditer(line):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(line):
        if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(line):
        if 9 <= len(digits_of(m[0])) <= 15:
            yield "phone", m.start(), m.end()


def _cards_within(line: str) -> Iterator[tuple[int, int, float]]:
    """Card numbers inside longer chains of digits: whole groups that an issuer's rule and Luhn confirm."""
    for m in CARD.finditer(line):
        groups = list(GROUP.finditer(m[0])) if len(m[0]) >= 13 else []
        i = 0
        while i < len(groups):
            for j in range(min(len(groups), i + 5), i, -1):
                sizes = [len(g[0]) for g in groups[i:j]]
                alike = j - i == 1 or sizes in ([4, 6, 5], [4, 6, 4]) or (set(sizes[:-1]) == {4} and sizes[-1] <= 4)
                if alike and 13 <= sum(sizes) <= 19 and ISSUERS.fullmatch(d := "".join(g[0] for g in groups[i:j])) and luhn(d):
                    yield m.start() + groups[i].start(), m.start() + groups[j - 1].end(), 0.7
                    i = j
                    break
            else:
                i += 1


def _phones_within(line: str) -> Iterator[tuple[int, int, float]]:
    """International numbers that ran into other digits: the most groups that have 9 to 15 digits."""
    for m in PHONE.finditer(line):
        n, end = 0, 0
        for g in GROUP.finditer(m[0]):
            if n + len(g[0]) > 15:
                break
            n, end = n + len(g[0]), g.end()
        if 9 <= n and end < len(m[0]):
            yield m.start(), m.start() + end, 0.6


def _ibans(line: str) -> Iterator[tuple[int, int, float]]:
    for m in IBAN.finditer(line):
        at, left = m.end(), IBAN_LENGTH.get(m[0][:2], 0) - 4
        while left > 0 and at < len(line):
            at += line[at] in " -" and at + 1 < len(line)
            if not ("0" <= line[at] <= "9" or "A" <= line[at] <= "Z"):
                break
            at, left = at + 1, left - 1
        whole = re.sub("[ -]", "", line[m.start() : at])
        if left == 0 and not line[at : at + 1].isalnum() and mod97(whole):
            yield m.start(), at, 0.9


def _ip6s(line: str) -> Iterator[tuple[int, int, float]]:
    for m in IP6.finditer(line) if ":" in line else ():
        try:
            ipaddress.IPv6Address(m[0])
        except ValueError:
            continue
        if (n := len(re.findall("[0-9A-Fa-f]+", m[0]))) >= 2:
            yield m.start(), m.end(), 0.7 if n >= 4 else 0.4


def _spelled(line: str) -> Iterator[tuple[int, int, float]]:
    done = 0
    for m in SPELLED_AT.finditer(line):
        held = line[max(done, m.start() - 65) : m.start()]
        if 0 < (name := len(held) - len(held.rstrip(LOCAL))) <= 64 and re.search("[A-Za-z]{2,}$", m[1]):
            done = m.end() + len(m[1])
            yield m.start() - name, done, 0.6


def _nationals(line: str) -> Iterator[tuple[int, int, float]]:
    for m in NATIONAL.finditer(line):
        if 9 <= len(digits_of(m[0])) <= 12 and len(GROUP.findall(m[0])) >= 3:
            yield m.start(), m.end(), 0.5 if m[1] else 0.3


SCORED = (("card", _cards_within), ("phone", _phones_within), ("ip6", _ip6s), ("ssn", lambda x: ((m.start(), m.end(), 0.5) for m in SSN.finditer(x))), ("email", _spelled), ("phone", _nationals))


def _lines(text: str) -> Iterator[tuple[int, str]]:
    """(start, line) of the lines that have a digit or a sign of an address."""
    m = TELLING.search(text)
    while m:
        first = text.rfind("\n", 0, m.start()) + 1
        last = text.find("\n", m.start())
        last = len(text) if last < 0 else last
        yield first, text[first:last]
        m = TELLING.search(text, last)


def find(text: str | None, threshold: float = 0.5) -> list[Span]:
    """All spans of a text by kind as in KINDS, then start; none of a null text."""
    out: list[Span] = []
    for at, line in _lines(text or ""):
        here = [Span(kind, at + a, at + b, in_context(text, kind, at + a, at + b, 0.8), True) for kind, a, b in _plain(line)]
        for a, b, score in _ibans(line):
            here.append(Span("iban", at + a, at + b, in_context(text, "iban", at + a, at + b, score), False))
        taken = bytearray(len(line))
        for s in here:
            taken[s.start - at : s.end - at] = b"\1" * (s.end - s.start)
        for kind, propose in SCORED:
            for a, b, score in propose(line):
                if any(taken[a:b]) or (score := in_context(text, kind, at + a, at + b, score)) < threshold:
                    continue
                here.append(Span(kind, at + a, at + b, score, False))
                taken[a:b] = b"\1" * (b - a)
        out += here
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def spans_of(c: Column, threshold: float = 0.5) -> Column:
    """array<struct<kind, start, end, score, plain>> of a text column, in code points, end exclusive.

    Null and empty texts have an empty array; texts of any length are read whole. A row's spans depend on its text only.
    """

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[s._asdict() for s in find(t.as_py(), threshold)] for t in texts], ARROW)

    return F.arrow_udf(run, SCHEMA)(c.cast("string"))


def redacted_text(text: str, spans: list[dict]) -> str:
    """text with each span as <KIND>; overlapping spans are one, named after the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(c: Column, spans: Column) -> Column:
    """The text with its spans replaced by their kinds; null stays null, a text without spans stays as it is."""

    def run(texts: pa.Array, found: pa.Array) -> pa.Array:
        return pa.array([None if t is None else redacted_text(t, s or []) for t, s in zip(texts.to_pylist(), found.to_pylist(), strict=True)], pa.string())

    return F.arrow_udf(run, "string")(c.cast("string"), spans)


def redact(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs, all columns and rows as they are but the text redacted. Other columns may have any name."""
    text = F.col(f"`{text_col}`")
    return docs.withColumn(text_col, redacted(text, spans_of(text, threshold)))


def written_out(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def document_spans(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): one row per row of docs; null ids and repeated rows keep theirs, other columns are ignored."""
    return docs.select(F.col(f"`{id_col}`").alias(id_col), spans_of(F.col(f"`{text_col}`"), threshold).alias("spans"))
