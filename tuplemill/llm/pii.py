"""Personal data by anchor expansion (operator 10).

An Aho-Corasick automaton finds the places where personal data can be: at
signs, plus signs, digits, address schemes and identifier cues.  A small
deterministic parser for each kind expands such an anchor to the boundaries of
the value and validates it.

Kinds of the base contract are ``email``, ``ip``, ``card`` and ``phone``.  The
method adds ``address`` (a scheme followed by an authority, as in ``mailto:``
or ``https://user@host``, that names a person or a numbered host) and
``account`` (a value that an identifier cue such as ``token =`` introduces).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .common import map_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "address", "account")

# Schemes and identifier cues, as people write them.
SCHEMES = ("mailto:", "sip:", "xmpp:", "http://", "https://", "ftp://", "ssh://")
CUES = ("token", "password", "passwd", "secret", "api_key", "apikey", "access_key", "account", "iban", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AUTHORITY = re.compile(r"(?:[A-Za-z0-9._%+-]+(?::[^\s@/]*)?@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?")
_BETWEEN = re.compile(r"[\x20\t]*(?:(?:no|nr|number|id)\b\.?)?[\x20\t]*(?:[:=#]|is\b)[\x20\t]*[\"']?", re.I)
_NUMBER_WORD = re.compile(r"[\x20\t]+(?:no|nr|number|id)\b\.?[\x20\t]+", re.I)
_IBAN_LEAD = re.compile(r"[\x20\t]*(?:(?:no|nr|number)\b\.?)?[\x20\t]*[:=#]?[\x20\t]*[\"']?", re.I)
_IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]){11,30}")
_VALUE = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_\-/+.]*[A-Za-z0-9])?")

SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "n_address bigint, n_account bigint, span_list array<struct<kind:string,start:int,end:int>>"
)


def luhn(digits: str) -> bool:
    """Whether the checksum of a run of digits is right."""
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d)
        if place % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


class Finder:
    """Finds spans in one text after another."""

    def __init__(self) -> None:
        import ahocorasick

        auto = ahocorasick.Automaton()
        for c in "@+0123456789":
            auto.add_word(c, (c, 1))
        for word in SCHEMES:
            for form in {word, word.capitalize(), word.upper()}:
                auto.add_word(form, ("scheme", len(form)))
        for word in CUES:
            for form in {word, word.capitalize(), word.upper()}:
                auto.add_word(form, ("cue", len(form)))
        auto.make_automaton()
        self._auto = auto

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All (kind, start, end) of a text, in code points, in order."""
        found: list[tuple[str, int, int]] = []
        next_of = dict.fromkeys(KINDS, 0)  # where the next span of a kind can begin
        digits_end = 0
        for last, (what, n) in self._auto.iter(text):
            at = last + 1 - n
            if what == "@":
                self._email(text, at, next_of, found)
            elif what == "+":
                self._phone(text, at, next_of, found)
            elif what == "scheme":
                self._address(text, at, last + 1, next_of, found)
            elif what == "cue":
                self._account(text, at, last + 1, next_of, found)
            else:
                if at >= digits_end:  # the first digit of its run; no other can begin an address that this one can't
                    digits_end = _DIGITS.match(text, at).end()
                    self._ip(text, at, digits_end, next_of, found)
                self._card(text, at, next_of, found)
        rank = {k: i for i, k in enumerate(KINDS)}
        found.sort(key=lambda s: (s[1], rank[s[0]], s[2]))
        return found

    @staticmethod
    def _email(text: str, at: int, next_of: dict, found: list) -> None:
        start, least = at, next_of["email"]
        while start > least and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            next_of["email"] = m.end()

    @staticmethod
    def _phone(text: str, at: int, next_of: dict, found: list) -> None:
        if at >= next_of["phone"] and (m := _PHONE.match(text, at)):
            next_of["phone"] = m.end()
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append(("phone", at, m.end()))

    @staticmethod
    def _ip(text: str, at: int, digits_end: int, next_of: dict, found: list) -> None:
        begin = max(at, next_of["ip"])
        if begin < digits_end and (m := _IP.match(text, begin)):
            next_of["ip"] = m.end()
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append(("ip", begin, m.end()))

    @staticmethod
    def _card(text: str, at: int, next_of: dict, found: list) -> None:
        if at >= next_of["card"] and (m := _CARD.match(text, at)):
            next_of["card"] = m.end()
            if m.end() - at <= 37:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", at, m.end()))

    @staticmethod
    def _address(text: str, start: int, at: int, next_of: dict, found: list) -> None:
        if start < next_of["address"] or start and text[start - 1].isalnum():
            return
        m = _AUTHORITY.match(text, at)
        if m and ("@" in m.group() or _IP.match(m.group())):
            found.append(("address", start, m.end()))
            next_of["address"] = m.end()

    @staticmethod
    def _account(text: str, start: int, at: int, next_of: dict, found: list) -> None:
        """A value behind a cue: an IBAN by its checksum, else one that a separator or a number word introduces."""
        if start < next_of["account"] or start and text[start - 1].isalnum():
            return
        span = None
        if text[start:at].lower() == "iban":
            span = iban(text, _IBAN_LEAD.match(text, at).end())
        if span is None and (m := _BETWEEN.match(text, at)):
            v = _VALUE.match(text, m.end())
            if v and len(v.group()) >= 6 and any(c in "0123456789" for c in v.group()):
                span = v.span()
        elif span is None and (m := _NUMBER_WORD.match(text, at)):
            v = _VALUE.match(text, m.end())
            if v and len(v.group()) >= 6 and v.group()[0] in "0123456789":
                span = v.span()
        if span:
            found.append(("account", *span))
            next_of["account"] = span[1]


def iban(text: str, at: int) -> tuple[int, int] | None:
    """The span of the longest IBAN at a place, single spaces allowed: its remainder by 97 must be 1."""
    m = _IBAN.match(text, at)
    if not m:
        return None
    for end in range(m.end(), at + 14, -1):
        if text[end - 1] == " " or text[end : end + 1].isalnum():
            continue
        plain = text[at:end].replace(" ", "").upper()
        if len(plain) < 15:
            return None
        if plain.isascii() and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1:
            return at, end
    return None


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row with the spans of personal data in its whole text.

    A null text counts as empty: no spans, counts of 0, the digest of an empty
    string.  A null id stays null.  Repeated rows give repeated results.  Other
    columns of the input are not read, so their names can't clash.  A narrow
    map without a shuffle; a text is held by one task at a time.
    """

    def make():
        finder = Finder()

        def row(doc_id, text):
            spans = finder.spans(text or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            n = {k: sum(s[0] == k for s in spans) for k in KINDS}
            digest = hashlib.sha256(_joined(base).encode()).hexdigest()
            listed = [{"kind": k, "start": a, "end": b} for k, a, b in spans]
            return (doc_id, n["email"], n["ip"], n["card"], n["phone"], digest, _joined(spans), n["address"], n["account"], listed)

        return row

    return map_rows(docs, [id_col, text_col], SCHEMA.replace("doc_id", id_col, 1), make)
