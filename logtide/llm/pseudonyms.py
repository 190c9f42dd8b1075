"""Format-preserving pseudonyms for personal data.

Validated values (card numbers, account numbers, phone numbers, IP addresses, dates, mail names) are ranked within their
format, the rank is permuted by a keyed Feistel network, and the value of the new rank takes the old one's place with the same
separators.  A permutation of the whole format keeps values of equal content equal in every document and different ones different,
without any table of values; check digits are made anew, so a valid value stays valid.

Dates are those of the calendar's whole range, 0001 to 9999: year first or last, with ``-``, ``/`` or ``.``, or with a month's name in four languages; a date has one pseudonym
in all of these forms.  Where day and month could be either, the day is first; only what cannot be so is read month first.  Years of two figures are no dates.

Cases:  a null text stays null and has no finds; a text without finds stays as it is; where finds overlap, the earlier kind in
``ORDER`` and then the first wins; a value beside other numbers and words is found at the borders of its groups; rows that repeat get equal
results; an empty table gives no row; doc_id is cast to long; a very long text takes time in proportion to its length and finds; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import secrets
from collections.abc import Iterator
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read

ROUNDS = 8
SETTING = "logtide.pseudonym.key"
"""The session's key; one that has none draws one at random, so that its pseudonyms are linked with each other and with no other session's."""
KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
ORDER = ("email", "iban", "card", "ssn", "ip", "date", "named date", "phone", "other card")
"""What is found by one is out of reach for those after it; ``other card``: digits that pass the Luhn test, but of no known issuer and beside others; one such
extent in ten of any numbers passes, which is the price of missing no card."""
TAKEN = "\0"


def _round(key: bytes, kind: str, size: int, turn: int, value: int) -> int:
    seed = b"%s|%d|%d|%d" % (kind.encode(), size, turn, value)
    return int.from_bytes(hashlib.blake2b(seed, key=key[:64], digest_size=16).digest(), "big")


@lru_cache(maxsize=100_000)
def permute(key: bytes, kind: str, rank: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1: a Feistel network on a * b >= size, walked until it is inside again."""
    if size < 2:
        return rank
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(rank, b)
        for turn in range(0, ROUNDS, 2):
            left = (left + _round(key, kind, size, turn, right)) % a
            right = (right + _round(key, kind, size, turn + 1, left)) % b
        rank = left * b + right
        if rank < size:
            return rank


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _digits(key: bytes, kind: str, digits: str) -> str:
    return str(permute(key, kind, int(digits), 10 ** len(digits))).zfill(len(digits))


def _refill(shape: str, symbols: str, into: str = "0123456789") -> str:
    """``shape`` with its characters of ``into`` replaced in turn."""
    turn = iter(symbols)
    return "".join(next(turn) if c in into else c for c in shape)


def _mixed(key: bytes, kind: str, text: str) -> str:
    """Permute letters and digits of ``text`` within their own alphabets; other characters stay."""
    sets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    of = [next((s for s in sets if c in s), c) for c in text]
    rank, size = 0, 1
    for c, s in zip(text, of, strict=True):
        rank, size = rank * len(s) + s.index(c), size * len(s)
    new, out = permute(key, f"{kind}:{''.join('x' if len(s) == 1 else s[0] for s in of)}", rank, size), []
    for s in reversed(of):
        new, i = divmod(new, len(s))
        out.append(s[i])
    return "".join(reversed(out))


# Validation and replacement by kind; a replacement of None means that the match is no valid value.


def _email(m: re.Match, key: bytes) -> str | None:
    local, _, host = m[0].partition("@")
    return f"{_mixed(key, 'email', local)}@{host}"


def _iban(shape: str, key: bytes) -> str | None:
    value = shape.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(value) <= 34 or number(value[4:] + value[:4]) % 97 != 1:
        return None
    body = _mixed(key, f"iban{value[:2]}", value[4:])
    check = str(98 - number(body + value[:2] + "00") % 97).zfill(2)
    return _refill(shape, value[:2] + check + body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _ibans(text: str, key: bytes) -> Iterator[tuple[int, int, str]]:
    """Account numbers; where words or numbers follow, the country's length is tried first and then every other, the longest first."""
    at = 0
    for m in IBAN.finditer(text):
        if m.start() < at:
            continue
        ends, n = [], 4
        for c in IBAN_REST.match(text, m.end())[0]:
            ends.append(ends[-1] + 1 if ends else m.end() + 1)
            n += c != " "
            if n > 34:
                break
        stops = [e for e in ends if text[e - 1] != " " and not text[e : e + 1].isalnum()]
        stops.sort(key=lambda e: (len(text[m.start() : e].replace(" ", "")) != IBAN_LENGTH.get(m[0][:2]), -e))
        for stop in stops:
            new = _iban(text[m.start() : stop], key)
            if new is not None:
                at = stop
                yield m.start(), stop, new
                break


def _card(shape: str, key: bytes) -> str | None:
    digits = re.sub(r"[^0-9]", "", shape)
    if luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = _digits(key, "card", digits[:-1])
    return _refill(shape, body + luhn_digit(body))


def _cards(text: str, key: bytes, every: bool) -> Iterator[tuple[int, int, str]]:
    """Card numbers among groups of digits: of all extents from group to group those of issuers' prefixes and lengths and those that
    are a whole run with one separator; with ``every``, of any prefix.  Inside a run, all groups but the last have four digits or more and one separator.  Wider ones
go first."""
    for m in RUN.finditer(text):
        if m.end() - m.start() < 13:
            continue
        groups = [(g.start(), g.end()) for g in GROUP.finditer(text, m.start(), m.end())]
        extents = []
        for i, (start, _) in enumerate(groups):
            n = 0
            for j in range(i, len(groups)):
                stop = groups[j][1]
                n += stop - groups[j][0]
                if n > 19:
                    break
                if n >= 13:
                    digits = re.sub("[ -]", "", text[start:stop])
                    whole = stop - start == m.end() - m.start() and len(set(m[0]) & {" ", "-"}) < 2
                    grouped = j == i or min(stop - start for start, stop in groups[i:j]) >= 4 and len(set(text[start:stop]) & {" ", "-"}) == 1
                    if whole or grouped and (every or ISSUER.fullmatch(digits)):
                        extents.append((-n, start, stop))
        done: set[int] = set()
        for _, start, stop in sorted(extents):
            new = None if start in done or stop - 1 in done else _card(text[start:stop], key)
            if new is not None:
                done.update(range(start, stop))
                yield start, stop, new


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = m[0].split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = 898  # 001 to 899 without 666
    rank = ((int(area) - 1 - (int(area) > 666)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    rank, serial_new = divmod(permute(key, "ssn", rank, areas * 99 * 9999), 9999)
    area_new, group_new = divmod(rank, 99)
    area_new += 1
    return f"{area_new + (area_new >= 666):03d}-{group_new + 1:02d}-{serial_new + 1:04d}"


def _phone(m: re.Match, key: bytes) -> str | None:
    lead = m["lead"] or ""
    if m["code"]:
        code = CODE.match(re.sub("[^0-9]", "", m[0]))[0]
        lead = re.match(r"\+" + "[^0-9]*".join(code), m[0])[0]
    rest = m[0][len(lead) :]
    digits = re.sub(r"[^0-9]", "", rest)
    return lead + _refill(rest, _digits(key, "phone", digits))


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    rank = permute(key, "ip", int.from_bytes(bytes(parts), "big"), 2**32)
    return ".".join(str(x) for x in rank.to_bytes(4, "big"))


NEAR_FROM, NEAR_TO = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal()
LAST_DAY = date.max.toordinal()


def _other_day(at: date, key: bytes) -> date:
    """A permutation of the calendar's days.  Dates of 1900 to 2099 stay among themselves, as do those whose day of the month is beyond 12,
    so that what is written month first never meets what is written day first."""
    near = NEAR_FROM <= at.toordinal() < NEAR_TO
    gap = NEAR_TO - NEAR_FROM
    kind, size = ("date", gap) if near else ("far date", LAST_DAY - gap)
    rank = at.toordinal() - NEAR_FROM if near else at.toordinal() - 1 - gap * (at.toordinal() >= NEAR_TO)
    while True:
        rank = permute(key, kind, rank, size)
        new = date.fromordinal(rank + NEAR_FROM if near else rank + 1 + gap * (rank + 1 >= NEAR_FROM))
        if (new.day > 12) == (at.day > 12):
            return new


def _two(n: int, like: str) -> str:
    return f"{n:02d}" if len(like) == 2 else str(n)


def _date(m: re.Match, key: bytes) -> str | None:
    """Dates in figures: year first, or day and month before the year; of these both readings are tried, day first."""
    one, two, year = (m["m"], m["d"], m["y"]) if m["y"] else (m["m2"], m["d2"], m["y2"])
    month, day = int(one), int(two)
    month_first = not m["y"] and month > 12
    if month_first:
        month, day = day, month
    try:
        new = _other_day(date(int(year), month, day), key)
    except ValueError:
        return None
    wide = one if len(one) < len(two) else two  # one short figure: figures are written without leading zeros
    if m["y"]:
        return f"{new.year:04d}{m['ys']}{_two(new.month, wide)}{m['ys']}{_two(new.day, wide)}"
    first, second = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{_two(first, wide)}{m['sep']}{_two(second, wide)}{m['sep']}{new.year:04d}"


def _suffix(day: int) -> str:
    return "th" if 10 < day < 20 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _named_date(m: re.Match, key: bytes) -> str | None:
    """Dates with a month's name, which stays in its language, length and case."""
    name = m["n"] or m["n2"]
    style, month = MONTH_OF[name.lower()]
    day = m["d"] or m["d2"]
    try:
        new = _other_day(date(int(m["y"] or m["y2"]), month, int(day)), key)
    except ValueError:
        return None
    word = MONTHS[style][new.month - 1]
    word = word.upper() if name.isupper() else word.capitalize() if name[0].isupper() else word
    out = m[0]
    parts = {"y": f"{new.year:04d}", "y2": f"{new.year:04d}", "n": word, "n2": word, "d": _two(new.day, day), "d2": _two(new.day, day), "o": _suffix(new.day), "o2": _suffix(new.day)}
    for group in sorted((g for g in parts if m[g]), key=m.start, reverse=True):
        out = out[: m.start(group) - m.start()] + parts[group] + out[m.end(group) - m.start() :]
    return out


# Names of the months, by language and length.
MONTHS = [
    x.split() for x in (
        "january february march april may june july august september october november december", "jan feb mar apr may jun jul aug sep oct nov dec",
        "januar februar märz april mai juni juli august september oktober november dezember", "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    )
]
MONTH_OF = {name: (style, i + 1) for style, names in reversed(list(enumerate(MONTHS))) for i, name in enumerate(names)}
# Lengths of account numbers by country, issuers' prefixes and lengths of card numbers, calling codes.
IBAN_LENGTH = {
    c: int(n)
    for n, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL,OM,SO "
        "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
    ).split())
    for c in countries.split(",")
}
ISSUER = re.compile(r"4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|(?:5[1-5]|2[2-7])[0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11}|(?:35|8[12]|9792)[0-9]*(?<=^[0-9]{16})|6[0-9]{15,18}|5[06-9][0-9]{11,17}")
CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
IBAN_REST = re.compile(r"(?: ?[A-Z0-9])*")
RUN = re.compile(r"(?<![0-9])[0-9]+(?:[ -][0-9]+)*")
GROUP = re.compile(r"[0-9]+")
_NAMES = "|".join(sorted(MONTH_OF, key=len, reverse=True))
PATTERNS = {
    "email": (re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), _email),
    "ssn": (re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn),
    "phone": (
        re.compile(
            r"(?<![0-9A-Za-z])(?:(?P<lead>\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
            r"|(?P<code>\+[1-9])(?:[ ./-]?\(?[0-9]\)?){6,14}"
            r"|(?=0(?:[ /-]?[0-9]){8,11}(?![0-9]))0[1-9][0-9]{0,4}[ /-][0-9]{2,8}(?:[ -][0-9]{2,8})*"
            r"|\(0[1-9][0-9]{0,4}\) ?[0-9]{2,8}(?:[ -][0-9]{2,8})*|0[1-9](?:\.[0-9]{2}){4})(?![0-9])"
        ),
        _phone,
    ),
    "ip": (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), _ip),
    "date": (
        re.compile(
            r"(?<![0-9])(?<![0-9][./-])(?P<y>[0-9]{4})(?P<ys>[-/.])(?P<m>[0-9]{1,2})(?P=ys)(?P<d>[0-9]{1,2})(?![0-9]|[-/.][0-9])"
            r"|(?<![0-9])(?<![0-9][./-])(?P<d2>[0-9]{1,2})(?P<sep>[-/.])(?P<m2>[0-9]{1,2})(?P=sep)(?P<y2>[0-9]{4})(?![0-9]|[-/.][0-9])"
        ),
        _date,
    ),
    "named date": (
        re.compile(
            r"(?<![0-9A-Za-z])(?P<d>[0-9]{1,2})(?:(?P<o>st|nd|rd|th)|\.)?(?:[ -]| of | de )(?P<n>" + _NAMES + r")\.?(?:,? |-| de | del )(?P<y>[0-9]{4})(?![0-9])"
            r"|(?<![^\W_])(?P<n2>" + _NAMES + r")\.? (?P<d2>[0-9]{1,2})(?P<o2>st|nd|rd|th)?,? (?P<y2>[0-9]{4})(?![0-9])",
            re.IGNORECASE,
        ),
        _named_date,
    ),
}
DIGIT = re.compile(r"[0-9]")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")


def _matches(kind: str, pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """All matches; those of mail addresses are sought around each @ only."""
    if kind != "email":
        yield from pattern.finditer(text)
        return
    at = text.find("@")
    while at >= 0:
        local = LOCAL.search(text, max(0, at - 64), at)
        if local:
            found = pattern.match(text, local.start()) or pattern.search(text, local.start(), at + 255)
            if found and found.start() < at < found.end():
                yield found
        at = text.find("@", at + 1)


def replace(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)
    if not DIGIT.search(text) and "@" not in text:
        return text, counts
    found, rest = [], text
    for kind in ORDER:
        if kind == "iban":
            new = list(_ibans(rest, key))
        elif kind in ("card", "other card"):
            new = list(_cards(rest, key, kind != "card"))
        else:
            pattern, change = PATTERNS[kind]
            new = [(m.start(), m.end(), x) for m in _matches(kind, pattern, rest) if (x := change(m, key)) is not None]
        left, at = [], 0
        for start, stop, value in sorted(new):
            if start >= at:
                found.append((start, stop, kind.removeprefix("other ").removeprefix("named "), value))
                left += [rest[at:start], TAKEN * (stop - start)]
                at = stop
        if left:
            rest = "".join([*left, rest[at:]])
    out, at = [], 0
    for start, stop, kind, value in sorted(found):
        out += [text[at:start], value]
        at = stop
        counts[kind] += 1
    return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """Per row of (doc_id, text): doc_id, counts n_<kind>, and the text with pseudonyms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, dict.fromkeys(KINDS, 0)) if t.as_py() is None else replace(t.as_py(), key) for t in batch.column(1)]
            counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS]
            yield pa.record_batch([batch.column(0), *counts, pa.array([t for t, _ in done], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "text"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", text string"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def session_key(spark: SparkSession) -> bytes:
    key = spark.conf.get(SETTING, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(SETTING, key)
    return key.encode()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents"), session_key(spark))
