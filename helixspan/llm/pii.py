"""Format-preserving pseudonyms: validated private values are permuted within their format.

Each kind of value is found by a pattern, checked (Luhn digit, octet range, mod 97, calendar),
normalised, mapped to a mixed-radix number and permuted by a keyed Feistel network over that
very domain; check digits are recomputed and the value's own punctuation is put back. Equal
values therefore get equal pseudonyms in every document, and distinct values of one format
stay distinct. The network alternates modular additions on two halves of the radix list, so it
is a bijection on any domain; only dates walk cycles, past numbers that are no days of their form
(dd/mm/yyyy and mm/dd/yyyy share their looks: a text that both could mean is day first, and a
day over 12 that comes second stays over 12).

Kinds: email, phone, card, iban, ssn, ip (of both versions), date, secret (values assigned to
password, token, secret or key names; without a digit only after `password=` and the like).

Phones are those with + and a country code, 8 to 15 digits in all, and the forms (ddd) ddd-dddd
and ddd-ddd-dddd of country 1, which get the pseudonym of the same number with +1; other national
forms are left as they are. Where a match of a card, IBAN or phone fails its check, shorter ones
that end at a border of its groups are tried.

The key is an argument without a default: who has it can invert the pseudonyms. session_key()
reads it from the session, with a published one for trials.

Defined cases: null text stays null, with no hits; the empty text and texts without digits, @ and
= are returned as they are; very long texts take time in proportion to their length; repeated
rows give repeated results; an empty table has no rows; columns of other names, or names that
differ only by case, stay as they are.
"""
from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import secrets
from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_place, column_place, doc_columns, map_rows

KEY_SETTING = "spark.helixspan.pseudonym.key"
ROUNDS = 8
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_HEX = "0123456789abcdef"


_DRAWN: dict[str, bytes] = {}


def session_key(spark) -> bytes:
    """The key in the setting spark.helixspan.pseudonym.key; where that is unset, one drawn for the session and kept nowhere.

    With a drawn key equal values stay linked inside the session, but not with those of another one.
    """
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _DRAWN.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


# --- Feistel permutation over mixed radices ---------------------------------------------------


def _round(key: bytes, tweak: bytes, i: int, value: int) -> int:
    raw = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    return int.from_bytes(hashlib.blake2b(tweak + b"|%d|" % i + raw, key=key, digest_size=64).digest(), "big")


def permute(key: bytes, tweak: bytes, digits: list[int], radices: list[int], back: bool = False) -> list[int]:
    """A keyed bijection on the vectors with 0 <= digits[i] < radices[i]; back inverts it."""
    half = (len(radices) + 1) // 2
    sizes, values = [1, 1], [0, 0]
    for i, (d, r) in enumerate(zip(digits, radices)):
        side = int(i >= half)
        sizes[side] *= r
        values[side] = values[side] * r + d
    tweak = tweak + b"|%x|%x" % tuple(sizes)
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = i % 2
        step = _round(key, tweak, i, values[1 - side])
        values[side] = (values[side] - step if back else values[side] + step) % sizes[side]
    out: list[int] = []
    for side, part in ((1, radices[half:]), (0, radices[:half])):
        v = values[side]
        for r in reversed(part):
            out.append(v % r)
            v //= r
    return out[::-1]


def _permute_text(key: bytes, tweak: bytes, text: str, alphabets: list[str], back: bool = False) -> str:
    moved = permute(key, tweak, [a.index(c) for c, a in zip(text, alphabets)], [len(a) for a in alphabets], back)
    return "".join(a[d] for a, d in zip(alphabets, moved))


def _classed(key: bytes, tweak: bytes, text: str, back: bool = False) -> str:
    """Permutes ASCII letters and digits within their class; other characters stay in place."""
    classes = {c: a for a in (_LOWER, _UPPER, _DIGIT) for c in a}
    held = [(i, classes[c]) for i, c in enumerate(text) if c in classes]
    if not held:
        return text
    shape = "".join("l" if c in _LOWER else "u" if c in _UPPER else "d" if c in _DIGIT else c for c in text)
    moved = _permute_text(key, tweak + shape.encode(), "".join(text[i] for i, _ in held), [a for _, a in held], back)
    out = list(text)
    for (i, _), c in zip(held, moved):
        out[i] = c
    return "".join(out)


# --- validation ---------------------------------------------------------------------------------


def luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10


def _mod97(iban: str) -> int:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def _lay(template: str, chars: str) -> str:
    """Puts chars in the places of the template's letters and digits."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in template)


# --- kinds: each gives the pseudonym, or None if the value isn't valid ------------------------------


def _email(key, m):
    local, _, domain = m["mail"].partition("@")
    name, _, tld = domain.rpartition(".")
    return f"{_classed(key, b'email', local.lower())}@{_classed(key, b'domain', name.lower())}.{tld.lower()}"


def _card(key, m):
    d = re.sub(r"\D", "", m[0])
    if not 13 <= len(d) <= 19 or luhn_sum(d) or len(set(d)) == 1:
        return None
    body = _permute_text(key, b"card%d" % len(d), d[:-1], [_DIGIT] * (len(d) - 1))
    return _lay(m[0], body + str(-luhn_sum(body + "0") % 10))


_UNDIALLED = [(a, e) for a in _DIGIT for e in _DIGIT if a in "01" or e in "01"]


# Country codes of two digits; 1 and 7 have one, the others three.
_CODES2 = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _national(key, m):
    """A number of country 1 without its code."""
    new = _phone(key, _PHONE1.fullmatch("+1 " + m[0]))
    return new[3:]


def _phone(key, m):
    d = re.sub(r"\D", "", m[0])
    if not 8 <= len(d) <= 15:
        return None
    if d[0] == "1" and len(d) == 11:  # country 1: area and exchange start with 2 to 9 in numbers that can be dialled
        if (d[1], d[4]) in _UNDIALLED:  # the others are permuted among themselves
            lead, *rest = permute(key, b"phone1 undialled", [_UNDIALLED.index((d[1], d[4])), *map(int, d[2:4] + d[5:])], [len(_UNDIALLED), *[10] * 8])
            (area, exchange), rest = _UNDIALLED[lead], "".join(map(str, rest))
            return _lay(m[0], d[0] + area + rest[:2] + exchange + rest[2:])
        wide = "23456789"
        alphabets = [wide, _DIGIT, _DIGIT, wide, *[_DIGIT] * 6]
        return _lay(m[0], d[0] + _permute_text(key, b"phone1", d[1:], alphabets))
    keep = 1 if d[0] in "17" else 2 if d[:2] in _CODES2 else 3  # the country code's digits
    return _lay(m[0], d[:keep] + _permute_text(key, b"phone" + d[:keep].encode(), d[keep:], [_DIGIT] * (len(d) - keep)))


def _iban(key, m):
    v = re.sub(r"\s", "", m[0])
    if not 15 <= len(v) <= 34 or _mod97(v) != 1:
        return None
    body = _classed(key, b"iban" + v[:2].encode(), v[4:])
    check = 98 - _mod97(v[:2] + "00" + body)
    return _lay(m[0], f"{v[:2]}{check:02d}{body}")


def _ssn(key, m):
    a, b, c = (int(x) for x in m[0].split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    groups = [x for x in range(1, 900) if x != 666]
    i, j, k = permute(key, b"ssn", [groups.index(a), b - 1, c - 1], [len(groups), 99, 9999])
    return f"{groups[i]:03d}-{j + 1:02d}-{k + 1:04d}"


def _ip(key, m):
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    return ".".join(map(str, permute(key, b"ip", [int(p) for p in parts], [256] * 4)))


def _ip6(key, m):
    try:
        whole = ipaddress.IPv6Address(m[0])
    except ValueError:
        return None
    if not re.search(r"[0-9]", m[0]) or int(whole) < 1 << 32:  # a::b is code, :: and ::1 are no one's
        return None
    # Groups of zeros stay, so that :: stands where it stood; the others are permuted together among numbers that aren't zero.
    groups = [int(x, 16) for x in whole.exploded.split(":")]
    at = [i for i, g in enumerate(groups) if g]
    for i, g in zip(at, permute(key, b"ip6|" + bytes(at), [groups[i] - 1 for i in at], [0xFFFF] * len(at))):
        groups[i] = g + 1
    head, gap, tail = m[0].partition("::")
    written = lambda part: part.split(":") if part else []
    size = sum(2 if "." in x else 1 for x in written(tail))
    out = []
    for part, g in ((head, groups), (tail, groups[8 - size :] if gap else [])):
        texts, i = [], 0
        for x in written(part):
            if "." in x:
                texts.append(str(ipaddress.IPv4Address(g[i] << 16 | g[i + 1])))
                i += 2
            else:
                y = f"{g[i]:0{len(x)}x}" if x[0] == "0" and len(x) == 4 else f"{g[i]:x}"
                texts.append(y.upper() if m[0] != m[0].lower() else y)
                i += 1
        out.append(":".join(texts))
    return gap.join(out)


_DAY0, _DAY1 = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal()


def _day(key, year, month, day):
    try:
        n = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    if not _DAY0 <= n < _DAY1:
        return None
    n -= _DAY0
    while True:  # 319 * 229 is two more than the 73049 days: the walk goes on from these two
        hi, lo = permute(key, b"date", list(divmod(n, 229)), [319, 229])
        n = hi * 229 + lo
        if n < _DAY1 - _DAY0:
            return dt.date.fromordinal(_DAY0 + n)


def _date(key, m):
    sep = re.search(r"\D", m[0])[0]
    a, b, c = m[0].split(sep)
    if len(a) == 4:
        d = _day(key, int(a), int(b), int(c))
        return d and f"{d.year:04d}{sep}{d.month:02d}{sep}{d.day:02d}"
    first, second = (int(a), int(b))
    if second > 12:  # month first, and so is the pseudonym: the walk goes on from other days
        d = _day(key, int(c), first, second)
        while d and d.day <= 12:
            d = _day(key, d.year, d.month, d.day)
        return d and f"{d.month:02d}{sep}{d.day:02d}{sep}{d.year:04d}"
    d = _day(key, int(c), second, first)
    return d and f"{d.day:02d}{sep}{d.month:02d}{sep}{d.year:04d}"


def _secret(key, m):
    value = m["value"]
    if not re.search(r"[0-9]", value) and not re.match(r"(?i)(?:password|passwd|pwd)=", m[0]):
        return None
    if re.fullmatch(r"[0-9a-f]+", value):
        new = _permute_text(key, b"hex%d" % len(value), value, [_HEX] * len(value))
    else:
        new = _classed(key, b"secret", value)
    at = m.start("value") - m.start()
    return m[0][:at] + new + m[0][at + len(value):]


KINDS = (
    ("secret", re.compile(r"""(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|bearer)["']?\s*[=:]\s*["']?(?P<value>[A-Za-z0-9+/_\-.]{6,}[A-Za-z0-9+/_\-=])|\b(?P<aws>AKIA)(?P<rest>[0-9A-Z]{16})\b"""), _secret),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+\-])[._%+\-]*+(?P<mail>[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,})"), _email),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    ("card", re.compile(r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])"), _card),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{1,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)"), _phone),
    ("phone", re.compile(r"(?<![\w+\-.(])(?:\(\d{3}\) ?|\d{3}-)\d{3}-\d{4}(?![\w\-]|\.\d)"), _national),
    ("ssn", re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"), _ssn),
    ("ip", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"), _ip),
    ("ip", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:]|\.\d)"), _ip6),
    ("date", re.compile(r"(?<![\d/\-.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/\-]|\.\d)"), _date),
)
_ANY = re.compile(r"[0-9@=]|::")
# Kinds whose patterns run over spaces, and so may run on into what follows the value.
_GROUPED = ("iban", "card", "phone")
_PRINTED = re.compile(r"(?<![\d.])(?:(?:[3-6]|2[2-7])\d{2}\d(?:\d{9,15}|([ -])\d{4}\1\d{4}\1\d{4})|3\d{3}([ -])\d{6}\2\d{4,5})(?!\d)")
_PHONE1 = re.compile(r"(?<![\w+])\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)")
_NEXT = re.compile("|".join(p.pattern for _, p, make in KINDS if make in (_ssn, _ip, _date)))


def _tries(kind: str, text: str, m: re.Match, stop: int):
    """Spans to check for a match of a grouped kind, the likeliest first; none passes stop.

    After the match come its prefixes that end at a group's border. Cards are first looked for in
    the layouts they are printed in, anywhere in the match, and not in a phone of country 1; phones end before a number of social
    security, an address or a date that follows them, and those of country 1 have eleven digits.
    """
    start, end = m.span()
    ends = [i for i in range(min(end, stop), start, -1) if text[i - 1].isalnum() and (i == end or not text[i].isalnum())]
    if kind == "card":
        phones = [p.span() for p in _PHONE1.finditer(text, max(0, start - 20), end + 20)]
        at = start
        while (c := _PRINTED.search(text, at)) and c.start() < end:
            if c.end() <= stop and not any(s < c.end() and c.start() < e for s, e in phones):
                yield c.span()
            at = c.start() + 1
        ends = [i for i in ends if not any(s < i and start < e for s, e in phones)]
    elif kind == "phone":
        if text[start + 1] == "1":
            ends.sort(key=lambda i: sum(c.isdigit() for c in text[start:i]) != 11)
        following = next((n.start() for n in _NEXT.finditer(text, start + 1, end + 20) if text[n.start() - 1] == " "), end) if len(ends) > 1 else end
        ends.sort(key=lambda i: i > following)
    for i in ends:
        yield start, i


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, list[str]]:
    """The text with each validated value replaced, and the kind of every replaced value in order.

    Kinds go in the order of KINDS; a span that one kind has taken isn't looked at again.
    """
    if not text or not _ANY.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []  # in order of place
    for kind, pattern, make in KINDS:
        at, before, own = 0, [s for s, *_ in taken], []
        while m := pattern.search(text, at):
            at = m.end()
            name = "mail" if kind == "email" else 0
            start, end = m.span(name)
            last = bisect_right(before, start) - 1
            if last >= 0 and taken[last][1] > start:
                at = taken[last][1]
                continue
            stop = before[last + 1] if last + 1 < len(before) else len(text)
            if kind in _GROUPED and make is not _national:
                for s, e in _tries(kind, text, m, stop):
                    one = pattern.fullmatch(text, s, e)
                    new = one and make(key, one)
                    if new is not None:
                        own.append((s, e, new, kind))
                        at = e
                        break
                continue
            if stop < end:
                continue
            if kind == "secret" and m["value"] is None:
                new = m["aws"] + _classed(key, b"aws", m["rest"])
            else:
                new = make(key, m)
            if new is not None:
                own.append((start, end, new, kind))
        if own:
            taken = sorted(taken + own)
    if not taken:
        return text, []
    out, at = [], 0
    for s, e, new, _ in taken:
        out += [text[at:s], new]
        at = e
    out.append(text[at:])
    return "".join(out), [k for *_, k in taken]


SCHEMA = "doc_id bigint, text string, n_values bigint, kinds string"


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """Per document: the text with pseudonyms, how many values were replaced, their distinct kinds."""

    def run(c):
        done = [pseudonymise(t, key) for t in c["text"].to_pylist()]
        return {
            "doc_id": c["doc_id"],
            "text": [t for t, _ in done],
            "n_values": [len(k) for _, k in done],
            "kinds": [",".join(sorted(set(k))) for _, k in done],
        }

    return map_rows(doc_columns(docs, "doc_id", "text"), run, SCHEMA)


def pseudonymise_column(docs: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """docs with its text column replaced and n_chars, where there is one, counted anew; all other columns as they are."""
    own, at = by_place(docs), f"c{column_place(docs, column)}"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def run(c):
        return {**c, at: [pseudonymise(t, key)[0] for t in c[at].to_pylist()]}

    out = map_rows(own, run, schema)
    if (n := column_place(docs, "n_chars")) is not None:
        out = out.withColumn(f"c{n}", F.length(at).cast(own.schema[f"c{n}"].dataType))
    return out.toDF(*docs.columns)
