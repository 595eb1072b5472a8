"""Surrogates of single entities: same type, script and format, keyed, and distinct by construction wherever the format allows.

Formats of fixed alphabets (numbers, addresses, secrets) are permuted by a Feistel network over all texts of the format. Names
are made of syllables of their script, with an ending of their gender, from a keyed hash; listed given names are permuted in
their list. Where that gives a real value or one already taken, ``attempt`` counts on: first other permutations of the same
format, from ``WIDE`` on a wider one or a range that no real value is in, so that a used-up format has a way on.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from datetime import date, timedelta
from functools import lru_cache

from linkspark.llm.pii_detect import DIGITS, GIVEN, LISTED, MONTHS, NAMES, PARTICLES, STREET_ENDS, STREETS, parsed_date

LOW, UP, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: Attempts in an entity's own format, before it is widened.
WIDE = 3
#: What names of a script are made of: starts of syllables, vowels, and endings by gender.
ONSETS = {
    "latin": "b c d f g h j k l m n p r s t v z br cl dr fr gr kl pl pr st tr".split(),
    "cyrillic": "б в г д ж з к л м н п р с т ф х ш бр гр др кр тр ст".split(),
    "greek": "β γ δ ζ θ κ λ μ ν π ρ σ τ φ χ κρ στ τρ".split(),
}
VOWELS = {"latin": "a e i o u".split(), "cyrillic": "а е и о у".split(), "greek": "α ε η ι ο".split()}
ENDINGS = {
    ("f", "latin"): "a ia ina ella ette ora inde".split(), ("m", "latin"): "o us an er in ard on".split(), ("", "latin"): "er son man ell ini ard ey as".split(),
    ("f", "cyrillic"): "а ия ина ана".split(), ("m", "cyrillic"): "ан ей ор ил ам".split(), ("", "cyrillic"): "енко ич ук ак".split(),
    ("f", "greek"): "α η ια".split(), ("m", "greek"): "ος ης ας".split(), ("", "greek"): "ου ης ακης".split(),
}
#: Endings of family names that tell the gender; they stay.
KEPT_ENDINGS = ["ская", "ский", "ова", "ева", "ина", "ов", "ев", "ин", "ová"]


def tweaked(key: str, kind: str, attempt: int) -> bytes:
    own = hashlib.blake2b(key.encode(), digest_size=32).digest()
    return hashlib.blake2b(f"{kind}:{attempt}".encode(), key=own, digest_size=32).digest()


def number(text: str, key: bytes, size: int = 32) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), key=key, digest_size=size).digest(), "big")


def permute(value: int, a: int, b: int, key: bytes) -> int:
    """A keyed permutation of the whole numbers below a * b: eight Feistel rounds on the two digits to radices a and b."""
    left, right = divmod(value, b)
    for r in range(8):
        h = number(f"{r}:{right if r % 2 == 0 else left}", key)
        if r % 2 == 0:
            left = (left + h) % a
        else:
            right = (right + h) % b
    return left * b + right


def permuted(text: str, alphabets: list[str], key: bytes) -> str:
    """The image of ``text`` under a keyed permutation of all texts with these alphabets by position ('': fixed)."""
    free = [i for i, a in enumerate(alphabets) if len(a) > 1]
    value, sizes = 0, [len(alphabets[i]) for i in free]
    for i in free:
        value = value * len(alphabets[i]) + alphabets[i].index(text[i])
    half = (len(free) + 1) // 2
    a = b = 1
    for s in sizes[:half]:
        a *= s
    for s in sizes[half:]:
        b *= s
    shape = "|".join(a if len(a) > 1 else c for a, c in zip(alphabets, text, strict=True))
    value = permute(value, a, b, hashlib.blake2b(shape.encode(), key=key, digest_size=32).digest())
    out = list(text)
    for i, s in zip(reversed(free), reversed(sizes), strict=True):
        value, k = divmod(value, s)
        out[i] = alphabets[i][k]
    return "".join(out)


@lru_cache(256)
def list_order(names: tuple[str, ...], key: bytes) -> dict[str, str]:
    """A keyed permutation of a list that is one cycle: no name stays itself."""
    order = sorted(names, key=lambda n: number(n, key))
    return dict(zip(order, order[1:] + order[:1], strict=True))


def by_class(text: str, hexadecimal: bool = False) -> list[str]:
    return [HEX if hexadecimal and c in HEX else DIGITS if c in DIGITS else LOW if c in LOW else UP if c in UP else "" for c in text]


def luhn(digits: str) -> int:
    """The check digit that ``digits`` want."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_check(country: str, account: str) -> int:
    """The check number that a country code and an account want."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country) + "00") % 97


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            return "latin" if c < "ɐ" else "greek" if "Ͱ" <= c < "Ѐ" else "cyrillic" if "Ѐ" <= c < "԰" else "other"
    return "other"


@lru_cache(4096)
def _block(c: str) -> str:
    """The letters without case of the 128 code points around ``c``."""
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if x.isalpha() and x.lower() == x)


def made_name(word: str, gender: str, seed: int, longer: int = 0) -> str:
    """A word that can be said, about as long as ``word`` and in its script, with an ending of the gender."""
    script = script_of(word)

    def pick(own: list[str]) -> str:
        nonlocal seed
        seed, k = divmod(seed, len(own))
        return own[k]

    if script == "other":
        letters = [c for c in word if c.isalpha()] or ["a"]
        return "".join(pick(list(_block(c)) or [c]) for c in letters + letters[-1:] * longer)
    kept = next((e for e in KEPT_ENDINGS if gender == "" and word.endswith(e) and len(word) > len(e) + 1), None)
    ending = kept or pick(ENDINGS[gender, script])
    syllables = min(8, max(1, round((len(word) - len(ending)) / 2.4))) + longer
    out = ""
    for i in range(syllables):
        out += pick(ONSETS[script])
        if i < syllables - 1 or ending[0] not in VOWELS[script]:
            out += pick(VOWELS[script])
    return out + ending


def _words(entity: str, gender: str, key: bytes, longer: int) -> str:
    """Each run of letters of a name made anew; hyphens and apostrophes stay."""
    parts = iter(range(1 << 30))
    return re.sub(r"[^\W\d_]+", lambda m: made_name(m.group(), gender, number(f"{next(parts)}:{entity}", key, 64), longer), entity)


def _street(entity: str, key: bytes, longer: int) -> str:
    def token(m: re.Match) -> str:
        word, seed = m.group(), number(f"{m.start()}:{entity}", key, 64)
        if word.isdigit():
            return str(seed % (9 * 10 ** (len(word) - 1)) + 10 ** (len(word) - 1))
        if word in STREETS or word in PARTICLES or len(word) == 1:
            return word
        end = next((e for e in STREET_ENDS if word.endswith(e) and len(word) > len(e)), "")
        return made_name(word[: len(word) - len(end)], "", seed, longer) + end

    return re.sub(r"\d+|[^\W\d_]+", token, entity)


def _public(v: int) -> bool:
    private = v >> 24 in (10, 127) or v >> 16 in (0xC0A8, 0xA9FE) or 0xAC10 <= v >> 16 < 0xAC20
    return 1 <= v >> 24 <= 223 and not private


def _ip(entity: str, key: bytes, wide: bool) -> str:
    value = int.from_bytes(bytes(map(int, entity.split("."))), "big")
    if wide:  # the reserved range, which nobody has
        out = 0xF0000000 | number(entity, key) % (1 << 28)
    elif _public(value):  # walk the permutation until it is public again
        out = permute(value, 1 << 16, 1 << 16, key)
        while not _public(out):
            out = permute(out, 1 << 16, 1 << 16, key)
    else:
        out = (value & ~0xFFFF) | permute(value & 0xFFFF, 256, 256, key)
    return ".".join(map(str, out.to_bytes(4, "big")))


def _ipv6(entity: str, key: bytes) -> str:
    value = int(ipaddress.IPv6Address(entity))
    return str(ipaddress.IPv6Address(value >> 112 << 112 | permute(value & ((1 << 112) - 1), 1 << 56, 1 << 56, key)))


def _date(entity: str, key: bytes) -> str:
    """Another day, before or from 2020 on as the date is: a permutation of the days of either range."""
    first, last = (date(1900, 1, 1), date(2019, 12, 31)) if entity < "2020" else (date(2020, 1, 1), date(2099, 12, 31))
    days = (last - first).days + 1
    side = int(days**0.5) + 1
    at = permute((date.fromisoformat(entity) - first).days, side, side, key)
    while at >= days:
        at = permute(at, side, side, key)
    return (first + timedelta(at)).isoformat()


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of a normal form, in the same format, or from ``WIDE`` attempts on in a wider one."""
    longer = max(0, attempt - WIDE + 1)

    def drawn(n: int) -> str:
        return f"{number(entity, key) % 10**n:0{n}d}"

    if kind in NAMES:
        gender = kind[6:]
        if attempt == 0 and LISTED.get(entity) == gender and kind != "family":
            names = next(ns for ns in GIVEN.values() if entity in ns)
            return list_order(tuple(names), key)[entity]
        return _words(entity, gender, key, attempt // 2)
    if kind == "street":
        return _street(entity, key, attempt // 2)
    if kind == "birth_date":
        return _date(entity, key)
    if kind == "card":
        body = "9" + drawn(len(entity) - 2) if longer else permuted(entity[:-1], ["", *[DIGITS] * (len(entity) - 2)], key)
        return body + str((luhn(body) + int(entity[-1]) - luhn(entity[:-1])) % 10)
    if kind == "phone":
        if longer:
            return "555" + drawn(7) if len(entity) == 10 else "999" + drawn(max(1, len(entity) - 3))
        fixed = {0, 3} if len(entity) == 10 else {0, 1}
        return permuted(entity, ["" if i in fixed else DIGITS for i in range(len(entity))], key)
    if kind == "ssn":
        return "9" + drawn(8) if longer else permuted(entity, ["", *[DIGITS] * (len(entity) - 1)], key)
    if kind == "ip":
        return _ip(entity, key, longer > 0)
    if kind == "ipv6":
        return _ipv6(entity, key)
    if kind == "iban":
        country = "ZZ" if longer else entity[:2]
        account = permuted(entity[4:], by_class(entity[4:]), key)
        off = int(entity[2:4]) - iban_check(entity[:2], entity[4:])  # 0 for a valid one
        return f"{country}{(iban_check(country, account) + off - 2) % 97 + 2:02d}{account}"
    extra = "".join(LOW[c % 26] for c in number(entity, key).to_bytes(32, "big")[: 6 + longer]) if longer else ""
    if kind == "email":
        user, _, host = entity.rpartition("@")
        name, _, top = host.rpartition(".")
        new = permuted(user + name, by_class(user + name), key)
        return f"{new[: len(user)]}{extra}@{new[len(user) :]}.{top}"
    fixed = 4 if entity[:4] in ("AKIA", "ASIA", "ghp_") else 3 if entity[:3] == "sk-" else 0
    return permuted(entity, [""] * fixed + by_class(entity[fixed:], all(x in HEX for x in entity)), key) + extra


def laid_out(kind: str, found: str, entity: str) -> str:
    """A surrogate's normal form, written as the mention is: its separators, country code, order of a date, and capitals."""
    if kind in ("card", "ssn", "phone", "iban"):
        out, left = list(found), list(entity)
        for i in range(len(found) - 1, -1, -1):
            if left and found[i].isalnum():
                out[i] = left.pop()
        return "".join(out)
    if kind == "birth_date":
        day, (_, shape) = date.fromisoformat(entity), parsed_date(found)
        if shape == "named":
            out = re.sub(r"[A-Za-z]+", MONTHS[day.month - 1].capitalize(), found)
            return re.sub(r"\b\d{1,2}\b", str(day.day), re.sub(r"\b\d{4}\b", f"{day.year:04d}", out), count=1)
        order = {"iso": [day.year, day.month, day.day], "month_first": [day.month, day.day, day.year], "day_first": [day.day, day.month, day.year]}[shape]
        numbers = iter(order)
        return re.sub(r"\d+", lambda m: f"{next(numbers):0{len(m.group())}d}", found)
    if kind in NAMES or kind == "street":
        if kind in NAMES and found.isupper() and len(found) > 1:
            return entity.upper()
        own = iter(re.findall(r"[^\W\d_]+", found))
        return re.sub(r"[^\W\d_]+", lambda m: m.group().capitalize() if next(own, "X")[:1].isupper() else m.group(), entity)
    if kind == "email" and len(found) == len(entity):
        return "".join(e.upper() if f.isupper() else e for f, e in zip(found, entity, strict=True))
    return entity
