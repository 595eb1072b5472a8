"""Where a text holds personal data: spans with a kind and the normal form that makes two mentions one entity.

Everything is linear in the text: spans are marked in a byte mask, and bare mentions of a name are found by looking each
word up, however many names the text has.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_right
from collections.abc import Callable
from datetime import date

#: Given names by gender and script; a listed name maps to another of its list.
GIVEN = {
    ("f", "latin"): "anna maria elena laura julia sophie claire marie lucie emma olivia alice sarah jane mary susan linda karen "
    "nancy lisa carmen lucia isabel pilar ingrid helga petra sabine monika greta".split(),
    ("m", "latin"): "john james robert michael david thomas peter paul mark george henry jack daniel martin simon jean pierre luc "
    "michel louis jose juan carlos luis pablo hans karl otto fritz stefan".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья ирина татьяна светлана юлия екатерина".split(),
    ("m", "cyrillic"): "иван пётр сергей алексей дмитрий андрей михаил николай владимир павел".split(),
}
#: Titles by gender.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "г-жа"],
    "m": ["Mr", "Herr", "Señor", "Sr", "Monsieur", "M", "г-н"],
    "": ["Dr", "Prof"],
}
#: Lower-case words inside a name, which stay; kinds of streets, which stay too.
PARTICLES = ["de", "del", "della", "di", "da", "dos", "du", "la", "le", "van", "von", "der", "den", "bin", "al", "el"]
STREETS = [
    "street", "st", "avenue", "ave", "road", "rd", "lane", "ln", "drive", "dr", "boulevard", "blvd", "court", "ct", "square",
    "terrace", "highway", "hwy", "rue", "place", "chemin", "calle", "avenida", "ул", "д",
]
STREET_ENDS = ["straße", "strasse", "weg", "platz", "allee", "gasse"]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DIGITS = "0123456789"

GENDER = {t: g for g, ts in TITLES.items() for t in ts}
LISTED = {name: g for (g, _), names in GIVEN.items() for name in names}
#: Kinds of one class must differ in their surrogates, as a reader sees but the word.
NAMES = ("given_f", "given_m", "given", "family")

_UPPER = r"[^\W\d_a-zß-öø-ÿа-яѐ-џά-ώ]"
_TITLE = "|".join(map(re.escape, sorted((t for t in GENDER if t != "M"), key=len, reverse=True)))
_NAME = rf"(?!(?:{_TITLE})\b){_UPPER}[\w'’-]+"
_PART = "|".join(PARTICLES)
_MONTH = "|".join(m.capitalize() for m in MONTHS)
_TITLED = re.compile(
    rf"(?<!\w)(?:({_TITLE})\.?|(M)\.) +"
    rf"({_NAME}(?: (?:(?:{_PART}) ){{0,2}}{_NAME}){{0,2}})"
)
_TOKEN = re.compile(r"[^\W\d_][\w'’-]*")
_POSSESSIVE = re.compile(r"(?:['’]s|['’-]+)$")
_ISO, _DOTTED = r"\d{4}-\d\d-\d\d", r"\d{1,2}[./]\d{1,2}[./]\d{4}"
_DATE = rf"(?:{_ISO}|{_DOTTED}|\d{{1,2}}\.? (?:{_MONTH}) \d{{4}}|(?:{_MONTH}) \d{{1,2}},? \d{{4}})"
_BORN = r"(?i:\bborn(?: on)?|\bd\.?o\.?b\.?|\bdate of birth|\bbirth ?date|\bgeboren(?: am)?|\bnée? le|\bnacid[oa] el|\bродил(?:ся|ась))"


def _any(*parts: str) -> Callable[[str], bool]:
    return lambda text: any(p in text for p in parts)


def _digits(text: str) -> bool:
    return re.search(r"\d\D{0,2}\d", text) is not None


def _digit(text: str) -> bool:
    return any(d in text for d in DIGITS)


#: Kind, pattern (its first group is the entity), and a quick test without which the pattern cannot match.
PATTERNS: list[tuple[str, re.Pattern, Callable[[str], bool]]] = [
    (
        "secret",
        re.compile(
            r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s*[=:]\s*[\"']?([^\s\"'<>,;]{6,})"
        ),
        _any("=", ":"),
    ),
    (
        "secret",
        re.compile(r"\b((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b"),
        _any("AKIA", "ASIA", "gh", "sk-"),
    ),
    ("email", re.compile(r"(?<![\w.+-])([A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"), _any("@")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b"), _digits),
    ("card", re.compile(r"(?<![\d.+-])([3-6](?:[ -]?\d){12,18})(?![\d-])"), _digits),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]?\d{3,4})(?!\d)"), _any("+")),
    ("phone", re.compile(r"(?<![\w+.-])((?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[.-]\d{4})(?![\d-])"), _digits),
    ("ssn", re.compile(r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])"), _any("-")),
    (
        "ip",
        re.compile(r"(?<![\w.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)"),
        _digit,
    ),
    (
        "ipv6",
        re.compile(r"(?i)(?<![\w:.])((?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![\w:])"),
        lambda text: "::" in text or text.count(":") > 6,
    ),
    ("birth_date", re.compile(rf"{_BORN}[:\s]+({_DATE})(?!\d)"), _digit),
    (
        "street",
        re.compile(
            r"(?<![\w.])(\d{1,5}[A-Za-z]? (?:[A-Z][a-z'’-]+ ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd"
            r"|Court|Ct|Square|Terrace|Highway|Hwy))(?!\w)"
        ),
        _digit,
    ),
    (
        "street",
        re.compile(rf"(?<!\w)([A-ZÄÖÜ][\wäöüß-]*(?:{'|'.join(STREET_ENDS)}) \d{{1,4}}[a-z]?)(?!\w)"),
        _any(*(f"{e} " for e in STREET_ENDS)),
    ),
    (
        "street",
        re.compile(
            r"(?<![\w.])(\d{1,4},? (?:rue|avenue|boulevard|place|chemin|calle|avenida) (?:(?:de|du|des|la|le|del|los) ){0,2}"
            r"[A-ZÀ-Ö][\w'’-]+)(?!\w)"
        ),
        _any("rue ", "avenue ", "boulevard ", "place ", "chemin ", "calle ", "avenida "),
    ),
    ("street", re.compile(r"(?<!\w)(ул\. ?[А-ЯЁ][а-яё]+,? (?:д\. ?)?\d{1,4})(?!\w)"), _any("ул.")),
]


def parsed_date(found: str) -> tuple[date, str] | None:
    """The date that ``found`` writes, and how: iso, by numbers (month first only if the second is over 12), or by name."""
    numbers = [int(x) for x in re.findall(r"\d+", found)]
    try:
        if re.fullmatch(_ISO, found):
            return date(*numbers), "iso"
        if re.fullmatch(_DOTTED, found):
            first, second, year = numbers
            return (date(year, first, second), "month_first") if second > 12 else (date(year, second, first), "day_first")
        day, year = numbers
        return date(year, MONTHS.index(re.search(r"[A-Za-z]+", found)[0].lower()) + 1, day), "named"
    except ValueError:
        return None


def normal(kind: str, found: str) -> str | None:
    """What makes two mentions the same entity; None where the mention cannot be one."""
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "phone":
        digits = re.sub(r"\D", "", found)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "ipv6":
        try:
            return str(ipaddress.IPv6Address(found))
        except ValueError:
            return None
    if kind == "birth_date":
        own = parsed_date(found)
        return own[0].isoformat() if own and 1900 <= own[0].year < 2100 else None
    if kind == "secret":
        return found
    return found.lower() if len(found.lower()) == len(found) else found


Span = tuple[int, int, str, str]


def _titled_words(m: re.Match) -> list[tuple[int, int, str, str]]:
    """The words of a titled name: all but the last are given names, a single one if it is listed as such."""
    gender = GENDER[m.group(1) or m.group(2)]
    words = [(w.start() + m.start(3), w.group()) for w in re.finditer(r"\S+", m.group(3)) if w.group() not in PARTICLES]
    out = []
    for k, (start, word) in enumerate(words):
        word = _POSSESSIVE.sub("", word)
        own = normal("name", word)
        if not word:
            continue
        if k < len(words) - 1 or (len(words) == 1 and own in LISTED):
            g = gender or LISTED.get(own, "")
            out.append((start, start + len(word), f"given_{g}" if g else "given", own))
        else:
            out.append((start, start + len(word), "family", own))
    return out


def detect(text: str | None) -> list[Span]:
    """Start, end, kind and normal form of each entity, in order and without overlaps.

    Names are found behind titles, and then wherever the text repeats a word of theirs bare with a capital, two letters or
    more; such a mention is the entity that was last titled so before it.
    """
    if not text:
        return []
    found: list[Span] = []
    mask: bytearray | None = None

    def add(start: int, end: int, kind: str, entity: str) -> bool:
        nonlocal mask
        if mask is None:
            mask = bytearray(len(text))
        if mask.find(1, start, end) >= 0:
            return False
        mask[start:end] = b"\1" * (end - start)
        found.append((start, end, kind, entity))
        return True

    tested: dict[Callable, bool] = {}
    for kind, pattern, hint in PATTERNS:
        if hint not in tested:
            tested[hint] = hint(text)
        if not tested[hint]:
            continue
        for m in pattern.finditer(text):
            entity = normal(kind, m.group(1))
            if entity is not None:
                add(m.start(1), m.end(1), kind, entity)

    titled: dict[str, list[tuple[int, str, str]]] = {}
    whole: dict[tuple[str, str], tuple[str, str]] = {}  # of a titled word and the one after it, what the first stands for
    for m in _TITLED.finditer(text):
        words = [w for w in _titled_words(m) if add(*w)]
        for start, end, kind, entity in words:
            titled.setdefault(text[start:end].lower(), []).append((start, kind, entity))
        for (a, b, kind, entity), (c, d, _, _) in zip(words, words[1:], strict=False):
            whole[text[a:b].lower(), text[c:d].lower()] = kind, entity
    if titled:
        _add_bare(text, titled, whole, add)
    return sorted(found)


def _add_bare(text: str, titled: dict, whole: dict, add: Callable) -> None:
    """Mentions of titled words without their title. A given name before its family name is that person's."""
    tokens = _TOKEN.finditer(text)
    m = next(tokens, None)
    while m:
        after = next(tokens, None)
        word, follows = _POSSESSIVE.sub("", m.group()), _POSSESSIVE.sub("", after.group()).lower() if after else ""
        pieces = [(m.start(), word)]
        if word.lower() not in titled:
            pieces = [(m.start() + p.start(), p.group()) for p in re.finditer(r"[^'’-]+", word)]
        for start, piece in pieces:
            known = titled.get(piece.lower())
            if known and not piece[0].islower():
                _, kind, entity = known[max(0, bisect_right(known, (start, "", "")) - 1)]
                kind, entity = whole.get((piece.lower(), follows), (kind, entity))
                add(start, start + len(piece), kind, entity)
        m = after
