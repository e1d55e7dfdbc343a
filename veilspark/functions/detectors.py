"""The personal-data detectors: an ordered registry, which can be added to; earlier types claim their characters first."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

from .checks import aba_ok, iban_ok, luhn_ok

#: Any white space of JavaScript's \s, inside and outside a character class (fixed values).
WS = r"\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_S = f"[{WS}]"
#: Months, titles and labels, organisation suffixes, and pairs that are no names (fixed values).
MONTHS = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.?"
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Dame|Judge|Justice|Hon|Officer|Det|Detective|Sgt|Lt|Capt|Rev|Atty|Attorney|Name|Client|Defendant|Plaintiff|Witness|Applicant|Customer|Patient|Employee|Tenant|Landlord|Claimant|Respondent|Suspect|Victim|Complainant"
SUFFIXES = r"Inc|Incorporated|LLC|L\.L\.C|Ltd|Limited|Corp|Corporation|GmbH|PLC|LLP|LP|Co|Company|Holdings|Group|Partners|Bank|Trust"
STOP_PAIRS = frozenset(
    (
        "United States", "United Kingdom", "New York", "New Jersey", "New Hampshire", "New Mexico", "North Carolina", "South Carolina", "North Dakota", "South Dakota", "West Virginia", "Rhode Island", "Supreme Court",
        "District Court", "High Court", "Crown Court", "Court of Appeal", "Federal Court", "European Union", "Hong Kong", "Los Angeles", "San Francisco", "Las Vegas", "Social Security", "Internal Revenue",
    )
)
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_CAP = "[A-Z][a-z'\u2019-]+"
_PART = rf"(?:{_CAP}|[A-Z]\.)"


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


@dataclass(frozen=True)
class Detector:
    """pattern: for re.ASCII; check: keeps or drops a match, which is consumed either way; group: the part that is the span."""

    id: str
    token: str
    pattern: str = ""
    on: bool = True
    check: Callable[[str], bool] | None = None
    group: int = 0
    compact: bool = False  #: whether values are compared without separators


#: Formats of identifiers (fixed values: ids, tokens, patterns, order).
DETECTORS = (
    Detector("custom", "TERM"),
    Detector("card", "CARD", r"\b(?:\d[ -]?){12,18}\d\b", check=lambda m: 13 <= len(_digits(m)) <= 19 and luhn_ok(_digits(m)), compact=True),
    Detector("iban", "IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", check=iban_ok, compact=True),
    Detector("ssn", "SSN", r"\b(?!000|666|9\d\d)\d{3}[- ](?!00)\d{2}[- ](?!0000)\d{4}\b", compact=True),
    Detector("routing", "ROUTING", r"\b\d{9}\b", check=aba_ok, compact=True),
    Detector("email", "EMAIL", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    Detector("phone", "PHONE", rf"(?<![\d-])(?:\+\d{{1,3}}[{WS}.-]?)?(?:\(\d{{2,4}}\)[{WS}.-]?|\d{{2,4}}[{WS}.-])\d{{3,4}}[{WS}.-]?\d{{3,4}}(?![\d-])", check=lambda m: 10 <= len(_digits(m)) <= 15, compact=True),
    Detector("ipv4", "IP", rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", compact=True),
    Detector("ipv6", "IP", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", compact=True),
    Detector("secret", "KEY", r"\b(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|sk-[A-Za-z0-9_-]{20,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b"),
    Detector("date", "DATE", rf"\b(?:\d{{1,2}}[/.-]\d{{1,2}}[/.-](?:\d{{4}}|\d{{2}})|\d{{4}}-\d{{2}}-\d{{2}}|{MONTHS} \d{{1,2}},? \d{{4}}|\d{{1,2}}(?:st|nd|rd|th)? {MONTHS},? \d{{4}})\b"),
    Detector("url", "URL", rf"\bhttps?://[^{WS}<>\"')\]]+", on=False),
    Detector("uspostal", "ZIP", r"\b\d{5}(?:-\d{4})?\b", on=False),
    Detector("ukpostal", "POSTCODE", r"\b[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}\b", on=False),
    Detector("org", "ORG", rf"\b(?:[A-Z][A-Za-z&'.-]*{_S}){{0,4}}[A-Z][A-Za-z&'.-]*,?{_S}(?:{SUFFIXES})(?!\w)"),
    Detector("name", "NAME", rf"\b(?:{TITLES})\.?:?{_S}+({_PART}(?:{_S}{_PART}){{0,3}})", group=1),
    Detector("capnames", "NAME", rf"\b{_CAP}{_S}{_CAP}(?:{_S}{_CAP})?\b", on=False, check=lambda m: m not in STOP_PAIRS),
)
_registered: list[tuple[Detector, str | None]] = []


def register(detector: Detector, before: str | None = None) -> None:
    """Adds a type. It claims its characters before the type named (which may be a registered one), else after all others."""
    if detector.id in by_id():
        raise ValueError(f"there is a detector {detector.id} already")
    if before is not None and before not in by_id():
        raise ValueError(f"unknown detector: {before}")
    re.compile(detector.pattern, re.ASCII)
    _registered.append((detector, before))


def unregister(name: str) -> None:
    """Takes a registered type out again, and lets those that were to stand before it stand last."""
    kept = [(d, None if before == name else before) for d, before in _registered if d.id != name]
    if len(kept) == len(_registered):
        raise ValueError(f"no registered detector {name}")
    _registered[:] = kept


def ordered() -> list[Detector]:
    """All types in priority order."""
    out = list(DETECTORS)
    for d, before in _registered:
        out.insert(len(out) if before is None else next(i for i, x in enumerate(out) if x.id == before), d)
    return out


def by_id() -> dict[str, Detector]:
    return {d.id: d for d in ordered()}


BY_ID = {d.id: d for d in DETECTORS}
DEFAULTS = tuple(d.id for d in DETECTORS if d.on)


@cache
def _same_letter() -> dict[str, str]:
    """Letters beyond ASCII that are one but for case, as a character class each: those of one upper-case character."""
    upper: dict[str, list[str]] = {}
    for c in map(chr, range(0x80, 0x10000)):
        u = c.upper()
        upper.setdefault(u if len(u) == 1 and u >= "\x80" else c, []).append(c)
    return {c: f"[{''.join(same)}]" for same in upper.values() if len(same) > 1 for c in same}


def term_pattern(term: str) -> str:
    """A custom term in any case, bounded by ASCII word boundaries where it starts or ends with a word character."""
    letters = [f"[{c.lower()}{c.upper()}]" if c.isascii() and c.isalpha() else re.escape(c) if c.isascii() else _same_letter().get(c, c) for c in term]
    word = "[A-Za-z0-9_]"
    return (rf"(?<!{word})" if re.match(word, term) else "") + "".join(letters) + (rf"(?!{word})" if re.match(word, term[-1]) else "")


@dataclass(frozen=True)
class Chosen:
    """The enabled detectors in priority order with their patterns, custom terms the longest first: what tasks need, by value."""

    detectors: tuple[Detector, ...]
    terms: tuple[str, ...] = ()

    def compiled(self) -> list[tuple[Detector, re.Pattern]]:
        """Disabled detectors are never compiled."""
        out = []
        for d in self.detectors:
            out += [(d, re.compile(term_pattern(t))) for t in self.terms] if d.id == "custom" else [(d, re.compile(d.pattern, re.ASCII))]
        return out


def choose(types=None, terms=()) -> Chosen:
    """By default the types that are on; unknown ones are an error. A Detector among the types stands in for the one of its id."""
    known = ordered()
    given = None if types is None else list(types)
    own = {t.id: t for t in given or () if isinstance(t, Detector)}
    enabled = {d.id for d in known if d.on} if given is None else {t.id if isinstance(t, Detector) else t for t in given}
    if unknown := enabled - {d.id for d in known}:
        raise ValueError(f"unknown detector: {', '.join(sorted(unknown))}")
    blank = codecs.decode(WS, "unicode_escape")
    kept = sorted((t.strip(blank) for t in terms if t and t.strip(blank)), key=len, reverse=True)
    return Chosen(tuple(own.get(d.id, d) for d in known if d.id in enabled), tuple(kept))


def compiled(types=None, terms=()) -> list[tuple[Detector, re.Pattern]]:
    return choose(types, terms).compiled()


def normalize(kind: Detector | str, text: str, strict_compat: bool = False) -> str:
    """The form in which two values are the same. Dots of IP addresses stay unless strict_compat."""
    d = kind if isinstance(kind, Detector) else by_id().get(kind)
    if d and d.compact:
        drop = rf"[{WS}()-]" if d.id.startswith("ip") and not strict_compat else rf"[{WS}.()-]"
        return re.sub(drop, "", text).lower()
    return re.sub(f"{_S}+", " ", text).strip().lower()


def token_for(kind: str) -> str:
    known = by_id()
    return known[kind].token if kind in known else kind.upper()
