"""Personal data and secrets: checksums, detectors and replacement by placeholders. PII-01 to PII-29."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import regex

from .text import WS, ascii_word, trim, words_of

MODES = ("pseudonymize", "mask", "redact")
REDACTED = "[CONFIDENTIEL]"
#: Counters whose values are compared by their digits and letters alone.
BY_DIGITS = frozenset({"TELEPHONE", "IBAN", "CARTE_BANCAIRE", "SECURITE_SOCIALE"})

# What each detector looks for.
PEM = r"-----BEGIN[ A-Z_-]*PRIVATE KEY-----[\s\S]*?-----END[ A-Z_-]*PRIVATE KEY-----"
JWT = r"\beyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+\b"
OPENAI = r"\bsk-(?:proj-)?[a-zA-Z0-9_-]{32,}\b"
AWS = r"\b(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])\b"
GITHUB = r"\b(?:ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{82})\b"
WEBHOOK = r"https://(?:hooks\.slack\.com/services/[A-Za-z0-9_/]+|discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+)"
NIR = r"\b[12][\s.-]?\d{2}[\s.-]?(?:0[1-9]|1[0-2]|20)[\s.-]?(?:[0-8]\d|9[0-8]|2A|2B)[\s.-]?\d{3}[\s.-]?\d{3}(?:[\s.-]?\d{2})?\b"
IBAN = r"\b[A-Z]{2}\d{2}(?:[\s-]?[A-Z0-9]{4}){2,7}(?:[\s-]?[A-Z0-9]{1,4})?\b"
CARD = r"\b(?:\d[ -]?){13,19}\b"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE_FR = r"(?:(?:\+|00)33|0)\s*[1-9](?:[\s.-]*\d{2}){4}\b"
PHONE = r"(?<![\w+])\+[1-9]\d{0,2}(?:[\s.-]?\(?\d{1,4}\)?){1,4}[\s.-]?\d{2,4}(?!\d)"
IPV4 = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
NAME_WORD = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
CIVILITIES = r"M\.|Mme|Mlle|Monsieur|Madame|Mademoiselle|Dr\.?|Docteur|Pr\.?|Professeur|Maître|Me|Mr\.?|Mrs\.?|Ms\.?"
ROLES = r"Signé(?:[ \t]+par)?|Salarié|Employé|Collaborateur|Client|Patient|Auteur|Bénéficiaire|Destinataire|Interlocuteur|Contact"

_FULL_NAME = rf"{NAME_WORD}(?:[ \t]+{NAME_WORD}){{1,2}}(?!\p{{L}})"
_CIVIL = regex.compile(rf"(?<!\p{{L}})({CIVILITIES})[ \t]+({_FULL_NAME})")
_ROLE = regex.compile(rf"(?<!\p{{L}})({ROLES})[ \t]*:[ \t]*({_FULL_NAME})", regex.I)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def luhn(text: str) -> bool:
    """PII-01: 13 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = _digits(text)
    if not 13 <= len(digits) <= 19:
        return False
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban(text: str) -> bool:
    """PII-02: country, check digits and account, with remainder 1 by 97 once the first four are last and letters numbers."""
    bare = re.sub(f"[{WS}-]", "", text).upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", bare):
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def nir(text: str) -> bool:
    """PII-03: 13 digits, or 15 whose last two are 97 less the remainder of the others by 97."""
    bare = re.sub(f"[{WS}.-]", "", text)
    if not re.fullmatch("[12][0-9]{12}(?:[0-9]{2})?", bare):
        return False
    return len(bare) == 13 or 97 - int(bare[:13]) % 97 == int(bare[13:])


def _phone_size(text: str) -> bool:
    return 8 <= len(_digits(text)) <= 15


def _routable(text: str) -> bool:
    return int(text.partition(".")[0]) > 0


@dataclass(frozen=True)
class Detector:
    """One kind of entity: the switch it obeys, the counter of its placeholders, its label, and a test of its matches.

    `start` finds, as the last of its matches' first characters less `back`, every place where the pattern may begin, by what
    is rare in prose; only there the pattern is tried. So prose costs one search for a character, whatever is planted in it.
    """

    entity: str
    switch: str
    counter: str
    label: str
    pattern: re.Pattern[str]
    test: Callable[[str], bool] | None = None
    start: re.Pattern[str] | None = None
    back: int = 0

    def starts(self, text: str) -> Iterator[int]:
        """Where the pattern may begin, in order."""
        for m in self.start.finditer(text):
            yield m.start() - self.back

    def sub(self, to: Callable[[re.Match[str]], str], text: str) -> str:
        """As pattern.sub."""
        out: list[str] = []
        last = 0
        for at in self.starts(text):
            if at >= last and (m := self.pattern.match(text, at)):
                out += (text[last:at], to(m))
                last = m.end()
        return "".join(out) + text[last:] if out else text


class _Mail(Detector):
    """Addresses begin anywhere in the run of characters before an @."""

    def starts(self, text: str) -> Iterator[int]:
        for m in self.start.finditer(text):
            at = m.start()
            while at and text[at - 1] in _LOCAL:
                at -= 1
            yield from range(at, m.start())


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What A-Z is where case doesn't count, and a digit with no letter, digit or _ before it.
_ANY_CASE = "A-Za-z\u0130\u0131\u017f\u212a"
_FIRST_DIGIT = "[{d}](?<![A-Za-z0-9_][{d}])"
#: In the order in which they see the text; each sees what those before it have left.
DETECTORS = (
    Detector("private_key", "secrets", "SECRET", "CLE_PRIVEE", ascii_word(PEM, re.I), start=re.compile("-(?=----[bB])")),
    Detector("jwt_token", "secrets", "SECRET", "TOKEN_JWT", ascii_word(JWT), start=re.compile("eyJ")),
    Detector("api_key_openai", "secrets", "SECRET", "API_KEY_OPENAI", ascii_word(OPENAI), start=re.compile("sk-")),
    Detector("aws_key", "secrets", "SECRET", "AWS_ACCESS_KEY", ascii_word(AWS), start=re.compile("AKIA")),
    Detector("github_token", "secrets", "SECRET", "GITHUB_TOKEN", ascii_word(GITHUB), start=re.compile("g(?=hp_|ithub_pat_)")),
    Detector("webhook_secret", "secrets", "SECRET", "WEBHOOK_SECRET", ascii_word(WEBHOOK, re.I), start=re.compile("[hH](?=[tT][tT][pP])")),
    Detector("french_nir", "nir", "SECURITE_SOCIALE", "NIR", ascii_word(NIR, re.I), nir, re.compile(_FIRST_DIGIT.format(d="12"))),
    Detector("iban", "ibans", "IBAN", "IBAN", ascii_word(IBAN, re.I), iban, re.compile(f"[0-9](?<=[{_ANY_CASE}]{{2}}[0-9])(?=[0-9])"), 2),
    Detector("credit_card", "cards", "CARTE_BANCAIRE", "CB", ascii_word(CARD), luhn, re.compile(_FIRST_DIGIT.format(d="0-9") + "(?=[ -]?[0-9])")),
    _Mail("email", "emails", "EMAIL", "EMAIL", ascii_word(EMAIL), start=re.compile("@")),
    Detector("phone_fr", "phones", "TELEPHONE", "TEL", ascii_word(PHONE_FR), start=re.compile("[+0]")),
    Detector("phone_intl", "phones", "TELEPHONE", "TEL", ascii_word(PHONE), _phone_size, re.compile(r"\+(?=[1-9])")),
    Detector("ip_address", "ips", "IP", "ADRESSE_IP", ascii_word(IPV4), _routable, re.compile(_FIRST_DIGIT.format(d="0-9") + r"(?=[0-9]{0,2}\.)")),
)
SWITCHES = ("secrets", "nir", "ibans", "cards", "emails", "phones", "ips", "names")


@dataclass
class Registry:
    """The placeholders of one document: equal values get equal ones, numbered by counter in order of discovery."""

    mode: str = "pseudonymize"
    names: dict[tuple[str, str], str] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)
    originals: dict[str, str] = field(default_factory=dict)
    entities: list[dict] = field(default_factory=list)

    def _same(self, counter: str, value: str) -> str:
        if counter in BY_DIGITS:
            bare = re.sub("[^0-9A-Za-z+]", "", value)
            return re.sub(r"\A(?:(?:00|\+)33|0)", "0", bare).lower()
        return " ".join(words_of(value)).lower()

    def replace(self, entity: str, counter: str, label: str, value: str) -> str:
        if self.mode == "redact":
            out = REDACTED
        elif self.mode == "mask":
            out = f"[{label}]"
        else:
            key = counter, self._same(counter, value)
            if key not in self.names:
                self.counts[counter] = self.counts.get(counter, 0) + 1
                self.names[key] = f"[{label}_{self.counts[counter]}]"
                self.originals[self.names[key]] = trim(value)
            out = self.names[key]
        self.entities.append({"type": entity, "original": value, "placeholder": out})
        return out


def _mask_names(text: str, registry: Registry) -> str:
    found: set[str] = set()

    def named(name: str) -> str:
        found.add(name)
        return registry.replace("person_name", "PERSONNE", "PERSONNE", name)

    text = _CIVIL.sub(lambda m: f"{m[1]} {named(m[2])}", text)
    text = _ROLE.sub(lambda m: f"{m[1]}: {named(m[2])}", text)
    if not found:
        return text
    spaced = (r"[ \t]+".join(regex.escape(w) for w in regex.split(r"[ \t]+", name)) for name in sorted(found, key=lambda n: (-len(n), n)))
    return regex.sub(rf"(?<!\p{{L}})(?:{'|'.join(spaced)})(?!\p{{L}})", lambda m: named(m[0]), text)


def anonymize(text: str | None, mode: str = "pseudonymize", off: tuple[str, ...] = ()) -> dict:
    """PII-28: text with placeholders, entities in order of discovery, counts by type, and originals by placeholder.

    off names switches that are turned off. Null and empty texts hold nothing.
    """
    registry = Registry(mode)
    out = text or ""
    for d in DETECTORS if out else ():
        if d.switch not in off:
            out = d.sub(lambda m, d=d: registry.replace(d.entity, d.counter, d.label, m[0]) if d.test is None or d.test(m[0]) else m[0], out)
    if out and "names" not in off:
        out = _mask_names(out, registry)
    by_type: dict[str, int] = {}
    for e in registry.entities:
        by_type[e["type"]] = by_type.get(e["type"], 0) + 1
    return {"text": out, "entities": registry.entities, "total": len(registry.entities), "by_type": by_type, "originals": registry.originals}


def restore(text: str, originals: dict[str, str]) -> str:
    """PII-29: put originals back for placeholders, the longest first."""
    for name in sorted(originals, key=len, reverse=True):
        text = text.replace(name, originals[name])
    return text


def matches(entity: str, text: str) -> Iterator[str]:
    """What one detector alone would replace."""
    d = next(d for d in DETECTORS if d.entity == entity)
    return (m[0] for m in d.pattern.finditer(text) if d.test is None or d.test(m[0]))
