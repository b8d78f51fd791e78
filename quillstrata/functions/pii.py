"""Detection and masking of personal data as native column expressions.

Patterns are documented here and plain enough to be repeated in another regex dialect. A word edge means
"no ASCII letter, digit or underscore on the other side", independent of the Unicode settings of the runtime.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstrata.functions.slots import hide_slots, interleave, protect_slots
from quillstrata.functions.text import let

# Entity names, their masks, and the default selection.
DEFAULT_ENTITIES = ("EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD")
CONFIGURED_ENTITIES = DEFAULT_ENTITIES + ("CRYPTO", "IP_ADDRESS", "IBAN_CODE")
MASKS = {"EMAIL_ADDRESS": "<EMAIL>", "PHONE_NUMBER": "<PHONE>", "CREDIT_CARD": "<CARD>"}

_OPEN = "(?<![0-9A-Za-z_])"
_CLOSE = "(?![0-9A-Za-z_])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

# Possessive runs only spare backtracking; they accept the same texts as the plain greedy form.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
# North American grouping with an optional country code, or any other "+" number in two to five groups.
PHONE = (
    rf"(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{3}}\)[ .-]?|{_OPEN}[0-9]{{3}}[ .-])[0-9]{{3}}[ .-][0-9]{{4}}{_CLOSE}"
    rf"|\+[0-9]{{1,3}}(?:[ .-][0-9]{{2,4}}){{2,5}}{_CLOSE}"
)
# 13 to 19 digits in groups of four, or 4-6-5.
CARD = (
    rf"{_OPEN}(?:[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{4}}[ -]?[0-9]{{1,7}}|[0-9]{{4}}[ -]?[0-9]{{6}}[ -]?[0-9]{{5}})"
    rf"{_CLOSE}"
)
IP = rf"{_OPEN}(?:{_OCTET}\.){{3}}{_OCTET}{_CLOSE}"
IBAN = rf"{_OPEN}[A-Z]{{2}}[0-9]{{2}}(?:[ -]?[A-Z0-9]{{4}}){{2,7}}(?:[ -]?[A-Z0-9]{{1,3}})?{_CLOSE}"
WALLET = rf"{_OPEN}(?:bc1[a-z0-9]{{25,59}}|[13][1-9A-HJ-NP-Za-km-z]{{25,34}}){_CLOSE}"


def luhn_ok(candidate: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(candidate, "[^0-9]", ""))


def iban_ok(candidate: Column) -> Column:
    """ISO 13616: country and check digits go last, letters count 10 to 35, the whole leaves 1 modulo 97."""
    plain = F.regexp_replace(candidate, "[ -]", "")
    digits = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")

    def step(acc: Column, sign: Column) -> Column:
        number = F.when(sign.rlike("[0-9]"), acc * 10 + F.ascii(sign) - 48).otherwise(
            acc * 100 + F.ascii(sign) - 55
        )
        return F.when(sign == "", acc).otherwise(F.pmod(number, F.lit(97)))

    return F.aggregate(digits, F.lit(0), step) == 1


@dataclass(frozen=True)
class Entity:
    name: str
    pattern: str
    # Cheap text that must occur before the pattern is tried at all.
    hint: Callable[[Column], Column]
    check: Callable[[Column], Column] | None = None

    @property
    def mask(self) -> str:
        return MASKS.get(self.name, f"<{self.name}>")

    def redact(self, text: Column) -> Column:
        def rewrite(t: Column) -> Column:
            if self.check is None:
                return F.regexp_replace(t, self.pattern, self.mask)
            masked = F.transform(
                F.regexp_extract_all(t, F.lit(self.pattern), F.lit(0)),
                lambda hit: F.when(self.check(hit), F.lit(self.mask)).otherwise(hit),
            )
            return interleave(F.split(t, self.pattern), masked)

        return let(text, lambda t: F.when(self.hint(t), rewrite(t)).otherwise(t))

    def count(self, text: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))
        if self.check is not None:
            hits = F.filter(hits, self.check)
        return F.when(self.hint(text), F.size(hits)).otherwise(0)


# In the order in which they are masked: longer, checked forms before the ones they could be taken for.
ENTITIES = [
    Entity("EMAIL_ADDRESS", EMAIL, lambda t: t.contains("@")),
    Entity("CRYPTO", WALLET, lambda t: t.rlike(WALLET)),
    Entity("IBAN_CODE", IBAN, lambda t: t.rlike(IBAN), iban_ok),
    Entity("CREDIT_CARD", CARD, lambda t: t.rlike(CARD), luhn_ok),
    Entity("IP_ADDRESS", IP, lambda t: t.rlike(IP)),
    Entity("PHONE_NUMBER", PHONE, lambda t: t.rlike("[0-9][ .-][0-9]{4}|[+][0-9]")),
]


def _selected(entities: Sequence[str]) -> list[Entity]:
    unknown = set(entities) - {e.name for e in ENTITIES}
    if unknown:
        raise ValueError(f"unknown entities: {sorted(unknown)}")
    return [e for e in ENTITIES if e.name in entities]


def redact(text: Column, entities: Sequence[str] = DEFAULT_ENTITIES) -> Column:
    """Mask the entities without regard to slots."""
    for entity in _selected(entities):
        text = entity.redact(text)
    return text


def redact_email(text: Column) -> Column:
    return redact(text, ["EMAIL_ADDRESS"])


def redact_phone(text: Column) -> Column:
    return redact(text, ["PHONE_NUMBER"])


def redact_card(text: Column) -> Column:
    return redact(text, ["CREDIT_CARD"])


def redact_configured(text: Column) -> Column:
    return redact(text, CONFIGURED_ENTITIES)


def sanitize_text(text: Column, entities: Sequence[str] = DEFAULT_ENTITIES) -> Column:
    """Mask the entities everywhere but inside template slots."""
    return protect_slots(text, lambda t: redact(t, entities))


def detect_pii(text: Column, entities: Sequence[str] = DEFAULT_ENTITIES) -> Column:
    """Entity names, one per hit, in masking order; empty for clean, blank or null text."""

    def walk(t: Column, rest: list[Entity]) -> Column:
        head = F.array_repeat(F.lit(rest[0].name), rest[0].count(t))
        if len(rest) == 1:
            return head
        # Each entity is looked for in what the earlier ones left over.
        return F.concat(head, let(rest[0].redact(t), lambda left: walk(left, rest[1:])))

    found = let(hide_slots(text), lambda t: walk(t, _selected(entities)))
    return F.coalesce(found, F.array().cast("array<string>"))
