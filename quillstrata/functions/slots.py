"""Template slots such as ``{{Order Number}}``: finding them and keeping them out of a rewrite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstrata.functions.text import let

# Fixed patterns. A nested opening brace stays part of the name, as in "{{{{a}}": "{{a".
SLOT = r"\{\{[^}]+\}\}"
SLOT_NAME = r"\{\{([^}]+)\}\}"

# A private-use sign stands in for a slot. One that is already in the text is handled like a slot and comes back
# unchanged, so no stand-in can collide.
_STAND_IN = "\ue000"
_HIDDEN = rf"{SLOT}|{_STAND_IN}"


def slot_names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SLOT_NAME), F.lit(1))


def has_slot(text: Column) -> Column:
    return text.rlike(SLOT)


def hide_slots(text: Column) -> Column:
    return F.regexp_replace(text, _HIDDEN, _STAND_IN)


def interleave(pieces: Column, fillers: Column) -> Column:
    """piece, filler, piece, ... — ``pieces`` has one element more than ``fillers``."""
    return F.array_join(
        F.flatten(
            F.zip_with(pieces, fillers, lambda piece, filler: F.array(piece, F.coalesce(filler, F.lit(""))))
        ),
        "",
    )


def protect_slots(text: Column, rewrite) -> Column:
    """Apply ``rewrite`` (Column -> Column) to everything outside the slots."""

    def guarded(t: Column) -> Column:
        restored = interleave(
            F.split(rewrite(hide_slots(t)), _STAND_IN),
            F.regexp_extract_all(t, F.lit(_HIDDEN), F.lit(0)),
        )
        return F.when(t.rlike(_HIDDEN), restored).otherwise(rewrite(t))

    return let(text, guarded)
