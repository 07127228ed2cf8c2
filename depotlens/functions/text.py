"""Lot extraction, keyword triggers, excerpts and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shape of a lot code, e.g. ``DL-0441`` or ``RLT-2024-0891``.
LOT_PATTERN = r"[A-Z]{2,4}-[0-9]{4}(-[0-9]{4})?"

# Substrings of a lower-cased reply that fire each agent's action loop.
TRIGGERS = {
    "equipment": ["critical", "dispatch", "compressor", "immediate", "within 1 hour", "maintenance"],
    "safety": ["quarantine", "recall", "rlt-2024-0891", "class ii", "isolate"],
    "forecasting": ["markdown", "salmon", "spoilage", "expiry", "discount", "price"],
}

# A forecasting reply must also mention one of these.
PRICE_WORDS = ["%", "price", "discount", "markdown"]

LOOP_OF_AGENT = {
    "equipment": "equipment_dispatch",
    "safety": "wms_quarantine",
    "forecasting": "pos_markdown",
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def normalise_lot(lot) -> Column:
    return F.upper(F.trim(F.replace(_c(lot), F.lit("#"), F.lit(""))))


def extract_lots(text) -> Column:
    """Distinct normalised lot codes in free text."""
    return F.array_distinct(F.regexp_extract_all(F.upper(_c(text)), F.lit(LOT_PATTERN), F.lit(0)))


def reasoning_excerpt(text, length: int = 180) -> Column:
    """First ``length`` characters with an ellipsis that is always appended."""
    return F.concat(F.substring(F.coalesce(_c(text), F.lit("")), 1, length), F.lit("…"))


def _any_of(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def trigger_match(agent, text, triggers: dict[str, list[str]] | None = None,
                  price_words: list[str] | None = None) -> Column:
    """The loop a reply fires, or null. Plain substring tests; one loop at most, chosen by agent."""
    agent, lower = _c(agent), F.lower(_c(text))
    triggers = TRIGGERS if triggers is None else triggers
    price_words = PRICE_WORDS if price_words is None else price_words
    loop = F.lit(None).cast("string")
    for name, words in triggers.items():
        hit = _any_of(lower, words)
        if name == "forecasting":
            hit = hit & _any_of(lower, price_words)
        loop = F.when((agent == name) & hit, LOOP_OF_AGENT[name]).otherwise(loop)
    return loop


def action_key(prefix: str, *parts) -> Column:
    """Replay-stable id: the prefix and a 128-bit hash of the trigger key.

    Two differently salted 64-bit hashes, because one alone would collide among billions of actions.
    """
    key = [_c(p) for p in parts]
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(n), *key)), 16, "0") for n in (1, 2)]
    return F.concat(F.lit(f"{prefix}-"), *halves)


def tokens(text) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def spaced_tokens(text) -> Column:
    """The ``tokens`` in one string, a single space behind each (and one space alone if there are none)."""
    return F.concat(F.trim(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
