"""Helpers on column and dataset names. They see metadata only, never rows."""

from __future__ import annotations

import re

# --- fixed values -----------------------------------------------------------
KEY_SUFFIXES = ("_id", "_code", "_key", "_ref", "_no", "_num")
KEY_PREFIXES = ("fk_", "ref_")
IRREGULAR_PLURALS = {
    "people": "person", "children": "child", "men": "man", "women": "woman",
    "teeth": "tooth", "feet": "foot", "mice": "mouse", "geese": "goose",
}
# ----------------------------------------------------------------------------


def snake_case(name: str | None) -> str:
    """``customerId`` -> ``customer_id``; anything but letters and digits becomes ``_``."""
    text = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", (name or "").strip())
    return re.sub(r"[^A-Za-z0-9]+", "_", text).lower().strip("_")


def tokenize_name(name: str | None) -> list[str]:
    return [t for t in snake_case(name).split("_") if t]


def plain_name(name: str | None) -> str:
    """Lower case with runs of other characters as one ``_``; edges are kept."""
    return re.sub(r"[^a-z0-9]+", "_", (name or "").lower())


def has_name_token(name: str | None, tokens) -> bool:
    """True when one of ``tokens`` stands between ``_`` or edges of the name."""
    padded = f"_{plain_name(name)}_"
    return any(f"_{t.lower()}_" in padded for t in tokens)


def base_entity(name: str) -> str:
    """``fk_customer_id`` -> ``customer``."""
    base = snake_case(name)
    suffix = next((s for s in KEY_SUFFIXES if base.endswith(s)), "")
    base = base[: len(base) - len(suffix)]
    prefix = next((p for p in KEY_PREFIXES if base.startswith(p)), "")
    return base[len(prefix):]


def singular(token: str) -> str:
    if token in IRREGULAR_PLURALS:
        return IRREGULAR_PLURALS[token]
    for ending, cut, add in (
        ("ies", 3, "y"), ("ves", 3, "f"),
        ("ses", 2, ""), ("xes", 2, ""), ("zes", 2, ""), ("ches", 2, ""), ("shes", 2, ""),
    ):
        if token.endswith(ending):
            return token[:-cut] + add
    return token[:-1] if token.endswith("s") and len(token) > 3 else token


def is_generic_id(name: str) -> bool:
    return snake_case(name) == "id"


def is_key_like(name: str) -> bool:
    return snake_case(name).endswith(KEY_SUFFIXES)


def points_to(column: str, dataset: str) -> bool:
    """Every token of the column's entity occurs, in singular, in the dataset's name."""
    wanted = tokenize_name(base_entity(column))
    present = {singular(t) for t in tokenize_name(dataset)}
    return bool(wanted) and all(t in present or singular(t) in present for t in wanted)


def is_primary_key(column: str, dataset: str) -> bool:
    return is_generic_id(column) or (is_key_like(column) and points_to(column, dataset))


def is_foreign_key(column: str, dataset: str) -> bool:
    return is_key_like(column) and not is_primary_key(column, dataset)
