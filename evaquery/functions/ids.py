"""Identifier functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and what compatibility decomposition leaves of them in ASCII.
ACCENTED = "ÁÀÂÄÃÅáàâäãåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÖÕóòôöõÚÙÛÜúùûüÑñÇçÝýÿ"
PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuNnCcYyy"


def token(value: Column, fallback: str = "ITEM") -> Column:
    """Upper-case ASCII words joined by underscores; ``fallback`` if none is left."""
    ascii_only = F.regexp_replace(F.translate(value, ACCENTED, PLAIN), r"[^\x00-\x7F]+", "")
    made = F.upper(F.regexp_replace(F.regexp_replace(ascii_only, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(made == "", fallback).otherwise(made)


def prefixed(prefix: str, value: Column) -> Column:
    """Prefix and the upper-cased alphanumeric runs of a name, letters of any script kept."""
    made = F.regexp_replace(F.regexp_replace(F.upper(F.trim(value)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")
    return F.when(made == "", prefix).otherwise(F.concat(F.lit(f"{prefix}_"), made))


def reference(layer: Column, container: Column, member: Column) -> Column:
    return F.concat_ws(":", layer, container, member)


def tail(reference_: Column) -> Column:
    """The last segment of a reference: the key it joins on."""
    return F.element_at(F.split(reference_, ":"), -1)


def _renamed(value: Column, old: str, new: str) -> Column:
    return F.when(value.startswith(old), F.concat(F.lit(new), F.substr(value, F.lit(len(old) + 1)))).otherwise(F.concat(F.lit(new), token(value)))


def node_of_cell(cell: Column) -> Column:
    return _renamed(cell, "CS_", "N_")


def edge_of_boundary(boundary: Column) -> Column:
    return _renamed(boundary, "CB_", "E_")


def db_node_of_cell(cell: Column) -> Column:
    """ND- for CS- and digits; null where the id does not match."""
    return F.when(cell.rlike("^CS-[0-9]+$"), F.concat(F.lit("ND-"), F.substr(cell, F.lit(4))))


def db_edge_of_boundary(boundary: Column) -> Column:
    return F.when(boundary.rlike("^CB-[0-9]+$"), F.concat(F.lit("EG-"), F.substr(boundary, F.lit(4))))


def numbered(prefix: str | Column, n: Column, width: int) -> Column:
    """Prefix and the number, zero-padded to ``width`` digits at least."""
    text = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")))


def fixed(prefix: str | Column, n: Column, width: int) -> Column:
    """Prefix and the number in just ``width`` places, as the database's lpad: zeros before a short one, a long one cut at its end."""
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def compact_cell(cell: Column) -> Column:
    return token(F.regexp_replace(cell, "^CS_(L00_)?", ""))


def level_code(level: Column) -> Column:
    """L and two digits for a numbered level, else the level's token; L00 for none."""
    name = F.regexp_replace(F.upper(F.when(F.coalesce(level, F.lit("")) == "", "LEVEL_00").otherwise(level)), "^LEVEL_", "")
    digits = F.regexp_replace(name, "^0+(?=[0-9])", "")
    return F.when(name.rlike("^[0-9]+$"), F.concat(F.lit("L"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))).otherwise(token(name, "L00"))


def display(value: Column, prefixes: list[str]) -> Column:
    """The id without the first of ``prefixes`` that it starts with, in the order given."""
    return F.regexp_replace(value, "^(?:" + "|".join(prefixes) + ")", "")
