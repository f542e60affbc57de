"""Canonical spellings of record keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_key(c: Column) -> Column:
    """Hexadecimal digits in upper case without hyphens and surrounding blanks; null for blank and all-zero keys."""
    digits = F.upper(F.replace(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("-"), F.lit("")))
    return F.when(~digits.rlike("^0*$"), digits)


def int_key(c: Column) -> Column:
    """The number as text without leading zeros and surrounding blanks; null where it's no number."""
    return F.trim(c.cast("string")).try_cast("bigint").cast("string")


@dataclass(frozen=True)
class KeyKind:
    """How keys of a table are spelled: canonical text, a short binary form for shuffles, and text again from that."""

    text: Callable[[Column], Column]
    pack: Callable[[Column], Column]
    unpack: Callable[[Column], Column]


def _packed(text: Column) -> Column:
    """16 bytes for 32 hexadecimal digits; what isn't such a key stays text, with a mark that keeps it from being 16 bytes long."""
    odd = F.encode(F.concat(F.lit("?"), text), "UTF-8")
    return F.when(text.rlike("^[0-9A-F]{32}$"), F.unhex(text)).when(F.octet_length(odd) != 16, odd).otherwise(F.encode(F.concat(F.lit("??"), text), "UTF-8"))


def _unpacked(c: Column) -> Column:
    return F.when(F.octet_length(c) == 16, F.hex(c)).otherwise(F.regexp_replace(F.decode(c, "UTF-8"), r"^\?\??", ""))


UUID = KeyKind(uuid_key, lambda c: _packed(uuid_key(c)), _unpacked)
NUMBER = KeyKind(int_key, lambda c: F.encode(int_key(c), "UTF-8"), lambda c: F.decode(c, "UTF-8"))
