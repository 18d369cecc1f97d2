"""Text functions: normalising recognized text, names of photos, display formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings

#: Unicode white space as the recognized text may hold it, in a form that Java and RE2 both read.
WHITE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Hyphens and dashes U+2010 to U+2015, the minus sign and the low line.
DASHES = "‐‑‒–—―−_"
#: Characters a photo's name may not have.
ILLEGAL = '/\\:*?"<>|'


def normalize(raw: Column) -> Column:
    """Recognized text in the form of codes: upper case, plain dashes, no white space, one dash after the first character, no leading zeros."""
    text = F.regexp_replace(F.translate(F.upper(raw), DASHES, "-" * len(DASHES)), WHITE + "+", "")
    dashed = F.regexp_replace(text, r"^(.)([0-9]{1,4})$", "$1-$2")
    return F.regexp_replace(dashed, r"^(.)-0*([0-9]+)$", "$1-$2")


def normal_form(raw: str) -> str:
    """normalize() of one string in plain Python, for code that already runs in a worker."""
    text = "".join(c for c in raw.upper().translate(str.maketrans(DASHES, "-" * len(DASHES))) if not c.isspace())
    if dashed := re.fullmatch(r"(.)([0-9]{1,4})", text):
        text = f"{dashed[1]}-{dashed[2]}"
    if padded := re.fullmatch(r"(.)-0*([0-9]+)", text):
        text = f"{padded[1]}-{padded[2]}"
    return text


def trimmed(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{WHITE}+", ""), f"{WHITE}+$", "")


def stem(path: Column) -> Column:
    """The last component of a path without its last suffix; names that start or end with their only dot stay whole."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]+$", "")


def photo_name(given: Column, path: Column) -> Column:
    """The given photo id, or the image's stem where that is null or empty."""
    return F.coalesce(F.nullif(given, F.lit("")), stem(path))


def name_error(raw: Column, settings: Settings = SETTINGS) -> Column:
    """What is wrong with a photo's name, or null: the first of empty, long, dots, illegal, control, reserved."""
    name = trimmed(raw)
    reserved = r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$"
    return (
        F.when(name == "", F.lit("empty"))
        .when(F.length(name) > settings.longest_name, F.lit("long"))
        .when(name.isin(".", ".."), F.lit("dots"))
        .when(name.rlike(r'[/\\:*?"<>|]'), F.lit("illegal"))
        .when(name.rlike(r"[\x00-\x1f]"), F.lit("control"))
        .when(F.upper(name).rlike(reserved), F.lit("reserved"))
    )


def illegal_found(raw: Column) -> Column:
    """The illegal characters of a name, distinct, in order, as one string."""
    return F.array_join(F.array_sort(F.array_intersect(F.split(trimmed(raw), ""), F.split(F.lit(ILLEGAL), ""))), "")


def percent(part: Column, whole: Column) -> Column:
    """part / whole as a percentage with one decimal; null for nothing at all."""
    return F.when(whole > 0, F.format_string("%.1f%%", 100.0 * part / whole))


def display_date(iso: Column) -> Column:
    """An ISO date and time with a space in place of its T."""
    return F.replace(iso, F.lit("T"), F.lit(" "))
