"""Names, roles and keywords out of paths and header values."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of filters and of frame roles.
FILTERS = {
    "L": "L", "LUM": "L", "LUMINANCE": "L", "R": "R", "RED": "R", "G": "G", "GREEN": "G", "B": "B", "BLUE": "B",
    "HA": "HA", "HALPHA": "HA", "HΑ": "HA", "HYDROGENALPHA": "HA", "O3": "OIII", "OIII": "OIII", "OXYGENIII": "OIII",
    "S2": "SII", "SII": "SII", "SULFURII": "SII", "SULPHURII": "SII", "NOFILTER": "NOFILTER",
}
ROLES = {
    "LIGHT": ("LIGHT", "LIGHTS", "LIGHTFRAME", "LIGHTFRAMES", "SCIENCE", "SCIENCEFRAME", "SCIENCEFRAMES", "OBJECT"),
    "FLAT": ("FLAT", "FLATS", "FLATFRAME", "FLATFRAMES", "FLATFIELD", "FLATFIELDS", "RAWFLAT", "SKYFLAT", "DOMEFLAT", "TWILIGHTFLAT"),
    "MASTER_FLAT": ("MASTERFLAT", "MASTERFLATFRAME", "MASTERFLATFIELD"),
    "DARK": ("DARK", "DARKS", "DARKFRAME", "DARKFRAMES", "DARKFLAT", "DARKFLATS", "FLATDARK", "FLATDARKS"),
    "MASTER_DARK": ("MASTERDARK", "MASTERDARKFRAME", "MASTERDARKFLAT", "MASTERFLATDARK"),
    "BIAS": ("BIAS", "BIASES", "BIASFRAME", "BIASFRAMES", "ZERO", "ZEROS", "ZEROFRAME"),
    "MASTER_BIAS": ("MASTERBIAS", "MASTERBIASFRAME", "MASTERZERO"),
    "MASTER_LIGHT": ("MASTERLIGHT",),
}
FILTERLESS = ("UNKNOWN", "NONE", "UNSPECIFIED")


def folded(c: Column) -> Column:
    """Upper case without marks, blanks and underscores."""
    return F.regexp_replace(F.upper(c), r"[^A-Z0-9]+", "")


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def cleaned(c: Column) -> Column:
    """A header's text without blanks and quotes around it; null for an empty one."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(c), "^['\"]+|['\"]+$", "")), F.lit(""))


def filter_name(c: Column) -> Column:
    """The common name of a filter; any other text is the filter in upper case, and an empty one null."""
    name = F.upper(cleaned(c))
    return F.coalesce(_lookup(F.regexp_replace(name, r"[^\p{L}\p{N}]+", ""), FILTERS), name)


def filter_or_filterless(name: Column) -> Column:
    """The filter of a light or flat: one that names none belongs to the channel NOFILTER."""
    return F.when(name.isNull() | name.isin(*FILTERLESS), "NOFILTER").otherwise(name)


def frame_role(c: Column) -> Column:
    """A name of ROLES, or null: a type that is no calibration role is never taken for a light."""
    return _lookup(folded(c), {word: role for role, words in ROLES.items() for word in words})


def role_in_path(path: Column) -> Column:
    """The role that a path names: a master's name anywhere in the file's, else the last word of the file's name or its three folders."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    # Names of masters, in this order.
    masters = {"MASTERFLATDARK": "MASTER_DARK", "MASTERDARKFLAT": "MASTER_DARK", "MASTERFLAT": "MASTER_FLAT", "MASTERDARK": "MASTER_DARK", "MASTERBIAS": "MASTER_BIAS", "MASTERZERO": "MASTER_BIAS", "MASTERLIGHT": "MASTER_LIGHT"}
    master = F.coalesce(*[F.when(F.contains(folded(stem), F.lit(word)), role) for word, role in masters.items()])
    folders = F.slice(F.reverse(parts), 2, 3)
    words = F.split(F.upper(F.concat_ws("/", F.reverse(folders), stem)), r"[^A-Z0-9]+")
    named = F.filter(F.transform(words, frame_role), lambda r: r.isNotNull())
    return F.coalesce(master, F.element_at(F.when(F.size(named) > 0, named), -1))


def path_keywords(c: Column, names: list[str]) -> Column:
    """Map of the keywords NAME_value, NAME-value or NAME value in a path, by NAME in capitals; the innermost place counts.

    A value may hold letters, digits, blanks and any of -():. and ends at anything else; blanks around it go.
    """
    found = []
    for name in names:
        every = F.regexp_extract_all(c, F.lit(rf"(?i)(?:^|[^A-Za-z0-9]){re.escape(name)}[_\- ]([-():. A-Za-z0-9]+)"), 1)
        values = F.filter(F.transform(every, lambda v: F.trim(v)), lambda v: v != "")
        found.append(F.struct(F.lit(name.upper()).alias("key"), F.element_at(F.when(F.size(values) > 0, values), -1).alias("value")))
    return F.map_from_entries(F.filter(F.array(*found), lambda e: e["value"].isNotNull()))


def seconds_in_name(c: Column) -> Column:
    """An exposure like 300s or 1.5sec in a name, in seconds."""
    return F.regexp_extract(c, r"(?i)(?:^|[_\- ])([0-9]+(?:\.[0-9]+)?) ?s(?:ec)?(?:$|[_\-. ])", 1).try_cast("double")


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet will not take for a formula."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def redacted_path(c: Column) -> Column:
    """The last two parts of a path."""
    return F.regexp_extract(c, r"([^/]*/?[^/]*)$", 1)


def innermost(c: Column) -> Column:
    """The last part of a path that is not empty."""
    return F.element_at(F.filter(F.split(c, "/"), lambda x: x != ""), -1)
