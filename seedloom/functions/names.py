"""Names, headers and categories as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = "__MISSING__"


def parse_mature_id(name: Column) -> Column:
    """First of a ``;`` or ``,`` list, without its arm."""
    first = F.trim(F.element_at(F.split(name, "[;,]"), 1))
    return F.regexp_replace(first, "_[35]p[*]*$", "")


def parse_reference_id(name: Column) -> Column:
    """The mature id without its variant number."""
    return F.regexp_replace(parse_mature_id(name), "-v[0-9]+$", "")


def parse_mature_header(header: Column) -> Column:
    """Struct of arm, species and precursor id of a header like ``Hsa-Let-7-P1b_5p``; null arm if it names none."""
    arm = F.nullif(F.regexp_extract(header, "_([35]p)[*]*$", 1), F.lit(""))
    precursor = parse_mature_id(header)
    return F.struct(arm.alias("arm"), F.element_at(F.split(precursor, "-"), 1).alias("species"), precursor.alias("precursor_id"))


def strip_pri_pre(name: Column) -> Column:
    """A name without its ``_pri`` or ``_pre`` ending."""
    return F.regexp_replace(name, "_(?:pri|pre)$", "")


def parse_species_name(text: Column) -> Column:
    """Struct of common and scientific name; the last parenthesis is the scientific one, null without it."""
    scientific = F.nullif(F.trim(F.regexp_extract(text, r"^.*\(([^()]+)\)[^()]*$", 1)), F.lit(""))
    common = F.trim(F.regexp_replace(text, r"\([^()]+\)[^()]*$", ""))
    return F.struct(common.alias("common_name"), scientific.alias("scientific_name"))


def lineage_array(text: Column) -> Column:
    """``;``-separated lineage, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def normalize_category(value: Column) -> Column:
    """Trimmed category; missing tokens in any case, empty and null become one token."""
    clean = F.trim(value)
    return F.when(clean.isNull() | F.upper(clean).isin("", "NA", "NAN", "NONE", "NULL"), MISSING).otherwise(clean)


def profile_id(*parts: Column) -> Column:
    """A stable id from a sequence and its scores."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
