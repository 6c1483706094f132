"""Coded fields: lists of codes, phases, factors, and the attribution of errors to controllers."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions.text import rx, strip, text_of, texts
from narrata.packs import fixed


def lookup(values: dict[str, str], key: Column) -> Column:
    """The value of ``key``, or null."""
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(values.items()))), key)


def split_codes(c: Column) -> Column:
    """Codes between semicolons, stripped, blank ones left out; null: none."""
    return F.filter(F.transform(F.split(text_of(c), ";"), strip), lambda x: x != "")


def map_phase(c: Column) -> Column:
    """Phase of the first code; unknown codes: Other; no code: Unknown."""
    codes = split_codes(c)
    return F.when(F.size(codes) == 0, fixed.UNKNOWN).otherwise(F.coalesce(lookup(fixed.PHASE_OF_CODE, F.get(codes, F.lit(0))), F.lit("Other")))


def blames_controller(narrative: Column, function: Column) -> Column:
    """Whether the narrator attributes the error to a controller, or is one and tells of an own error."""
    controller = F.arrays_overlap(split_codes(function), texts(fixed.CONTROLLER_FUNCTIONS))
    text = text_of(narrative)
    return text.rlike(rx(fixed.CONTROLLER_ERROR)) | (controller & text.rlike(rx(fixed.OWN_ERROR)))


def map_factor(c: Column, narrative: Column | None = None, function: Column | None = None) -> Column:
    """Factor of the whole code; unknown or no code: Unknown. Human becomes ATC where a controller is to blame."""
    plain = F.coalesce(lookup(fixed.FACTOR_OF_CODE, strip(c)), F.lit(fixed.UNKNOWN))
    if narrative is None:
        return plain
    atc = blames_controller(narrative, F.lit("") if function is None else function)
    return F.when((plain == "Human") & atc, "ATC").otherwise(plain)
