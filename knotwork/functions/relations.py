"""Validation of answers that name a relation, as JSON somewhere in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.config import RELATIONS

_SCHEMA = "rel_type string, confidence double, reason string, direction string, _bad string"
DIRECTIONS = ("source_to_target", "target_to_source")


def parsed_relation(text: Column) -> Column:
    """struct(rel_type, confidence, reason, direction), or null if the text holds no valid relation.

    The whole text is tried, else the span from the first { to the last }. The type is one of the known ones in
    any case, the confidence is from 0 to 1, and there are no other keys.
    """
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    raw = F.when(span != "", span)
    x = F.from_json(raw, _SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    kind = F.upper(F.trim(x["rel_type"]))
    extra = F.size(F.array_except(F.json_object_keys(raw), F.array(*map(F.lit, ("rel_type", "confidence", "reason", "direction"))))) > 0
    direction = F.coalesce(x["direction"], F.lit(DIRECTIONS[0]))
    ok = x["_bad"].isNull() & kind.isin(*RELATIONS) & x["confidence"].between(0, 1) & ~F.coalesce(extra, F.lit(True)) & direction.isin(*DIRECTIONS)
    return F.when(ok, F.struct(kind.alias("rel_type"), x["confidence"].alias("confidence"), F.coalesce(x["reason"], F.lit("")).alias("reason"), direction.alias("direction")))
