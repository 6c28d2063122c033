"""Frontmatter of notes: the only part of parsing that needs a YAML reader, and so Python."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

try:
    import yaml
except ImportError:
    yaml = None

SCHEMA = T.StructType([T.StructField("title", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("raw", T.StringType()), T.StructField("body", T.StringType())])
_CLOSE = re.compile(r"^---\s*$", re.MULTILINE)


def split_frontmatter(content: str) -> tuple[dict, str, str]:
    """(values, raw YAML, body). Malformed or missing frontmatter gives ({}, '', all of it). Without a YAML reader, an error."""
    if yaml is None:
        raise ImportError("frontmatter needs PyYAML; without it titles, tags, aliases and links would be lost")
    content = content.lstrip("﻿")
    if not content.startswith("---"):
        return {}, "", content
    rest = content[3:]
    close = _CLOSE.search(rest)
    if close is None:
        return {}, "", content
    try:
        values = yaml.load(rest[: close.start()], getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except Exception:
        return {}, "", content
    return (values, rest[: close.start()], rest[close.end() :]) if isinstance(values, dict) else ({}, "", content)


def names(given: object, strip_hash: bool = False) -> list[str]:
    """Sorted distinct names of a list or a comma-separated string."""
    parts = [str(x) for x in given if x is not None] if isinstance(given, list) else given.split(",") if isinstance(given, str) else []
    return sorted({y for x in parts if (y := (x.lstrip("#") if strip_hash else x).strip())})


@F.pandas_udf(SCHEMA)
def _parse(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in contents:
        rows = []
        for content in s:
            values, raw, body = split_frontmatter(content or "")
            title = values.get("title")
            rows.append((None if title is None else str(title), names(values.get("aliases") or values.get("alias")), names(values.get("tags") or values.get("tag"), True), raw, body))
        yield pd.DataFrame(rows, columns=["title", "aliases", "tags", "raw", "body"])


def frontmatter(content: Column) -> Column:
    """struct(title, aliases, tags, raw, body). Give it only contents that begin with ---; others have none."""
    return _parse(content)
