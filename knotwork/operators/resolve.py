"""Where links lead (R01-R03), as joins with three dictionaries of the notes: by path, by file name and by alias."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.config import ASSETS
from knotwork.functions.text import file_name, parent, stem
from knotwork.operators.joins import lookup_join


def _md(path: Column) -> Column:
    return F.when(F.endswith(path, F.lit(".md")), path).otherwise(F.concat(path, F.lit(".md")))


def _any_end(path: Column, ends: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in ends:
        out = out | F.endswith(F.lower(path), F.lit(e))
    return out


@dataclass
class LinkIndex:
    """paths(key, path), names(key, folder, path, depth), aliases(key, path); key is lower-case."""

    paths: DataFrame
    names: DataFrame
    aliases: DataFrame

    @classmethod
    def of(cls, notes: DataFrame) -> LinkIndex:
        """Of notes(path, aliases). Of paths or aliases that differ only in case, the smallest path is taken."""
        notes = notes.where("path IS NOT NULL")
        distinct = notes.select("path").distinct()
        paths = distinct.groupBy(F.lower("path").alias("key")).agg(F.min("path").alias("path"))
        names = distinct.select(F.lower(stem("path")).alias("key"), parent("path").alias("folder"), "path", F.size(F.split("path", "/")).alias("depth"))
        aliases = notes.select(F.explode("aliases").alias("key"), "path").where("trim(key) <> ''").groupBy(F.lower(F.trim("key")).alias("key")).agg(F.min("path").alias("path"))
        return cls(paths, names, aliases)


def _first_by_path(links: DataFrame, index: LinkIndex, key: Column, name: str) -> DataFrame:
    right = index.paths.withColumnRenamed("key", "__key").withColumnRenamed("path", name)
    return lookup_join(links.withColumn("__key", key), right, "__key").drop("__key")


def resolve_by_name(links: DataFrame, index: LinkIndex) -> DataFrame:
    """links(source_path, target, ...) with target_path, is_unresolved and step, the first step that hits:

    self (no target), root (the path from the vault's root, with or without extension), folder (from the source's
    folder), name (the file name: the only one, else in the same folder, else the least deep, else the smallest
    path), alias, else ghost. Null targets count as empty. A ghost without a folder goes to the source's
    folder; assets keep their extension, other ghosts are notes.
    """
    plain = F.trim(F.coalesce(F.try_url_decode(F.replace(F.trim(F.coalesce("target", F.lit(""))), F.lit("+"), F.lit("%2B"))), F.coalesce("target", F.lit(""))))
    norm = F.regexp_replace(F.regexp_replace(F.replace(plain, F.lit("\\"), F.lit("/")), "^/+", ""), r"^\./", "")
    rows = links.withColumn("__norm", norm).withColumn("__folder", parent("source_path"))
    rows = _first_by_path(rows, index, F.lower(_md(F.col("__norm"))), "__root_md")
    rows = _first_by_path(rows, index, F.lower(F.col("__norm")), "__root")
    rows = _first_by_path(rows, index, F.when(F.col("__folder") != "", F.lower(F.concat("__folder", F.lit("/"), _md(F.col("__norm"))))), "__near")
    base = F.lower(F.regexp_replace(file_name(F.col("__norm")), r"(?i)\.md$", ""))
    rows = rows.withColumn("__base", base)
    # of a file name, the least deep note; and the one note of each folder, so both joins are lookups
    shallow = index.names.groupBy(F.col("key").alias("__base")).agg(F.min(F.struct("depth", "path")).alias("x")).select("__base", F.col("x.path").alias("__shallow"))
    local = index.names.groupBy(F.concat_ws("\u0000", "key", "folder").alias("__local")).agg(F.min("path").alias("__same"))
    rows = lookup_join(rows, shallow, "__base")
    rows = lookup_join(rows.withColumn("__local", F.concat_ws("\u0000", "__base", "__folder")), local, "__local")
    rows = lookup_join(rows.withColumn("__alias", F.lower("__norm")), index.aliases.select(F.col("key").alias("__alias"), F.col("path").alias("__aliased")), "__alias")
    asset = _any_end(F.col("__norm"), ASSETS)
    name = F.when(asset, F.col("__norm")).otherwise(_md(F.col("__norm")))
    ghost = F.when(~F.contains("__norm", F.lit("/")) & (F.col("__folder") != ""), F.concat("__folder", F.lit("/"), name)).otherwise(name)
    none = F.col("__norm") == ""
    found = F.coalesce(F.when(none, F.col("source_path")), "__root_md", "__root", "__near", "__same", "__shallow", "__aliased")
    step = F.when(none, "self").when(F.col("__root_md").isNotNull() | F.col("__root").isNotNull(), "root").when(F.col("__near").isNotNull(), "folder").when(F.col("__shallow").isNotNull(), "name").when(F.col("__aliased").isNotNull(), "alias").otherwise("ghost")
    return rows.select(*links.columns, F.coalesce(found, ghost).alias("target_path"), found.isNull().alias("is_unresolved"), step.alias("step"))


def normal_path(path: Column) -> Column:
    """A path with its . and .. steps taken, as a fold over its parts; .. above the root stay."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))

    def step(done: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != "..")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p)))

    done = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(done == "", F.lit(".")).otherwise(done)


def resolve_by_path(links: DataFrame, index: LinkIndex) -> DataFrame:
    """The same for vaults whose links are strict relative paths; step is self, path or ghost."""
    plain = F.trim(F.coalesce(F.try_url_decode(F.replace(F.trim(F.coalesce("target", F.lit(""))), F.lit("+"), F.lit("%2B"))), F.coalesce("target", F.lit(""))))
    norm = F.trim(F.replace(plain, F.lit("\\"), F.lit("/")))
    joined = F.when(F.startswith(norm, F.lit("/")), F.regexp_replace(norm, "^/+", "")).otherwise(F.concat_ws("/", F.nullif(parent("source_path"), F.lit("")), norm))
    rows = links.withColumn("__norm", norm).withColumn("__path", normal_path(joined))
    known = F.lit(False)
    for e in (".md", ".markdown", ".png", ".jpg", ".svg", ".pdf"):
        known = known | F.endswith("__path", F.lit(e))
    rows = rows.withColumn("__file", F.when(known, F.col("__path")).otherwise(F.concat("__path", F.lit(".md"))))
    rows = _first_by_path(rows, index, F.lower("__file"), "__a")
    rows = _first_by_path(rows, index, F.lower("__path"), "__b")
    none = F.col("__norm") == ""
    found = F.coalesce(F.when(none, F.col("source_path")), "__a", "__b")
    return rows.select(*links.columns, F.coalesce(found, F.col("__file")).alias("target_path"), found.isNull().alias("is_unresolved"), F.when(none, "self").when(found.isNotNull(), "path").otherwise("ghost").alias("step"))
