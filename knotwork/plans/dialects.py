"""Dialects of vaults (R04-R06): what is ignored, how titles are chosen and how links are resolved, as expressions."""

from __future__ import annotations

from pathlib import Path
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.config import EXTENSIONS, IGNORED_FOLDERS, SITE_FOLDERS
from knotwork.functions.text import file_name, note_title
from knotwork.operators.resolve import LinkIndex, resolve_by_name, resolve_by_path


@runtime_checkable
class Dialect(Protocol):
    name: str

    def can_handle(self, root: str) -> bool: ...

    def keeps(self, path: Column) -> Column: ...

    def title(self, given: Column, path: Column, body: Column) -> Column: ...

    def resolve(self, links: DataFrame, index: LinkIndex) -> DataFrame: ...


def _keeps(path: Column, folders: tuple[str, ...], ignored: tuple[str, ...] = ()) -> Column:
    """No ignored or hidden folder on the way, and a visible file of a known kind (in lower case only)."""
    steps = F.split(path, "/")
    way = F.slice(steps, 1, F.size(steps) - 1)
    hidden = F.exists(way, lambda p: p.isin(*folders) | F.startswith(p, F.lit(".")))
    name = file_name(path)
    ends = F.lit(False)
    for e in EXTENSIONS:
        ends = ends | F.endswith(name, F.lit(e))
    return ~hidden & ~F.startswith(name, F.lit(".")) & ends & (~name.isin(*ignored) if ignored else F.lit(True))


class NameLinks:
    """[[name]] links, found anywhere in the vault."""

    name = "obsidian"

    def __init__(self, ignored_files: tuple[str, ...] = ()):
        self.ignored_files = ignored_files

    def can_handle(self, root: str) -> bool:
        return any((Path(root) / x).exists() for x in (".obsidian", "site-options.json", "publish.css"))

    def keeps(self, path: Column) -> Column:
        return _keeps(path, IGNORED_FOLDERS, self.ignored_files)

    def title(self, given: Column, path: Column, body: Column) -> Column:
        return note_title(given, path, body)

    def resolve(self, links: DataFrame, index: LinkIndex) -> DataFrame:
        return resolve_by_name(links, index)


class PathLinks:
    """[text](relative/path.md) links."""

    name = "commonmark"

    def __init__(self, ignored_files: tuple[str, ...] = ()):
        self.ignored_files = ignored_files

    def can_handle(self, root: str) -> bool:
        return not (Path(root) / ".obsidian").exists()

    def keeps(self, path: Column) -> Column:
        return _keeps(path, (*IGNORED_FOLDERS, *SITE_FOLDERS), self.ignored_files)

    def title(self, given: Column, path: Column, body: Column) -> Column:
        return note_title(given, path)

    def resolve(self, links: DataFrame, index: LinkIndex) -> DataFrame:
        return resolve_by_path(links, index)


_known: dict[str, Dialect] = {d.name: d for d in (NameLinks(), PathLinks())}


def register(dialect: Dialect) -> None:
    if not isinstance(dialect, Dialect):
        raise TypeError("not a dialect")
    _known[dialect.name] = dialect


def names() -> list[str]:
    return sorted(_known)


def get(name: str) -> Dialect:
    if name.lower() not in _known:
        raise ValueError(f"unknown dialect {name}; known are {', '.join(names())}")
    return _known[name.lower()]


def detect(root: str, preferred: str | None = None) -> Dialect:
    """The one preferred, else one whose marks are in the folder, else strict paths if nothing speaks against them."""
    if preferred and preferred != "auto":
        return get(preferred)
    for name in names():
        if name != "commonmark" and _known[name].can_handle(root):
            return _known[name]
    return _known["commonmark"] if _known["commonmark"].can_handle(root) else _known["obsidian"]
