"""Column functions over notes' text and paths. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The syntax of notes. The code patterns are masked before the others are looked for.
FENCES = r"(?s)```.*?```|~~~.*?~~~"
INLINE_CODE = r"`[^`\n]+`"
NOTE_LINK = r"(!)?\[\[([^\[\]|\n#]+)?(?:#([^\[\]|\n]+))?(?:\|([^\[\]|\n]+))?\]\]"
PAGE_LINK = r"(!)?\[([^\]\n]+)\]\(([^)\n]+)\)"
TAG = r"(?:^|[\s(\[{])#([a-zA-Z0-9_\-/]*[a-zA-Z_\-/][a-zA-Z0-9_\-/]*)"
HEADING = r"^(#{1,6})\s+(.*)$"
FIRST_HEADING = r"(?m)^#\s+(.+)$"
EXTERNAL = r"^(http://|https://|mailto:|ftp://)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mask_code(text: Column | str) -> Column:
    """Without fenced blocks and inline code."""
    return F.regexp_replace(F.regexp_replace(_c(text), FENCES, ""), INLINE_CODE, "")


def mask_links(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), NOTE_LINK, ""), PAGE_LINK, "")


def clean_names(values: Column, strip_hash: bool = False) -> Column:
    """Trimmed, without empty ones, distinct and sorted; for tags also without leading #."""

    def one(x: Column) -> Column:
        return F.trim(F.regexp_replace(x, "^#+", "") if strip_hash else x)

    return F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(values, lambda x: x.isNotNull()), one), lambda x: x != "")))


def inline_tags(text: Column | str, also: Column | None = None) -> Column:
    """Sorted distinct tags of a body (code is masked by the caller), with those of the frontmatter."""
    found = F.regexp_extract_all(mask_links(text), F.lit(TAG), F.lit(1))
    found = F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"[.,;!?:]+$", "")), lambda t: t != "")
    return F.array_sort(F.array_distinct(F.array_union(found, also) if also is not None else found))


def _unquoted(x: Column) -> Column:
    """Percent escapes resolved; a plus stays a plus. What is not well-formed stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def _part(raw: Column, pattern: str, group: int) -> Column:
    return F.coalesce(F.regexp_extract(raw, pattern, group), F.lit(""))


def note_links(text: Column | str) -> Column:
    """Array of structs target, anchor, alias, is_embed, raw_text of [[target#anchor|alias]] links, in order."""
    raws = F.regexp_extract_all(_c(text), F.lit(NOTE_LINK), F.lit(0))
    return F.transform(
        raws,
        lambda r: F.struct(
            F.trim(_part(r, NOTE_LINK, 2)).alias("target"),
            F.trim(_part(r, NOTE_LINK, 3)).alias("anchor"),
            F.trim(_part(r, NOTE_LINK, 4)).alias("alias"),
            F.startswith(r, F.lit("!")).alias("is_embed"),
            r.alias("raw_text"),
        ),
    )


def page_links(text: Column | str) -> Column:
    """The same of [alias](target#anchor) links; those to other sites are left out."""
    raws = F.regexp_extract_all(_c(text), F.lit(PAGE_LINK), F.lit(0))

    def one(r: Column) -> Column:
        dest = F.trim(_part(r, PAGE_LINK, 3))
        cut = F.instr(dest, "#")
        target = F.when(cut > 0, F.substring_index(dest, "#", 1)).otherwise(dest)
        anchor = F.when(cut > 0, F.substr(dest, cut + 1)).otherwise(F.lit(""))
        return F.struct(_unquoted(F.trim(target)).alias("target"), _unquoted(F.trim(anchor)).alias("anchor"), F.trim(_part(r, PAGE_LINK, 2)).alias("alias"), F.startswith(r, F.lit("!")).alias("is_embed"), r.alias("raw_text"))

    inner = F.filter(raws, lambda r: ~F.trim(_part(r, PAGE_LINK, 3)).rlike(EXTERNAL))
    return F.filter(F.transform(inner, one), lambda x: (x["target"] != "") | (x["anchor"] != ""))


def all_links(text: Column | str) -> Column:
    """Both kinds in document order.

    Places are found by cutting the text at each link: a link's place is the length of what stands before
    it, and a text has few links, so this stays an array fold in the JVM.
    """
    text = _c(text)
    either = f"(?:{NOTE_LINK})|(?:{PAGE_LINK})"
    raws = F.regexp_extract_all(text, F.lit(either), F.lit(0))
    one = F.transform(raws, lambda r: F.when(r.rlike(r"^!?\[\["), F.element_at(note_links(r), 1)).otherwise(F.try_element_at(page_links(r), F.lit(1))))
    return F.filter(one, lambda x: x.isNotNull())


def first_heading(text: Column | str) -> Column:
    """The text of the first first-level heading, or null."""
    return F.nullif(F.trim(F.regexp_extract(mask_code(text), FIRST_HEADING, 1)), F.lit(""))


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """The file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^./]*$", "")


def parent(path: Column | str) -> Column:
    """The folder of a path, '' at the root."""
    path = _c(path)
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def note_folder(path: Column | str) -> Column:
    """The folder a note stands in, without empty steps and single dots; '' at the root."""
    steps = F.filter(F.split(_c(path), "/"), lambda p: (p != "") & (p != "."))
    return F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0))), "/")


def note_title(given: Column | str, path: Column | str, text: Column | str | None = None) -> Column:
    """Title of the frontmatter, else (where headings count) the first heading, else the stem."""
    parts = [F.nullif(F.trim(_c(given)), F.lit(""))]
    if text is not None:
        parts.append(first_heading(text))
    return F.coalesce(*parts, stem(path))


def word_estimate(text: Column | str) -> Column:
    """Words by white space, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(_c(text), F.lit(r"(?U)\S+")))


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_c(text)) / 3.8).cast("int") + 10)


def eval_path(path: Column | str) -> Column:
    return F.lower(F.regexp_replace(F.trim(_c(path)), "^/+", ""))


def search_terms(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda t: t != "")


def outline(text: Column | str) -> Column:
    """Array of structs line (from 1), level, title of the lines that are headings; code is not masked."""
    lines = F.transform(F.split(_c(text), "\r\n|\r|\n"), lambda s, i: F.struct((i + 1).alias("line"), F.trim(F.replace(s, F.lit("\t"), F.lit(" "))).alias("s")))
    heads = F.filter(lines, lambda x: x["s"].rlike(HEADING))
    return F.transform(heads, lambda x: F.struct(x["line"].alias("line"), F.length(F.regexp_extract(x["s"], HEADING, 1)).alias("level"), F.trim(F.regexp_extract(x["s"], HEADING, 2)).alias("title")))


def plain_heading(text: Column | str) -> Column:
    """A heading without marks of emphasis and links, lower-case, for comparisons."""
    x = F.regexp_replace(_c(text), r"^#+\s*", "")
    for pattern, by in ((r"[*_~`]", ""), (r"\[\[(?:[^\]|]+\|)?([^\]]+)\]\]", "$1"), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"\s+", " ")):
        x = F.regexp_replace(x, pattern, by)
    return F.lower(F.trim(x))


def leaf_heading(breadcrumb: Column | str) -> Column:
    """The last heading of '# A > ## B', without its marks."""
    return F.trim(F.regexp_replace(F.element_at(F.split(_c(breadcrumb), r"\s+>\s+"), -1), r"^#+\s*", ""))


def locate_heading(text: Column | str, section: Column | str, passage: Column | str) -> Column:
    """The line (from 0) of the first heading or bold line that equals, holds or is held by the section's heading, both plain;
    else that of the passage's first 50 characters; else -1."""
    text, want = F.coalesce(_c(text), F.lit("")), plain_heading(F.coalesce(_c(section), F.lit("")))
    lines = F.transform(F.split(text, "\n"), lambda s, i: F.struct(i.alias("line"), F.trim(s).alias("s")))
    heads = F.filter(lines, lambda x: F.startswith(x["s"], F.lit("#")) | F.startswith(x["s"], F.lit("**")))
    plain = F.filter(F.transform(heads, lambda x: F.struct(x["line"].alias("line"), plain_heading(x["s"]).alias("s"))), lambda x: (x["s"] != "") & (F.contains(x["s"], want) | F.contains(want, x["s"])))
    cut = F.substring(F.regexp_replace(F.coalesce(_c(passage), F.lit("")), r"^\s+|\s+$", ""), 1, 50)
    at = F.when(cut != "", F.instr(text, cut)).otherwise(F.lit(0))
    before = F.when(at > 0, F.size(F.split(F.substr(text, F.lit(1), at - 1), "\n")) - 1).otherwise(F.lit(-1))
    return F.when((want != "") & (F.size(plain) > 0), F.element_at(plain, 1)["line"]).otherwise(before)


def heading_and_body(text: Column | str) -> Column:
    """struct(heading, body) of a chunk whose first line may be a heading."""
    t = F.regexp_replace(_c(text), r"^\s+", "")
    cut = F.instr(t, "\n")
    head = F.startswith(t, F.lit("#"))
    return F.struct(
        F.when(~head, F.lit("")).when(cut == 0, F.trim(t)).otherwise(F.trim(F.substring_index(t, "\n", 1))).alias("heading"),
        F.when(~head, t).when(cut == 0, F.lit("")).otherwise(F.regexp_replace(F.substr(t, cut + 1), r"^\s+|\s+$", "")).alias("body"),
    )


def excerpt(text: Column | str, most: int) -> Column:
    clean = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most)), F.lit("…"))).otherwise(clean)


def pair_key(a: Column | str, b: Column | str) -> Column:
    """The same for both orders."""
    return F.concat_ws("::", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def cache_key(query: Column, mode: Column, near: Column, limit: Column, folder: Column, tags: Column) -> Column:
    """SHA-256 of the canonical form: case, white space, slashes and the order of tags make no difference."""

    def low(x: Column) -> Column:
        return F.lower(F.trim(F.coalesce(x, F.lit(""))))

    names = F.array_sort(F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(F.trim(F.regexp_replace(t, "^#+", "")))))
    parts = [F.regexp_replace(low(query), r"\s+", " "), low(mode), low(near), F.coalesce(limit.cast("string"), F.lit("")), F.regexp_replace(low(folder), "^/+|/+$", ""), F.array_join(names, ",")]
    return F.sha2(F.concat_ws("|", *parts), 256)
