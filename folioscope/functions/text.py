"""Column expressions over text: stripping, page artifacts, token estimates, tagged numbers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that only give a page number.
PAGE_ARTIFACTS = (
    r"(?U)^\s*第\s*\d+\s*页\s*共\s*\d+\s*页\s*$",
    r"(?U)^\s*第\s*\d+\s*页\s*$",
    r"(?iU)^\s*Page\s+\d+\s+of\s+\d+\s*$",
)
#: File suffixes and their kinds.
FILE_TYPES = {"pdf": "pdf", "md": "markdown", "markdown": "markdown", "docx": "docx", "doc": "doc"}
MODEL_DEFAULT = "gpt-4o"


def strip(text: Column) -> Column:
    """Without white space, Unicode white space included, at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_artifact(line: Column) -> Column:
    found = line.rlike(PAGE_ARTIFACTS[0])
    for pattern in PAGE_ARTIFACTS[1:]:
        found = found | line.rlike(pattern)
    return found


def drop_artifacts(text: Column) -> Column:
    """The lines that are no page numbers, joined again; null is empty."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.array_join(F.filter(lines, lambda x: ~is_artifact(x)), "\n")


def normalized(text: Column) -> Column:
    return strip(drop_artifacts(text))


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the characters, one at least; none for null and empty text."""
    n = F.length(text)
    return F.when(n > 0, F.greatest(F.lit(1), F.floor(n / 4).cast("int"))).otherwise(F.lit(0))


def dots_to_colon(text: Column) -> Column:
    """Dot leaders of a table of contents, with or without spaces between the dots, as a colon."""
    return F.regexp_replace(F.regexp_replace(text, r"\.{5,}", ": "), r"(?:\. ){5,}\.?", ": ")


def tagged_number(tag: Column) -> Column:
    """12 of <physical_index_12> or physical_index_12; null for other text."""
    return F.try_to_number(F.nullif(F.regexp_extract(tag, r"^<?physical_index_(\d+)>?$", 1), F.lit("")), F.lit("999999999")).cast("int")


def page_number(value: Column) -> Column:
    """A printed page as a number; null where it is none."""
    return strip(value.cast("string")).try_cast("int")


def code_level(code: Column) -> Column:
    """Parts of a dotted code: 3 of 1.2.3."""
    return F.size(F.split(code, r"\."))


def parent_code(code: Column) -> Column:
    """1.2 of 1.2.3; null of a single part."""
    return F.when(F.instr(code, ".") > 0, F.regexp_replace(code, r"\.[^.]*$", ""))


def heading_level(style: Column) -> Column:
    """The number in a style name that holds "heading N" in any case; null without one."""
    return F.nullif(F.regexp_extract(style, r"(?i)heading\s+(\d+)", 1), F.lit("")).cast("int")


def file_type(path: Column) -> Column:
    """Kind of a file by its suffix; raises on others."""
    suffix = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.create_map(*(F.lit(x) for pair in FILE_TYPES.items() for x in pair))[suffix]
    return F.coalesce(kind, F.raise_error(F.concat(F.lit("unsupported file type: "), F.coalesce(path, F.lit("null")))).cast("string"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def safe_name(name: Column, replacement: str = "-") -> Column:
    return F.replace(name, F.lit("/"), F.lit(replacement))


def preview(text: Column, most: int = 40) -> Column:
    """At most that many characters, with dots where it was cut."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def is_qwen(model: Column) -> Column:
    m = F.lower(model)
    return F.coalesce(m.startswith("qwen") | m.contains("/qwen"), F.lit(False))


def model_name(model: Column) -> Column:
    return F.coalesce(F.nullif(strip(model), F.lit("")), F.lit(MODEL_DEFAULT))


def image_markdown(reference: Column, alt: Column) -> Column:
    """![alt](reference); square brackets of the alt text become round ones."""
    return F.concat(F.lit("!["), F.translate(alt, "[]", "()"), F.lit("]("), reference, F.lit(")"))


def image_extension(ext: Column) -> Column:
    e = F.lower(F.regexp_replace(ext, r"^\.", ""))
    return F.when(e == "jpg", F.lit("jpeg")).otherwise(e)


def content_type(ext: Column) -> Column:
    return F.concat(F.lit("image/"), image_extension(ext))


def image_name(stem: Column, page_no: Column, index: Column, ext: Column) -> Column:
    """stem-page-N-I.ext, without -I for the first image of a page."""
    return F.concat(stem, F.lit("-page-"), page_no.cast("string"), F.when(index > 1, F.concat(F.lit("-"), index.cast("string"))).otherwise(F.lit("")), F.lit("."), ext)


def url_file_name(url: Column, default: str = "remote-file.bin") -> Column:
    """The last part of a URL's path, or the default."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"^[^?#]*/([^/?#]+)(?:[?#].*)?$", 1), F.lit("")), F.lit(default))


def header_file_name(disposition: Column, url: Column) -> Column:
    """The name in a Content-Disposition header, else that in the URL."""
    named = F.nullif(F.regexp_extract(disposition, r'(?i)filename="?([^";]+)"?', 1), F.lit(""))
    return F.coalesce(named, url_file_name(url))


def start_tags(text: Column) -> Column:
    """The numbers of all <start_index_N> tags in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"<start_index_(\d+)>"), F.lit(1)), lambda x: x.cast("int"))


def first_start(text: Column) -> Column:
    """The number of the first tag, -1 without one."""
    return F.coalesce(F.try_element_at(start_tags(text), F.lit(1)), F.lit(-1))


def last_start(text: Column) -> Column:
    return F.coalesce(F.try_element_at(start_tags(text), F.lit(-1)), F.lit(-1))
