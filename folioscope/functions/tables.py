"""Column expressions over tables held as array<array<string>>: cleaning, Markdown, titles, keys and boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_artifact, strip

#: The title of a table without one, the name of a column without one, and the longest title.
TABLE_TITLE, COLUMN_NAME, TITLE_LENGTH = "表格", "列", 15
#: A table is at the top of a page if it starts and is high within this share of the page.
TOP_SHARE, HEIGHT_SHARE, HEADER_PAGES = 0.15, 0.15, 2
#: Fixed value: the share of a block that a table must cover to stand for it.
OVERLAP = 0.3
DESCRIPTION_LENGTH = 200


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n", -1), strip), lambda x: x != "")


def clean_cell(cell: Column, artifacts: bool = True) -> Column:
    """One space for tabs and runs of spaces, LF line ends, no blank lines, no page numbers; null is empty."""
    text = F.regexp_replace(F.translate(F.coalesce(cell, F.lit("")), " \t", "  "), r"\r\n|\r", "\n")
    lines = _lines(text)
    if artifacts:
        lines = F.filter(lines, lambda x: ~is_artifact(x))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), " +", " "))


def width(cells: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(cells, lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))


def padded(cells: Column, clean=clean_cell) -> Column:
    """Rows of the same width with clean cells."""
    w = width(cells)
    full = lambda r: F.concat(F.coalesce(r, F.array().cast("array<string>")), F.array_repeat(F.lit(None).cast("string"), w - F.coalesce(F.size(r), F.lit(0))))
    return F.transform(cells, lambda r: F.transform(full(r), lambda c: clean(c)))


def normalize_table(cells: Column) -> Column:
    """Padded clean rows without blank ones but the first; a blank first row gets numbered column names."""
    rows = F.filter(padded(cells), lambda r, i: (i == 0) | F.exists(r, lambda c: c != ""))
    named = F.transform(rows, lambda r, i: F.when((i == 0) & ~F.exists(r, lambda c: c != ""), F.transform(r, lambda _, j: F.concat(F.lit(COLUMN_NAME), (j + 1).cast("string")))).otherwise(r))
    return F.when(width(cells) > 0, named).otherwise(F.array().cast("array<array<string>>"))


def normalize_rows(cells: Column) -> Column:
    """Padded clean rows without any blank one; page numbers stay."""
    return F.filter(padded(cells, lambda c: clean_cell(c, False)), lambda r: F.exists(r, lambda c: c != ""))


def plain_table(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")), "\n")


def markdown_table(cells: Column) -> Column:
    """Header, rule and body with escaped bars; empty without cells."""
    w = width(cells)
    escape = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rows = F.transform(cells, lambda r: line(F.concat(F.transform(r, escape), F.array_repeat(F.lit(""), w - F.size(r)))))
    rule = line(F.array_repeat(F.lit("---"), w))
    out = F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(0))))
    return F.when(w > 0, F.array_join(out, "\n")).otherwise(F.lit(""))


def table_block(markdown: Column, title: Column, summary: Column) -> Column:
    """Bold title, table, and the summary where there is one, parted by blank lines."""
    return F.concat_ws("\n\n", F.concat(F.lit("**"), title, F.lit("**")), markdown, summary)


def structure_key(cells: Column) -> Column:
    """Columns and the first row that is not blank, lower-cased with single spaces."""
    rows = F.filter(cells, lambda r: F.exists(r, lambda c: strip(F.coalesce(c, F.lit(""))) != ""))
    first = F.coalesce(F.try_element_at(rows, F.lit(1)), F.array().cast("array<string>"))
    tidy = F.transform(first, lambda c: F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))))
    return F.struct(width(cells).alias("columns"), tidy.alias("first"))


def table_title(value: Column) -> Column:
    """A reply's first line without quotes, brackets and punctuation, cut to TITLE_LENGTH; the default if none is left."""
    first = F.coalesce(F.try_element_at(F.split(strip(value), r"\r\n|\n|\r"), F.lit(1)), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(strip(first), "^[\"'“”‘’《〈【\\[\\(]+", ""), "[\"'“”‘’》〉】\\]\\)]+$", "")
    tidy = strip(F.regexp_replace(F.regexp_replace(bare, "[。！!？?,，:：;；、]", ""), r"(?U)\s+", " "))
    return F.coalesce(F.nullif(strip(F.left(tidy, F.lit(TITLE_LENGTH))), F.lit("")), F.lit(TABLE_TITLE))


def default_title(index: Column) -> Column:
    return F.when(index > 1, F.concat(F.lit(f"{TABLE_TITLE} "), index.cast("string"))).otherwise(F.lit(TABLE_TITLE))


def one_line(value: Column, most: int | None = None) -> Column:
    """White space as single spaces; null if nothing is left."""
    out = F.nullif(strip(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(""))
    return F.left(out, F.lit(most)) if most else out


def box(value: Column) -> Column:
    """Four numbers or null."""
    return F.when(F.size(value) == 4, F.transform(value, lambda x: x.cast("double")))


def at_top(bbox: Column, page_height: Column) -> Column:
    """Whether a table starts and ends within the top of its page; false without a box or height."""
    top, low = F.try_element_at(bbox, F.lit(2)), F.try_element_at(bbox, F.lit(4))
    return F.coalesce((page_height > 0) & (top < TOP_SHARE * page_height) & (low - top < HEIGHT_SHARE * page_height), F.lit(False))


def overlap(block: Column, other: Column) -> Column:
    """The share of a block's area that the other box covers; 0 without area."""
    at = lambda b, i: F.element_at(b, i)
    w = F.greatest(F.lit(0.0), F.least(at(block, 3), at(other, 3)) - F.greatest(at(block, 1), at(other, 1)))
    h = F.greatest(F.lit(0.0), F.least(at(block, 4), at(other, 4)) - F.greatest(at(block, 2), at(other, 2)))
    area = (at(block, 3) - at(block, 1)) * (at(block, 4) - at(block, 2))
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))
