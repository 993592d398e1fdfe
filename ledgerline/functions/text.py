"""Text functions: slugs, escaping, tag stripping, references, normalised templates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

SEP = " > "


def slug(path: Column) -> Column:
    """Each part of a path lower-cased, spaces to '-', the middle dot dropped, '&' to 'and', outer '-' cut; parts joined by '_'."""
    part = lambda p: F.regexp_replace(F.replace(F.replace(F.replace(F.lower(p), F.lit(" "), F.lit("-")), F.lit("·"), F.lit("")), F.lit("&"), F.lit("and")), "^-+|-+$", "")
    return F.array_join(F.transform(F.split(path, SEP), part), "_")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def grouped(c: Column, places: int = 0) -> Column:
    """A number with thousands separators; the binary value is rounded, ties to even."""
    return F.format_number(c.cast("double"), places)


def stamp(at: Column) -> Column:
    """ISO-8601 in UTC, to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def exif_time(at: Column) -> Column:
    return F.date_format(at, "yyyy:MM:dd HH:mm:ss")


def days_ago(today: Column, days: Column, hour: Column, minute: Column) -> Column:
    """The moment so many days before a day, its time replaced."""
    day = F.date_sub(today, days.cast("int"))
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), hour, minute, F.lit(0))


def pack_token(token: Column) -> Column:
    """A change token as base64 of its JSON."""
    return F.base64(F.encode(F.to_json(token), "UTF-8"))


def unpack_token(packed: Column, schema: str) -> Column:
    """The token, NULL where the text is none."""
    return F.from_json(F.decode(F.try_to_binary(packed, F.lit("base64")), "UTF-8"), schema)


def label(c: Column, most: int = 34) -> Column:
    return escape_html(F.left(c, F.lit(most)))


def strip_tags(c: Column) -> Column:
    """Paragraph ends and breaks to newlines, tabs kept, all other tags dropped, five entities decoded, no more than one empty line."""
    for pattern, to in ((r"</(w:)?p>", "\n"), (r"<w:tab[^>]*/?>", "\t"), (r"<(w:)?br[^>]*/?>", "\n"), (r"<[^>]+>", "")):
        c = F.regexp_replace(c, pattern, to)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def links(c: Column) -> Column:
    """Targets of markdown links without fragments; web and mail targets left out."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\[[^\]]*\]\(([^)\s]+)\)"), F.lit(1)), lambda x: F.regexp_replace(F.split_part(x, F.lit("#"), F.lit(1)), r"(\.md):\d+$", "$1"))
    return F.filter(found, lambda x: (x != "") & ~x.rlike("^(https?:|mailto:)"))


def file_references(c: Column, extensions: tuple[str, ...] = ("md", "py", "swift", "json", "csv", "txt")) -> Column:
    """Names in backticks that end in one of the extensions; globs left out."""
    found = F.regexp_extract_all(c, F.lit(r"`([^`\s]+\.(?:" + "|".join(extensions) + r"))`"), F.lit(1))
    return F.filter(found, lambda x: ~x.contains("*"))


def section(c: Column, heading: str) -> Column:
    """Text between a heading and the next one of any level."""
    return F.regexp_extract(c, rf"(?ms)^#+ {heading}[^\n]*\n(.*?)(?=^#+ |\z)", 1)


def skeleton(c: Column, regions: list[str]) -> Column:
    """c with variable regions blanked, so that variants of a template can be compared."""
    for r in regions:
        c = F.regexp_replace(c, r, "")
    return c


#: Characters worked on at once by likelihood(); a longer text is worked on alone.
CHARACTERS = 1 << 22


def likelihood(c: Column) -> Column:
    """Character analogue of the text-likelihood signal over whole texts: 1.5 x share of neighbours whose codes, 255 at most, differ by over 40, plus half
    the fullest of 16 bins, at most 1; 0 for fewer than two characters, NULL for NULL. One pass of array operations over each Arrow batch."""
    return F.pandas_udf(_likelihoods, DoubleType())(c)


def _likelihoods(texts: pd.Series) -> pd.Series:
    out = np.zeros(len(texts))
    given = texts.fillna("").tolist()
    size = np.fromiter(map(len, given), np.int64, len(given))
    part = np.cumsum(size) // CHARACTERS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(given)]
    for a, b in zip(cuts, cuts[1:]):
        n, rows = size[a:b], b - a
        level = np.minimum(np.frombuffer("".join(given[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32), 255).astype(np.int32)
        doc = np.repeat(np.arange(rows), n)
        far = np.flatnonzero((np.abs(np.diff(level)) > 40) & (doc[1:] == doc[:-1]))
        edges = np.bincount(doc[far], minlength=rows)
        peak = np.bincount(doc * 16 + level // 16, minlength=rows * 16).reshape(rows, 16).max(axis=1, initial=0)
        out[a:b] = np.where(n < 2, 0.0, np.minimum(1.0, 1.5 * edges / np.maximum(n - 1, 1) + 0.5 * peak / np.maximum(n, 1)))
    return pd.Series(out).where(texts.notna().to_numpy())


def array_likelihood(codes: Column) -> Column:
    """The signal over an array of 0-255 levels in reading order; 0 for fewer than two."""
    n = F.size(codes)
    edges = F.size(F.filter(F.zip_with(codes, F.slice(codes, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.abs(a - b) > 40), lambda x: x))
    peak = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda b: F.size(F.filter(codes, lambda x: F.floor(x / 16) == b))))
    return F.when(n < 2, 0.0).otherwise(F.least(F.lit(1.0), 1.5 * F.try_divide(edges, n - 1) + 0.5 * F.try_divide(peak, n)))
