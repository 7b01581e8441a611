"""String projections used while turning raw hits into posts and reports.

All are plain ``pyspark.sql.functions`` expressions so they stay inside
whole-stage codegen and push no Python into the hot path.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's behaviour) -------------------
# Markup pattern replaced by one space before entities are decoded.
TAG_PATTERN = r"<[^>]+>"
# The five entities decoded, applied one after another in exactly this order.
ENTITIES = [("&amp;", "&"), ("&gt;", ">"), ("&lt;", "<"), ("&#x27;", "'"), ("&quot;", '"')]
# Characters display escaping replaces, in this order ('&' is left alone).
DISPLAY_ESCAPES = [('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")]
# Dataset key: first 30 characters, ' ' -> '_', '/' -> '-'.
DATASET_KEY_CHARS = 30
# Similarity bands (strictly greater than).
BAND_HIGH, BAND_LOW = 0.6, 0.3
BAND_NAMES = ("very similar", "loosely related", "unrelated")
# ---------------------------------------------------------------------------

# Unicode whitespace as Python's str.split() sees it.  Java's (?U)\s is the
# Unicode White_Space property, which lacks U+001C..U+001F; add them.
WHITESPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
# Letters-only tokenisation used by search and keyword labels.
NON_LETTERS = r"[^\p{L}]+"


def clean_text(c: Column | str) -> Column:
    """Strip markup, decode five entities, collapse whitespace, trim.

    Null and empty input give ''.  Tags are removed *before* decoding, so an
    encoded tag survives as text; entities are decoded in sequence, so
    ``&amp;lt;`` ends up as ``<``.
    """
    c = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    c = F.regexp_replace(c, TAG_PATTERN, " ")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, WHITESPACE_RUN, " "))


def strip_all(c: Column | str) -> Column:
    """Strip leading/trailing Unicode whitespace (``trim`` only strips spaces)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def dataset_key(topic: Column | str) -> Column:
    """File-safe dataset key derived from a topic."""
    t = F.col(topic) if isinstance(topic, str) else topic
    head = F.substring(t, 1, DATASET_KEY_CHARS)
    return F.replace(F.replace(head, F.lit(" "), F.lit("_")), F.lit("/"), F.lit("-"))


def preview(c: Column | str, n: int, ellipsis: bool = True) -> Column:
    """First ``n`` characters; the ellipsis is appended even to short text."""
    c = F.col(c) if isinstance(c, str) else c
    head = F.substring(c, 1, n)
    return F.concat(head, F.lit("...")) if ellipsis else head


def html_escape_display(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for char, entity in DISPLAY_ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def percent_1dp(part: Column, total: Column) -> Column:
    """``round(part / total * 100, 1)`` with ties to even; null on empty total."""
    return F.bround(F.try_divide(part.cast("double"), total) * 100.0, 1)


def year_month(ts: Column | str) -> Column:
    return F.date_format(F.col(ts) if isinstance(ts, str) else ts, "yyyy-MM")


def similarity_band(sim: Column) -> Column:
    return (F.when(sim > BAND_HIGH, BAND_NAMES[0])
            .when(sim > BAND_LOW, BAND_NAMES[1])
            .otherwise(BAND_NAMES[2]))


def numbered_lines(items: Column, width: int) -> Column:
    """``"1. a\\n2. b"`` from an array of strings, each cut to ``width``."""
    return F.array_join(
        F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "),
                                                 F.substring(x, 1, width))),
        "\n")


def terms(c: Column | str, min_len: int = 1) -> Column:
    """Lower-cased letter runs of at least ``min_len`` characters."""
    c = F.col(c) if isinstance(c, str) else c
    toks = F.split(F.lower(c), NON_LETTERS)
    return F.filter(toks, lambda t: F.length(t) >= F.lit(max(min_len, 1)))
