"""String rules shared by the comparators and the transcript operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Curly quotes and primes with their ASCII forms, the dash code points, and the
# markup that comparison ignores.
QUOTES_FROM = "‘’‚′“”„″"
QUOTES_TO = "''''\"\"\"\""
DASHES = "[‐‑‒–—―−]"
HTML_TAG = r"(?i)<br\s*/?>|</?[a-z][^>]*>"
MARKDOWN_STYLE = r"\*\*|__|`"

# ``(?U)`` makes \s and \w follow Unicode, so a no-break space counts as white space.
SPACE = r"(?U)\s+"
SPACE_AROUND_SEPARATOR = r"(?U)\s*([/\-,:])\s*"


def squash(c: Column) -> Column:
    """Runs of white space become one blank; the ends are trimmed."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def strip_space(c: Column) -> Column:
    """White space of any kind removed from both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def remove_space(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def normalize_text(c: Column) -> Column:
    """The comparison form of a string: quotes, dashes, markup and separator blanks made uniform."""
    c = F.translate(c, QUOTES_FROM, QUOTES_TO)
    c = F.regexp_replace(c, DASHES, "-")
    c = F.regexp_replace(c, HTML_TAG, " ")
    c = F.regexp_replace(c, MARKDOWN_STYLE, "")
    c = F.regexp_replace(c, SPACE_AROUND_SEPARATOR, "$1")
    return squash(c)


def bare_text(c: Column) -> Column:
    """:func:`normalize_text` without any white space, in two passes.

    Blanks around separators and runs of blanks need no step of their own, as all white space goes;
    style marks and white space share no character, so one pass takes both.
    """
    dashes = DASHES[1:-1]
    uniform = F.translate(c, QUOTES_FROM + dashes, QUOTES_TO + "-" * len(dashes))
    # All that is replaced there lies outside ASCII; a tag needs its bracket.
    c = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(uniform)
    c = F.when(c.contains("<"), F.regexp_replace(c, HTML_TAG, " ")).otherwise(c)
    return F.regexp_replace(c, rf"(?U){MARKDOWN_STYLE}|\s+", "")


def fold_alnum(c: Column) -> Column:
    """Lower case with every run of other characters turned into one blank."""
    return F.trim(F.regexp_replace(F.lower(c), "[^0-9a-z]+", " "))


def word_count(folded: Column) -> Column:
    """Number of words in a :func:`fold_alnum` string."""
    return F.when(folded == "", F.lit(0)).otherwise(F.size(F.split(folded, " ")))


def safe_file_id(c: Column) -> Column:
    """Characters outside ``A-Za-z0-9._-`` become underscores."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def safe_entry_name(c: Column) -> Column:
    """A registry id as it appears in front of a transcriber's key: ``@ . /`` become ``_ - _``."""
    return F.translate(c, "@./", "_-_")


def strip_code_fence(c: Column) -> Column:
    """Drop one outer Markdown fence when it wraps the whole text; fences inside stay."""
    body = strip_space(F.regexp_extract(c, r"(?isU)^```(?:markdown|md)?\s*\n(.*)\n```\s*$", 1))
    return F.when(body != "", body).otherwise(c)
