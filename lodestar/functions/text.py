"""Text expressions: links, words, scripts, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: `[[Target]]`, `[[Target|text]]`, `[[Target\|text]]` in tables, and the same behind `!` for embeds.
WIKI_LINK = r"!?\[\[[^\[\]|\\]+(?:\\?\|[^\[\]]*)?\]\]"
#: `[text](https://...)`
INLINE_LINK = r"\]\((https?://[^\s()]*(?:\([^\s()]*\)[^\s()]*)*)\)"
IMAGE = r"(?i)\.(png|jpe?g|gif|webp|svg|avif|bmp)$"
URL = r"^https?://\S+$"


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path: Column | str, suffix: str = ".md") -> Column:
    """The last path component without its suffix."""
    name = F.element_at(F.split(_column(path), "/"), -1)
    return F.when(name.endswith(suffix), name.substr(F.lit(1), F.length(name) - len(suffix))).otherwise(name)


def folder(path: Column | str) -> Column:
    path = _column(path)
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(F.lit(""))


def mask_inline_code(line: Column | str) -> Column:
    """Inline code becomes blanks of some length, so that links in it don't count."""
    return F.regexp_replace(_column(line), r"(`+)[^`]+\1", " ")


def whole_word(term: str) -> str:
    """A pattern for a literal term between non-letters; works the same on any Java version, in any script."""
    return r"(?<![\p{L}\p{N}_])\Q" + term.replace(r"\E", r"\E\\E\Q") + r"\E(?![\p{L}\p{N}_])"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits. No lemmas: none can be had offline."""
    # without a lambda the expression is compiled, and shared by all that a query derives from it
    return F.array_remove(F.split(F.lower(_column(text)), r"[^\p{L}\p{N}]+"), "")


def byte_length(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(_column(text)), F.lit(0))


def mixed_script(text: Column | str, foreign: str = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\u200B-\u200D\uFEFF\uFF01-\uFF5E]") -> Column:
    """Whether a line holds characters of the given classes: by default East Asian, zero-width and full-width ones."""
    return _column(text).rlike(foreign)


def two_scripts_in_word(text: Column | str) -> Column:
    """A word that mixes Latin and Cyrillic letters."""
    return _column(text).rlike(r"\p{IsLatin}\p{IsCyrillic}|\p{IsCyrillic}\p{IsLatin}")


def iso_date(text: Column | str) -> Column:
    """The date of a YYYY-MM-DD text, else null."""
    text = _column(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def is_set(value: Column) -> Column:
    """Neither null nor an empty string: unset is written both ways."""
    return value.isNotNull() & (value.cast("string") != "")
