"""Text normalisation and keyword rules."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from .dates import ColumnOrName, _col


def _accent_table() -> tuple[str, str]:
    """Latin letters that decompose into one base letter plus marks, and those base letters."""
    source, target = [], []
    for code in chain(range(0x00C0, 0x0250), range(0x1E00, 0x1F00)):
        plain = "".join(ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch))
        if len(plain) == 1 and plain != chr(code):
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: ColumnOrName) -> Column:
    """Latin letters without their accents, composed or decomposed."""
    return F.regexp_replace(F.translate(_col(c), _ACCENTED, _PLAIN), r"\p{Mn}+", "")


def slug(c: ColumnOrName) -> Column:
    """Trimmed lower-case text with spaces as underscores."""
    return F.replace(F.lower(F.trim(_col(c))), F.lit(" "), F.lit("_"))


def normalize_name(c: ColumnOrName, rewrites: Sequence[tuple[str, str]] = ()) -> Column:
    """Accent-free lower-case words separated by single blanks, after literal ``rewrites``."""
    text = strip_accents(F.lower(F.trim(_col(c))))
    for old, new in rewrites:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(text, "[^a-z0-9]+", " "))


def blob(*cols: ColumnOrName) -> Column:
    """Lower-case text of several columns joined by blanks, NULLs as empty text."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(_col(c), F.lit("")) for c in cols]))


def any_keyword(text: Column, keywords: Sequence[str], whole_words: bool = False) -> Column:
    """1 when any keyword occurs in the (lower-case) text, else 0."""
    body = "|".join(re.escape(k.lower()) for k in keywords)
    pattern = rf"(?<![\p{{L}}\p{{N}}])(?:{body})(?![\p{{L}}\p{{N}}])" if whole_words else body
    return F.coalesce(text.rlike(pattern), F.lit(False)).cast("int")


def keyword_flags(
    cols: Sequence[ColumnOrName], rules: Mapping[str, Sequence[str]], whole_words: bool = False
) -> dict[str, Column]:
    """One 0/1 column per named keyword list, searched in the joined text of ``cols``."""
    text = blob(*cols)
    return {name: any_keyword(text, words, whole_words) for name, words in rules.items()}


def event_class(cols: Sequence[ColumnOrName], rules: Mapping[str, str]) -> dict[str, Column]:
    """One 0/1 column per named regular expression, searched in the joined text of ``cols``."""
    text = blob(*cols)
    return {name: F.coalesce(text.rlike(pattern), F.lit(False)).cast("int") for name, pattern in rules.items()}


# Severity words and colour words of public warnings with their level.
SEVERITY_LEVELS = {"minor": 1, "moderate": 2, "severe": 3, "extreme": 4}
COLOUR_LEVELS = (
    (4, "rojo", "red"),
    (3, "naranja", "orange"),
    (2, "amarillo", "yellow"),
    (1, "verde", "green"),
)


def severity_level(c: ColumnOrName) -> Column:
    """Severity word -> 1..4; anything else 0."""
    word = F.lower(F.trim(_col(c)))
    out = F.lit(0)
    for name, level in SEVERITY_LEVELS.items():
        out = F.when(word == name, level).otherwise(out)
    return out


def colour_level(text: ColumnOrName) -> Column:
    """Highest colour named in the text: Spanish words anywhere, English ones blank-delimited; else 0."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(" "))
    out = F.lit(0)
    for level, spanish, english in reversed(COLOUR_LEVELS):
        out = F.when(padded.contains(spanish) | padded.contains(f" {english} "), level).otherwise(out)
    return out


def alert_level(severity: ColumnOrName, *texts: ColumnOrName) -> Column:
    """Larger of the severity level and the colour level of the texts."""
    return F.greatest(severity_level(severity), colour_level(blob(*texts)))


# The eight code points in which ISO-8859-15 differs from ISO-8859-1.
LATIN_1, LATIN_9 = "¤¦¨´¸¼½¾", "€ŠšŽžŒœŸ"


def decode_bytes(c: ColumnOrName) -> Column:
    """Bytes -> text as UTF-8 when valid, else ISO-8859-15 (which accepts every byte)."""
    raw = _col(c)
    latin = F.translate(F.decode(raw, "ISO-8859-1"), LATIN_1, LATIN_9)
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(latin)


def clean_xml_text(c: ColumnOrName) -> Column:
    """The XML alert document inside a noisy buffer; NULL when there is none."""
    found = F.regexp_extract(_col(c), r"(?is)(<\?xml.*</alert>)", 1)
    bare = F.regexp_extract(_col(c), r"(?is)(<alert.*</alert>)", 1)
    return F.nullif(F.when(found != "", found).otherwise(bare), F.lit(""))


def chunk_key(start: ColumnOrName, end: ColumnOrName) -> Column:
    """First 12 hex digits of md5(``start|end``)."""
    return F.substring(F.md5(F.concat_ws("|", _col(start), _col(end))), 1, 12)
