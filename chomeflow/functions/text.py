"""Cleaning of address text, and kanji numerals, as column functions.

Patterns start with flags that give Java's classes the meaning that the rules
have: Unicode digits and spaces, and only a line feed ends a line.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?Ud)"

#: Signs that always become a hyphen.
DASHES = "-－‐‑‒–—―−～〜~─━﹣﹘"
#: Kanji digits with their values in the same order, and kanji powers.
DIGITS, VALUES = "〇零一壱二弐三参四五六七八九", "00112233456789"
POWERS = {"十": 10, "拾": 10, "百": 100, "千": 1000}
KANJI = f"[{DIGITS}{''.join(POWERS)}]"
NUMBER = rf"(?:\d+|{KANJI}+)"
#: What makes a numeral with 番 a proper noun, and a sequence part of a building's name.
BLOCK_NAMES = "町丁街館割組場屋通筋"
NOT_BUILDING = "(?!ビル|号館|館|マンション|アパート|ハイツ|レジデンス|タワー)"

#: The decimal digits of all scripts but ASCII, and their values in the same order.
_DECIMALS = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd"]
DECIMALS, DECIMAL_VALUES = "".join(_DECIMALS), "".join(str(unicodedata.digit(c)) for c in _DECIMALS)

#: Characters that compatibility composition leaves alone in any company of each other.
_COMPOSED = r"^[\x00-\x7f、-〃々-〇ぁ-ゖァ-ヺー一-鿿]*$"
_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85                　\xa0"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(_BLANK))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def nfkc(c: Column) -> Column:
    """Compatibility composition, by the Unicode library that comes with Spark; most address text doesn't need the call."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    return F.when(c.rlike(_COMPOSED), c).otherwise(composed)


def compose_input(raw: Column) -> Column:
    """The first half of cleaning; it calls ``nfkc`` and so stands in a projection of its own."""
    return nfkc(F.btrim(F.coalesce(raw, F.lit("")), F.lit("﻿ \t\r\n")))


def clean_composed(composed: Column) -> Column:
    """The second half of cleaning, on composed text."""
    beside = r"[\d〇一二三四五六七八九十壱弐参拾]"
    c = F.regexp_replace(composed, f"{FLAGS}ー(?<={beside}ー)ー*(?={beside})", "-")
    c = F.translate(c, DASHES, "-" * len(DASHES))
    c = F.regexp_replace(c, "-+", "-")
    c = F.regexp_replace(c, FLAGS + r"^(?:〒\s*(?:\d{3}[-ー]?\d{4}|\d{7})?|\d{3}[-ー]\d{4})\s*", "")
    c = F.regexp_replace(c, "[ 　 \t\r\n]+", " ")
    return strip(c)


def sanitize(raw: Column) -> Column:
    return clean_composed(compose_input(raw))


def pattern_sql(pattern: str) -> str:
    """A pattern as a raw string literal, with the flags."""
    return f'r"{FLAGS}{pattern}"'


def kanji_number_sql(token: str) -> str:
    """SQL of the value of a kanji numeral, positional or with powers; null for any other text."""
    power = "CASE c " + " ".join(f"WHEN '{p}' THEN {n}L" for p, n in POWERS.items()) + " END"
    digit = f"CAST(substr('{VALUES}', instr('{DIGITS}', c), 1) AS BIGINT)"
    summed = (
        f"aggregate(split({token}, ''), named_struct('total', 0L, 'digit', 0L), (acc, c) -> CASE WHEN instr('{DIGITS}', c) > 0 THEN named_struct('total', acc.total, 'digit', {digit}) "
        f"ELSE named_struct('total', acc.total + IF(acc.digit = 0L, 1L, acc.digit) * {power}, 'digit', 0L) END, acc -> acc.total + acc.digit)"
    )
    return f"CASE WHEN {token} RLIKE '^[{DIGITS}]+$' THEN try_cast(translate({token}, '{DIGITS}', '{VALUES}') AS BIGINT) WHEN {token} RLIKE '^{KANJI}+$' THEN {summed} END"


def number_sql(token: str) -> str:
    """SQL of the value of decimal digits of any script, or of a kanji numeral."""
    other = f"try_cast(translate({token}, '{DECIMALS}', '{DECIMAL_VALUES}') AS BIGINT)"
    return f"CASE WHEN {token} RLIKE '^[0-9]+$' THEN try_cast({token} AS BIGINT) WHEN {token} RLIKE {pattern_sql('^[^' + KANJI[1:-1] + ']*$')} THEN {other} ELSE {kanji_number_sql(token)} END"


def kanji_number(token: str) -> Column:
    """The value of a column of kanji numerals."""
    return F.expr(kanji_number_sql(token))


def number(token: str) -> Column:
    """The value of an SQL text's decimal digits or kanji numeral."""
    return F.expr(number_sql(token))


#: Tokens that a numeral may stand beside; everything else is left in runs.
_TOKEN = rf"{KANJI}+|\d+|丁目|番地の|番地|番|号|-|(?:(?!丁目)[^{KANJI[1:-1]}\d番号-])+"

#: Where nothing is to be done: a numeral stands before a mark or a dash, or behind a dash or 番地の.
#: (The marks come first in the pattern, as a class of many kanji is slow to test at each character.)
ANY_STEP = f"(?:丁目|番|号|-)(?<={KANJI}(?:丁目|番|号|-))|(?:-|番地の){KANJI}"


def _as_digits(token: str) -> str:
    """A numeral as digits without leading zeros; a positional one may be longer than a number."""
    positional = f"regexp_replace(translate({token}, '{DIGITS}', '{VALUES}'), '^0+(?=.)', '')"
    return f"CASE WHEN {token} RLIKE '^[{DIGITS}]+$' THEN {positional} ELSE CAST({kanji_number_sql(token)} AS STRING) END"


def _is_kanji(token: str) -> str:
    return f"instr('{KANJI[1:-1]}', substr(coalesce(nullif({token}, ''), '-'), 1, 1)) > 0"


def numerals_sql(tokens: str) -> str:
    """SQL of the text of a column of tokens, with kanji numerals as digits where the tokens around make them numbers."""
    before, before_2, behind, behind_2 = (f"get({tokens}, i {k})" for k in ("- 1", "- 2", "+ 1", "+ 2"))
    is_digits = f"coalesce({before_2}, '') RLIKE {pattern_sql(chr(94) + chr(92) + 'd')}"
    number_if = " OR ".join(
        f"({x})"
        for x in (
            f"{behind} IN ('丁目', '番地', '番地の')",
            f"{behind} = '番' AND {behind_2} = '号'",
            f"{behind} = '番' AND {before} = '丁目' AND ({is_digits} OR {_is_kanji(before_2)}) AND instr('{BLOCK_NAMES}', substr(coalesce({behind_2}, '-'), 1, 1)) = 0",
            f"{behind} = '号' AND ({before} = '番' OR ({before} = '-' AND {is_digits}))",
            f"{before} = '番地の'",
        )
    )
    return f"array_join(transform({tokens}, (t, i) -> CASE WHEN {_is_kanji('t')} AND ({number_if}) THEN {_as_digits('t')} ELSE t END), '')"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {pattern_sql(_TOKEN)}, 0)"


def sequences_sql(text: str) -> str:
    """SQL of a text with kanji numerals as digits in sequences of numbers joined by hyphens."""
    sequence = rf"(?<!第){NUMBER}(?:-{NUMBER})+{NOT_BUILDING}|[^\d{KANJI[1:-1]}]+|[\s\S]"
    part = f"CASE WHEN p RLIKE '^{KANJI}+$' THEN {_as_digits('p')} ELSE p END"
    told = f"CASE WHEN contains(t, '-') AND t RLIKE '{KANJI}' THEN array_join(transform(split(t, '-'), p -> {part}), '-') ELSE t END"
    return f"CASE WHEN {text} RLIKE '{KANJI}-|-{KANJI}' THEN array_join(transform(regexp_extract_all({text}, {pattern_sql(sequence)}, 0), t -> {told}), '') ELSE {text} END"


def captures(text: Column, pattern: str, n: int) -> Column:
    """The groups of an anchored pattern after one pass: [true, group 1, ...], or one element if it doesn't match."""
    marks = "\u0001" + "\u0001".join(f"${i}" for i in range(1, n + 1))
    return F.split(F.regexp_replace(text, FLAGS + pattern, marks), "\u0001")


def matched(found: Column) -> Column:
    return F.size(found) > 1


def group(found: Column, i: int) -> Column:
    """Group i; null if it is absent or empty."""
    return F.nullif(F.get(found, F.lit(i)), F.lit(""))
