"""Block and lot numbers by one pattern with a branch for each state; then building, floor and unit."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chomeflow.functions.text import BLOCK_NAMES, FLAGS, KANJI, NUMBER, captures, group, matched, number, strip

GAIKU, CHIBAN, UNSPECIFIED = "gaiku_hoshiki", "chiban", "unspecified"

#: The marks behind a number, and those around a building's parts.
CHOME, LOT, LOT_OF, BLOCK, HOUSE = "丁目", "番地", "番地の", "番", "号"
BASEMENTS, FLOORS, ROOM = ["B", "地下"], ["階", "F", "f"], "室"
#: Large and small sections of a village.
LARGE, SMALL = "大字", "小?字"

#: A number and what may stand behind it, as groups by name; ``first`` and ``second`` are numbers, ``mark`` their kind.
_N = NUMBER
_SECOND = f"(?:[の-]?(<second>{_N}){HOUSE}?)?"
_NOT_NAME = f"(?![{BLOCK_NAMES}])"
#: Behind a kanji numeral and 番 alone, which are the name of a place.
_PLACE = f"(?<={KANJI}{BLOCK})"
#: The states in order, and what each takes behind a town; the first that finds its numbers wins, at the first place it finds them.
_STATES = {
    "chome": rf"(<chome>{_N}){CHOME}\s*(?:(<first>{_N})(<mark>{LOT_OF}|{LOT}|{BLOCK}){_SECOND}|(<from>{_N})-(<to>{_N})|(<single>{_N}){HOUSE}?)?",
    "hyphen": r"(<first>\d+)-(<second>\d+)(?:-(<third>\d+))?",
    "named": f"(<first>{_N})(<mark>{LOT_OF}|{LOT}|{BLOCK}{_NOT_NAME}){_SECOND}",
    "marked": f"(<first>{_N})(<mark>{LOT}|{BLOCK}{_NOT_NAME}|{HOUSE})",
    "bare": r"(<first>\d+)",
}
_NO_PLACES = {"named", "marked"}
#: What a state can't do without: a text that lacks it passes the branch by, before any numeral is looked for.
_NEEDED = {"chome": CHOME, "hyphen": r"\d-\d", "named": BLOCK, "marked": f"[{BLOCK}{HOUSE}]", "bare": r"\d"}


def _automaton() -> tuple[str, dict[tuple[str, str], int]]:
    """One pattern with a branch for each state, and the number of each state's groups."""
    groups: dict[tuple[str, str], int] = {}

    def numbered(state: str, pattern: str) -> str:
        def number(m: re.Match) -> str:
            groups[state, m[1]] = len(groups) + 1
            return "("

        return re.sub(r"\(<(\w+)>", number, pattern)

    branches = []
    for state, taken in _STATES.items():
        # what is found first is held to be no place's name; if it is one, the next state has its turn
        first = re.sub(r"\(<\w+>", "(?:", taken)
        guard = f"(?!(?>.*?{first}){_PLACE})" if state in _NO_PLACES else ""
        branches.append(f"(?=.*?{_NEEDED[state]})" + guard + numbered(state, f"(<town>.*?){taken}(<tail>.*)"))
    return f"^(?:{'|'.join([*branches, numbered('default', '(<town>.*)')])})$", groups


_PATTERN, _GROUPS = _automaton()

_ANY = r"([\s\S]*"
_STOREY = rf"((?:{'|'.join(BASEMENTS)})?\d+\s*[{''.join(FLOORS)}])"
_FLOOR = f"^{_ANY}?)" + _STOREY + r"(?:[\sA-Za-z0-9]|$)?" + f"{_ANY})$"
_UNIT = f"^{_ANY}?)" + rf"(\d+\s*{HOUSE}{ROOM}?|(?:^|\s)\d{{3,4}}(?:\s|$))" + f"{_ANY})$"

_BOTH_SECTIONS = FLAGS + rf"{LARGE}([^字\s\d]+?){SMALL}([^\s\d]+)"


def _first(*found: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in found])


def oaza(town: Column) -> Column:
    return _first(F.regexp_extract(town, _BOTH_SECTIONS, 1), F.regexp_extract(town, FLAGS + rf"{LARGE}([^\s\d]+)", 1))


def koaza(town: Column) -> Column:
    return _first(F.regexp_extract(town, _BOTH_SECTIONS, 2), F.regexp_extract(town, FLAGS + rf"(?<!大){SMALL}([^\s\d]+)", 1))


def _if(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array(F.lit("")))


def parse_blocks(df: DataFrame, text: str, has_chome: Column) -> DataFrame:
    """Adds ``_b``: town, chome, ban, go, banchi, edaban, oaza, koaza, regime, tail, state.

    One pass of one pattern finds the state and its parts; lines are not read across.
    """
    df = df.withColumns({"_s": strip(F.col(text)), "_has_chome": has_chome})
    df = df.withColumn("_c", captures(F.col("_s"), _PATTERN, len(_GROUPS)))
    got = lambda state, name: f"get(_c, {_GROUPS[state, name]})"
    told = lambda state, name: f"nullif({got(state, name)}, '')"
    sign = {"chome": "chome", "hyphen": "first", "named": "first", "marked": "first", "bare": "first"}
    found = " ".join(f"WHEN {got(state, name)} <> '' THEN '{state}'" for state, name in sign.items())
    df = df.withColumn("_kind", F.expr(f"CASE {found} ELSE 'default' END"))
    each = lambda name, *states: " ".join(f"WHEN '{x}' THEN {got(x, name)}" for x in states)
    states = list(_STATES)
    three = f"{got('hyphen', 'third')} <> ''"
    df = df.withColumns(
        {
            "_town": strip(F.expr(f"CASE _kind {each('town', *states)} ELSE _s END")),
            "_tail": strip(F.expr(f"CASE _kind {each('tail', *states)} ELSE '' END")),
            "_mark": F.expr(f"CASE _kind {each('mark', 'chome', 'named', 'marked')} END"),
            "_three": F.expr(f"_kind = 'hyphen' AND {three}"),
            "_t0": F.expr(f"CASE WHEN _kind = 'chome' THEN {got('chome', 'chome')} WHEN {three} THEN {got('hyphen', 'first')} END"),
            "_t1": F.expr(
                f"CASE _kind WHEN 'chome' THEN coalesce({told('chome', 'first')}, {told('chome', 'from')}, {told('chome', 'single')}) "
                f"WHEN 'hyphen' THEN IF({three}, {got('hyphen', 'second')}, {got('hyphen', 'first')}) {each('first', 'named', 'marked', 'bare')} END"
            ),
            "_t2": F.expr(
                f"CASE _kind WHEN 'chome' THEN coalesce({told('chome', 'second')}, {told('chome', 'to')}) "
                f"WHEN 'hyphen' THEN IF({three}, {got('hyphen', 'third')}, {got('hyphen', 'second')}) WHEN 'named' THEN {told('named', 'second')} END"
            ),
            "_state": F.expr(
                f"CASE WHEN _kind <> 'chome' THEN _kind WHEN {got('chome', 'first')} <> '' THEN 'chome_named' WHEN {got('chome', 'from')} <> '' THEN 'chome_hyphen' "
                f"WHEN {got('chome', 'single')} <> '' THEN 'chome_single' ELSE 'chome' END"
            ),
        }
    )
    section = F.col("_town").contains("字")
    df = df.withColumns({"_oaza": F.when(section, oaza(F.col("_town"))), "_koaza": F.when(section, koaza(F.col("_town")))})
    village = "(_oaza IS NOT NULL OR _koaza IS NOT NULL) AND _kind NOT IN ('default', 'chome') AND NOT _three"
    df = df.withColumns({"_lot": F.expr(f"coalesce(startswith(_mark, '{LOT}'), false) OR ({village})"), "_n0": number("_t0"), "_n1": number("_t1"), "_n2": number("_t2")})
    gaiku = "_kind = 'chome' OR (_kind = 'hyphen' AND (_three OR _has_chome)) OR (_kind = 'named' AND _n2 IS NOT NULL)"
    b = F.expr(
        f"""named_struct('town', _town, 'chome', _n0, 'ban', IF(_lot, NULL, _n1), 'go', IF(_lot, NULL, _n2), 'banchi', IF(_lot, _n1, NULL), 'edaban', IF(_lot, _n2, NULL),
        'oaza', _oaza, 'koaza', _koaza, 'regime', CASE WHEN _lot THEN '{CHIBAN}' WHEN {gaiku} THEN '{GAIKU}' ELSE '{UNSPECIFIED}' END, 'tail', _tail, 'state', _state)"""
    )
    return df.withColumn("_b", b).drop("_s", "_has_chome", "_c", "_kind", "_town", "_tail", "_mark", "_three", "_t0", "_t1", "_t2", "_state", "_oaza", "_koaza", "_lot", "_n0", "_n1", "_n2")


def parse_building(df: DataFrame, tail: Column) -> DataFrame:
    """Adds ``_g``: building, floor, unit. What matches is cut out whole, with the sign that follows a floor."""
    df = df.withColumn("_w", strip(F.coalesce(tail, F.lit(""))))
    w = F.col("_w")
    df = df.withColumn("_f", _if(w.rlike(r"(?U)\d"), captures(w, _FLOOR, 3)))
    f = F.col("_f")
    df = df.withColumn("_w2", F.when(matched(f), strip(F.concat(F.get(f, F.lit(1)), F.lit(" "), F.get(f, F.lit(3))))).otherwise(w))
    w2 = F.col("_w2")
    df = df.withColumn("_u", _if(w2.rlike(r"(?U)\d"), captures(w2, _UNIT, 3)))
    u = F.col("_u")
    left = F.when(matched(u), F.concat(F.get(u, F.lit(1)), F.lit(" "), F.get(u, F.lit(3)))).otherwise(w2)
    name = strip(F.regexp_replace(left, FLAGS + r"\s+", " "))
    g = F.struct(F.nullif(name, F.lit("")).alias("building"), strip(group(f, 2)).alias("floor"), strip(group(u, 2)).alias("unit"))
    return df.withColumn("_g", g).drop("_w", "_f", "_w2", "_u")
