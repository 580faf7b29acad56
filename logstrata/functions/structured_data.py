"""RFC 5424 structured data: text, JSON and map forms, without Python workers.

All repetitions below are possessive. A pattern that may give characters back
recurses once per character in Java, and one long parameter value then
overflows the stack of the executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_TYPE = "map<string,map<string,string>>"

# Grammar of RFC 5424 section 6.3, as patterns. The dot stands for any character
# (the s flag); a class such as [\s\S] is several times slower in Java.
NAME = r"[!#-<>-\\^-~]{1,32}+"
VALUE = r'[^"\\\]]*+(?:\\.[^"\\\]]*+)*+'
PARAM = rf'{NAME}="{VALUE}"'
ELEMENT = rf"\[{NAME}(?: {PARAM})*+\]"
DATA = rf"(?:{ELEMENT})++"

_ELEMENTS = f"(?s){ELEMENT}"
_PARAMS = rf'(?s) ({NAME})="({VALUE})"'


# Characters that need care: an escape in the text or in JSON, or a name
# character that sorts before the closing quote of a name.
_SPECIAL = r"[\\!<>&\x00-\x1f\u2028\u2029]"

# A name that occurs twice in a row among sorted members.
_REPEATED = r'"([^"]+)":"[^"]*","\1":'


def pieces(data: Column) -> Column:
    """Elements of a text without special characters, else NULL.

    Each is ``[id`` and then a line break and a JSON member per parameter.
    Such a text holds no bracket or line break of its own, so two passes over
    it split it.
    """
    members = F.regexp_replace(data, rf' ({NAME})="([^"]*+)"', '\n"$1":"$2"')
    split = F.array_remove(F.split(members, "]"), "")
    return F.when(~F.rlike(data, F.lit(_SPECIAL)), split)


def pieces_repeat_ids(found: Column) -> Column:
    """True if an element id occurs twice, which the RFC forbids."""
    ids = F.transform(found, lambda e: F.substring_index(e, "\n", 1))
    return (F.size(found) > 1) & (F.size(F.array_distinct(ids)) < F.size(found))


def pieces_to_json(found: Column) -> Column:
    """Stored form of ``pieces``; NULL if an element repeats a name.

    Members and elements are sorted as text, which sorts them by name.
    """

    def element(piece: Column) -> Column:
        lines = F.split(piece, "\n")
        members = F.sort_array(F.slice(lines, F.lit(2), F.size(lines)))
        sd_id = F.substring(F.get(lines, 0), F.lit(2), F.length(piece))
        return F.concat(
            F.lit('"'), sd_id, F.lit('":{'), F.array_join(members, ","), F.lit("}")
        )

    elements = F.array_join(F.sort_array(F.transform(found, element)), ",")
    text = F.concat(F.lit("{"), elements, F.lit("}"))
    return F.when(~F.rlike(text, F.lit(_REPEATED)), text)


def _unescape(value: Column) -> Column:
    return F.regexp_replace(value, r'\\(["\\\]])', "$1")


def _last_wins(pairs: Column) -> Column:
    """Pairs sorted by name; of a repeated name only the last one stays."""
    numbered = F.transform(
        pairs, lambda p, i: F.struct(p["names"].alias("k"), i, p["values"].alias("v"))
    )
    # A one-element transform gives the sorted array a name, so that the
    # neighbour test does not sort again for every element.
    kept = F.transform(
        F.array(F.sort_array(numbered)),
        lambda a: F.filter(
            a, lambda e, i: (i == F.size(a) - 1) | (F.get(a, i + 1)["k"] != e["k"])
        ),
    )[0]
    return F.transform(
        kept, lambda e: F.struct(e["k"].alias("names"), e["v"].alias("values"))
    )


def split_elements(sd: Column) -> Column:
    """Array of (id, parameter names, parameter values) of a text, by id.

    ``sort_array`` compares values directly; ``array_sort`` would run a
    comparison lambda for each pair.
    """
    found = F.transform(
        F.regexp_extract_all(sd, F.lit(_ELEMENTS), F.lit(0)),
        lambda e: F.struct(
            F.regexp_extract(e, rf"^\[({NAME})", 1).alias("k"),
            F.regexp_extract_all(e, F.lit(_PARAMS), F.lit(1)).alias("names"),
            F.when(
                F.contains(e, F.lit("\\")),
                F.transform(
                    F.regexp_extract_all(e, F.lit(_PARAMS), F.lit(2)), _unescape
                ),
            )
            .otherwise(F.regexp_extract_all(e, F.lit(_PARAMS), F.lit(2)))
            .alias("values"),
        ),
    )
    return F.sort_array(found)


def has_duplicate_ids(split: Column) -> Column:
    """True if an element id occurs twice, which the RFC forbids."""
    ids = F.transform(split, lambda e: e["k"])
    return (F.size(split) > 1) & (F.size(F.array_distinct(ids)) < F.size(split))


def _param_map(element: Column) -> Column:
    """Parameters of an element sorted by name; a repeated name's last value."""
    names = element["names"]
    pairs = F.arrays_zip(names, element["values"])
    repeated = (F.size(names) > 1) & (F.size(F.array_distinct(names)) < F.size(names))
    ordered = F.when(repeated, _last_wins(pairs)).otherwise(F.sort_array(pairs))
    return F.map_from_entries(ordered)


def to_json_text(split: Column) -> Column:
    """Stored form of ``split_elements``: JSON, both key levels sorted.

    The ids must be distinct. Angle brackets, ampersands and the two Unicode
    line separators are written as escapes, as the stored format has them.
    """
    entries = F.transform(split, lambda e: F.struct(e["k"], _param_map(e)))
    text = F.to_json(F.map_from_entries(entries))
    for char in "<>&\u2028\u2029":
        text = F.replace(text, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    return text


def parse(sd: Column) -> Column:
    """Stored text to a nested map; a dash, blank or bad JSON is empty."""
    empty = F.create_map().cast(MAP_TYPE)
    parsed = F.when(~sd.isin("-", ""), F.from_json(sd, MAP_TYPE))
    return F.coalesce(parsed, empty)


def flatten(parsed: Column) -> Column:
    """One-line text ``id:{k=v, k=v}, id:{...}`` of a nested map, else a dash."""
    items = F.transform(
        F.map_entries(parsed),
        lambda e: F.concat(
            e["key"],
            F.lit(":{"),
            F.array_join(
                F.transform(
                    F.map_entries(F.coalesce(e["value"], F.create_map())),
                    lambda kv: F.concat(kv["key"], F.lit("="), kv["value"]),
                ),
                ", ",
            ),
            F.lit("}"),
        ),
    )
    text = F.array_join(items, ", ")
    return F.when(F.coalesce(F.size(parsed), F.lit(0)) > 0, text).otherwise(F.lit("-"))
