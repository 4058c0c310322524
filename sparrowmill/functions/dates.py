"""Dates by a small grammar over the shape of a text.

The shape of a text is the text with 9 for each digit and a for each run of letters. Each
form that is read is a shape, made by rule from the orders of day, month and year, so one
look-up tells where each part stands, and one date is built from the parts.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowmill.functions import lookups as L

WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
ZONES = ("gmt", "utc", "ist", "est", "edt", "cst", "cdt", "mst", "mdt", "pst", "pdt", "bst", "cet", "cest", "z")


def listed_shapes() -> dict[str, str]:
    """Shapes of the listed formats with their order: d, m, y in digits, s a year of two digits, n a month's name, N its full name."""
    out: dict[str, str] = {}
    for d in ("9", "99"):
        for m in ("9", "99"):
            out[f"9999-{m}-{d}"] = "ymd"
            for c in "/-":
                out[f"{d}{c}{m}{c}9999"], out[f"{d}{c}{m}{c}99"] = "dmy", "dms"
        out |= {f"{d} a 9999": "dny", f"a {d}, 9999": "ndy", f"{d}/9999": "my"}
    return out | {"a 9999": "Ny"}


def loose_shapes() -> dict[str, str]:
    """Shapes that only a general reader takes, weekday, time, zone and the ending of ordinals left out."""
    out = {"a 9999": "ny", "a, 9999": "ny", "a-9999": "ny", "a/9999": "ny", "9999 a": "yn", "9999-a": "yn"}
    for d in ("9", "99"):
        out |= {f"a {d}, 9999": "ndy", f"a {d} 9999": "ndy", f"{d} a, 9999": "dny", f"9999 a {d}": "ynd", f"9999-a-{d}": "ynd"}
        for c in "-/ .":
            out |= {f"{d}{c}a{c}9999": "dny", f"{d}{c}a{c}99": "dns"}
        for m, c in product(("9", "99"), "-/."):
            out |= {f"{d}{c}{m}{c}9999": "dmy", f"9999{c}{m}{c}{d}": "ymd"}
    return out


def _lookup(pairs: dict[str, object], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[x if isinstance(x, Column) else F.lit(x) for pair in pairs.items() for x in pair]), key)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is found once a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _tidy(raw: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(raw, r"\s{2,}|[^\S ]", " ")))


def _shape(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, "0123456789", "9" * 10), "[a-z]+", "a")


def _places(order: str, listed: bool) -> Column:
    """Where year, month and day stand among the parts of a text (no day: null), whether the form is a listed one, and whether that takes only a month's full name."""
    at = {{"s": "y", "n": "m", "N": "m"}.get(letter, letter): k for k, letter in enumerate(order)}
    return F.struct(F.lit(at["y"]).alias("y"), F.lit(at["m"]).alias("m"), F.lit(at.get("d")).cast("int").alias("d"), F.lit(listed).alias("listed"), F.lit("N" in order).alias("full"))


def _dated(text: Column, at: Column) -> Column:
    """A struct of day (null for one that doesn't exist) and listed, of a tidy text with its places."""
    months = {name: str(k) for k, month in enumerate(L.MONTHS, 1) for name in (month.lower(), month[:3].lower())}
    full = sorted(month.lower() for month in L.MONTHS)

    def built(parts: Column) -> Column:
        year, month = F.get(parts, at["y"]), F.get(parts, at["m"])
        century = F.when(F.length(year) > 2, "").when(year >= "69", "19").otherwise("20")
        day = F.coalesce(F.get(parts, at["d"]), F.lit("1"))
        date = F.concat(century, year, F.lit("-"), F.coalesce(_lookup(months, month), month), F.lit("-"), day).try_cast("date")
        return F.struct(date.alias("day"), (at["listed"] & (~at["full"] | month.isin(*full))).alias("listed"))

    # In every form that is read, parts stand apart by one separator, or by a comma and a space.
    return let(F.split(F.translate(text, "./-,", "   "), " "), built)


def parse_date(raw: Column) -> Column:
    """The date of a text in one of the listed formats; two-digit years from 69 on are of the last century."""
    places = {shape: _places(order, True) for shape, order in listed_shapes().items()}
    found = lambda text: let(_lookup(places, _shape(text)), lambda at: F.when(at.isNotNull(), _dated(text, at)))
    return let(let(_tidy(raw), found), lambda f: F.when(f["listed"], f["day"]))


def _bare(text: Column) -> Column:
    """A tidy text without a weekday before, a time and zone after, and the endings of ordinals."""
    days = "|".join(sorted({d[:n] for d in WEEKDAYS for n in (3, 9)}, key=lambda d: (-len(d), d)))
    zone = rf"(?: ?(?:{'|'.join(ZONES)}|[+-][0-9]{{2}}:?[0-9]{{2}}))?"
    bare = F.regexp_replace(text, rf"^(?:{days}),? |(?:[ t]|, )[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}}(?:[.][0-9]+)?)?(?: ?[ap]m)?{zone}$", "")
    return F.regexp_replace(bare, r"\b([0-9]{1,2})(?:st|nd|rd|th)\b", "$1")


def read_date(raw: Column) -> Column:
    """A struct of day and listed: as parse_date, else as a general reader takes it; null where nothing is read.

    A shape has one order for both readers, so a text is taken apart once. No text with a loose shape has
    anything that bare texts leave out, but weekdays in a month's place, which are no date either way.
    """
    loose = {shape: _places(order, False) for shape, order in loose_shapes().items()}
    both = loose | {shape: _places(order, True) for shape, order in listed_shapes().items()}

    def found(text: Column, places: dict[str, Column], otherwise: Callable[[Column], Column] | None = None) -> Column:
        dated = lambda at: F.when(at.isNotNull(), _dated(text, at))
        return let(_lookup(places, _shape(text)), dated if otherwise is None else lambda at: dated(at).otherwise(otherwise(text)))

    return let(_tidy(raw), lambda text: found(text, both, lambda t: let(_bare(t), lambda b: found(b, loose))))
