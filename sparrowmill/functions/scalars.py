"""Column functions of the domain: built-in expressions only, no Python on the executors."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparrowmill.functions import dates
from sparrowmill.functions import lookups as L


def first_match(pairs: list[tuple[Column, Column]]) -> Column:
    """The value beside the first condition that holds, else null."""
    out = None
    for condition, value in pairs:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out


def unit_to_ppb(value: Column, unit: Column) -> Column:
    """value (text, thousands' commas allowed) in ppb; null if it is no number or the unit is unknown.

    The unit's own factor, else that of the first listed unit which contains it or is contained in it.
    """
    u = F.regexp_replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), "[µμ]", "u")
    number = parse_number(value).try_cast("double")
    exact = [(u == key, F.lit(factor)) for key, factor in L.UNIT_TO_PPB.items()]
    partial = [(u.contains(key) | F.lit(key).contains(u), F.lit(factor)) for key, factor in L.UNIT_TO_PPB.items()]
    return number * first_match(exact + partial)


def parse_number(value: Column) -> Column:
    """Text with thousands' commas as text that casts to a number."""
    return F.regexp_replace(F.trim(value), ",", "")


def parse_date(raw: Column) -> Column:
    """The date under the one of DATE_FORMATS that fits; two-digit years from 69 on are of the last century."""
    return dates.parse_date(raw)


def parse_date_loosely(raw: Column) -> Column:
    """A struct of day and ambiguous: as parse_date, else as a general reader takes it, when ambiguous is true."""
    stated = date_is_ambiguous(raw)
    return dates.let(dates.read_date(raw), lambda f: F.struct(f["day"].alias("day"), ((f["day"].isNotNull() & ~f["listed"]).eqNullSafe(True) | stated).alias("ambiguous")))


def date_is_ambiguous(raw: Column) -> Column:
    """Day and month could be exchanged: both from 1 to 12, and different."""
    one, other = r"(?:0?([1-9])|(1[0-2]))[/-]", r"(?:0?[1-9]|1[0-2])[/-]"
    return F.coalesce(F.trim(raw).rlike(rf"^{one}(?!(?:0?\1|\2)[/-]){other}"), F.lit(False))


def normalise_pass_fail(raw: Column) -> Column:
    """True, false or null (unknown) from a verdict in words."""
    w = F.lower(F.trim(raw))
    good = w.rlike("pass|satisfactory|conforming|safe|compliant")
    return F.when(good, ~w.rlike("not|un|non|fail")).when(w.contains("fail"), F.lit(False))


def infer_pass_fail(verdict: Column, ppb: Column, limit: Column) -> Column:
    return F.coalesce(verdict, ppb <= limit)


def canonical_state(raw: Column) -> Column:
    """The state with this name or short name, else the text itself in title case; null for empty."""
    key = F.lower(F.trim(raw))
    names = [(key.isin(*aliases), F.lit(state)) for state, aliases in L.STATES.items()]
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(None)).otherwise(F.coalesce(first_match(names), F.initcap(raw)))


def state_in_title(title: Column) -> Column:
    """The first listed state one of whose names occurs in a title."""
    t = F.lower(title)
    return first_match([(t.contains(alias), F.lit(state)) for alias, state in L.STATE_ALIASES.items()])


def commodity_category(name: Column) -> Column:
    key = F.lower(F.trim(name))
    return first_match([(key.contains(word), F.lit(category)) for word, category in L.CATEGORY_WORDS.items()])


def lab_tier(name: Column) -> Column:
    """1 if a keyword of the first tier occurs in the name, else null."""
    key = F.lower(name)
    return first_match([(key.contains(word), F.lit(1)) for word in L.TIER1_KEYWORDS])


def redact_email(address: Column) -> Column:
    user = F.substring_index(address, "@", 1)
    host = F.when(address.contains("@"), F.split_part(address, F.lit("@"), F.lit(2)))
    return F.concat(F.substring(user, 1, 2), F.lit("***@"), F.coalesce(F.nullif(host, F.lit("")), F.lit("***")))


def first_digit(value: Column) -> Column:
    """The first digit other than 0; null for values that aren't over 0."""
    digits = F.regexp_extract(value.cast("decimal(38,6)").cast("string"), "[1-9]", 0)
    return F.when(value > 0, F.nullif(digits, F.lit("")).cast("int"))


def is_round(value: Column) -> Column:
    """Within 0.001 of a multiple of a half."""
    return F.abs(value - F.rint(value * 2) / 2) < 0.001


def quarter_label(day: Column) -> Column:
    return F.date_format(day, "yyyy-'Q'Q")


def quarter_season(label: Column) -> Column:
    return F.right(label, F.lit(1)).cast("int")


def fail_rate(failed: Column, tests: Column) -> Column:
    """The share of failures, four decimals."""
    return F.round(failed.cast("decimal(18,0)") / tests.cast("decimal(18,0)"), 4)


def dedup_hash(day: Column, lab: Column, commodity: Column, contaminant: Column, ppb: Column, district: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    value = F.coalesce(ppb, F.lit(0.0)).cast("decimal(38,3)")
    return F.sha2(F.concat_ws("|", text(day), text(lab), F.lower(F.trim(text(commodity))), text(contaminant), value.cast("string"), text(district)), 256)


def confidence(tier1: Column, in_range: Column, ocr: Column, manual: Column) -> Column:
    """Base plus what applies, within 0 and 1, three decimals."""
    part = lambda condition, name: F.when(condition, F.lit(L.CONFIDENCE[name])).otherwise(F.lit(0.0)).cast("decimal(4,3)")
    total = F.lit(L.CONFIDENCE["base"]).cast("decimal(4,3)") + part(manual, "manual") + part(tier1, "tier1") + part(in_range, "range") + part(ocr < L.OCR_LEAST, "low_ocr")
    return F.greatest(F.lit(0).cast("decimal(4,3)"), F.least(F.lit(1).cast("decimal(4,3)"), total.cast("decimal(4,3)")))


def confidence_parts(tier1: Column, in_range: Column, ocr: Column, manual: Column) -> Column:
    """A map of what makes up a confidence: the base and each part that applies."""
    applies = {"base": F.lit(True), "manual": manual, "tier1": tier1, "range": in_range, "low_ocr": ocr < L.OCR_LEAST}
    whole = F.create_map(*[x for name, condition in applies.items() for x in (F.lit(name), F.when(condition, F.lit(L.CONFIDENCE[name])))])
    return F.map_filter(whole, lambda _, v: v.isNotNull())


def sort_tokens(text: Column) -> Column:
    """Lower-cased words in order, joined by a space."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")), " ")


def similarity(a: Column, b: Column) -> Column:
    """200 times the longest common subsequence over both lengths; 100 for equal texts, both in token order already.

    The table of the usual recurrence is folded row by row, one array a letter of a.
    """
    letters_a, letters_b = F.filter(F.split(a, ""), lambda c: c != ""), F.filter(F.split(b, ""), lambda c: c != "")
    start = F.transform(letters_b, lambda _: F.lit(0))

    def row(above: Column, letter: Column) -> Column:
        def cell(left: Column, x: Column) -> Column:
            i = F.size(left)
            over = F.element_at(above, i + 1)
            corner = F.when(i == 0, F.lit(0)).otherwise(F.element_at(above, F.greatest(i, F.lit(1))))
            beside = F.when(i == 0, F.lit(0)).otherwise(F.element_at(left, F.lit(-1)))
            return F.concat(left, F.array(F.when(x == letter, corner + 1).otherwise(F.greatest(over, beside))))

        return F.aggregate(letters_b, F.expr("cast(array() as array<int>)"), cell)

    common = F.aggregate(letters_a, start, row)
    size = F.length(a) + F.length(b)
    best = F.when(F.size(common) == 0, F.lit(0)).otherwise(F.element_at(common, F.lit(-1)))
    return F.when(size == 0, F.lit(100.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(200.0 * best / size)


def by_first_letter(alternatives: list[str], before: str = "") -> str:
    """Patterns that begin with a letter each, after before, as one group; it finds what they find joined by |.

    At each place only those with the place's letter are tried, in their order. Letters beyond Latin-1 pass
    the first look, as some fold to a Latin one in either case.
    """
    groups: dict[str, list[str]] = {}
    for a in alternatives:
        groups.setdefault(a[0].lower(), []).append(a[1:])
    letters = "".join(sorted(groups))
    return rf"(?-iu:(?=[{letters}{letters.upper()}\x{{100}}-\x{{10FFFF}}])){before}({'|'.join(f'{c}(?:{"|".join(rest)})' for c, rest in groups.items())})"


def field_patterns() -> dict[str, str]:
    """Patterns, in either case, of fields in running text, made of the vocabularies; the first group is the field, of a value the second its unit."""
    flexible = lambda words: [r"[\s-]*".join(map(re.escape, re.split("[ -]", w))) for w in sorted(set(words), key=lambda w: (-len(w), w))]
    # A toxin's letter and number belong to its name.
    suffix = {"aflatoxin": r"(?:[\s-]?[bg][12]?|[\s-]?[12])?", "ochratoxin": r"[\s-]?a"}
    findings = by_first_letter([flexible([w])[0] + suffix.get(w, "") for w in sorted(L.FINDING_WORDS, key=lambda w: (-len(w), w))])
    stems = "|".join(m[:3] for m in L.MONTHS)
    digits = lambda *sizes: "[/-]".join(rf"\d{{{n}}}" for n in sizes)
    dates = [digits("1,2", "1,2", "2,4"), digits("4", "2", "2"), rf"(?:{stems})[a-z]*[\s,]+\d{{4}}"]
    units = "|".join(re.escape(u) for u in sorted(L.UNIT_TO_PPB, key=len, reverse=True))
    return {
        "contaminant": findings,
        "value_unit": rf"(\d+(?:\.\d+)?)\s*({units})",
        "pass_fail": by_first_letter(flexible(L.VERDICT_WORDS), r"\b") + r"\b",
        "date": rf"\b({'|'.join(dates)})\b",
        "lab_id": rf"\b((?:{'|'.join(L.LAB_CODES)})[/-]?[A-Z0-9]{{4,20}})\b",
        "state": by_first_letter(list(L.STATES), r"\b") + r"\b",
    }


def chi2_survival_8(x: Column) -> Column:
    """P(X > x) for chi-square with 8 degrees of freedom, in closed form."""
    h = x / 2
    return F.exp(-h) * (1 + h + h * h / 2 + h * h * h / 6)
