"""Text helpers as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(text: Column) -> Column:
    """Quotes, tilde, plus and line breaks to spaces, ``[`` dropped, ``]`` to ``_``, white space collapsed and trimmed."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\r\n‘’“”'\"~+][", "          _")
    return F.trim(F.regexp_replace(plain, r"\s{2,}", " "))


def normalize_key(text: Column) -> Column:
    """Trimmed, one pass of double to single spaces, upper case."""
    return F.upper(F.replace(F.trim(text), F.lit("  "), F.lit(" ")))


def safe_name(text: Column) -> Column:
    """Letters, digits and Hangul kept, the rest as single underscores, none at the ends; ``Unnamed`` if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9가-힣]+", "_"), r"^_+|_+$", "")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unnamed")).otherwise(name)


def sheet_name(text: Column, longest: int = 31) -> Column:
    return F.substring(F.regexp_replace(text, r"[\\/?*\[\]:]", "_"), 1, longest)


def number(text: Column) -> Column:
    """A number with thousands separators; null if it isn't one."""
    return F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def holds(text: Column, part: str) -> Column:
    """Whether the text has the part, regardless of case; no sign in the part has a meaning of its own."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def under(path: Column, prefix: str) -> Column:
    return F.startswith(path, F.lit(prefix))


def percent(text: Column) -> Column:
    return F.regexp_replace(text, r"[%\s]", "").try_cast("double")


def holds_number(text: Column, value: Column) -> Column:
    """Whether the whole number stands in the text, with no digit next to it, thousands separators ignored."""
    return F.regexp_like(F.replace(text, F.lit(","), F.lit("")), F.concat(F.lit("(^|[^0-9])"), value.cast("string"), F.lit("($|[^0-9])")))


#: Words that the classifier reads as others.
SYNONYMS = {"VIS": "VISUAL", "VSL": "VISUAL", "FUNC": "FUNCTION"}
#: What a defect label holds if it tells of a criterion that a unit may fail and still pass.
CRITERIA = ("moving", "deform", " ok", "oqc")
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def compared(text: Column, normal: bool = False) -> Column:
    """The text by which names are compared: trimmed, and normalised if asked."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return normalize(trimmed) if normal else trimmed


def classified(text: Column) -> Column:
    """The text by which the classifier compares: normalised, upper case, signs but dashes as single spaces."""
    return F.trim(F.regexp_replace(F.upper(compared(text, True)), r"[^A-Z0-9-]+", " "))


def tokens(text: Column, synonyms: dict[str, str] = SYNONYMS) -> Column:
    """Upper-case tokens of letters and digits, synonyms replaced, all-digit tokens dropped, each once in order."""
    words = F.split(classified(text), "[ -]+")
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    words = F.transform(words, lambda w: F.coalesce(F.element_at(table, w), w))
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~F.regexp_like(w, F.lit("^[0-9]+$"))))


def criterion_label(text: Column) -> Column:
    """Whether a defect label names a criterion."""
    return F.coalesce(F.regexp_like(F.lower(text), F.lit("|".join(CRITERIA))), F.lit(False))


def month_name(key: Column) -> Column:
    """The short name of M1 to M12; other keys as they are."""
    table = F.create_map(*[F.lit(x) for i, name in enumerate(MONTHS) for x in (f"M{i + 1}", name)])
    return F.coalesce(F.element_at(table, key), key)


def fenced_json(text: Column) -> Column:
    """The part of a model's answer that is JSON: inside a fence, or from the first brace to the last."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    found = F.when(inner != "", inner).otherwise(F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1))
    return F.regexp_replace(found, r"^\s+|\s+$", "")


#: Date formats in the order they are tried; those without a year take one as a parameter.
DATES = ("yyyy-M-d", "yyyy/M/d", "M-d", "M/d", "d-MMM", "d-MMM-yyyy", "d/MMM")
#: The last of the hundred years that two digits can mean.
LAST_SHORT_YEAR = 2049


def parse_date(text: Column, year: int) -> Column:
    """The first format that fits, else what a general parser makes of it; texts without a year take ``year``, a parameter so that results don't change by day.

    Days and months may have one digit or two, but the numbers of dates that begin with a year are whole. Two digits
    after a month's name are a year up to LAST_SHORT_YEAR.
    """
    short = F.regexp_extract(F.trim(text), "^[0-9]{1,2}-[A-Za-z]{3}-([0-9]{2})$", 1)
    century = F.when(short.try_cast("int") <= LAST_SHORT_YEAR % 100, str(LAST_SHORT_YEAR // 100)).otherwise(str(LAST_SHORT_YEAR // 100 - 1))
    trimmed = F.when(short != "", F.concat(F.regexp_replace(F.trim(text), "[0-9]{2}$", ""), century, short)).otherwise(F.trim(text))
    found = []
    for f in DATES:
        if "y" in f:
            whole = F.regexp_like(trimmed, F.lit("^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}$")) if f.startswith("y") else F.regexp_like(trimmed, F.lit("-[0-9]{4}$"))
            found.append(F.when(whole, F.try_to_timestamp(trimmed, F.lit(f))))
        else:
            found.append(F.try_to_timestamp(F.concat(F.lit(f"{year} "), trimmed), F.lit(f"yyyy {f}")))
    return F.coalesce(*found, _general_date(F.trim(text))).cast("date")


#: Forms of a whole date that a general parser takes, with the groups that are year, month and day.
WHOLE_DATES = (
    (r"^(\d{4})([-/])(\d{1,2})\2(\d{1,2})$", (1, 3, 4)),
    (r"^(\d{1,2})([-/])(\d{1,2})\2(\d{4})$", (4, 1, 3)),
    (r"^(?:[A-Za-z]{3,9}, )?([A-Za-z]{3,9}) (\d{1,2}),? (\d{4})$", (3, 1, 2)),
    (r"^(?:[A-Za-z]{3,9}, )?(\d{1,2}) ([A-Za-z]{3,9}),? (\d{4})$", (3, 2, 1)),
)
#: A time of day behind a date: hours to seconds, a half of the day, a zone.
CLOCK = r" ((?:[01]?\d|2[0-3]):[0-5]?\d(?::[0-5]?\d(?:\.\d{1,7})?)?)( ?[AaPp][Mm])?( ?(?:Z|GMT|[+-]\d{2}:\d{2}))?$"
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _general_date(trimmed: Column) -> Column:
    """A whole date with or without a time of day; a name of a weekday before it isn't checked.

    Numbers are month, day, year if they don't begin with the year. Times with a zone are taken to the session's.
    """
    months = F.create_map(*[F.lit(x) for i, name in enumerate(FULL_MONTHS) for n in dict.fromkeys((name, name[:3])) for x in (n, str(i + 1))])

    def numbers(day: Column) -> Column:
        found = F.lit(None).cast("string")
        for form, groups in WHOLE_DATES:
            parts = [F.regexp_extract(day, form, g) for g in groups]
            parts[1] = F.coalesce(F.element_at(months, F.lower(parts[1])), parts[1])
            found = F.when(F.regexp_like(day, F.lit(form)), F.concat_ws("-", *parts)).otherwise(found)
        return found

    def parsed(p: Column) -> Column:
        sound = (p["half"] == "") | ~F.regexp_like(p["clock"], F.lit("^(0?0|1[3-9]|2[0-3]):"))
        zoned = F.concat(p["day"], F.lit(" "), p["clock"], F.when(p["zone"] == "GMT", "Z").otherwise(p["zone"]))
        return F.when(p["zone"] != "", F.try_to_timestamp(zoned, F.lit("yyyy-M-d H:m[:s][.SSSSSSS]XXX"))).when(sound, F.try_to_timestamp(p["day"], F.lit("yyyy-M-d")))

    def cut(spaced: Column) -> Column:
        clock = [F.trim(F.regexp_extract(spaced, CLOCK, i)).alias(n) for i, n in enumerate(("clock", "half", "zone"), 1)]
        return F.struct(_once(F.regexp_replace(spaced, CLOCK, ""), numbers).alias("day"), *clock)

    spaced = F.regexp_replace(F.regexp_replace(trimmed, r"^(\d{4}-\d{1,2}-\d{1,2})T(?=\d)", "$1 "), r"\s+", " ")
    return _once(_once(spaced, cut), parsed)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def same_date(a: Column, b: Column, year: int) -> Column:
    """Whether two texts are equal but for case and outer space, or are the same date."""
    left, right = (F.trim(F.coalesce(c, F.lit(""))) for c in (a, b))
    return (F.lower(left) == F.lower(right)) | F.coalesce(parse_date(left, year) == parse_date(right, year), F.lit(False))


def process_type(text: Column, keep_unknown: bool = True) -> Column:
    """The four process types by their names; others as they are, or empty."""
    upper = F.upper(F.trim(text))
    kinds = F.when(upper.startswith("SUB"), "SUB").when(upper.startswith("MAIN"), "MAIN").when(upper.contains("FUNCTION"), "FUNCTION").when(upper.contains("VISUAL"), "VISUAL")
    return kinds.otherwise(text if keep_unknown else F.lit(""))


def material_of(material: Column, line_shift: Column) -> Column:
    """The material, or where it is blank the line shift's part before its last underscore, or all of it if that is none."""
    before = F.regexp_extract(line_shift, "(?s)^(.+)_[^_]*$", 1)
    return F.coalesce(F.nullif(material, F.lit("")), F.nullif(before, F.lit("")), line_shift)


def process_rank(kind: Column) -> Column:
    return F.when(kind.startswith("SUB"), 1).when(kind == "MAIN", 2).when(kind == "FUNCTION", 3).when(kind == "VISUAL", 4).otherwise(5)
