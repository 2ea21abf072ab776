"""Column functions on answer values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from surveyloom import fixed_values as V
from surveyloom.functions.text import first_filled, strip

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_number(c: Column) -> Column:
    """Plain decimal numbers as DOUBLE, anything else NULL."""
    text = F.trim(c)
    value = text.try_cast("double")
    return F.when(text.rlike(NUMBER) & (F.abs(value) < float("inf")), value)  # NaN is above infinity


def answer_value(field_value: Column, raw_value: Column) -> Column:
    return F.coalesce(first_filled(field_value, raw_value), F.lit(""))


def is_selected(value: Column) -> Column:
    return ~strip(F.coalesce(value, F.lit(""))).isin(V.UNSELECTED_VALUES)


def recode(c: Column, mapping: Mapping[object, object], other: Column | None = None) -> Column:
    """CASE from a recode table; values not listed become ``other`` (NULL by default)."""
    case = None
    for old, new in mapping.items():
        case = F.when(c == F.lit(old), F.lit(new)) if case is None else case.when(c == F.lit(old), F.lit(new))
    return case.otherwise(other if other is not None else F.lit(None)) if case is not None else c


def band(c: Column, bands: Sequence[tuple[float | None, float | None, str]]) -> Column:
    """Label of the first band (low, high) that holds the value, both ends included."""
    case = F.lit(None).cast("string")
    for low, high, label in reversed(bands):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (c >= low)
        if high is not None:
            inside = inside & (c <= high)
        case = F.when(inside & c.isNotNull(), F.lit(label)).otherwise(case)
    return case


def drop_first_choice(c: Column) -> Column:
    """Choice 1 means "not taken": NULL; the others move down by one."""
    return F.when(c > 1, c - 1)


def leading_score(c: Column) -> Column:
    """``4(符合)`` → 4, a bare number as it is."""
    return parse_number(F.regexp_replace(c, r"^([0-9]+)\(.*$", "$1"))


def split_blanks(c: Column, n: int) -> list[Column]:
    """The first ``n`` numbers of a multi-blank answer."""
    return blank_numbers(blank_parts(c), n)


def blank_parts(c: Column) -> Column:
    return F.split(c, r"\|\r\n|\|\n|\|")


def blank_numbers(parts: Column, n: int) -> list[Column]:
    return [parse_number(F.try_element_at(parts, F.lit(i + 1))) for i in range(n)]


def chosen_count(c: Column, none_label: str, other_word: str = "其他", separator: str = r"\|\r\n") -> Column:
    """Number of chosen options; every "other…" entry together counts once."""
    items = F.filter(F.split(c, separator), lambda x: x != none_label)
    is_other = lambda x: x.contains(other_word)
    count = F.size(F.filter(items, lambda x: ~is_other(x))) + F.exists(items, is_other).cast("int")
    return F.when(c.isNotNull(), count)


def sleep_hours(wake_h: Column, wake_m: Column, bed_h: Column, bed_m: Column) -> Column:
    """Hours slept from wake and bed time on a twelve or 24 hour clock."""
    return plausible_sleep(hours_between(wake_h, wake_m, bed_h, bed_m))


def hours_between(wake_h: Column, wake_m: Column, bed_h: Column, bed_m: Column) -> Column:
    bed = F.when(bed_h.between(8, 11), bed_h + 12).when(bed_h == 12, F.lit(0.0)).otherwise(bed_h)
    wake_minutes = wake_h * 60 + wake_m
    minutes = F.when(bed > 17, wake_minutes + (24 - bed) * 60 - bed_m).when(
        bed < 8, wake_minutes - (bed * 60 + bed_m)
    )
    return F.round(minutes / 60, 2)


def plausible_sleep(hours: Column) -> Column:
    return F.when((hours > 2) & (hours < 15), hours)


def bounded_hours(c: Column, limit: float = 24) -> Column:
    hours = parse_number(F.regexp_replace(c, r"\|", ""))
    return F.when(hours <= limit, hours)


def option_labels(options: Column) -> Column:
    """Labels of an option list ``a//C//b_______//C//c`` in code order."""
    return F.transform(
        F.split(options, "//C//"),
        lambda o: F.trim(F.split(F.trim(o), "_______").getItem(0)),
    )
