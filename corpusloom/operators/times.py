"""Times that a text names: how long something has lasted or when it began, as an interval.

A small grammar in column expressions: a number in digits or Chinese numerals below ten thousand
(a half too) and a unit, next to words that make it a span; days and weeks named from today;
vague spans. The interval is the minute, hour, day, week, month or year that the time lies in.
Months count 30 days and years 365.

Precision is ``exact``, ``vague`` (a unit without a number) or ``default``: nothing is named, so
the time is now. Spans go before named days, those before vague spans; the leftmost counts.
Null texts are empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units with their seconds and the part of the calendar they name.
UNITS = {
    "分钟": (60, "minute"), "小时": (3600, "hour"), "天": (86400, "day"), "日": (86400, "day"), "周": (604800, "week"), "星期": (604800, "week"),
    "礼拜": (604800, "week"), "个月": (2592000, "month"), "月": (2592000, "month"), "年": (31536000, "year"),
}
#: Names of days and weeks with the days they lie back and the part of the calendar they name.
NAMED = {
    "大前天": (3, "day"), "前天": (2, "day"), "昨天": (1, "day"), "昨晚": (1, "day"), "今天": (0, "day"), "今早": (0, "day"),
    "上个月": (30, "month"), "上周": (7, "week"), "去年": (365, "year"), "前年": (730, "year"),
}
DIGITS = "一二三四五六七八九"

_UNIT = "分钟|小时|天|日|周|星期|礼拜|个月|月|年"
_NUMBER = r"[0-9]{1,6}|[零〇一二两三四五六七八九十百千]+|半"
SPAN = rf"(?:持续|有|已经)[\x20]*({_NUMBER})[\x20]*({_UNIT})|({_NUMBER})[\x20]*({_UNIT})[\x20]*(?:了|以|前|来)"
VAGUE = rf"(?:几|数)[\x20]*({_UNIT})"
NAME = "大前天|前天|昨天|昨晚|今天|今早|上个月|上周|去年|前年"


def number(text: Column) -> Column:
    """The value of a number in digits or Chinese numerals; a last digit counts ones, so 一百五 is 105."""
    plain = F.translate(text, "两〇", "二零")
    digit = lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(DIGITS), c))
    before = lambda unit: digit(F.regexp_extract(plain, f"([{DIGITS}]){unit}", 1))
    tens = F.when(F.contains(plain, F.lit("十")), F.greatest(before("十"), F.lit(1))).otherwise(0)
    spoken = 1000 * before("千") + 100 * before("百") + 10 * tens + digit(F.regexp_extract(plain, f"([{DIGITS}])$", 1))
    return F.when(text == "半", 0.5).when(text.rlike("^[0-9]+$"), F.expr("0.0") + text.try_cast("double")).otherwise(spoken.cast("double"))


def _look_up(key: Column, table: dict, place: int, kind: str) -> Column:
    entries = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[place]))])
    return F.try_element_at(entries, key).cast(kind)


def _floor(part: Column, at: Column) -> Column:
    out = F.date_trunc("minute", at)
    for name in ("hour", "day", "week", "month", "year"):
        out = F.when(part == name, F.date_trunc(name, at)).otherwise(out)
    return out


def grounded(text: Column, now: Column) -> Column:
    """struct(onset, earliest, before, precision, named) of a text said at ``now``; onset lies in [earliest, before).

    A vague span has no onset and no interval.
    """
    text = F.coalesce(text, F.lit(""))
    group = lambda pattern, k: F.regexp_extract(text, pattern, k)
    span, name, vague = group(SPAN, 0), group(NAME, 0), group(VAGUE, 0)
    either = lambda a, b: F.when(group(SPAN, a) != "", group(SPAN, a)).otherwise(group(SPAN, b))
    value, unit = number(either(1, 3)), either(2, 4)
    back = F.when(span != "", value * _look_up(unit, UNITS, 0, "double")).when(name != "", 86400.0 * _look_up(name, NAMED, 0, "double"))
    back = F.when((span == "") & (name == "") & (vague == ""), 0.0).otherwise(back)
    part = F.when(span != "", _look_up(unit, UNITS, 1, "string")).when(name != "", _look_up(name, NAMED, 1, "string")).otherwise("minute")
    onset = F.timestamp_seconds(F.unix_timestamp(now) - F.round(back).cast("long"))
    earliest = _floor(part, onset)
    step = {p: F.expr(f"interval 1 {p}") for p in ("hour", "day", "week", "month", "year")}
    before = earliest + F.expr("interval 1 minute")
    for p, one in step.items():
        before = F.when(part == p, earliest + one).otherwise(before)
    precision = F.when((span != "") | (name != ""), "exact").when(vague != "", "vague").otherwise("default")
    named = F.when(span != "", span).when(name != "", name).otherwise(vague)
    return F.struct(onset.alias("onset"), F.when(onset.isNotNull(), earliest).alias("earliest"), F.when(onset.isNotNull(), before).alias("before"), precision.alias("precision"), named.alias("named"))


def elapsed(onset: Column, now: Column) -> Column:
    """How long ago, in days and hours, hours, or minutes; null if it lies ahead."""
    s = F.unix_timestamp(now) - F.unix_timestamp(onset)
    days, hours, minutes = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s / 60)
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return (
        F.when(s < 0, F.lit(None)).when((days > 0) & (hours > 0), F.concat(say(days, "天"), say(hours, "小时"))).when(days > 0, say(days, "天"))
        .when(hours > 0, say(hours, "小时")).when(minutes > 0, say(minutes, "分钟")).otherwise(F.when(s.isNotNull(), "刚刚"))
    )


def asks_how_long(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("几天|多久|多长")
