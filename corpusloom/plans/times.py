"""Time expressions in whole ``conversations``: every turn says one, or none, after its text."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import times
from corpusloom.plans.tables import read

SAID = (
    "持续三天", "头痛两周了", "有 12 小时", "十二个月前", "二十五天以来", "一百零三天了", "半年了", "昨天开始", "大前天发热", "上周", "几天了", "数小时", "",
    "已经四十分钟", "今早起", "去年", "一千二百天前", "3年了", "九日前", "三星期了",
)
NOW = "2024-03-05 10:30:15"


def _turns(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, SAID)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(SAID))) + 1).cast("int"))
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said).alias("text"))
    now = F.lit(NOW).cast("timestamp") + F.make_interval(hours=F.col("turn"))
    return c.withColumn("now", now)


def time_grounding(spark, sf_dir):
    t = _turns(spark, sf_dir).withColumn("g", times.grounded(F.col("text"), F.col("now")))
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))
    return t.select("conv_id", "turn", day("g.onset").alias("onset"), day("g.earliest").alias("earliest"), day("g.before").alias("before"), F.col("g.precision").alias("precision"), F.col("g.named").alias("named"))


def onset_durations(spark, sf_dir):
    """How long what a conversation first named has lasted at each later turn."""
    t = _turns(spark, sf_dir).withColumn("g", times.grounded(F.col("text"), F.col("now")))
    first = t.filter("g.precision = 'exact'").groupBy("conv_id").agg(F.min_by("g.onset", "turn").alias("onset"))
    return t.join(first, "conv_id").select("conv_id", "turn", F.coalesce(times.elapsed(F.col("onset"), F.col("now")), F.lit("-")).alias("elapsed"))


QUERIES = {f.__name__: f for f in (time_grounding, onset_durations)}

_UNIT, _NUMBER = "分钟|小时|天|日|周|星期|礼拜|个月|月|年", "[0-9]{1,6}|[零〇一二两三四五六七八九十百千]+|半"
_SPAN = f"(?:持续|有|已经)[\\x20]*({_NUMBER})[\\x20]*({_UNIT})|({_NUMBER})[\\x20]*({_UNIT})[\\x20]*(?:了|以|前|来)"
_DIGIT = "coalesce(nullif(strpos('一二三四五六七八九', nullif(regexp_extract(p, '{0}', 1), '')), 0), 0)"
_TURNS = f"""c AS (SELECT conv_id, turn, coalesce(text, '') || ' ' || [{', '.join(f"'{s}'" for s in SAID)}][(conv_id * 7 + turn) % {len(SAID)} + 1] AS text, TIMESTAMP '{NOW}' + to_hours(turn) AS now FROM conversations),
m AS (SELECT *, regexp_extract(text, '{_SPAN}') AS span, coalesce(nullif(regexp_extract(text, '{_SPAN}', 1), ''), regexp_extract(text, '{_SPAN}', 3)) AS num,
  coalesce(nullif(regexp_extract(text, '{_SPAN}', 2), ''), regexp_extract(text, '{_SPAN}', 4)) AS unit,
  regexp_extract(text, '大前天|前天|昨天|昨晚|今天|今早|上个月|上周|去年|前年') AS name, regexp_extract(text, '(?:几|数)[\\x20]*({_UNIT})') AS vague FROM c),
v AS (SELECT *, translate(num, '两〇', '二零') AS p FROM m),
n AS (SELECT *, CASE WHEN num = '半' THEN 0.5 WHEN regexp_matches(num, '^[0-9]+$') THEN num::DOUBLE ELSE
  (1000 * {_DIGIT.format('([一二三四五六七八九])千')} + 100 * {_DIGIT.format('([一二三四五六七八九])百')} + CASE WHEN contains(p, '十') THEN 10 * greatest(1, {_DIGIT.format('([一二三四五六七八九])十')}) ELSE 0 END
   + {_DIGIT.format('([一二三四五六七八九])$')})::DOUBLE END AS value FROM v),
b AS (SELECT *, CASE WHEN span <> '' THEN value * CASE unit WHEN '分钟' THEN 60 WHEN '小时' THEN 3600 WHEN '天' THEN 86400 WHEN '日' THEN 86400 WHEN '周' THEN 604800 WHEN '星期' THEN 604800 WHEN '礼拜' THEN 604800 WHEN '个月' THEN 2592000 WHEN '月' THEN 2592000 ELSE 31536000 END
    WHEN name <> '' THEN 86400 * CASE name WHEN '大前天' THEN 3 WHEN '前天' THEN 2 WHEN '昨天' THEN 1 WHEN '昨晚' THEN 1 WHEN '上个月' THEN 30 WHEN '上周' THEN 7 WHEN '去年' THEN 365 WHEN '前年' THEN 730 ELSE 0 END
    WHEN vague = '' THEN 0 END AS back,
  CASE WHEN span <> '' THEN CASE unit WHEN '分钟' THEN 'minute' WHEN '小时' THEN 'hour' WHEN '天' THEN 'day' WHEN '日' THEN 'day' WHEN '个月' THEN 'month' WHEN '月' THEN 'month' WHEN '年' THEN 'year' ELSE 'week' END
    WHEN name <> '' THEN CASE name WHEN '上个月' THEN 'month' WHEN '上周' THEN 'week' WHEN '去年' THEN 'year' WHEN '前年' THEN 'year' ELSE 'day' END ELSE 'minute' END AS part FROM n),
o AS (SELECT *, now - to_seconds(round(back)::BIGINT) AS onset, CASE WHEN span <> '' OR name <> '' THEN 'exact' WHEN vague <> '' THEN 'vague' ELSE 'default' END AS precision FROM b)"""
_SHOWN = "coalesce(strftime({0}, '%Y-%m-%d %H:%M:%S'), '-')"
ORACLES = {
    "time_grounding": f"""WITH {_TURNS} SELECT conv_id, turn, {_SHOWN.format('onset')} AS onset, {_SHOWN.format('date_trunc(part, onset)')} AS earliest,
  {_SHOWN.format("date_trunc(part, onset) + CASE part WHEN 'minute' THEN INTERVAL 1 MINUTE WHEN 'hour' THEN INTERVAL 1 HOUR WHEN 'day' THEN INTERVAL 1 DAY WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH ELSE INTERVAL 1 YEAR END")} AS before,
  precision, CASE WHEN span <> '' THEN span WHEN name <> '' THEN name ELSE vague END AS named FROM o""",
    "onset_durations": f"""WITH {_TURNS}, f AS (SELECT conv_id, arg_min(onset, turn) AS first FROM o WHERE precision = 'exact' GROUP BY conv_id),
e AS (SELECT o.conv_id, turn, epoch(now)::BIGINT - epoch(first)::BIGINT AS s FROM o JOIN f ON f.conv_id = o.conv_id)
SELECT conv_id, turn, CASE WHEN s < 0 THEN '-' WHEN s >= 86400 THEN (s // 86400) || '天' || CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || '小时' ELSE '' END
  WHEN s >= 3600 THEN (s // 3600) || '小时' WHEN s >= 60 THEN (s // 60) || '分钟' ELSE '刚刚' END AS elapsed FROM e""",
}
