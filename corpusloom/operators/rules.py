"""Dictionary matching, routing, query rewriting and safety rules.

Dictionaries and rule tables are data: the caller passes them, and they are small. Matching
many words in long texts runs in Arrow batches (operators/dictionary.py); what an expression
can do stays in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from corpusloom.functions.text import replace_in_turn
from corpusloom.operators.dictionary import Longest, Words, scan_words


def find_all(texts: DataFrame, words: dict[str, str], negators: Sequence[str] = (), boundaries: bool = True) -> DataFrame:
    """All dictionary hits in text order: (id, keyword, canonical, start, stop).

    texts: (id, text). With boundaries a hit is dropped if a negator stands right before it,
    if it is part of a longer Latin word, or if it is part of a longer hit.
    """
    held = Words([("", w, c, "", "") for w, c in words.items() if w])
    hits = scan_words(texts, held, Longest(negators) if boundaries else None)
    return hits.select("id", "keyword", "canonical", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))


def canonical_names(hits: DataFrame) -> DataFrame:
    """Distinct canonical names of each text in order of their first hit."""
    first = hits.groupBy("id", "canonical").agg(F.min("start").alias("start"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start", "canonical"))), lambda x: x["canonical"])
    return first.groupBy("id").agg(ordered.alias("names"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def route(text: Column, symptom: Sequence[str], knowledge: Sequence[str], greetings: Sequence[str], short: int = 4) -> Column:
    """symptom before knowledge before greetings; empty is general; null if no rule applies."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return (
        F.when(low == "", "general").when(contains_any(low, symptom), "symptom").when(contains_any(low, knowledge), "knowledge")
        .when(low.isin(list(greetings)) | (F.length(low) <= short), "general")
    )


def normalise_label(raw: Column, names: Sequence[str], default: str) -> Column:
    """The name that the text equals, else the first it contains, else the default."""
    low = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.when(low.isin(list(names)), low)
    for n in names:
        out = out.when(F.contains(low, F.lit(n)), F.lit(n))
    return out.otherwise(F.lit(default))


def strip_background(text: Column, before: str, after: str, most: int = 12) -> Column:
    """Removes ``before X after`` with X of up to ``most`` characters, then edge commas and spaces."""
    return F.regexp_replace(F.regexp_replace(text, f"{before}.{{1,{most}}}?{after}", ""), r"^[, ]+|[, ]+$", "")


def enrich(text: Column, intents: Sequence[str], rules: Sequence[tuple[str, Sequence[str]]], generic: Sequence[str]) -> Column:
    """Appends the care words of all rules whose key the text has, each once and only if it isn't there."""
    words = F.array().cast("array<string>")
    for key, more in rules:
        words = F.concat(words, F.when(F.contains(text, F.lit(key)), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(*map(F.lit, generic)))
    fresh = F.filter(F.array_distinct(words), lambda w: ~F.contains(text, w))
    return F.when(contains_any(text, intents) & (F.size(fresh) > 0), F.concat_ws(" ", text, F.array_join(fresh, " "))).otherwise(text)


def rewrite(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    return replace_in_turn(text, rules)


def same_query(left: Column, right: Column) -> Column:
    flat = lambda c: F.regexp_replace(F.regexp_replace(c, r"[ \t\n\r]+", ""), r"^[,.!?;:]+|[,.!?;:]+$", "")
    return flat(left) == flat(right)


def has_anaphora(text: Column, words: Sequence[str], entities: Sequence[str], short: int = 15) -> Column:
    return contains_any(text, words) | (F.length(text) < short) & ~contains_any(text, entities)


def guard(original: Column, rewritten: Column, entities: Sequence[str]) -> Column:
    """The rewrite, unless an entity of the original is missing in it."""
    lost = F.lit(False)
    for e in entities:
        lost = lost | F.contains(original, F.lit(e)) & ~F.contains(rewritten, F.lit(e))
    return F.when(lost, original).otherwise(rewritten)


def dosage_mg(text: Column) -> Column:
    """The first number with a unit, in mg: g times 1000, ug by 1000."""
    number = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?) ?(mg|ug|g)", 1)
    unit = F.regexp_extract(text, r"([0-9]+(?:\.[0-9]+)?) ?(mg|ug|g)", 2)
    value = F.when(number != "", number).cast("double")
    return F.when(unit == "g", value * 1000).when(unit == "ug", value / 1000).otherwise(value)


def dosage_check(doses: DataFrame) -> DataFrame:
    """Exceeds if a single dose, a daily phrase, or dose times frequency is above the limit.

    doses: (id, single_mg, per_day, daily_mg, max_mg).
    """
    exceeds = (F.col("single_mg") > F.col("max_mg")) | (F.col("daily_mg") > F.col("max_mg")) | (F.col("single_mg") * F.col("per_day") > F.col("max_mg"))
    return doses.select("id", F.coalesce(exceeds, F.lit(False)).alias("exceeds"))


def interactions(items: DataFrame, rules: DataFrame) -> DataFrame:
    """Unordered pairs of a basket that a rule names in either order: (id, a, b, risk), one row a pair.

    items: (id, item), rules: (a, b, risk), small; only items that some rule names are paired.
    """
    two_way = rules.select("a", "b", "risk").unionByName(rules.select(F.col("b").alias("a"), F.col("a").alias("b"), "risk"))
    two_way = two_way.filter("a < b").groupBy("a", "b").agg(F.min("risk").alias("risk"))
    one = items.distinct()
    first = one.join(F.broadcast(two_way), F.col("item") == F.col("a")).select("id", "a", "b", "risk")
    return first.join(one.withColumnRenamed("item", "other").withColumnRenamed("id", "of"), (F.col("id") == F.col("of")) & (F.col("b") == F.col("other"))).select("id", "a", "b", "risk")


def _either_holds(items: Column, word: str) -> Column:
    """Whether an item contains the word or the word an item."""
    return F.exists(items, lambda x: F.contains(x, F.lit(word)) | F.contains(F.lit(word), x))


def combinations(items: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """Rules all of whose words a basket has, as part of an item or with one as their part: (id, rule).

    items: (id, item); a basket's distinct items are brought together, as a person's few findings are.
    """
    baskets = items.groupBy("id").agg(F.collect_set("item").alias("items"))
    met = []
    for name, words in rules.items():
        every = F.lit(True)
        for w in words:
            every = every & _either_holds(F.col("items"), w)
        met.append(F.when(every, F.lit(name)))
    return baskets.select("id", F.explode(F.array_compact(F.array(*met))).alias("rule"))


def urgency(emergency: Column, combination: Column, severity: Column, hours: Column, urgent: Column, longest: float = 72, severe: Sequence[str] = ("severe",)) -> Column:
    """red for an emergency or a dangerous combination, yellow for severity, duration or a finding to watch, else green."""
    watch = severity.isin(list(severe)) | (hours > longest) | urgent
    return F.when(emergency | combination, "red").when(watch, "yellow").otherwise("green")


def assertions(texts: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Matches of any pattern with their order in the text: (id, pattern, n, match)."""
    out = None
    for k, p in enumerate(patterns):
        found = F.regexp_extract_all("text", F.lit(p), F.lit(0))
        part = texts.select("id", F.lit(k).alias("pattern"), F.posexplode(found).alias("n", "match"))
        out = part if out is None else out.unionByName(part)
    return out


def outer_merge(seen: DataFrame, read: DataFrame) -> DataFrame:
    """Full outer merge by name; what was read overrides, and the tag says where a row comes from.

    Both: (id, name, value, unit). An id that one side lacks altogether keeps the other's rows.
    """
    s, r = seen.alias("s"), read.alias("r")
    tag = F.when(F.col("s.value").isNotNull() & F.col("r.value").isNotNull(), "verified").when(F.col("r.value").isNotNull(), "read_only").otherwise("seen_only")
    return s.join(r, ["id", "name"], "full").select("id", "name", F.coalesce("r.value", "s.value").alias("value"), F.coalesce("r.unit", "s.unit").alias("unit"), tag.alias("origin"))


def age_group(text: Column) -> Column:
    age = F.regexp_extract(text, r"([0-9]{1,3}) ?years", 1)
    years = F.when(age != "", age).cast("int")
    return F.when(years < 16, "child").when(years >= 60, "elderly").when(years.isNotNull(), "adult")


def departments(items: DataFrame, of: DataFrame, default: str) -> DataFrame:
    """Distinct departments of each id in order, the default if none is known."""
    known = items.join(F.broadcast(of), "item", "left").groupBy("id").agg(F.array_sort(F.collect_set("department")).alias("d"))
    return known.select("id", F.when(F.size("d") > 0, F.array_join("d", ",")).otherwise(F.lit(default)).alias("departments"))


def latest_severity(hits: DataFrame, order: dict[str, int]) -> DataFrame:
    """The severity that comes last in the order of the map among those a text has."""
    place = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])
    nth = F.row_number().over(W.partitionBy("id").orderBy(place[F.col("canonical")].desc()))
    return hits.withColumn("nth", nth).filter("nth = 1").select("id", F.col("canonical").alias("severity"))
