"""Review of answers: assertions, urgent findings, disclaimers, medication rules, triage of a person.

Rule tables, word lists and templates are arguments, and small. All of it is expressions over
one row, so a review of any number of answers needs no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.rules import contains_any

_NONE = "array<string>"


def none() -> Column:
    return F.array().cast(_NONE)


def either_holds(items: Column, word: str) -> Column:
    """Whether an item contains the word, or the word an item."""
    return F.exists(F.coalesce(items, none()), lambda x: F.contains(x, F.lit(word)) | F.contains(F.lit(word), x))


def words_where(words: Sequence[str], holds) -> Column:
    """The words for which ``holds(word)`` is true, in their order."""
    return F.array_compact(F.array(*[F.when(holds(w), F.lit(w)) for w in words])) if words else none()


# --- assertions


@dataclass(frozen=True)
class Assertion:
    """A pattern to find; ``keyword`` is the part at its start that ``replacement`` takes the place of."""

    pattern: str
    replacement: str
    keyword: str | None = None


def assertion_places(text: Column, rules: Sequence[Assertion]) -> Column:
    """array of (pattern, match, position) of all rules in their order; positions count code points from 0.

    The matches of a pattern don't overlap, so each is where its text next occurs. Patterns may
    not look at what lies around a match.
    """
    text = F.coalesce(text, F.lit(""))
    out = F.array().cast("array<struct<pattern:string,match:string,position:int>>")
    for rule in rules:
        found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<pattern:string,match:string,position:int>>").alias("all"))

        out = F.concat(out, F.aggregate(found, start, _placing(text, rule.pattern), lambda s: s["all"]))
    return out


def _placing(text: Column, pattern: str):
    def step(state: Column, match: Column) -> Column:
        here = F.call_function("locate", match, text, state["at"])
        row = F.struct(F.lit(pattern).alias("pattern"), match.alias("match"), (here - 1).alias("position"))
        return F.struct((here + F.length(match)).alias("at"), F.concat(state["all"], F.array(row)).alias("all"))

    return step


def revise_assertions(text: Column, rules: Sequence[Assertion]) -> Column:
    """The text with the keyword of each match replaced; the rest of a match stays."""
    for rule in rules:
        if rule.keyword is None:
            pattern = rule.pattern
        else:
            rest = rule.pattern.removeprefix(re.escape(rule.keyword)).removeprefix(rule.keyword)
            pattern = f"{re.escape(rule.keyword)}(?={rest})"
        text = F.regexp_replace(text, pattern, rule.replacement.replace("\\", "\\\\").replace("$", "\\$"))
    return text


# --- urgent findings and disclaimers


def emergencies(answer: Column, findings: Column, onset_names: Column, words: Sequence[str], care: Sequence[str]) -> Column:
    """struct(found, addressed, needs_alert): findings and onsets that hold an urgent word, then urgent words of the answer."""
    answer = F.coalesce(answer, F.lit(""))
    urgent = lambda xs: F.filter(F.coalesce(xs, none()), lambda x: contains_any(x, words))
    found = F.array_distinct(F.concat(urgent(findings), urgent(onset_names), words_where(words, lambda w: F.contains(answer, F.lit(w)))))
    addressed = contains_any(answer, care)
    return F.struct(found.alias("found"), addressed.alias("addressed"), ((F.size(found) > 0) & ~addressed).alias("needs_alert"))


def has_disclaimer(answer: Column, marks: Sequence[str]) -> Column:
    return contains_any(F.coalesce(answer, F.lit("")), marks)


def append(answer: Column, *parts: Column | str) -> Column:
    """The answer without white space at its end, and the parts."""
    return F.concat(F.rtrim(F.regexp_replace(answer, r"\s+$", "")), *[F.lit(p) if isinstance(p, str) else p for p in parts])


@dataclass(frozen=True)
class ReviewRules:
    assertions: Sequence[Assertion]
    urgent: Sequence[str]
    care: Sequence[str]
    disclaimer: str
    disclaimer_marks: Sequence[str]
    alert: tuple[str, str] = ("\n\nUrgent: you mentioned ", ", please see a doctor at once.")


def review(answers: DataFrame, rules: ReviewRules) -> DataFrame:
    """(id, status, risk_tags, revised): assertions softened, an alert and a disclaimer appended where they lack.

    answers: (id, answer, findings, onset_names). Status is revise if anything was changed. A null answer is empty.
    """
    text = F.coalesce("answer", F.lit(""))
    checks = answers.select(
        "id", text.alias("answer"), assertion_places(text, rules.assertions).alias("claims"),
        emergencies(text, F.col("findings"), F.col("onset_names"), rules.urgent, rules.care).alias("e"), has_disclaimer(text, rules.disclaimer_marks).alias("disclaimed"),
    )
    claimed = F.size("claims") > 0
    revised = F.when(claimed, revise_assertions(F.col("answer"), rules.assertions)).otherwise(F.col("answer"))
    revised = F.when(F.col("e.needs_alert"), append(revised, rules.alert[0], F.array_join("e.found", ", "), rules.alert[1])).otherwise(revised)
    revised = F.when(~F.col("disclaimed"), append(revised, "\n\n" + rules.disclaimer)).otherwise(revised)
    tags = F.array_compact(F.array(F.when(claimed, "diagnostic_assertion"), F.when(F.col("e.needs_alert"), "emergency_risk_missed")))
    changed = claimed | F.col("e.needs_alert") | ~F.col("disclaimed")
    return checks.select("id", F.when(changed, "revise").otherwise("pass").alias("status"), tags.alias("risk_tags"), revised.alias("revised"))


# --- triage


@dataclass(frozen=True)
class TriageRules:
    urgent: Sequence[str]
    watch: Sequence[str]
    combinations: dict[str, Sequence[str]]
    departments: dict[str, str]
    department: str = "general"
    longest_hours: float = 72
    severe: Sequence[str] = ("severe",)
    names: dict[str, str] = field(default_factory=lambda: {"red": "emergency", "yellow": "see a doctor", "green": "at home"})


def longest_duration(onsets: DataFrame, now: Column) -> DataFrame:
    """(id, hours) since the earliest known onset, to one digit; no row for ids without. onsets: (id, name, onset)."""
    hours = (F.unix_micros(now) - F.unix_micros(F.col("onset").cast("timestamp"))) / 3.6e9
    known = onsets.filter("onset is not null").groupBy("id").agg(F.max(hours).alias("hours"))
    return known.select("id", F.round(F.greatest(F.lit(0.0), "hours"), 1).alias("hours"))


def suggested_departments(findings: Column, rules: TriageRules) -> Column:
    """For each finding the department of the first key that holds it or that it holds; distinct, in order."""
    of = lambda x: F.coalesce(*[F.when(F.contains(x, F.lit(k)) | F.contains(F.lit(k), x), F.lit(d)) for k, d in rules.departments.items()], F.lit(None))
    found = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.coalesce(findings, none()), of))))
    return F.when(F.size(found) > 0, F.array_join(found, " or ")).otherwise(F.lit(rules.department))


def triage(people: DataFrame, rules: TriageRules) -> DataFrame:
    """(id, level, reason, risk_tags, status, advice) of (id, findings, severity, hours)."""
    findings = F.coalesce("findings", none())
    urgent = words_where(rules.urgent, lambda w: either_holds(findings, w))
    together = F.array_compact(F.array(*[F.when(_all(either_holds(findings, w) for w in ws), F.lit(name)) for name, ws in rules.combinations.items()]))
    watch = words_where(rules.watch, lambda w: F.contains(F.array_join(findings, " "), F.lit(w)))
    p = people.withColumns({"urgent": urgent, "together": together, "watch": watch})
    severe, long = F.coalesce(F.col("severity").isin(list(rules.severe)), F.lit(False)), F.coalesce(F.col("hours") > rules.longest_hours, F.lit(False))
    reason = (
        F.when(F.size("urgent") > 0, F.concat(F.lit("urgent: "), F.array_join("urgent", ", "))).when(F.size("together") > 0, F.concat(F.lit("together: "), F.array_join("together", ", ")))
        .when(severe, "severe").when(long, "long").when(F.size("watch") > 0, F.concat(F.lit("watch: "), F.array_join("watch", ", "))).otherwise("mild")
    )
    level = F.when((F.size("urgent") > 0) | (F.size("together") > 0), "red").when(severe | long | (F.size("watch") > 0), "yellow").otherwise("green")
    tags = F.array_compact(F.array(F.when(F.size("urgent") > 0, "emergency_symptom"), F.when(F.size("together") > 0, "dangerous_combination"), F.when(long, "duration_exceeded")))
    p = p.select("*", level.alias("level"), reason.alias("reason"), tags.alias("risk_tags"))
    action = F.when(F.col("level") == "yellow", F.concat(F.lit("see "), suggested_departments(F.col("findings"), rules))).when(F.col("level") == "red", "go at once").otherwise("rest")
    named = F.create_map(*[x for k, v in rules.names.items() for x in (F.lit(k), F.lit(v))])[F.col("level")]
    said = F.when(F.size(findings) > 0, F.array_join(findings, ", ")).otherwise("not clear")
    lasted = F.when(F.col("hours").isNotNull(), F.format_string("%.0f h", "hours")).otherwise("not known")
    advice = F.concat_ws("\n", F.concat(F.lit("level: "), named), F.concat(F.lit("findings: "), said), F.concat(F.lit("lasted: "), lasted), F.concat(F.lit("do: "), action), F.concat(F.lit("reason: "), "reason"))
    return p.select("id", "level", "reason", "risk_tags", F.when(F.col("level") == "green", "pass").otherwise("revise").alias("status"), advice.alias("advice"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


# --- medication


@dataclass(frozen=True)
class MedicationRules:
    """contraindications and child_notes by item; interactions as pairs; the fields an answer must name, with templates."""

    contraindications: dict[str, Sequence[str]]
    interactions: Sequence[tuple[str, str]]
    fields: dict[str, str]
    child_notes: dict[str, str]
    child_words: Sequence[str]
    disclaimer: str


def contraindicated(item: str, conditions: Column, rules: MedicationRules) -> Column:
    """Of the item's contraindications those that hold one of the person's conditions, or that one holds."""
    return words_where(rules.contraindications.get(item, ()), lambda c: either_holds(conditions, c))


def missing_fields(answer: Column, fields: Sequence[str]) -> Column:
    return words_where(list(fields), lambda f: ~F.contains(answer, F.lit(f)))


def review_medication(answers: DataFrame, rules: MedicationRules) -> DataFrame:
    """(id, status, risk_tags, revised) of (id, answer, items, conditions).

    Known items are the keys of ``contraindications``, in that order. If anything is amiss,
    warnings and templates are appended, for missing fields and child notes per known item, and
    the disclaimer; else the answer passes as it is. An answer without items passes.
    """
    text, items = F.coalesce("answer", F.lit("")), F.coalesce("items", none())
    has, known = (lambda i: F.array_contains(items, i)), list(rules.contraindications)
    unknown = F.filter(items, lambda x: ~x.isin(known))
    missing = missing_fields(text, rules.fields)
    any_known = F.exists(items, lambda x: x.isin(known))
    revised, tags = text, []
    for i in known:
        found = F.when(has(i), contraindicated(i, F.col("conditions"), rules)).otherwise(none())
        tags.append(F.when(F.size(found) > 0, F.lit(f"contraindication:{i}")))
        revised = F.when(F.size(found) > 0, append(revised, f"\n\nNot to be taken: {i} with ", F.array_join(found, ", "), ".")).otherwise(revised)
    notes = F.array_compact(F.array(*[F.when(has(a) & has(b), F.lit(f"  - {a} and {b} interact")) for a, b in rules.interactions]))
    tags.append(F.when(F.size(notes) > 0, F.lit("drug_interaction")))
    revised = F.when(F.size(notes) > 0, append(revised, "\n\nInteractions:\n", F.array_join(notes, "\n"))).otherwise(revised)
    tags.append(F.when(any_known & (F.size(missing) > 0), F.lit("incomplete_fields")))
    for i in known:
        lines = F.array_compact(F.array(*[F.when(F.array_contains(missing, f), F.lit(t.replace("{item}", i))) for f, t in rules.fields.items()]))
        revised = F.when(has(i) & (F.size(missing) > 0), append(revised, "\n\n", F.array_join(lines, "\n"))).otherwise(revised)
    tags.append(F.when(F.size(unknown) > 0, F.lit("unknown_drug")))
    revised = F.when(F.size(unknown) > 0, append(revised, "\n\nNot in the rules: ", F.array_join(unknown, ", "), ".")).otherwise(revised)
    for i, note in rules.child_notes.items():
        revised = F.when(has(i) & contains_any(text, rules.child_words), append(revised, f"\n\nFor children: {note}")).otherwise(revised)
    tags = F.array_compact(F.array(*tags))
    amiss = F.size(tags) > 0
    revised = F.when(amiss, append(revised, "\n\n" + rules.disclaimer)).otherwise(text)
    return answers.select("id", F.when(amiss, "revise").otherwise("pass").alias("status"), tags.alias("risk_tags"), revised.alias("revised"))
