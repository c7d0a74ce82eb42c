"""Column expressions that bring loosely written values into shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of question types, separators of lists, endings of questions.
QUESTION_TYPES = {
    "symptoms": "symptom", "症状": "symptom", "知识": "knowledge", "knowledge_query": "knowledge", "general_query": "general", "闲聊": "general", "问候": "general",
}
LIST_SEPARATORS = r"[，,、；;\s]+"


def age(text: Column) -> Column:
    """The digits of the text as one number, null without any."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.try_to_number(digits, F.lit("9" * 18)).cast("int")


def items(text: Column, separators: str = LIST_SEPARATORS) -> Column:
    """The parts of a text between separators, without empty ones; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), separators), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def allergies(text: Column) -> Column:
    """Parts between commas, without white space around; null for null and empty."""
    return F.when(text != "", items(text, "[，,]"))


def question_type(text: Column, names: dict[str, str] = QUESTION_TYPES) -> Column:
    low = F.lower(F.trim(text))
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, low), low)


def without_prefix(text: Column, prefix: str) -> Column:
    """The text without ``prefix`` and a colon (ASCII or wide) at its start, in any case."""
    return F.trim(F.regexp_replace(F.trim(text), f"(?i)^{prefix}[:：]", ""))


def first_known(old: Column, new: Column) -> Column:
    """The old text unless it is null or blank."""
    return F.when(F.trim(old) != "", old).otherwise(new)


def without_markers(text: Column, marker: str = r"\[来源:[^\]]*\]") -> Column:
    return F.trim(F.regexp_replace(text, marker, ""))


def questions(text: Column) -> Column:
    """The parts that end with a question mark, each with a wide one; the text itself if there are fewer than two."""
    parts = F.filter(F.transform(F.split(text, "[？?]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.transform(parts, lambda x: F.concat(x, F.lit("？")))).otherwise(F.array(text))


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters without white space, after punctuation and digits became spaces."""
    clean = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[，。！？、；：（）\[\]{}【】《》\s\d\-_=+|\\<>]+", " "))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(clean) - 1, F.lit(1))), lambda k: F.substr(clean, k, F.lit(2)))
    return F.filter(pairs, lambda x: (F.length(x) == 2) & ~F.contains(x, F.lit(" ")))


def described_difference(actual: Column, expected: Column, most: int = 5, words: str = r"[一-鿿A-Za-z0-9]{2,}") -> Column:
    """What words are missing and what is too much, up to ``most`` each in order; says so where one is empty."""
    of = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(words), F.lit(0)))
    missing, extra = F.array_except(of(expected), of(actual)), F.array_except(of(actual), of(expected))
    listed = lambda name, a: F.when(F.size(a) > 0, F.concat(F.lit(name + ": "), F.array_join(F.slice(F.array_sort(a), 1, most), ", ")))
    both = F.concat_ws("; ", listed("missing", missing), listed("extra", extra))
    differs = F.when(both != "", both).otherwise("differs in meaning")
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return F.when(empty(actual), "actual is empty").when(empty(expected), "expected is empty").otherwise(differs)


def cache_key(question: Column, versions: dict[str, Column | str], prefix: str = "") -> Column:
    """prefix and the MD5 of the question and ``name=version`` of all versions in order of name; null ones are left out."""
    column = lambda v: F.lit(v) if isinstance(v, str) else v
    parts = [F.concat(F.lit(f"{k}="), column(v)) for k, v in sorted(versions.items())]
    return F.concat(F.lit(prefix), F.md5(F.concat_ws("|", question, *parts)))


def answer_key(question: Column, kb_version: Column, prompt_version: Column) -> Column:
    return F.concat(F.lit("answer:"), F.substring(F.md5(F.concat_ws(":", question, kb_version, prompt_version)), 1, 16))


def any_of(text: Column, words: Sequence[str]) -> Column:
    return text.rlike("|".join(words))
