"""Text expressions that the operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[一-鿿A-Za-z0-9]+"


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-cased runs of letters a-z, digits and CJK characters, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[一-鿿a-z0-9]+"), F.lit(0))
    return F.filter(found, lambda t: F.length(t) >= least) if least > 1 else found


def clean(text: Column, least: int = 5) -> Column:
    """White space collapsed; shorter texts than ``least`` become empty."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", " "))
    return F.when(F.length(flat) < least, F.lit("")).otherwise(flat)


def head_and_tail(text: Column, most: int) -> Column:
    """The first two thirds of ``most`` characters and the rest from the end, if it is longer."""
    head = most * 2 // 3
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, head), F.right(text, F.lit(most - head))))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def overlaps(question: Column, content: Column, fillers: Sequence[str] = ()) -> Column:
    """Whether some token of two or more characters, fillers aside, occurs in the content.

    A question of fillers only is matched by any of its tokens.
    """
    every = tokens(question, 2)
    telling = F.filter(every, lambda t: ~t.isin(list(fillers))) if fillers else every
    asked = F.when(F.size(telling) > 0, telling).otherwise(every)
    return F.exists(asked, lambda t: F.contains(F.lower(content), t))


def share_of(part: Column, whole: Column) -> Column:
    """|part and whole| / |whole| for two arrays as sets; 0 for an empty whole."""
    sized = F.size(F.array_distinct(whole))
    return F.when(sized == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / sized)


def replace_in_turn(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Each rule works on what the ones before it left."""
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def normalise_for_comparison(text: Column) -> Column:
    """White space dropped, full-width forms made half-width, edge punctuation trimmed, lower case."""
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\r]+", "")
    wide, narrow = "，。！？；：（）", ",.!?;:()"
    flat = F.lower(F.translate(flat, wide, narrow))
    return F.regexp_replace(flat, r"^[,.!?;:()]+|[,.!?;:()]+$", "")


def first_json_object(text: Column) -> Column:
    """The text of a fenced block if there is one, else from the first { to the last }."""
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    widest = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    return F.when(fenced != "", F.trim(fenced)).otherwise(F.nullif(widest, F.lit("")))
