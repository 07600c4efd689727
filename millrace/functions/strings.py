"""Text and lists in text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def trim_space(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def replace_each(text: Column, pairs: Mapping[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def word_from_end(text: Column, n: int) -> Column:
    """The n-th word from the end (1: the last), null if there are fewer."""
    return F.try_element_at(F.split(trim_space(text), r"\s+"), F.lit(-n))


def repaired(value: Column, names: Mapping[str, str]) -> Column:
    """Values replaced by a map, others as they are."""
    out = value
    for old, new in names.items():
        out = F.when(value == old, new).otherwise(out)
    return out


def item_count(text: Column, delimiter: str, empty_is_none: bool = False) -> Column:
    """Items of a delimited list; an empty text is one item unless said otherwise, null stays null."""
    n = F.length(text) - F.length(F.replace(text, F.lit(delimiter), F.lit(""))) + 1
    return F.when(text == "", 0).otherwise(n) if empty_is_none else n


def quoted_items(text: Column) -> Column:
    """The items of a list written as "[' a ', ' b ']"; an item with a comma in it becomes two."""
    bare = replace_each(text, {"[": "", "]": "", "' ": "", " '": ""})
    return F.transform(F.split(bare, ","), lambda x: F.trim(x))


def joined_items(items: Column) -> Column:
    """One text of all items, with _ inside an item and a blank between items."""
    return F.array_join(F.transform(items, lambda x: F.replace(x, F.lit(" "), F.lit("_"))), " ")


def number_in(text: Column, pattern: str) -> Column:
    """The first number of a text that fits the pattern as a whole, else null."""
    return F.when(text.rlike(f"^(?:{pattern})$"), F.regexp_extract(text, r"\d+", 0).cast("double"))


def first_contained(text: Column, parts: Sequence[str], then: Mapping[str, Sequence[str]], default: str) -> Column:
    """The first of ``parts`` that the text holds; else the first name of ``then`` one of whose parts it holds; else ``default``."""
    pairs = [(p, [p]) for p in parts] + list(then.items())
    out = F.lit(default)
    for name, any_part in reversed(pairs):
        hit = F.lit(False)
        for p in any_part:
            hit = hit | text.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def link_texts(html: Column) -> Column:
    """Texts of the links of list items or table cells, in order."""
    return F.regexp_extract_all(html, F.lit(r"<(?:li|td)[^>]*><a[^>]*>([^<]*)</a>"), F.lit(1))
