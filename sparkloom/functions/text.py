"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THINK_OPEN, THINK_CLOSE = "<think>", "</think>"

#: White space as Python's ``str.strip`` sees it, for Java patterns.
SPACE = r"[\s\x1c-\x1f\x85   -     　]"


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def strip_thinking(text: Column) -> Column:
    """Without closed thinking pairs and an unclosed tail; blank lines collapse and the ends are stripped."""
    closed = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    tail = F.regexp_replace(closed, r"(?s)<think>.*\z", "")
    return strip(F.regexp_replace(tail, rf"\n{SPACE}*\n", "\n"))


def split_thinking(text: Column) -> tuple[Column, Column]:
    """(reasoning or null, content) of a whole answer that may start with a thinking pair."""
    text = F.coalesce(text, F.lit(""))
    opened = F.startswith(text, F.lit(THINK_OPEN))
    close_at = F.locate(THINK_CLOSE, text)
    closed = opened & (close_at > 0)
    inside = strip(F.when(closed, F.substring(text, F.lit(8), close_at - 8)).otherwise(F.substring(text, 8, 1 << 30)))
    reasoning = F.when(opened, F.nullif(inside, F.lit("")))
    content = F.when(closed, strip(F.substring(text, close_at + len(THINK_CLOSE), F.lit(1 << 30)))).when(opened, "").otherwise(text)
    return reasoning, content


def estimate_tokens(text: Column) -> Column:
    """Two tokens for five characters, at least one for a text that isn't empty."""
    return tokens_of_length(F.length(F.coalesce(text, F.lit(""))))


def tokens_of_length(n: Column) -> Column:
    """As ``estimate_tokens``, for a text of ``n`` characters."""
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n * 2 / 5).cast("int"))).cast("int")


def cut_at_stop(text: Column, stops: Column) -> Column:
    """The text before the earliest stop word; empty stop words don't count."""
    at = F.array_min(F.filter(F.transform(F.filter(stops, lambda s: s != ""), lambda s: F.instr(text, s)), lambda i: i > 0))
    return F.when(at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def file_name(model: Column) -> Column:
    """A model name that can be a file name."""
    named = F.coalesce(F.nullif(model, F.lit("")), F.lit("default"))
    kept = F.trim(F.regexp_replace(named, r'[<>:"/\\|?*\x00-\x1f]+', "_"), F.lit(" ."))
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("default"))


def clean_special(text: Column, special: list[str], drop_thinking: bool = False) -> Column:
    """Without special tokens, but for thinking tags and those that name tools, functions or parameters."""
    kept = lambda t: t in (THINK_OPEN, THINK_CLOSE) or any(k in t.lower() for k in ("tool", "function", "parameter"))
    for token in [t for t in special if not kept(t)] + ([THINK_OPEN, THINK_CLOSE] if drop_thinking else []):
        text = F.replace(text, F.lit(token), F.lit(""))
    return text


def title(doc_name: Column, chapter: Column) -> Column:
    """Trimmed document name and chapter, joined by a blank; parts that are empty before trimming are left out."""
    part = lambda c: F.when(F.coalesce(c, F.lit("")) != "", strip(c))
    return F.concat_ws(" ", part(doc_name), part(chapter))
