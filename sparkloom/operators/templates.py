"""Chat templates: an array of messages to a prompt, as one expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import strip

# The markers of each template.
IM_START, IM_END, IM_SEP, END = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|end|>"
ROLE_TAGS = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>", "observation": "<|observation|>", "tool": "<|observation|>"}
MASK_START = "[gMASK]<sop>"
THINK, THINK_SHUT = "<think>", "</think>"


def _parts(messages: Column, write) -> Column:
    return F.transform(messages, lambda m: write(F.coalesce(F.nullif(m["role"], F.lit("")), F.lit("user")), F.coalesce(m["content"], F.lit(""))))


def _line(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _joined(messages: Column, write, tail: str, by: str = "\n") -> Column:
    return F.array_join(F.concat(_parts(messages, write), F.array(F.lit(tail))), by)


def _tag(role: Column, tags: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, tag in tags.items():
        out = F.when(role == name, tag).otherwise(out)
    return out


def generic(messages: Column) -> Column:
    return _joined(messages, lambda r, c: _line(r, ": ", c), "assistant:")


def chatml(messages: Column) -> Column:
    return _joined(messages, lambda r, c: _line(IM_START, r, "\n", c, IM_END), f"{IM_START}assistant\n")


def chatml_thinking(messages: Column, think: bool = True) -> Column:
    tail = f"{IM_START}assistant\n{THINK}" + ("" if think else f"\n\n{THINK_SHUT}\n")
    return _joined(messages, lambda r, c: _line(IM_START, r, "\n", c, IM_END), tail)


def tagged(messages: Column) -> Column:
    write = lambda r, c: _line(_tag(r, ROLE_TAGS, ROLE_TAGS["user"]), "\n", c)
    return _line(MASK_START, _joined(messages, write, f"{ROLE_TAGS['assistant']}\n"))


def tagged_thinking(messages: Column) -> Column:
    return _line(tagged(messages), THINK)


def xml(messages: Column) -> Column:
    return _joined(messages, lambda r, c: _line("<", r, ">\n", c, "</", r, ">"), "<assistant>\n")


def xml_thinking(messages: Column, think: bool = True) -> Column:
    return _joined(messages, lambda r, c: _line("<", r, ">\n", c, "</", r, ">"), "<assistant>\n" + (THINK if think else ""))


def separated(messages: Column) -> Column:
    return _joined(messages, lambda r, c: _line(IM_START, r, IM_SEP, c, IM_END), f"{IM_START}assistant{IM_SEP}", "")


def separated_reasoning(messages: Column, system: str, think: bool = True) -> Column:
    """As ``separated``; ``system`` goes first where no system message is, and thinking is opened."""
    first = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    named = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    full = F.when(F.exists(messages, lambda m: m["role"] == "system"), named).otherwise(F.concat(first, named))
    return _joined(full, lambda r, c: _line(IM_START, r, IM_SEP, c, IM_END), f"{IM_START}assistant{IM_SEP}" + (f"{THINK}\n" if think else ""), "")


_BRIEF = {"system": "<|system|>", "user": "<|user|>", "assistant": "<|assistant|>"}


def brief(messages: Column) -> Column:
    return _joined(messages, lambda r, c: _line(_tag(r, _BRIEF, "<|user|>"), c, END), "<|assistant|>", "")


def brief_reasoning(messages: Column, think: bool = True) -> Column:
    return _joined(messages, lambda r, c: _line(_tag(r, _BRIEF, "<|user|>"), c, END), "<|assistant|>" + (f"{THINK}\n" if think else ""), "")


TEMPLATES = {
    "generic": generic, "chatml": chatml, "chatml_thinking": chatml_thinking, "tagged": tagged, "tagged_thinking": tagged_thinking, "xml": xml,
    "xml_thinking": xml_thinking, "separated": separated, "brief": brief, "brief_reasoning": brief_reasoning,
}

# Registered names, then substrings in the order that they are looked for.
_NAMED = (
    ("generic", "generic"), ("qwen", "qwen"), ("qwen2", "qwen2"), ("qwen3", "qwen3"), ("glm", "glm"), ("glm4", "glm4"), ("glm4-z1", "glm4-z1"), ("deepseek", "deepseek"),
    ("deepseek-r1", "deepseek-r1"), ("phi4", "phi4"), ("phi4-mini", "phi4-mini"), ("phi4-reasoning", "phi4-reasoning"), ("phi4-mini-reasoning", "phi4-mini-reasoning"),
)
_SUBSTRINGS = (
    (("qwen3",), "qwen3"), (("qwen2",), "qwen2"), (("qwen",), "qwen"), (("glm", "z1"), "glm4-z1"), (("glm4",), "glm4"), (("glm",), "glm"), (("deepseek", "r1"), "deepseek-r1"),
    (("deepseek",), "deepseek"), (("phi4", "mini", "reason"), "phi4-mini-reasoning"), (("phi-4", "mini", "reason"), "phi4-mini-reasoning"), (("phi4", "mini"), "phi4-mini"),
    (("phi-4", "mini"), "phi4-mini"), (("phi4", "reason"), "phi4-reasoning"), (("phi-4", "reason"), "phi4-reasoning"), (("phi4",), "phi4"), (("phi-4",), "phi4"),
)


def strategy(name: Column) -> Column:
    """The template family of a model name: exact first, then by substrings, else generic."""
    key = F.replace(F.lower(F.trim(F.coalesce(name, F.lit("generic")))), F.lit("_"), F.lit("-"))
    out = F.lit("generic")
    for words, found in reversed(_SUBSTRINGS):
        fits = F.lit(True)
        for word in words:
            fits = fits & F.contains(key, F.lit(word))
        out = F.when(fits, found).otherwise(out)
    for word, found in _NAMED:
        out = F.when(key == word, found).otherwise(out)
    return out


def tool_choice_sentence(choice: Column, name: Column) -> Column:
    """What a tool choice tells the model."""
    must = F.concat(F.lit('Important: You MUST call the tool "'), name, F.lit('" in your response.'))
    return (
        F.when(choice == "none", "Important: Do NOT call any tools. Respond with text only.")
        .when(choice == "required", "Important: You MUST call at least one tool in your response.")
        .when((choice == "function") & (F.coalesce(name, F.lit("")) != ""), must)
        .otherwise("")
    )


def with_system_text(messages: Column, text: Column) -> Column:
    """``text`` after the first system message, or as one where there is none."""
    first = F.try_element_at(messages, F.lit(1))
    extended = F.concat(F.array(F.struct(first["role"].alias("role"), F.concat(F.coalesce(first["content"], F.lit("")), text).alias("content"))), F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))))
    alone = F.concat(F.array(F.struct(F.lit("system").alias("role"), strip(text).alias("content"))), messages)
    return F.when(F.coalesce(first["role"] == "system", F.lit(False)), extended).otherwise(alone)


