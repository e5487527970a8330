"""Conversation planning: the query and its history, intent by rules, rewriting, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import text as X

# The word lists that the intent rules look for, in the order that the rules state them.
CHITCHAT = (
    "好的", "谢谢", "明白了", "知道了", "了解", "OK", "ok", "嗯", "哦", "行", "可以", "没问题", "感谢", "辛苦", "太棒了", "很好", "不错", "懂了", "收到",
)
CLARIFICATION = ("第一点", "第二点", "第三点", "第1点", "第2点", "第3点", "刚才说的", "你说的", "上面说的", "没太懂", "不太明白", "再说一遍")
FOLLOW_UP = (
    "它", "这个", "那个", "这", "那", "他", "她", "他们", "它们", "上面", "前面", "刚才", "之前", "详细", "具体", "展开", "解释一下", "说说", "为什么", "怎么", "如何",
    "什么意思",
)
TOPIC_SWITCH = ("另外", "还有", "顺便", "换个话题")
QUESTION = ("什么", "如何", "怎么", "为什么", "哪些", "是否")
FAMILIES = ("glm", "chatglm", "qwen", "deepseek")
# Prompt texts.
SYSTEM_PROMPT = """你是一个专业的知识库问答助手，严格根据检索到的知识库内容回答用户问题。

## 核心原则（必须严格遵守）
1. **只使用检索结果中明确存在的信息**：绝对禁止编造、推测或添加任何检索结果中没有的内容
2. **相关性判断**：如果检索结果与用户问题无关，必须明确告知用户"检索到的内容与您的问题不相关"，而不是强行从中提取信息
3. **忠实引用**：回答中的每个事实必须能在检索结果中找到原文依据

## 回答规范
1. 信息整合：归纳总结相关的检索内容，而非简单复制粘贴
2. 格式美观：善用列表、分段提高可读性
3. 引用标注：引用知识库内容时，在句末标注来源序号，格式为【1】【2】等
4. 语言一致：与用户问题语言保持一致
5. 坦诚告知：信息不足时请说明"知识库中未找到相关信息"

## 禁止行为
- 禁止编造具体数字、百分比、流程步骤等知识库中不存在的内容
- 禁止将检索结果中的概念错误关联

注意：检索结果的编号从1开始，请使用对应的数字序号进行引用。"""
NO_RESULT = "## 提示\n知识库中未找到与问题相关的信息。请根据你的知识尽可能回答，如果无法回答请告知用户。"
NOT_FOUND = "未找到相关知识库内容。"
FOUND_HEAD, QUESTION_HEAD = "## 知识库检索结果\n", "\n\n## 用户问题\n"
FOUND_TAIL = "\n\n请根据以上检索结果回答用户问题。如果检索结果与问题无关，请说明。"

INTENT = "struct<intent: string, confidence: double, should_search: boolean, rewrite_needed: boolean>"
TURN = "struct<role: string, content: string>"


def gather(turns: DataFrame) -> DataFrame:
    """conv_id, messages: each conversation's turns in order as one array."""
    item = F.struct("turn", "role", F.col("text").alias("content"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m")).select(
        "conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")
    )


def query_and_history(messages: Column) -> tuple[Column, Column]:
    """(query, history): the last user message and all before it; if that is missing or empty, the last message is the query."""
    n = F.size(messages)
    roles = F.transform(messages, lambda m: m["role"])
    last_user = F.when(F.array_contains(roles, "user"), n - F.array_position(F.reverse(roles), "user") + 1).cast("int")
    asked = F.element_at(messages, last_user)["content"]
    found = last_user.isNotNull() & (F.coalesce(asked, F.lit("")) != "")
    query = F.when(found, asked).when(n > 0, F.coalesce(F.element_at(messages, -1)["content"], F.lit(""))).otherwise("")
    kept = F.when(found, last_user - 1).otherwise(n - 1)
    return query, F.slice(messages, F.lit(1), F.greatest(kept, F.lit(0)))


def _any(text: Column, words: tuple[str, ...], test=F.contains) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | test(text, F.lit(word))
    return out


def intent(query: Column, has_history: Column, chitchat: tuple[str, ...] = CHITCHAT) -> Column:
    """struct<intent, confidence, should_search, rewrite_needed> by rules, the first that fits."""
    q = X.strip(query)
    n = F.length(q)
    said = lambda name, sure, look, again: F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"), F.lit(look).alias("should_search"), F.lit(again).alias("rewrite_needed"))
    switched = (F.startswith(q, F.lit("那")) & F.contains(q, F.lit("呢")) & (n > 5)) | _any(q, TOPIC_SWITCH, F.startswith)
    return (
        F.when((n <= 15) & _any(q, chitchat), said("chitchat", 0.9, False, False))
        .when(~has_history, said("knowledge_query", 0.95, True, False))
        .when(_any(q, CLARIFICATION), said("clarification", 0.8, True, True))
        .when(switched, said("topic_switch", 0.8, True, False))
        .when(_any(q, FOLLOW_UP), said("follow_up", 0.8, True, True))
        .when((n > 20) & _any(q, QUESTION), said("knowledge_query", 0.6, True, False))
        .otherwise(said("follow_up", 0.5, True, True))
    )


def intent_of_answer(answer: Column) -> Column:
    """The intent that a model's JSON answer states, code fence or not; one that isn't JSON is a follow-up at 0.3."""
    text = X.strip(answer)
    lines = F.split(text, "\n")
    body = F.when(F.startswith(text, F.lit("```")), F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 2, F.lit(0))), "\n")).otherwise(text)
    told = F.from_json(body, "intent string, should_search boolean, rewrite_needed boolean")
    ok = F.try_parse_json(body).isNotNull() & F.startswith(F.ltrim(body), F.lit("{"))
    name = F.lower(F.coalesce(told["intent"], F.lit("knowledge_query")))
    known = F.when(name.isin("knowledge_query", "follow_up", "topic_switch", "clarification", "chitchat"), name).otherwise("knowledge_query")
    made = F.struct(known.alias("intent"), F.lit(0.8).alias("confidence"), F.coalesce(told["should_search"], F.lit(True)).alias("should_search"), F.coalesce(told["rewrite_needed"], F.lit(False)).alias("rewrite_needed"))
    failed = F.struct(F.lit("follow_up").alias("intent"), F.lit(0.3).alias("confidence"), F.lit(True).alias("should_search"), F.lit(True).alias("rewrite_needed"))
    return F.when(ok, made).otherwise(failed)


def chosen_intent(rules: Column, model: Column | None = None, enabled: bool = True, has_history: Column | None = None) -> Column:
    """The rules' intent; the model's where the rules are under 0.7 and the model is surer; a plain query where intents are off."""
    if not enabled:
        again = F.lit(False) if has_history is None else has_history
        return F.struct(F.lit("knowledge_query").alias("intent"), F.lit(1.0).alias("confidence"), F.lit(True).alias("should_search"), again.alias("rewrite_needed"))
    if model is None:
        return rules
    return F.when((rules["confidence"] < 0.7) & (model["confidence"] > rules["confidence"]), model).otherwise(rules)


def history_text(history: Column, last: int, most: int | None = None, skip: tuple[str, ...] = ()) -> Column:
    """The last messages, one line each, with names for the roles; 无 for none."""
    recent = F.slice(history, F.greatest(F.size(history) - last + 1, F.lit(1)), F.lit(last))
    shown = F.filter(recent, lambda m: ~m["role"].isin(*skip)) if skip else recent
    name = lambda m: F.when(m["role"] == "user", "用户").when(m["role"] == "assistant", "助手").otherwise(m["role"])
    body = lambda m: F.substring(m["content"], 1, most) if most else m["content"]
    lines = F.array_join(F.transform(shown, lambda m: F.concat(name(m), F.lit(": "), F.coalesce(body(m), F.lit("")))), "\n")
    return F.when(F.size(shown) > 0, lines).otherwise("无")


def rewritten(query: Column, answer: Column) -> Column:
    """struct<query, applied> from a model's rewriting: quotes around it go; an empty or equal one changes nothing."""
    text = X.strip(answer)
    for quote in ('"', "'"):
        inner = F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))
        text = F.when(F.startswith(text, F.lit(quote)) & F.endswith(text, F.lit(quote)), inner).otherwise(text)
    text = F.coalesce(text, F.lit(""))
    applied = (F.lower(text) != F.lower(query)) & (F.length(text) > 0)
    return F.struct(F.when(F.length(text) > 0, text).otherwise(query).alias("query"), applied.alias("applied"))


def rewrite_gate(has_history: Column, has_model: bool, mode: str = "auto") -> Column:
    """Whether a rewriting is asked for at all."""
    return has_history if has_model and mode != "never" else F.lit(False)


def family(model: Column) -> Column:
    """glm, qwen, deepseek or generic by name."""
    low, out = F.lower(F.coalesce(model, F.lit(""))), F.lit("generic")
    for word in reversed(FAMILIES):
        out = F.when(F.contains(low, F.lit(word)), "glm" if word == "chatglm" else word).otherwise(out)
    return out


def prompt_history(history: Column, turns: int = 3) -> Column:
    """User and assistant messages alone, the last ``2 * turns``."""
    kept = F.filter(history, lambda m: m["role"].isin("user", "assistant"))
    return F.when(F.size(kept) > 2 * turns, F.slice(kept, F.size(kept) - 2 * turns + 1, F.lit(2 * turns))).otherwise(kept)


def _turn(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_observation(query: Column, history: Column, context: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System, history, question, and the hits as an observation."""
    found = F.when(F.coalesce(context, F.lit("")) != "", context).otherwise(NOT_FOUND)
    return F.concat(F.array(_turn("system", F.lit(system))), prompt_history(history), F.array(_turn("user", query), _turn("observation", found)))


def prompt_generic(query: Column, history: Column, context: Column, system: str = SYSTEM_PROMPT) -> Column:
    """System, history, and the question with the hits around it."""
    with_hits = F.concat(F.lit(FOUND_HEAD), context, F.lit(QUESTION_HEAD), query, F.lit(FOUND_TAIL))
    without = F.concat(F.lit(NO_RESULT + QUESTION_HEAD), query)
    asked = F.when(F.coalesce(context, F.lit("")) != "", with_hits).otherwise(without)
    return F.concat(F.array(_turn("system", F.lit(system))), prompt_history(history), F.array(_turn("user", asked)))
