"""Trimming to a budget of the rendered prompt.

Units go, the oldest first, until the tokens of the prompt that is left fit.  A unit is an assistant row with calls and the tool rows after it, or any
other row by itself; system rows and the last user row never go, so the budget may stay exceeded.  Tokens are estimated from the prompt's length.

For a template whose prompt is a frame plus a text a message, the length behind each unit is a running sum over rows: nothing is rendered twice, and no
conversation is gathered into an array.  For any other template the number of units is found by bisection, one rendering a step; that is the first number
that fits wherever dropping a unit never makes the prompt longer.

Defined cases: a missing role or content is empty text; a conversation that fits keeps all rows; a null budget keeps all rows; tied turns are ordered by role and content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.functions.text import tokens_of_length
from sparkloom.operators.compiled import Template

_ORDER = ("turn", "__role", "__text")


def _units(turns: DataFrame) -> DataFrame:
    """The rows with __at, their place in the conversation, __unit, the place of their unit's first row, and __stays."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("content", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("__role"), text.alias("__text"), (F.coalesce("calls", F.lit("")) != "").alias("__calls"), F.col("budget").alias("__budget"))
    by, whole = Window.partitionBy("conv_id").orderBy(*_ORDER), Window.partitionBy("conv_id")
    rows = rows.withColumn("__at", F.row_number().over(by))
    opener = F.max(F.when(F.col("__role") != "tool", F.struct("__at", ((F.col("__role") == "assistant") & F.col("__calls")).alias("calls")))).over(by)
    last = F.max(F.when(F.col("__role") == "user", F.col("__at"))).over(whole)
    rows = rows.withColumn("__opener", opener).withColumn("__stays", (F.col("__role") == "system") | F.coalesce(F.col("__at") == last, F.lit(False)))
    joins = F.coalesce((F.col("__role") == "tool") & F.col("__opener.calls"), F.lit(False))
    return rows.withColumn("__unit", F.when(joins, F.col("__opener.__at")).otherwise(F.col("__at"))).drop("__opener", "__calls")


def retrimmed(turns: DataFrame, template: Template, budget: Column, **flags) -> DataFrame:
    """conv_id, turn of the rows that stay.  ``turns`` has conv_id, turn, role, content, calls; ``budget`` is an expression over its columns, one value a conversation."""
    rows = _units(turns.withColumn("budget", budget))
    if template.additive:
        message = F.struct(F.col("__role").alias("role"), F.col("__text").alias("content"))
        rows = rows.withColumn("__size", F.length(template.piece(message, **flags)))
        whole = Window.partitionBy("conv_id")
        going = F.when(~F.col("__stays"), F.col("__size")).otherwise(0)
        # rows of a unit stand together, so that what goes before it is what goes before its first row
        through = F.sum(going).over(whole.orderBy("__unit").rangeBetween(Window.unboundedPreceding, Window.currentRow))
        before = through - F.sum(going).over(Window.partitionBy("conv_id", "__unit"))
        rows = rows.withColumn("__left", F.length(template.frame(**flags)) + F.sum("__size").over(whole) - before)
        goes = ~F.col("__stays") & (tokens_of_length(F.col("__left")) > F.col("__budget"))
        return rows.filter(~F.coalesce(goes, F.lit(False))).select("conv_id", "turn")
    number = F.when(~F.col("__stays"), F.dense_rank().over(Window.partitionBy("conv_id", "__stays").orderBy("__unit")))
    item = F.struct("__at", "turn", F.col("__role").alias("role"), F.col("__text").alias("content"), F.col("__number").alias("number"))
    arrays = rows.withColumn("__number", number).groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("m"), F.max("__number").alias("n"), F.first("__budget").alias("budget"))
    arrays = arrays.withColumn("n", F.coalesce("n", F.lit(0)))
    left = lambda gone: F.filter("m", lambda m: m["number"].isNull() | (m["number"] > gone))
    plain = lambda ms: F.transform(ms, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    fits = lambda gone: F.coalesce(tokens_of_length(F.length(template.render(plain(left(gone)), **flags))) <= F.col("budget"), F.lit(True))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        open_, good = state["low"] < state["high"], fits(middle)
        return F.struct(F.when(open_ & ~good, middle + 1).otherwise(state["low"]).alias("low"), F.when(open_ & good, middle).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.col("n") + 1)).cast("int"))
    found = arrays.withColumn("gone", F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.col("n").alias("high")), halve)["low"])
    return found.select("conv_id", F.explode(left(F.col("gone"))).alias("m")).select("conv_id", "m.turn")
