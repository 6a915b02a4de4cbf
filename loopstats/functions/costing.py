"""Money arithmetic on token counts. Spark's half-up `round` is used throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _side(tokens: Column, rate: Column) -> Column:
    return F.coalesce(tokens, F.lit(0)).cast("double") / 1000 * rate


def call_cost(prompt: Column, completion: Column, rp: Column, rc: Column) -> Column:
    """Cost of one call; missing token counts cost nothing."""
    return F.round(_side(prompt, rp) + _side(completion, rc), 6)


def token_breakdown(prompt: Column, completion: Column, rp: Column, rc: Column) -> Column:
    """Per-side costs; `cost` is the sum of the rounded sides, so it may differ from call_cost."""
    pc, cc = F.round(_side(prompt, rp), 6), F.round(_side(completion, rc), 6)
    return F.struct(
        F.coalesce(prompt, F.lit(0)).alias("prompt_tokens"),
        F.coalesce(completion, F.lit(0)).alias("completion_tokens"),
        pc.alias("prompt_cost"),
        cc.alias("completion_cost"),
        F.round(pc + cc, 6).alias("cost"),
    )
