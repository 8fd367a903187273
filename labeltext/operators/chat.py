"""PRM2 / PRM3 over whole conversations: turns folded in order and rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as PR
from .validate import require_columns


def fold_conversation(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role",
                      content: str = "text") -> DataFrame:
    """(key, messages): each key's messages in order, as an array of (role, content).

    Order: ``order`` (NULL first), ties by role, then content. A NULL role
    or content is empty. The array is one value: a conversation is folded
    by one task, as its rendering is one text.
    """
    require_columns(rows, [key, order, role, content], "conversations")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(order).alias("order"), text(role).alias("role"), text(content).alias("content"))
    folded = rows.groupBy(key).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return folded.select(key, F.transform("turns", lambda t: F.struct(t["role"], t["content"])).alias("messages"))


def render_conversation(folded: DataFrame, key: str = "conv_id", template: PR.ChatTemplate = PR.DEFAULT_TEMPLATE,
                        answer_role: str = "assistant") -> DataFrame:
    """(key, messages, full_text, prompt_text) of every folded conversation.

    ``full_text`` is the whole rendering. ``prompt_text`` is what a model
    is given: everything but an answer at the end, then the generation
    marker. The tokens of the two differ by the answer that carries the loss.
    """
    n = F.size("messages")
    answered = F.try_element_at("messages", F.lit(-1))["role"] == F.lit(answer_role)
    before = F.slice("messages", F.lit(1), n - F.when(answered, 1).otherwise(0))
    return folded.select(key, n.alias("n_messages"), template.render("messages").alias("full_text"),
                         template.render(before, add_generation_prompt=True).alias("prompt_text"))
