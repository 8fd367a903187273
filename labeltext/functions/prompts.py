"""Prompt, chat and training-example building (PRM1-5, ARR1, AGG16).

All row-level Column expressions: no grouping, no Python in the default path.
Token ids come from a pluggable tokenizer; the built-in one splits on
whitespace and maps a token to ``pmod(xxhash64(token), vocab_size)``, a
deterministic stand-in that keeps every array shape and mask rule exact. A
real tokenizer plugs in through ``token_ids_udf`` (Arrow-batched).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from . import text as T

# ---------------------------------------------------------------------------
# The instruction template of the reference (task line, blank
# line, title block, description block, closing instruction).
PROMPT_HEAD = "Classify the following job posting into one functional skill category.\n\n"
PROMPT_TITLE = "Job Title:\n"
PROMPT_DESCRIPTION = "\n\nJob Description:\n"
PROMPT_TAIL = "\n\nReturn only the category name."
# Masked label value and sequence defaults.
IGNORE_INDEX = -100
MAX_LENGTH = 512
MAX_DESCRIPTION_TOKENS = 400
# ---------------------------------------------------------------------------


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def build_prompt(title: Column | str, description: Column | str) -> Column:
    """PRM1: the instruction prompt; both parts are ``str()``-ed and stripped."""
    return F.concat(F.lit(PROMPT_HEAD + PROMPT_TITLE), T.py_strip(T.as_text(title)),
                    F.lit(PROMPT_DESCRIPTION), T.py_strip(T.as_text(description)), F.lit(PROMPT_TAIL))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat_messages(prompt: Column | str, answer: Column | str | None = None) -> Column:
    """PRM2: ``[{user: prompt}]`` for generation, ``+ {assistant: answer}``
    for training."""
    msgs = [message("user", _c(prompt))]
    if answer is not None:
        msgs.append(message("assistant", T.as_text(answer)))
    return F.array(*msgs)


@dataclass(frozen=True)
class ChatTemplate:
    """PRM3: how messages are rendered. The template belongs to the model's
    tokenizer; the default is a common open-tag / end-tag layout."""

    open: str = "<|{role}|>\n"
    close: str = "<|end|>\n"
    generation: str = "<|assistant|>\n"

    def render_message(self, m: Column) -> Column:
        head, tail = self.open.split("{role}")
        return F.concat(F.lit(head), m["role"], F.lit(tail), F.coalesce(m["content"], F.lit("")), F.lit(self.close))

    def render(self, messages: Column | str, add_generation_prompt: bool = False) -> Column:
        body = F.array_join(F.transform(_c(messages), self.render_message), "")
        return F.concat(body, F.lit(self.generation)) if add_generation_prompt else body


DEFAULT_TEMPLATE = ChatTemplate()


def whitespace_tokens(col: Column | str) -> Column:
    """Tokens of ``str.split()`` (empty text -> empty array)."""
    s = T.py_strip(T.collapse_ws(_c(col)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, " "))


def truncate_tokens(col: Column | str, max_tokens: int = MAX_DESCRIPTION_TOKENS) -> Column:
    """PRM4: keep the first ``max_tokens`` whitespace tokens (decoded with
    single spaces). After whitespace runs become one space, the cut is the
    text before the ``max_tokens``-th space: a byte scan, no token array."""
    if max_tokens <= 0:
        return F.when(_c(col).isNotNull(), F.lit(""))
    return F.substring_index(T.py_strip(T.collapse_ws(_c(col))), " ", max_tokens)


def keep_last_tokens(col: Column | str, max_tokens: int) -> Column:
    """The last ``max_tokens`` whitespace tokens with single spaces between
    them (truncation on the left): a prompt that is too long keeps its end."""
    if max_tokens <= 0:
        raise ValueError("max_tokens must be positive")
    return F.substring_index(T.py_strip(T.collapse_ws(_c(col))), " ", -max_tokens)


def hashed_ids(tokens: Column, vocab_size: int = 32000) -> Column:
    """Default token ids: ``pmod(xxhash64(token), vocab_size)`` as INT."""
    return F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(vocab_size)).cast("int"))


def md5_ids(col: Column | str, vocab_size: int = 32000) -> Column:
    """Token ids of a text's whitespace tokens from the first 15 hex digits of
    their MD5: portable, since other engines have that hash. Slower than
    the default; pass it as ``token_ids`` to ``encode_examples``."""
    digits = lambda t: F.conv(F.substring(F.md5(t), 1, 15), 16, 10).cast("bigint")
    return F.transform(whitespace_tokens(col), lambda t: (digits(t) % F.lit(vocab_size)).cast("int"))


def token_ids_udf(make_tokenizer, name: str = "token_ids"):
    """Wrap a tokenizer factory as an Arrow UDF ``string -> array<int>``.

    ``make_tokenizer()`` is called once per Python worker process and must
    return ``f(list[str]) -> list[list[int]]``.
    """
    import pandas as pd

    state = {}

    @F.pandas_udf(ArrayType(IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        tok = state.get("tok")
        if tok is None:
            tok = state["tok"] = make_tokenizer()
        return pd.Series(tok(s.fillna("").tolist()))

    ids.__name__ = name
    return ids


def encode_columns(n: Column, prompt_len: Column, ids: Column, max_length: int = MAX_LENGTH,
                   pad_id: int = 0) -> Column:
    """PRM5 + ARR1 on precomputed columns: ``ids`` already cut to
    ``max_length``, ``n = size(ids)``, ``prompt_len = least(size(prompt ids),
    max_length)``. Returns the struct of fixed-length ``input_ids``,
    ``attention_mask`` and ``labels`` (prompt positions and padding -100).

    The arguments should be plain columns: the label lambda runs per array
    element and must not re-derive the arrays.
    """
    pad = F.lit(max_length) - n
    input_ids = F.concat(ids, F.array_repeat(F.lit(pad_id), pad))
    mask = F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), pad))
    # -100 over the prompt, the answer ids, -100 over the padding: built from
    # slices and repeats (no per-element lambda).
    plen = F.least(prompt_len, n)
    answer = F.slice(ids, plen + 1, n - plen)
    labels = F.concat(F.array_repeat(F.lit(IGNORE_INDEX), plen), answer,
                      F.array_repeat(F.lit(IGNORE_INDEX), pad))
    return F.struct(input_ids.alias("input_ids"), mask.alias("attention_mask"), labels.alias("labels"))


def loss_token_count(labels: Column | str) -> Column:
    """AGG16: positions that carry loss (label != -100)."""
    return F.size(F.filter(_c(labels), lambda x: x != IGNORE_INDEX))
