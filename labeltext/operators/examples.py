"""Evaluation and training sets: SRC5 (load_eval_set), COL2 (training rows),
PRM5-7 (encoded examples, sampled training data, loss-token check)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as PR
from ..functions import text as T
from .clean import dedup_first
from .common import fence
from .rank import sample_exact
from .validate import require_columns, validate_training_frame

EVAL_COLUMNS = ["job_id", "title", "description", "instruction", "skill_name"]


def load_eval_set(df: DataFrame, label: str = "skill_name", id_col: str = "job_id") -> DataFrame:
    """SRC5: drop NULL labels (blank labels stay), fill/cast/strip title,
    description and label, keep rows with a title or a description, build the
    instruction, keep the known columns, one row per (instruction, label)
    (the smallest id wins)."""
    require_columns(df, ["title", "description", label], "test data")
    out = df.dropna(subset=[label])
    for c in ["title", "description", label]:
        out = out.withColumn(c, T.py_strip(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    out = fence(out.withColumn("instruction", PR.build_prompt("title", "description")), "eval_set")
    out = out.filter((F.col("title") != "") | (F.col("description") != ""))
    out = out.select([c for c in EVAL_COLUMNS if c in out.columns])
    if id_col not in out.columns:
        return out.dropDuplicates(["instruction", label])
    return dedup_first(out, ["instruction", label], id_col)


def encode_examples(df: DataFrame, template: PR.ChatTemplate = PR.DEFAULT_TEMPLATE,
                    max_length: int = PR.MAX_LENGTH,
                    max_description_tokens: int = PR.MAX_DESCRIPTION_TOKENS,
                    vocab_size: int = 32000, token_ids=None, label: str = "skill_name") -> DataFrame:
    """PRM5: one encoded example per row: prompt from title and truncated
    description, chat rendered with and without the answer, ids, mask and
    masked labels. ``token_ids`` (string Column -> array<int> Column, e.g.
    from ``token_ids_udf``) replaces the built-in hashed whitespace ids."""
    require_columns(df, ["title", "description", label], "training data")
    desc = PR.truncate_tokens(T.as_text("description"), max_description_tokens)
    prompt = PR.build_prompt("title", desc)
    prompt_text = template.render(PR.chat_messages(prompt), add_generation_prompt=True)
    full_text = template.render(PR.chat_messages(prompt, label), add_generation_prompt=False)
    staged = fence(df.select("*", prompt_text.alias("_prompt_text"), full_text.alias("_full_text")), "examples")
    if token_ids is None:
        # only the first max_length tokens are hashed; the prompt needs its length only
        full_ids = PR.hashed_ids(F.slice(PR.whitespace_tokens("_full_text"), 1, max_length), vocab_size)
        prompt_len = F.size(PR.whitespace_tokens("_prompt_text"))
    else:
        full_ids = F.slice(token_ids(F.col("_full_text")), 1, max_length)
        prompt_len = F.size(token_ids(F.col("_prompt_text")))
    ids = fence(staged.select(
        *df.columns, full_ids.alias("_ids"),
        F.least(prompt_len, F.lit(max_length)).alias("_plen")), "token_ids")
    sized = ids.select("*", F.size("_ids").alias("_n"))
    enc = PR.encode_columns(F.col("_n"), F.col("_plen"), F.col("_ids"), max_length)
    return sized.select(*df.columns, enc.alias("example")).select(*df.columns, "example.*")


def loss_tokens(encoded: DataFrame, id_col: str = "job_id") -> DataFrame:
    """AGG16 / PRM7: loss-carrying tokens per example (0 means the answer was
    truncated away)."""
    return encoded.select(id_col, PR.loss_token_count("labels").alias("loss_tokens"),
                          F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("tokens"))


def training_sample(split_df: DataFrame, split: str = "train", sample_size: int | None = 1000,
                    seed: int = 42, name: str = "train") -> DataFrame:
    """PRM6: rows of one split, validated (COL2) and sampled exactly."""
    part = split_df.filter(F.col("split") == split).drop("split")
    return sample_exact(validate_training_frame(part, name), sample_size, seed)
