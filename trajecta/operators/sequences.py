"""Padding, truncation, loss masks and pair encoding of token-id arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATION = ("left", "right", "middle", "error")


def fit_length(
    ids: Column | str, length: int, pad: Column | int = 0, left_pad: bool = True, truncation: str = "error"
) -> Column:
    """Pad or cut an array to exactly `length`."""
    if truncation not in TRUNCATION:
        raise ValueError(f"unknown truncation: {truncation}")
    ids = F.col(ids) if isinstance(ids, str) else ids
    pad = pad if isinstance(pad, Column) else F.lit(pad)
    n = F.size(ids)
    fill = F.array_repeat(pad, F.greatest(F.lit(length) - n, F.lit(0)))
    padded = F.concat(fill, ids) if left_pad else F.concat(ids, fill)
    half = length // 2
    if truncation == "left":
        cut = F.slice(ids, -length, length)
    elif truncation == "right":
        cut = F.slice(ids, 1, length)
    elif truncation == "middle":
        cut = F.concat(F.slice(ids, 1, half), F.slice(ids, -(length - half), length - half))
    else:
        cut = F.transform(ids, lambda x: F.when(x.isNotNull(), F.raise_error(F.lit(f"sequence longer than {length}")).cast("int")))
    return F.when(n <= length, padded).otherwise(cut)


def valid_tokens(ids: str, mask: str) -> Column:
    """Drop padding by mask."""
    return F.transform(F.filter(F.arrays_zip(ids, mask), lambda t: t[mask] > 0), lambda t: t[ids])


def sft_loss_mask(prompt_len: Column, response_len: Column, length: int) -> Column:
    """Ones on the tokens that are trained on: not the prompt but its last token, not the last valid token."""
    total = prompt_len + response_len
    last = F.least(total, F.lit(length)) - 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(length - 1)),
        lambda i: F.when(i >= total, 0)
        .when((prompt_len > 1) & (i < F.least(prompt_len, F.lit(length)) - 1), 0)
        .when(i == last, 0)
        .otherwise(1),
    )


def pair_encoding(prompt: Column, chosen: Column, rejected: Column, length: int) -> Column:
    """Prompt with each answer, zero-padded or cut on the right."""

    def fit(answer: Column) -> Column:
        return fit_length(F.concat(prompt, answer), length, 0, left_pad=False, truncation="right")

    return F.array(fit(chosen), fit(rejected))


def tokens(text: Column | str) -> Column:
    """Default word tokens; callers may plug in a model tokeniser as a column function instead."""
    text = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def turn_tokens(messages: Column | str, tokenize=tokens) -> Column:
    """Per message: role, its tokens, and one loss flag per token (assistant tokens only)."""
    messages = F.col(messages) if isinstance(messages, str) else messages
    return F.transform(
        messages,
        lambda m: F.struct(
            m["role"].alias("role"),
            tokenize(m["content"]).alias("tokens"),
            F.transform(tokenize(m["content"]), lambda _: (m["role"] == "assistant").cast("int")).alias("flags"),
        ),
    )


def chat_encoding(
    messages: Column | str,
    tokenize=tokens,
    generation_prefix: int = 1,
    max_length: int | None = None,
    tools: Column | None = None,
    system_prefix: Column | None = None,
) -> Column:
    """Tokens and loss mask of a chat: a role marker opens each turn and is never trained on.

    The marker stands for the `generation_prefix` tokens a chat template puts before an answer.  A template
    that renders one message alone would repeat its default system text and the tools before every turn; here
    `system_prefix` (unless the chat brings its own system turn) and `tools` stand before the first turn only.
    Of an assistant turn all but its first `generation_prefix` tokens are trained on, so a chat that opens
    with one trains on what its template puts before it too.
    """
    messages = F.col(messages) if isinstance(messages, str) else messages
    nothing = F.array().cast("array<string>")
    tools = nothing if tools is None else tools
    system_prefix = nothing if system_prefix is None else system_prefix

    def one(m, i):
        opening = F.concat(F.when(m["role"] == "system", nothing).otherwise(system_prefix), tools)
        marker = F.array_repeat(F.concat(F.lit("<"), m["role"], F.lit(">")), generation_prefix)
        all_tokens = F.concat(F.when(i == 0, opening).otherwise(nothing), marker, tokenize(m["content"]))
        trained = m["role"] == "assistant"
        return F.struct(
            all_tokens.alias("tokens"),
            F.transform(all_tokens, lambda _, j: (trained & (j >= generation_prefix)).cast("int")).alias("mask"),
        )

    turns = F.transform(messages, one)
    ids, mask = F.flatten(turns["tokens"]), F.flatten(turns["mask"])
    if max_length is not None:
        ids = fit_length(ids, max_length, F.lit("<pad>"), left_pad=False, truncation="right")
        mask = fit_length(mask, max_length, 0, left_pad=False, truncation="right")
    return F.struct(ids.alias("tokens"), mask.alias("loss_mask"))
