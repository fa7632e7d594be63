"""Exact token counts at every prefix of a text, and what follows from them: lengths, truncation, budgets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from factloom.llm.bpe import PrefixCounts, once_per_worker
from factloom.llm.textbatch import with_text_columns


def prefix_token_counts(df: DataFrame, tokenizer: str, text: str = "text", limit: int = 512, keep: Sequence[str] | None = None) -> DataFrame:
    """``df`` with n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``), chars_in_limit and token_steps.

    chars_in_limit is the most code points whose prefix has at most ``limit`` tokens (a longer prefix may have fewer tokens, so it is
    read from all prefixes).
    token_steps has a little-endian 16-bit difference per code point: its running sum is the number of tokens of each prefix, so
    ``tokens_of_prefix`` and ``longest_prefix`` need no tokenizer.  ``tokenizer`` is the path of a byte-level BPE file on the
    workers.  Null and empty texts have 0 bytes and tokens.  Whole texts, one linear pass, nothing shuffled.
    """

    def start():
        counter = once_per_worker(PrefixCounts, tokenizer)

        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            raw, n, chars, steps = data.tobytes(), np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64), []
            for i in range(len(n)):
                counts = counter.counts(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))
                n[i] = counts[-1] if len(counts) else 0
                fits = np.flatnonzero(counts <= limit)
                chars[i] = fits[-1] + 1 if len(fits) else 0
                steps.append(np.diff(counts.astype(np.int64), prepend=0).astype("<i2").tobytes())
            return [np.diff(offsets), n, n > limit, chars, steps]

        return work

    return with_text_columns(df, text, "n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long, token_steps binary", start, keep)


def tokens_of_prefix(steps: bytes, n_chars: int) -> int:
    """Tokens of the first ``n_chars`` code points."""
    return int(np.frombuffer(steps, "<i2")[:n_chars].sum(dtype=np.int64))


def longest_prefix(steps: bytes, budget: int) -> int:
    """The most code points whose prefix has at most ``budget`` tokens (0 if none has).  A longer prefix may have fewer tokens, so
    all prefixes count."""
    fits = np.flatnonzero(np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def truncate_to_budget(df: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """``df`` (with token_steps) and ``truncated``: the longest beginning of each text with at most ``budget`` tokens."""
    from pyspark.sql import functions as F

    @F.pandas_udf("int")
    def chars(steps):
        return steps.map(lambda s: longest_prefix(bytes(s), budget) if s is not None else 0)

    return df.withColumn("truncated", F.substring(F.coalesce(F.col(text), F.lit("")), F.lit(1), chars("token_steps")))
