"""Token counts with a byte-pair vocabulary from a file, in place of the estimate.

A vocabulary file has a token in base 64 and its rank on each line, as published tokenizers do; its path is a parameter
and must be readable on executors. Without one, ``functions.text`` estimates.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how the published vocabulary of this kind splits texts before its merges.
PATTERN = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def counter(path: str, pattern: str = PATTERN) -> Callable[[str], int]:
    """Counts a text's tokens; strings of special tokens are ordinary text. Give it to ``chunks.chunk`` as ``count``."""
    return lambda text: len(_encoding(path, pattern).encode_ordinary(text))


def token_count(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """Tokens of each text; null for null."""
    count = counter(path, pattern)
    return F.pandas_udf(lambda texts: texts.map(lambda t: None if t is None else count(t)).astype("Int32"), "int")(text)
