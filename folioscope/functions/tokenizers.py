"""Token counts by a tokenizer file, with the estimate where there is none."""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import tokens

#: Splits text before byte pairs are merged, as public byte-level vocabularies expect.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=8)
def encoder(path: str, pattern: str = PATTERN) -> Callable[[str], list[int]]:
    """text -> ids, by kind of file: .tiktoken ranks, tokenizers JSON, or a sentencepiece model."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        lib.no_truncation()
        lib.no_padding()
        return lambda text: lib.encode(text, add_special_tokens=False).ids
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    raise ValueError(f"no tokenizer for {path}")


def counted(text: Column, path: str | None = None) -> Column:
    """Tokens of the text by the tokenizer file that every worker has at path; null and empty text has none.

    Without a path it is the estimate, in the JVM.
    """
    if path is None:
        return tokens(text)

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(path)
        for part in parts:
            yield part.map(lambda t: len(encode(t)) if t else 0)

    return count(text)
