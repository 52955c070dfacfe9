"""Sizes of texts in tokens of a public byte-level BPE vocabulary.

The vocabulary file is a parameter; every executor must reach it under that
path. A text is counted in pieces cut where no token can cross, so a very long
one needs little more memory than a short one; a run without such a place is
one piece, however long.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from tesserae.session import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How such vocabularies cut a text into words before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_CHARS = 50_000
_PLACE = re.compile(r"(?<=\w) (?=\w)")


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str) -> Iterator[str]:
    """``text`` in parts before a space that follows a letter or digit, where no token crosses."""
    start = 0
    while len(text) - start > PIECE_CHARS:
        place = _PLACE.search(text, start + PIECE_CHARS)
        if place is None:
            break
        yield text[start : place.start()]
        start = place.start()
    yield text[start:]


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    if not text:
        return 0
    e = encoding(path)
    return sum(len(e.encode_ordinary(p)) for p in pieces(text))


def with_token_counts(df: DataFrame, text: str, keep: list[str], path: str = VOCABULARY) -> DataFrame:
    """(*keep, n_tokens); a null or empty text has none."""
    source = spread(df.select(*keep, df[text].alias("__text")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema) + ", n_tokens bigint"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            counts = [count_tokens(t if isinstance(t, str) else None, path) for t in part["__text"]]
            yield part[keep].assign(n_tokens=pd.Series(counts, index=part.index, dtype="int64"))

    return source.mapInPandas(run, schema)
