"""Token ids of texts by a tokenizer that the caller brings; words without one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

Encode = Callable[[str], list[int]]


def token_ids(text: Column, load: Callable[[], Encode]) -> Column:
    """Array of ids; ``load`` gives the encoder, once for each task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield texts.map(encode, na_action="ignore")

    return F.pandas_udf(run, "array<int>")(text)


def token_count(text: Column, load: Callable[[], Encode] | None = None) -> Column:
    """Number of tokens; without a tokenizer, of what white space parts."""
    return F.size(T.tokens(text) if load is None else token_ids(text, load)).cast("long")
