"""Counts of tokens: an estimate by bytes, or by a vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

#: Rows that the encoder takes at once; long texts are encoded one by one.
TOGETHER, LONG = 64, 1 << 16


def estimated(text: Column) -> Column:
    """Four bytes to a token."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def counted(text: Column, vocabulary: str) -> Column:
    """Tokens of ``text`` by a tokenizer's JSON file, which all machines see under this path; null for a null text, 0 for an empty one.

    Whole texts; special tokens are neither added nor read as such. Bytes that aren't UTF-8 count as the replacement character.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_file(vocabulary)
        encoder.encode_special_tokens = True
        for batch in batches:
            there = batch.dropna()
            short, long = there[there.str.len() <= LONG], there[there.str.len() > LONG]
            n = {k: len(encoder.encode(x, add_special_tokens=False).ids) for k, x in long.items()}
            for a in range(0, len(short), TOGETHER):
                part = short.iloc[a : a + TOGETHER]
                n |= {k: len(e.ids) for k, e in zip(part.index, encoder.encode_batch(part.tolist(), add_special_tokens=False), strict=True)}
            yield pd.Series([n.get(k) for k in batch.index], index=batch.index, dtype="Int64")

    return run(F.make_valid_utf8(text))
