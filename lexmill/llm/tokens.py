"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.shared import col

#: A ranks file: a base64 token and its rank on each line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the public byte-level vocabulary's own tokenizer splits a text before merging.
PRE_SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def encoder(ranks: bytes, pattern: str = PRE_SPLIT):
    """The encoder of a ranks file, made once in a process.

    It is kept with the library, as this module's own variables are new in each task: its code travels by value.
    """
    import tiktoken

    made = tiktoken.__dict__.setdefault("_made_encoders", {})
    key = hash((ranks, pattern))
    if key not in made:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        made[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return made[key]


def token_counts(df: DataFrame, text_col: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and the number of tokens of the whole text; null and empty texts have 0.

    The vocabulary file is read on the driver and sent to the executors: it doesn't grow with the data.
    """
    ranks = df.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    rows = df.select(*[col(c) for c in keep], col(text_col).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", `{out}` long"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(ranks.value)
        for b in batches:
            b[out] = [len(enc.encode_ordinary(t)) if t else 0 for t in b.pop("__text")]
            yield b

    return rows.mapInPandas(count, schema)
