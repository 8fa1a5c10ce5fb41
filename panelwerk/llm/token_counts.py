"""Token counts with a whole-token shortcut.

Which vocabulary strings are one token on their own is proven once, on the driver, by the library itself
(``word_tokens.whole_tokens``). Texts are then counted where they lie, in one scan without a shuffle: pre-tokens of any
script in the proven set count 1, only the rest are merged.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted one by one; extra columns are kept by
``token_counts``, one named like the count under another name. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import python_workers
from .common import set_aside, table
from .word_tokens import chunk_counter, count_texts, vocabulary_path, whole_tokens

#: Above so many tokens a text is over the limit.
LIMIT = 2048


def token_counts(docs: DataFrame, path: str | None = None, text: str = "text", column: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each text."""
    path = path or vocabulary_path()
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # bounded by the vocabulary

    @F.pandas_udf("long")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept = chunk_counter(path, whole.value)
        for batch in texts:
            yield pd.Series(count_texts(kept, batch), dtype="int64")

    python_workers(docs.sparkSession)
    return set_aside(docs, column).withColumn(column, count(F.coalesce(F.col(text), F.lit(""))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts(docs).withColumn("n_bytes", F.octet_length(F.coalesce("text", F.lit(""))).cast("long"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
