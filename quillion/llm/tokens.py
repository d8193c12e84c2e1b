"""Token counts by byte-pair merging (see ``bpe``): no identifiers are made.

The vocabulary file is read on the driver and broadcast (its size is that of the vocabulary, whatever the
input). Each worker remembers the counts of up to ``bpe.REMEMBERED`` words over its tasks; words beyond that
are merged again, so memory is bounded and results are not touched. Special strings inside a text count as one
token each, as the library has it by default.

Defined results: a null text counts as an empty one, with 0 bytes and 0 tokens; rows stay as they are, repeated
or not, and each document is counted by itself, so that there are no ties; a very long text or word costs time in proportion, but for a logarithm; the columns kept may have any
names but those of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .shared import small_batches

#: A document with more tokens is over the limit.
LIMIT = 2048


def count_tokens(docs: DataFrame, vocabulary: str, keep: list[str], limit: int = LIMIT) -> DataFrame:
    """The columns ``keep`` with n_bytes, n_tokens and over_limit, from the column text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(bpe.load(vocabulary))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(*keep, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = held.value
        words = bpe.Words(state)
        size = bpe.remembered(state, "_counts", bpe.counter(state)).__getitem__
        for batch in batches:
            counts = []
            for text in batch.column(batch.num_columns - 1):
                parts = words.segments(text.as_py())
                counts.append(len(parts) // 2 + sum(sum(map(size, words.split(x))) for x in parts[::2]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=schema.fieldNames())

    return source.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
