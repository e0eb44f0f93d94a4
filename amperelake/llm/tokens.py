"""Token ids of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amperelake.llm.bpe import PATTERN, SETTING, cached


def vocabulary_file(spark: SparkSession, path: str | None = None) -> str:
    """The vocabulary to use: `path`, else what the session's `spark.amperelake.vocabulary` names, else byte_bpe_50k of the
    installed package of public tokenizers."""
    path = path or spark.conf.get(SETTING, None)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return str(path)


def _each(texts: DataFrame, id_col: str, text_col: str, vocabulary: str | None, pattern: str, result: str, f):
    """Rows (id, f(encoder, text)) without a shuffle; the vocabulary file, of fixed size, is broadcast as it is."""
    content = texts.sparkSession.sparkContext.broadcast(Path(vocabulary_file(texts.sparkSession, vocabulary)).read_bytes())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        value = pa.list_(pa.int32()) if result.startswith("array") else pa.int32()
        bpe = cached(content.value, pattern)
        for b in batches:
            text = b.column(1)
            step = 512  # whole texts, a few hundred of them at a time, so a batch of long ones stays small
            for i in range(0, b.num_rows, step):
                out = pa.array([f(bpe, t) for t in text.slice(i, step).to_pylist()], type=value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, step), out], names=["id", "value"])

    id_type = dict(texts.dtypes)[id_col]
    return texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {id_type}, value {result}")


def token_ids(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """`id_col` and `ids`, the list of token ids of each text without special tokens.

    The list is empty for empty and for null texts; blank texts have the tokens of their blanks; strings of special
    tokens are ordinary text. One row per input row, repeated ids and texts included; an empty table gives no row.
    """
    out = _each(texts, id_col, text_col, vocabulary, pattern, "array<int>", lambda bpe, t: bpe.encode(t))
    return out.select(F.col("id").alias(id_col), F.col("value").alias("ids"))


def token_counts(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """`id_col` and `n_tokens`, the number of token ids of each text; 0 for empty and null texts."""
    out = _each(texts, id_col, text_col, vocabulary, pattern, "int", lambda bpe, t: bpe.count(t))
    return out.select(F.col("id").alias(id_col), F.col("value").alias("n_tokens"))
