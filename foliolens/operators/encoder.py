"""Token vectors: from a table, or trained on the sequences by word2vec; and what part of a book is encoded."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.functions.sequences import CONTEXT, chunks
from foliolens.sources.durable import stored


class TokenEncoder(Protocol):
    def vectors(self, sequences: DataFrame) -> DataFrame:
        """issuer_id, vec for the tokens of sequences (a column `tokens`)."""


class TableEncoder:
    """Vectors made elsewhere."""

    def __init__(self, table: DataFrame):
        self.table = table

    def vectors(self, sequences: DataFrame) -> DataFrame:
        used = sequences.select(F.explode("tokens").alias("issuer_id")).distinct()
        return self.table.join(used, "issuer_id", "left_semi").select("issuer_id", "vec")


class Word2VecEncoder:
    """Vectors trained on token order, in place of the small transformer of the original pipeline.

    Tasks of about per_task sequences, no more than there are cores, train from the same start in each round; a token's vectors are averaged.
    """

    def __init__(self, d: int = 64, min_count: int = 1, rounds: int = 1, window: int = 5, seed: int = 42, per_task: int = 5_000):
        self.per_task = per_task
        self.settings = {"vectorSize": d, "minCount": min_count, "maxIter": rounds, "windowSize": window, "seed": seed}

    def vectors(self, sequences: DataFrame) -> DataFrame:
        from pyspark.ml.feature import Word2Vec
        from pyspark.ml.functions import vector_to_array

        rows = stored(sequences.select(real_tokens(F.col("tokens")).alias("tokens")), "sentences")
        model = Word2Vec(inputCol="tokens", outputCol="v", numPartitions=self.tasks(rows.count(), rows.sparkSession.sparkContext.defaultParallelism), **self.settings).fit(rows)
        return model.getVectors().select(F.col("word").alias("issuer_id"), vector_to_array("vector").alias("vec"))

    def tasks(self, sequences: int, cores: int) -> int:
        return max(1, min(cores, sequences // self.per_task))


def real_tokens(tokens: Column) -> Column:
    """Tokens without the special ones, which begin with a bracket."""
    return F.filter(tokens, lambda t: ~t.rlike(r"^\["))


def covered(tokens: Column, coverage: str, context: int = CONTEXT) -> Column:
    """Pieces of a book that are encoded: `paper` the first context of ranks, `first-chunk` the first of equal chunks, `all-chunks` each of them, `full-sequence` the whole."""
    return {
        "paper": lambda: F.array(F.slice(tokens, 1, context)),
        "first-chunk": lambda: F.slice(chunks(tokens, context), 1, 1),
        "all-chunks": lambda: chunks(tokens, context),
        "full-sequence": lambda: F.array(tokens),
    }[coverage]()


def relabelled(df: DataFrame, label: str, order: list[int]) -> DataFrame:
    """df with label i replaced by order[i]."""
    return df.withColumn(label, F.get(F.array(*[F.lit(int(x)) for x in order]), F.col(label)))
