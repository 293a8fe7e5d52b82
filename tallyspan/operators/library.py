"""The document library: vectors and manifests, what has to be embedded, merging of document sets, expiry and cascades."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts of a call to an embedding function.
BATCH = 128


def ready(documents: DataFrame, manifests: DataFrame, keys: list[str], by: list[str], status: str = "vector_ready") -> DataFrame:
    """Per ``by``: documents and whether there are any and all have a manifest of the status."""
    state = documents.select(*keys).distinct().join(manifests.select(*keys, "index_status"), keys, "left")
    return state.groupBy(*by).agg(F.count("*").alias("documents"), F.bool_and(F.coalesce(F.col("index_status") == status, F.lit(False))).alias("ready"))


def vectors_of_model(vectors: DataFrame, manifests: DataFrame, keys: list[str], model: str) -> DataFrame:
    """Vectors of documents that were indexed by a model and have the dimension their manifest says."""
    held = manifests.where(F.col("embedding_model") == model).select(*keys, "embedding_dimension")
    return vectors.join(held, keys).where(F.size("embedding") == F.col("embedding_dimension")).drop("embedding_dimension")


def dimensions(vectors: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by``: vectors, least and greatest dimension and whether they agree; null vectors don't."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    return vectors.groupBy(*by).agg(F.count("*").alias("vectors"), F.min(size).alias("least"), F.max(size).alias("most"), ((F.min(size) == F.max(size)) & (F.min(size) > 0)).alias("consistent"))


def unit_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """Vectors of length 1; those with fewer than two numbers, nulls, infinite numbers or zero length drop out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, made = [], []
            for k, v in zip(batch[key], batch["embedding"], strict=True):
                a = np.asarray(v if v is not None else [], dtype=np.float64)
                n = np.sqrt(a @ a) if len(a) else 0.0
                if 2 <= len(a) <= 65_536 and np.isfinite(n) and n > 0:
                    ids.append(k)
                    made.append(a / n)
            yield pd.DataFrame({key: pd.Series(ids, dtype=batch[key].dtype), "embedding": pd.Series(made, dtype=object)})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, "embedding").mapInPandas(run, f"{key} {kind}, embedding array<double>")


def embed_missing(chunks: DataFrame, vectors: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """Vectors of the chunks that have none yet: key and embedding; ``embed`` gets ``BATCH`` texts at a time inside tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), BATCH):
                part = batch.iloc[i : i + BATCH]
                yield pd.DataFrame({key: part[key], "embedding": embed(list(part[text]))})

    kind = chunks.schema[key].dataType.simpleString()
    missing = chunks.where(F.col(text).isNotNull()).select(key, text).join(vectors.select(key), key, "left_anti")
    return missing.mapInPandas(run, f"{key} {kind}, embedding array<double>")


def merged_sets(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The documents of both sets, once each; the new row wins."""
    rest = [c for c in held.columns if c not in keys]
    both = held.select("*", F.lit(0).alias("__new")).unionByName(new.select(*held.columns, F.lit(1).alias("__new")))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__new", *rest)).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def unexpired(rows: DataFrame, written: str, now, seconds: int) -> DataFrame:
    """Rows whose time to live isn't over at ``now``."""
    return rows.where(F.unix_micros(F.col(written).cast("timestamp")) + seconds * 1_000_000 > F.unix_micros(F.lit(now).cast("timestamp")))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """What is left of every table without the rows of ``gone`` keys."""
    return {name: df.join(gone.select(*keys).distinct(), keys, "left_anti") for name, df in tables.items()}
