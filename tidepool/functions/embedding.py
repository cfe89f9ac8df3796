"""Embeddings as columns: unit length, bytes, model names, and the place where a model plugs in."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

# The names of the local model, its dimensions and profile; the smallest norm that is divided by.
LOCAL_NAMES = ["local-minilm", "sentence-transformers/all-MiniLM-L6-v2", "all-MiniLM-L6-v2"]
LOCAL_DIMENSIONS, LOCAL_PROFILE = 384, "local|sentence-transformers/all-MiniLM-L6-v2|384|v1|chars:none"
LEAST_NORM = 1.1920929e-07


class Embedder(Protocol):
    """What a model offers. An embedder is pickled to the tasks, where it loads its weights on first use."""

    name: str
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class NoModel:
    """Stands in where there is no model: vectors of zeros."""

    name = "none"

    def __init__(self, dimensions: int) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.zeros((len(texts), self.dimensions), np.float32)


def unit(vector: Column) -> Column:
    """Divided by its length; a vector without one stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > LEAST_NORM, F.transform(vector, lambda x: (x / norm).cast("float"))).otherwise(vector.cast("array<float>"))


@F.pandas_udf(BinaryType())
def to_bytes(vectors: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def from_bytes(data: pd.Series) -> pd.Series:
    """A last piece of fewer than four bytes is left out."""
    return data.map(lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], "<f4"))


def canonical_model(name: Column) -> Column:
    return F.when(name.isin(LOCAL_NAMES), LOCAL_NAMES[0]).otherwise(name)


def model_names(name: Column) -> Column:
    """All names under which a model's vectors may be stored."""
    return F.when(name.isin(LOCAL_NAMES), F.lit(LOCAL_NAMES)).otherwise(F.array(name))


def model_profile(name: Column, dimensions: Column) -> Column:
    local = name.isin(LOCAL_NAMES) & (dimensions == LOCAL_DIMENSIONS)
    return F.when(local, LOCAL_PROFILE).otherwise(F.concat_ws("|", F.lit("custom"), name, dimensions.cast("string")))


def embed(rows: DataFrame, model: Embedder, batch: int = 256) -> DataFrame:
    """id, embedding of rows (id, searchable_text) with text; so many texts go to the model at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                yield pd.DataFrame({"id": part["id"], "embedding": list(model.embed(part["searchable_text"].tolist()))})

    return rows.where(F.trim("searchable_text") != "").select("id", "searchable_text").mapInPandas(run, "id long, embedding array<float>")
