"""Embedding of texts with a cache: distinct texts, cache lookup, batches of what is missing.

Defined cases: null texts are left out; every distinct text is embedded once; a model that returns too few or empty vectors fails
the query; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlens.sources.caches import newest


def embedded(texts: DataFrame, cache: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 256) -> tuple[DataFrame, DataFrame]:
    """((text, vec) of all texts, (text, vec) to add to the cache). ``cache``: text, vec, cached_at, vec_id of one model."""
    wanted = texts.filter("text IS NOT NULL").select("text").distinct()
    held = newest(cache.filter("text IS NOT NULL AND vec IS NOT NULL").select("text", "vec", "cached_at", "vec_id"), ["text"], "cached_at", "vec_id").select("text", F.col("vec").cast("array<float>").alias("vec"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part["text"].tolist()
            for a in range(0, len(own), batch):
                some = own[a : a + batch]
                vectors = model(some)
                if len(vectors) != len(some) or not all(v is not None and len(v) for v in vectors):
                    raise ValueError("the model left texts without a vector")
                yield pd.DataFrame({"text": some, "vec": [np.asarray(v, np.float32) for v in vectors]})

    fresh = wanted.join(held, "text", "left_anti").mapInPandas(run, "text string, vec array<float>")
    return wanted.join(held, "text").unionByName(fresh), fresh


@dataclass(frozen=True)
class EmbeddingSettings:
    """Where embeddings come from. ``shape`` is 'data' (list of objects under ``data``) or 'plain' (list under ``embeddings``)."""

    model: str = ""
    base_url: str = ""
    shape: str = "data"
    dim: int | None = None
    api_key: str | None = None

    @classmethod
    def of(cls, *sources: dict | None) -> EmbeddingSettings:
        """Settings from defaults, files, the environment and the caller: of each the last source that has a value wins."""
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for s in sources for k, v in (s or {}).items() if k in names and v is not None})


def embedding_request(texts: list[str], settings: EmbeddingSettings) -> tuple[str, dict, dict]:
    """(url, payload, headers) of one batch."""
    base = settings.base_url.rstrip("/")
    if settings.shape == "plain":
        return f"{base}/api/embed", {"model": settings.model, "input": texts}, {}
    if settings.shape != "data":
        raise ValueError(f"unknown shape: {settings.shape}")
    if not settings.api_key:
        raise ValueError("an api key is needed")
    dim = {"dimensions": settings.dim} if settings.dim else {}
    return f"{base}/embeddings", {"model": settings.model, "input": texts, **dim}, {"Authorization": f"Bearer {settings.api_key}"}


def embedding_model(settings: EmbeddingSettings, post: Callable[[str, dict, dict], dict]) -> Callable[[list[str]], list[list[float]]]:
    """A model for ``embedded`` that asks a service through ``post`` (url, payload, headers) -> answer."""

    def model(texts: list[str]) -> list[list[float]]:
        answer = post(*embedding_request(texts, settings))
        return answer["embeddings"] if settings.shape == "plain" else [row["embedding"] for row in answer["data"]]

    return model


def model_slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def load_background(folder: str, slug: str, dim: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and matrix saved for a model and dimension, None if there are none."""
    paths = [os.path.join(folder, f"{part}_{slug}_{dim}.npy") for part in ("mean", "matrix")]
    return (np.load(paths[0]), np.load(paths[1])) if all(map(os.path.exists, paths)) else None
