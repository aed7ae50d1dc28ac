"""Embeddings of texts by a model that is plugged in, in Arrow batches."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quarrylens.session import spread


class Embedder(Protocol):
    """Loaded once in each task; gets whole batches of texts."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """A stand-in without weights: signed hash buckets of character trigrams, of length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for j in range(max(1, len(t) - 2)):
                h = int.from_bytes(hashlib.blake2b(t[j : j + 3].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1 if h >> 63 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(df: DataFrame, text: str, embedder: Embedder, into: str = "embedding", batch: int = 64) -> DataFrame:
    """``df`` with an array of floats for each text; null for null. A column named ``into`` is replaced."""
    keep = [c for c in df.columns if c != into]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{into}` array<float>"

    def run(batches):
        for pdf in batches:
            out: list = [None] * len(pdf)
            there = [i for i, t in enumerate(pdf[text]) if t is not None]
            for a in range(0, len(there), batch):
                part = there[a : a + batch]
                for i, v in zip(part, embedder.embed([pdf[text].iloc[i] for i in part])):
                    out[i] = v.astype("float32")
            yield pdf[keep].assign(**{into: out})

    return spread(df.select(*keep)).mapInPandas(run, schema)
