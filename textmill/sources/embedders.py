"""Embedding services over HTTP, and the choice between them. TF-IDF needs none and is the default offline."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from textmill.operators import tfidf

Post = Callable[[str, dict, dict], dict]


def post_json(url: str, body: dict, headers: dict) -> dict:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers}), timeout=60) as r:
        return json.load(r)


@dataclass(frozen=True)
class Service:
    """How a provider is asked, and where its vectors stand in the answer."""

    name: str
    url: str
    model: str
    key: str = ""
    batch: int = 64
    post: Post = field(default=post_json, compare=False)

    def request(self, texts: list[str]) -> tuple[str, dict]:
        """The paths and fields of each provider's protocol."""
        if self.name == "ollama":
            return f"{self.url}/api/embed", {"model": self.model, "input": texts}
        if self.name == "openai":
            return f"{self.url}/v1/embeddings", {"model": self.model, "input": texts}
        return f"{self.url}/v2/embed", {"model": self.model, "texts": texts, "input_type": "search_document", "embedding_types": ["float"]}

    def vectors(self, answer: dict, n: int) -> list[list[float]]:
        if self.name == "ollama":
            found = answer["embeddings"]
        elif self.name == "openai":
            found = [x["embedding"] for x in sorted(answer["data"], key=lambda x: x["index"])]
        else:
            found = answer["embeddings"]["float"]
        if len(found) != n:
            raise ValueError(f"{self.name} returned {len(found)} vectors for {n} texts")
        return found

    def embed(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(texts), self.batch):
            part = texts[at : at + self.batch]
            url, body = self.request(part)
            out += self.vectors(self.post(url, body, {"Authorization": f"Bearer {self.key}"} if self.key else {}), len(part))
        return out

    def transform(self, chunks: DataFrame) -> DataFrame:
        """id, content -> chunk_id, vector, dimensions; requests are made on the executors, a batch at a time."""
        service = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                v = service.embed(b["content"].tolist())
                yield pd.DataFrame({"chunk_id": b["id"], "vector": v, "dimensions": [len(x) for x in v]})

        return chunks.select("id", "content").mapInPandas(run, "chunk_id string, vector array<float>, dimensions int")


class TfIdf:
    name = "tfidf"

    def transform(self, chunks: DataFrame) -> DataFrame:
        return tfidf.dense(chunks)


#: Default addresses and models.
DEFAULTS = {"ollama": ("http://localhost:11434", "nomic-embed-text"), "openai": ("https://api.openai.com", "text-embedding-3-small"), "cohere": ("https://api.cohere.com", "embed-english-v3.0")}
KEYS = {"openai": "OPENAI_API_KEY", "cohere": "COHERE_API_KEY"}


def reachable(url: str) -> bool:
    from urllib.error import HTTPError
    from urllib.request import urlopen

    try:
        urlopen(url, timeout=2)
    except HTTPError:
        return True
    except OSError:
        return False
    return True


def create(name: str = "auto", model: str = "", batch: int = 64, env: dict[str, str] | None = None, alive: Callable[[str], bool] = reachable) -> Service | TfIdf:
    """auto: a local service that answers, else one with a key in the environment, else TF-IDF."""
    env = dict(os.environ) if env is None else env
    if name == "auto":
        name = "ollama" if alive(DEFAULTS["ollama"][0]) else next((n for n, k in KEYS.items() if env.get(k)), "tfidf")
    if name == "tfidf":
        return TfIdf()
    if name not in DEFAULTS:
        raise ValueError(f"unknown embedder: {name}")
    key = env.get(KEYS.get(name, ""), "")
    if name in KEYS and not key:
        raise ValueError(f"{name} needs {KEYS[name]}")
    url, known = DEFAULTS[name]
    return Service(name, url, model or known, key, batch)
