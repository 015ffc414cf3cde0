"""The seam for embedding models: a protocol, a deterministic one for tests, and an HTTP one."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from dataclasses import dataclass
from typing import Protocol


class Embedder(Protocol):
    model: str

    def generate(self, text: str) -> list[float]:
        """The vector of one text; raises if there is none."""


class HashEmbedder:
    """A vector that depends only on the text and the model name."""

    def __init__(self, model: str = "hash-embed", dim: int = 64):
        self.model, self.dim = model, dim

    def generate(self, text: str) -> list[float]:
        raw = hashlib.shake_256(f"{self.model}\0{text}".encode("utf-8", "surrogatepass")).digest(2 * self.dim)
        return [int.from_bytes(raw[2 * i : 2 * i + 2], "big") / 32768 - 1 for i in range(self.dim)]


def endpoint_url(base: str) -> str:
    """The embeddings address for a configured base address."""
    base = base.rstrip("/")
    if base.endswith("/embeddings"):
        return base
    return base + "/embeddings" if base.endswith("/v1") else base + "/v1/embeddings"


class HttpEmbedder:
    """One POST for each text to an endpoint that speaks the common embeddings format."""

    def __init__(self, base: str, model: str, token: str | None = None, timeout: float = 30.0):
        self.url, self.model, self.token, self.timeout = endpoint_url(base), model, token, timeout

    def generate(self, text: str) -> list[float]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": text}).encode(), headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            body = json.load(reply)
        if not body.get("data"):
            raise ValueError("the endpoint returned no vector")
        return [float(x) for x in body["data"][0]["embedding"]]


@dataclass(frozen=True)
class Health:
    """What the last probe of an embedder saw: ``unknown`` before the first, then ``ok`` or ``degraded``."""

    state: str = "unknown"
    latency: float = 0.0
    failures: int = 0
    error: str = ""


def probed(embedder: Embedder, dim: int, before: Health = Health()) -> Health:
    """One probe; failures in a row, wrong lengths among them, are counted until a probe succeeds."""
    began = time.monotonic()
    try:
        n = len(embedder.generate("probe"))
        error = "" if n == dim else f"length {n}, wanted {dim}"
    except Exception as e:  # noqa: BLE001 - any failure is a degraded endpoint
        error = str(e) or type(e).__name__
    spent = time.monotonic() - began
    return Health("degraded", spent, before.failures + 1, error) if error else Health("ok", spent)
