"""Hosted embedding providers over HTTP, with retries and a circuit breaker around any provider."""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.vectors import Provider, ProviderError

Post = Callable[[str, dict, dict], bytes]


def post_json(url: str, headers: dict, body: dict) -> bytes:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=30) as answer:
        return answer.read()


def _vectors(answer: bytes, read: Callable[[dict], list]) -> list[list[float]]:
    try:
        return [[float(x) for x in v] for v in read(json.loads(answer))]
    except (ValueError, KeyError, TypeError) as e:
        raise ProviderError(f"the provider's answer can't be read: {e}") from e


@dataclass
class OpenAI:
    """`v1/embeddings`; vectors come with their index and may be out of order."""

    base_url: str
    api_key: str
    model: str
    post: Post = post_json

    def embed(self, texts: list[str], dimensions: int) -> list[list[float]]:
        answer = self.post(f"{self.base_url.rstrip('/')}/v1/embeddings", {"Authorization": f"Bearer {self.api_key}"}, {"model": self.model, "input": texts, "dimensions": dimensions})
        return _vectors(answer, lambda a: [d["embedding"] for d in sorted(a["data"], key=lambda d: d["index"])])


@dataclass
class Gemini:
    """`batchEmbedContents`."""

    base_url: str
    api_key: str
    model: str
    post: Post = post_json

    def embed(self, texts: list[str], dimensions: int) -> list[list[float]]:
        requests = [{"model": f"models/{self.model}", "content": {"parts": [{"text": t}]}, "outputDimensionality": dimensions} for t in texts]
        answer = self.post(f"{self.base_url.rstrip('/')}/v1beta/models/{self.model}:batchEmbedContents", {"x-goog-api-key": self.api_key}, {"requests": requests})
        return _vectors(answer, lambda a: [e["values"] for e in a["embeddings"]])


@dataclass
class Guarded:
    """Retries with growing, jittered pauses; opens for a while when too many calls of the last seconds failed."""

    inner: Provider
    retries: int = 3
    pause: float = 0.2
    longest_pause: float = 10.0
    window: float = 30.0
    least_calls: int = 10
    ratio: float = 0.5
    open_for: float = 30.0
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    calls: deque = field(default_factory=deque)
    opened: float | None = None

    def _note(self, ok: bool) -> None:
        now = self.clock()
        self.calls.append((now, ok))
        while self.calls and self.calls[0][0] < now - self.window:
            self.calls.popleft()
        if len(self.calls) >= self.least_calls and sum(not k for _, k in self.calls) >= self.ratio * len(self.calls):
            self.opened = now

    def embed(self, texts: list[str], dimensions: int) -> list[list[float]]:
        for attempt in range(self.retries + 1):
            if self.opened is not None:
                if self.clock() - self.opened < self.open_for:
                    raise ProviderError("the circuit is open")
                self.opened = None
                self.calls.clear()
            try:
                out = self.inner.embed(texts, dimensions)
                self._note(True)
                return out
            except Exception as e:
                self._note(False)
                if attempt == self.retries:
                    raise ProviderError(str(e)) from e
                self.sleep(min(self.longest_pause, self.pause * 2**attempt) * (0.5 + random.random() / 2))
        raise AssertionError("unreachable")
