"""Language-model providers: the protocol, errors, prices, retries, and an offline provider.

A provider is called inside ``mapInPandas`` on executors, so it must pickle; a
client that it needs is made in ``open``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Protocol, TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

T = TypeVar("T")


class ModelError(Exception):
    """Any failure of a provider."""


class RateLimited(ModelError):
    pass


class TimedOut(ModelError):
    pass


class BadAnswer(ModelError):
    pass


@dataclass(frozen=True)
class Answer:
    text: str
    model_used: str
    tokens_in: int = 0
    tokens_out: int = 0
    usd: float = 0.0


class Provider(Protocol):
    def model_id(self) -> str: ...

    def complete(self, system: str, prompt: str) -> Answer: ...


#: USD per million tokens in and out.
PRICES = (
    ("gemini-2.5-flash-lite", 0.10, 0.40), ("gemini-2.5-flash", 0.30, 2.50), ("gemini-2.5-pro", 1.25, 10.0),
    ("claude-haiku-4.5", 1.0, 5.0), ("claude-sonnet-4.5", 3.0, 15.0),
    ("gpt-5-nano", 0.05, 0.40), ("gpt-5-mini", 0.25, 2.0), ("gpt-5", 1.25, 10.0),
)


def estimate_usd(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """By the price list; an unknown model costs nothing."""
    per = lambda k: F.try_element_at(F.create_map(*(F.lit(x) for p in PRICES for x in (p[0], p[k]))), model)
    return F.coalesce(F.round((tokens_in * per(1) + tokens_out * per(2)) / 1_000_000, 8), F.lit(0.0))


@dataclass(frozen=True)
class Retry:
    """Repeats a call on the listed errors, with no, linear or exponential delays."""

    most: int = 3
    backoff: str = "exponential"
    first_delay_s: float = 1.0
    on: tuple[type[Exception], ...] = field(default=(RateLimited, TimedOut))

    def delay(self, attempt: int) -> float:
        return {"none": 0.0, "linear": self.first_delay_s * (attempt + 1)}.get(self.backoff, self.first_delay_s * 2**attempt)

    def call(self, work: Callable[[], T], sleep: Callable[[float], None] = time.sleep) -> T:
        attempt = 0
        while True:
            try:
                return work()
            except self.on:
                if attempt >= self.most:
                    raise
                sleep(self.delay(attempt))
                attempt += 1


@dataclass(frozen=True)
class Fallbacks:
    """Tries models in order until one answers."""

    providers: Sequence[Provider]

    def model_id(self) -> str:
        return "Fallbacks:" + "|".join(p.model_id() for p in self.providers)

    def complete(self, system: str, prompt: str) -> Answer:
        last: ModelError | None = None
        for p in self.providers:
            try:
                return p.complete(system, prompt)
            except ModelError as e:
                last = e
        raise last or ModelError("no provider")


@dataclass(frozen=True)
class Scripted:
    """An offline provider: answers by a function of the prompt; counts words as tokens."""

    answer: Callable[[str], str]
    model: str = "scripted"

    def model_id(self) -> str:
        return f"Scripted:{self.model}"

    def complete(self, system: str, prompt: str) -> Answer:
        text = self.answer(prompt)
        return Answer(text, self.model, len(prompt.split()), len(text.split()))


#: Words in the names of a client's errors, and in messages, that tell what went wrong; the first that fits counts.
ERRORS = (
    (RateLimited, ("RateLimit", "Quota", "ResourceExhausted"), ("429",)),
    (TimedOut, ("Timeout", "DeadlineExceeded", "Connection"), ()),
    (BadAnswer, ("APIStatus", "BadRequest", "Invalid"), ()),
)


def error_of(e: Exception) -> ModelError:
    """A client's own error as one of ours."""
    if isinstance(e, ModelError):
        return e
    name, said = type(e).__name__, str(e)
    kind = next((k for k, names, words in ERRORS if any(x in name for x in names) or any(x in said for x in words)), None)
    return kind(said) if kind else ModelError(f"{name}: {said}")


def price_of(model: str, tokens_in: int, tokens_out: int) -> float:
    """L15 on the driver or in a worker."""
    price = next(((i, o) for m, i, o in PRICES if m == model), (0.0, 0.0))
    return round((tokens_in * price[0] + tokens_out * price[1]) / 1_000_000, 8)


@dataclass(frozen=True)
class RoutedClient:
    """A provider over a router of models, whose client is made by ``open`` on the executor.

    ``send(client, request)`` gives a chat completion as a dictionary. With route ``fallback`` the models are tried here one
    after the other; another route (``lowest-cost``, ``fastest``) hands the whole list to the router. The cost is the router's.
    """

    open: Callable[[], object]
    send: Callable[[object, dict], dict]
    models: tuple[str, ...]
    route: str = "fallback"
    headers: tuple[tuple[str, str], ...] = ()
    as_json: bool = True

    def __post_init__(self) -> None:
        if not self.models:
            raise ValueError("no model")

    def model_id(self) -> str:
        return "RoutedClient:" + "|".join(self.models)

    def request(self, model: str, system: str, prompt: str) -> dict:
        body: dict = {"usage": {"include": True}}
        if self.route != "fallback" and len(self.models) > 1:
            body |= {"models": list(self.models), "route": self.route}
        asked = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": prompt}], "extra_headers": dict(self.headers) or None, "extra_body": body}
        return asked | ({"response_format": {"type": "json_object"}} if self.as_json else {})

    def complete(self, system: str, prompt: str) -> Answer:
        client, last = self.open(), None
        for model in self.models if self.route == "fallback" else self.models[:1]:
            try:
                return self._read(self.send(client, self.request(model, system, prompt)), model)
            except Exception as e:
                last = error_of(e)
        raise last

    @staticmethod
    def _read(raw: dict, model: str) -> Answer:
        said = next((c.get("message") or {} for c in raw.get("choices") or ()), {}).get("content")
        if not said:
            raise BadAnswer("an empty answer")
        usage = raw.get("usage") or {}
        cost = usage.get("cost")
        return Answer(said, raw.get("model") or model, int(usage.get("prompt_tokens") or 0), int(usage.get("completion_tokens") or 0), float(cost) if isinstance(cost, (int, float)) else 0.0)


@dataclass(frozen=True)
class ChatClient:
    """A provider over a vendor's own client, made by ``open`` on the executor; its errors become ours.

    ``send(client, model, system, prompt)`` gives text and token counts; cost is by the price list.
    """

    name: str
    model: str
    open: Callable[[], object]
    send: Callable[[object, str, str, str], tuple[str, int, int]]

    def model_id(self) -> str:
        return f"{self.name}:{self.model}"

    def complete(self, system: str, prompt: str) -> Answer:
        try:
            text, tokens_in, tokens_out = self.send(self.open(), self.model, system, prompt)
        except Exception as e:
            raise error_of(e) from e
        if not text:
            raise BadAnswer("an empty answer")
        return Answer(text, self.model, tokens_in, tokens_out, price_of(self.model, tokens_in, tokens_out))


def aggregate_cost(calls: DataFrame) -> DataFrame:
    """Per document tokens, cost rounded to 8, the last call's model and the costs by call."""
    return calls.groupBy("doc_id").agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("usd"), 8).alias("usd"), F.max_by("model_used", "call_idx").alias("model_used"),
        F.transform(F.array_sort(F.collect_list(F.struct("call_idx", "model_used", "usd"))), lambda c: F.struct(c["model_used"], c["usd"])).alias("breakdown"),
    )
