"""Boundaries to models: interfaces that run inside a pandas UDF, and deterministic stand-ins for them."""

from __future__ import annotations

from collections.abc import Iterator

import hashlib
from abc import ABC, abstractmethod

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.session import reachable


class SpeechEngine(ABC):
    """Turns a text into samples."""

    rate = 24_000

    @abstractmethod
    def synthesize(self, text: str) -> list[float]: ...


class VisionModel(ABC):
    """Describes an image by its bytes and context."""

    @abstractmethod
    def describe(self, image: bytes, context: str) -> tuple[str, float]: ...


class ToneEngine(SpeechEngine):
    """A stand-in: ten samples for each character, from a hash of the text."""

    def synthesize(self, text: str) -> list[float]:
        seed = hashlib.md5(text.encode()).digest()
        return [(seed[k % 16] - 128) / 128 for k in range(10 * len(text))]


class NamingModel(VisionModel):
    """A stand-in: names the image's size."""

    def describe(self, image: bytes, context: str) -> tuple[str, float]:
        return f"An image of {len(image)} bytes.", 0.8


SPEECH: dict[str, type[SpeechEngine]] = {"tone": ToneEngine}
VISION: dict[str, type[VisionModel]] = {"naming": NamingModel}


#: Models of this worker by class: made once, for all batches and tasks that the worker serves.
_MADE: dict[type, object] = {}


def _made(kind: type):
    if kind not in _MADE:
        _MADE[kind] = kind()
    return _MADE[kind]


def _workers_can_import() -> None:
    if session := SparkSession.getActiveSession():
        reachable(session)


def speech(text: Column, engine: str, fallback: str = "tone") -> Column:
    """Samples of each text; an engine that isn't registered falls back. An engine with synthesize_all gets a batch of texts at a time."""
    kind = SPEECH.get(engine, SPEECH[fallback])
    _workers_can_import()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _made(kind)
        many = getattr(own, "synthesize_all", None) or (lambda texts: [own.synthesize(t) for t in texts])
        for texts in batches:
            yield pd.Series(many(texts.fillna("").tolist()), dtype=object)

    return run(text)


def describe(image: Column, context: Column, model: str, fallback: str = "naming") -> Column:
    """(description, confidence) of each image; a model that isn't registered falls back. A model with describe_all gets a batch of pairs at a time."""
    kind = VISION.get(model, VISION[fallback])
    _workers_can_import()

    @F.pandas_udf("description string, confidence double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = _made(kind)
        many = getattr(own, "describe_all", None) or (lambda pairs: [own.describe(i, c) for i, c in pairs])
        for images, contexts in batches:
            yield pd.DataFrame(many([(bytes(i or b""), c or "") for i, c in zip(images, contexts)]), columns=["description", "confidence"])

    return run(image, context)
