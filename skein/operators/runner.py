"""Running extractors and embeddings in tasks: named providers, bounded requests in flight, timeouts, retries.

A provider is made once a Python worker, by the function registered under its name.  An extractor's
provider answers one prompt with one text; failures become a status of their chunk and never end the
job, so that the other chunks of a source still count.  An embedding's provider maps a list of texts
to a list of vectors.
"""

from __future__ import annotations

import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: What a provider is asked; {content} stands for the chunk.
PROMPT = (
    "Read the text below and list the ideas in it that stand on their own, as JSON: an object whose key "
    '"concepts" has a list of objects with "title", "content", "suggested_tags" (two or three), "concept_type" '
    'and "abstraction_level".  Give an empty list if there are none.\n\nText:\n{content}'
)


class ProviderError(RuntimeError):
    """A provider's failure that may pass: the request is tried again."""


#: Factories by name: model and options to a function of one prompt.
EXTRACTORS: dict[str, Callable[..., Callable[[str], str]]] = {}
#: Factories by name, with the default model: model to a function of a list of texts.
EMBEDDINGS: dict[str, tuple[str, Callable[[str], Callable[[list[str]], list]]]] = {}


def register_extractor(name: str, factory: Callable[..., Callable[[str], str]]) -> None:
    EXTRACTORS[name] = factory


def register_embedding(name: str, default_model: str, factory: Callable[[str], Callable[[list[str]], list]]) -> None:
    EMBEDDINGS[name] = default_model, factory


def _ask(call: Callable[[str], str], prompt: str, retries: int, delay: float) -> tuple[str | None, str, str | None]:
    """(raw, status, error) of one request with its retries."""
    for attempt in range(retries + 1):
        try:
            return call(prompt), "ok", None
        except ProviderError as e:
            error = str(e)
            if attempt < retries:
                time.sleep(delay * (attempt + 1))
        except Exception as e:  # any other failure of a provider is final for this chunk
            return None, "provider_error", f"{type(e).__name__}: {e}"
    return None, "provider_error", error


def answers(prompts: Iterator[tuple], call: Callable[[str], str], in_flight: int, timeout: float, retries: int, delay: float) -> Iterator[tuple]:
    """(key, raw, status, error) for (key, prompt) in their order, with at most in_flight requests that are waited for at a time.

    A request that takes longer than timeout, retries included, gets the status provider_error; its thread
    is left behind and ends with the worker, and another one takes its place.  Threads serve many requests.
    """
    waiting: deque = deque()
    asked: queue.SimpleQueue = queue.SimpleQueue()
    threads = 0

    def serve() -> None:
        while (job := asked.get()) is not None:
            prompt, out = job
            out.put(_ask(call, prompt, retries, delay))

    def start() -> None:
        nonlocal threads
        threads += 1
        threading.Thread(target=serve, daemon=True).start()

    def finished() -> tuple:
        key, out, end = waiting.popleft()
        try:
            return key, *out.get(timeout=max(0.0, end - time.monotonic()))
        except queue.Empty:
            start()
            return key, None, "provider_error", f"no answer within {timeout:g} s"

    try:
        for key, prompt in prompts:
            if len(waiting) >= in_flight:
                yield finished()
            if threads < in_flight:
                start()
            out: queue.SimpleQueue = queue.SimpleQueue()
            waiting.append((key, out, time.monotonic() + timeout))
            asked.put((prompt, out))
        while waiting:
            yield finished()
    finally:
        for _ in range(threads):
            asked.put(None)


def extractor(provider: str, model: str | None = None, in_flight: int = 8, timeout: float = 120.0, retries: int = 2, delay: float = 0.5, prompt: str = PROMPT, **options) -> Callable[[DataFrame], DataFrame]:
    """A function from chunk rows (source_id, chunk_pos, chunk) to (source_id, chunk_pos, raw, status, error), for operators.extract and process."""
    if provider not in EXTRACTORS:
        raise ValueError(f"unknown extraction provider: {provider}")
    factory = EXTRACTORS[provider]
    before, _, after = prompt.partition("{content}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = factory(model, **options)
        for batch in batches:
            prompts = ((i, f"{before}{c}{after}") for i, c in enumerate(batch.column("chunk").to_pylist()))
            made = list(answers(prompts, call, in_flight, timeout, retries, delay))
            cols = [pa.array([m[k] for m in made], pa.string()) for k in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), batch.column("chunk_pos"), *cols], names=["source_id", "chunk_pos", "raw", "status", "error"])

    def apply(chunks: DataFrame) -> DataFrame:
        kind = chunks.schema["source_id"].dataType.simpleString()
        return chunks.select("source_id", "chunk_pos", "chunk").mapInArrow(run, f"source_id {kind}, chunk_pos int, raw string, status string, error string")

    return apply


def embedding(provider: str, model: str | None = None, lenient: bool = False, batch: int = 256) -> Callable[[Column], Column]:
    """A function from a text column to array<double>: the provider's model is loaded once a worker and called with ``batch`` texts.

    Where a call fails the job does, or, if lenient, its texts get null, which search and dedupe leave out.
    """
    if provider not in EMBEDDINGS:
        raise ValueError(f"unknown embedding provider: {provider}")
    default, factory = EMBEDDINGS[provider]

    @F.pandas_udf("array<double>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        call = factory(model or default)
        for part in parts:
            out: list = []
            for at in range(0, len(part), batch):
                texts = [x or "" for x in part.iloc[at : at + batch]]
                try:
                    out += [np.asarray(v, np.float64) for v in call(texts)]
                except Exception:
                    if not lenient:
                        raise
                    out += [None] * len(texts)
            yield pd.Series(out, dtype=object)

    return lambda text: F.when(text.isNotNull(), vectors(text))


def hashed_words(model: str) -> Callable[[list[str]], list]:
    """An embedding without a model file: words hashed into as many dimensions as the model's name ends with, with signs, at length one."""
    import re
    import zlib

    size = int(model.rpartition("-")[2])

    def call(texts: list[str]) -> list:
        out = np.zeros((len(texts), size))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % size] += 1.0 if h & (1 << 31) else -1.0
        norms = np.sqrt((out * out).sum(1, keepdims=True))
        return list(out / np.maximum(norms, 1e-300))

    return call


def outline(model: str | None = None) -> Callable[[str], str]:
    """An extractor without a model: the first lower-case word of a text is its one idea, in the forms that models' replies come in.

    The form follows from the text's length, so that every status of a reply occurs: fenced and bare JSON,
    other JSON, no JSON, items that fail the checks, empty lists, and a failing provider.
    """
    import json
    import re

    def call(prompt: str) -> str:
        text = prompt.partition("Text:\n")[2]
        found = re.search("[a-z]+", text)
        word = found[0] if found else ""
        item = {"title": f" {word} ", "content": f"{word} {len(text)}", "suggested_tags": [word, "words"], "concept_type": "observation", "abstraction_level": "concrete-example"}
        form = len(text) % 7
        if form == 3:
            raise ProviderError("the provider is down")
        return {
            0: f"Here it is:\n```json\n{json.dumps({'concepts': [item]})}\n```\n",
            1: json.dumps([item, {**item, "suggested_tags": [word]}]),
            2: '{"not_concepts": []}',
            4: "I can't find any.",
            5: json.dumps({"concepts": [{**item, "title": 1}]}),
            6: '```\n{"concepts": []}\n```',
        }[form]

    return call


register_extractor("outline", outline)
register_embedding("hashed-words", "crc-64", hashed_words)


def keyword_or_python(provider: str, model: str | None = None, lenient: bool = False) -> Callable[[Column], Column]:
    """The embedding of a provider: ``keywords`` is made of columns, the others run in Python."""
    from .vectors import keyword_embedding

    return keyword_embedding if provider == "keywords" else embedding(provider, model, lenient)


def collection_of(provider: str, model: str | None = None) -> tuple[str, str, str]:
    """(collection, provider, model) with the provider's default model where none is given; an unknown provider is an error."""
    from .vectors import DEFAULT_MODELS

    known = {**DEFAULT_MODELS, **{n: d for n, (d, _) in EMBEDDINGS.items()}}
    if provider not in known:
        raise ValueError(f"unknown embedding provider: {provider}")
    model = model or known[provider]
    part = lambda x: "_".join("".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split()) or "default"
    return f"{T.COLLECTION}{part(provider)}__{part(model)}", provider, model
