"""Text generators behind one interface: a chat endpoint over HTTP, and rules for tests.

A generator maps messages to a text or null. It runs inside tasks, over Arrow batches, with a thread pool of
its own for endpoints; failures are null texts with an error beside them, never exceptions.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.session import ship_package

Message = dict[str, str]


class Generator(Protocol):
    #: Calls that one task makes at a time.
    threads: int

    def chat(self, messages: Sequence[Message], row: int) -> str | None: ...


@dataclass
class RuleGenerator:
    """A function of the messages, for tests and dry runs."""

    rule: Callable[[Sequence[Message]], str | None]
    threads: int = 1

    def chat(self, messages: Sequence[Message], row: int) -> str | None:
        return self.rule(messages)


@dataclass
class HttpGenerator:
    """A chat-completions endpoint, or several: row r goes to address r modulo their number, attempts move on by one."""

    urls: Sequence[str]
    model: str
    key: str = ""
    temperature: float = 0.7
    top_p: float = 0.8
    max_tokens: int = 4096
    seconds: float = 120.0
    attempts: int = 3
    threads: int = 32
    extra: dict = field(default_factory=dict)

    def chat(self, messages: Sequence[Message], row: int) -> str | None:
        body = {"model": self.model, "messages": list(messages), "temperature": self.temperature, "top_p": self.top_p, "max_tokens": self.max_tokens, **self.extra}
        for attempt in range(self.attempts):
            url = self.urls[(row + attempt) % len(self.urls)].rstrip("/") + "/chat/completions"
            request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
            try:
                with urllib.request.urlopen(request, timeout=self.seconds) as response:
                    return json.load(response)["choices"][0]["message"]["content"]
            except Exception:
                if attempt + 1 < self.attempts:
                    time.sleep(2**attempt)
        return None


def _conversation(prompt: str | None, messages: list | None) -> list[Message]:
    return [dict(m) for m in messages or ()] + ([{"role": "user", "content": prompt}] if prompt is not None else [])


def generate(df: DataFrame, generator: Generator, prompt: str = "prompt", messages: str | None = None, name: str = "response") -> DataFrame:
    """``df`` with each row's answer and, where there is none, an error.

    ``prompt`` is a text column; ``messages`` an array<struct<role, content>> that comes before it. Order is
    the frame's own: rows carry their keys, so none is needed.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = batch.column(prompt).to_pylist()
            before = batch.column(messages).to_pylist() if messages else [None] * len(prompts)

            def one(i: int) -> tuple[str | None, str | None]:
                try:
                    answer = generator.chat(_conversation(prompts[i], before[i]), i)  # noqa: B023
                    return answer, None if answer is not None else "no answer"
                except Exception as e:
                    return None, str(e)[:300]

            if generator.threads > 1:
                with ThreadPoolExecutor(generator.threads) as pool:
                    out = list(pool.map(one, range(len(prompts))))
            else:
                out = [one(i) for i in range(len(prompts))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([a for a, _ in out], pa.string()), pa.array([e for _, e in out], pa.string())], names=[*batch.schema.names, name, f"{name}_error"]
            )

    ship_package(df.sparkSession)
    return df.mapInArrow(run, f"{kinds}, `{name}` string, `{name}_error` string")


def generate_with_retry(df: DataFrame, generator: Generator, key: str, retries: int = 3, accept=None, **columns: str) -> DataFrame:
    """Ask again for the rows without an acceptable answer (``accept``: a condition on the result), up to ``retries`` times.

    Every round's answers are kept, so a round asks only for what the rounds before left open.
    """
    name = columns.get("name", "response")
    accept = accept if accept is not None else F.col(name).isNotNull()
    left, done = df, None
    for i in range(retries):
        answered = generate(left, generator, **columns)
        answered = answered.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else answered.persist()
        final = i + 1 == retries
        good = answered if final else answered.where(F.coalesce(accept, F.lit(False)))
        done = good if done is None else done.unionByName(good)
        if final:
            break
        left = answered.where(~F.coalesce(accept, F.lit(False))).select(*df.columns)
        if left.isEmpty():
            break
    return done
