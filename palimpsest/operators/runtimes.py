"""Model runtimes: stand-ins, local models, chat servers and batch files, and their use on DataFrames.

A provider names a runtime: ``stub_letter`` and ``stub_judge``; ``local:module:function``;
``chat:url#model`` for a server of the chat-completions form; ``serve:name`` for one that
is started here, with the command of ``SERVED_<name>``.  ``flaky:n:provider`` fails on every
n-th talk, by a hash, and is the named provider otherwise; it stands in for a busy server.

A worker process keeps its runtimes: a local model is loaded once a worker, not once a
task, and a started server is one a machine (``served``), shared by all its workers.
"""

from __future__ import annotations

import atexit
import hashlib
import importlib
import json
import os
import random
import re
import shlex
import subprocess
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import served
from palimpsest.operators.stitching import byte_bins

#: Limits of a hosted batch file: rows and bytes.
BATCH_ROWS, BATCH_BYTES = 50_000, 190 << 20
#: Calls of one worker that wait for a server side by side.
SIDE_BY_SIDE = 8
#: Talks that a worker holds as objects at once.
TALKS_TOGETHER = 256


@dataclass(frozen=True)
class Answer:
    """What a model said, and how many tokens were read and said where it tells."""

    said: str
    read_tokens: int = 0
    said_tokens: int = 0


class Runtime(Protocol):
    """``answers`` takes message lists and gives an answer for each, in order."""

    def answers(self, talks: Sequence[list[dict]]) -> list[Answer]: ...

    def close(self) -> None: ...


class StubRuntime:
    """Answers by a function of the last message; for tests and offline runs."""

    def __init__(self, answer: Callable[[str], str]):
        self.answer = answer

    def answers(self, talks: Sequence[list[dict]]) -> list[Answer]:
        return [Answer(self.answer(t[-1]["content"])) for t in talks]

    def close(self) -> None:
        return None


class LocalModel:
    """A function in this process that completes talks, called with a bounded number at once."""

    def __init__(self, place: str, most: int = 32):
        module, _, name = place.partition(":")
        self.complete, self.most = getattr(importlib.import_module(module), name), most

    def answers(self, talks: Sequence[list[dict]]) -> list[Answer]:
        said: list[str] = []
        for at in range(0, len(talks), self.most):
            some = list(talks[at : at + self.most])
            out = self.complete(some)
            if len(out) != len(some):
                raise ValueError(f"{len(out)} answers to {len(some)} talks")
            said += out
        return [Answer(s) for s in said]

    def close(self) -> None:
        close = getattr(self.complete, "close", None)
        if close:
            close()


class ServerBusy(RuntimeError):
    """A server asks to be called again; ``retry_after`` seconds from now, if it says so."""

    def __init__(self, code: int, retry_after: float | None):
        super().__init__(f"the server answered {code}")
        self.retry_after = retry_after


def credential(name: str) -> str:
    """A secret from the environment variable, or from the file that ``<name>_FILE`` names."""
    if value := os.environ.get(name):
        return value
    path = os.environ.get(f"{name}_FILE")
    if not path:
        raise ValueError(f"neither {name} nor {name}_FILE is set")
    with open(path) as secret:
        return secret.read().strip()


class ChatServer:
    """A chat-completions server over HTTP; several calls wait side by side, each with its own backoff."""

    def __init__(self, url: str, model: str, key_name: str | None = None, options: dict | None = None, timeout: float = 600.0):
        self.url, self.model, self.options, self.timeout = url.rstrip("/"), model, options or {}, timeout
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {credential(key_name)}"} if key_name else {})
        self.pool = ThreadPoolExecutor(SIDE_BY_SIDE)

    def _call(self, talk: list[dict]) -> Answer:
        body = json.dumps({"model": self.model, "messages": talk, **self.options}).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{self.url}/v1/chat/completions", body, self.headers), timeout=self.timeout) as reply:
                found = json.load(reply)
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                wait = e.headers.get("Retry-After")
                raise ServerBusy(e.code, float(wait) if wait else None) from e
            raise ValueError(f"the server refused the request: {e.code} {e.read()[:500].decode(errors='replace')}") from e
        counts = found.get("usage") or {}
        return Answer(found["choices"][0]["message"]["content"] or "", counts.get("prompt_tokens", 0), counts.get("completion_tokens", 0))

    def answers(self, talks: Sequence[list[dict]]) -> list[Answer]:
        return [raised(a) for a in self.each(talks)]

    def each(self, talks: Sequence[list[dict]]) -> list[Answer | Exception]:
        """An answer or the last failure for each talk; one that fails costs the others nothing."""
        return list(self.pool.map(lambda t: caught(lambda: with_backoff(lambda: self._call(t))), talks))

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)


class ServedModel:
    """A chat server started as a process of its own, used when it is ready, and stopped at the end."""

    def __init__(self, command: Sequence[str], url: str, model: str, patience: float = 600.0, health: str = "/health"):
        self.process = subprocess.Popen(list(command), stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
        end = time.monotonic() + patience
        while True:
            try:
                with urllib.request.urlopen(url.rstrip("/") + health, timeout=5):
                    break
            except OSError as e:
                if self.process.poll() is not None or time.monotonic() > end:
                    self._stop()
                    raise RuntimeError(f"the server did not get ready: {' '.join(command)}") from e
                time.sleep(0.2)
        self.server = ChatServer(url, model)

    def answers(self, talks: Sequence[list[dict]]) -> list[Answer]:
        return self.server.answers(talks)

    def _stop(self) -> None:
        self.process.terminate()
        try:
            self.process.wait(10)
        except subprocess.TimeoutExpired:
            self.process.kill()

    def close(self) -> None:
        self.server.close()
        self._stop()


class SharedServer:
    """The machine's chat server of a name, started by whichever worker needs it first."""

    def __init__(self, name: str, command: Sequence[str], url: str, model: str, patience: float = 600.0, health: str = "/health", linger: float = served.LINGER):
        self.name, self.command = name, list(command)
        self.server = ChatServer(served.acquire(name, url, self.command, patience, health, linger), model)

    def answers(self, talks: Sequence[list[dict]]) -> list[Answer]:
        return self.server.answers(talks)

    def each(self, talks: Sequence[list[dict]]) -> list[Answer | Exception]:
        return self.server.each(talks)

    def close(self) -> None:
        self.server.close()
        served.release(self.name, self.command)


class FlakyRuntime:
    """Another runtime, but the talks whose last message's hash falls on 0 of n fail."""

    def __init__(self, inner: Runtime, n: int):
        self.inner, self.n = inner, n

    def answers(self, talks: Sequence[list[dict]]) -> list[Answer]:
        for t in talks:
            if int(hashlib.md5(t[-1]["content"].encode()).hexdigest()[:8], 16) % self.n == 0:
                raise ValueError("the server is busy")
        return self.inner.answers(talks)

    def close(self) -> None:
        self.inner.close()


def echo_letter(prompt: str) -> str:
    return "A" if len(prompt) % 2 else "B"


def yes_if_long(prompt: str) -> str:
    return "YES" if len(prompt) > 400 else "NO"


def first_new_word(prompt: str) -> str:
    """A stand-in extractor: the turn's first word of seven letters or more that is not known yet."""
    known, _, rest = prompt.partition("\n\nAssistant:\n")
    turn = rest.rpartition("\n\nUser:\n")[2]
    have = {line.partition(". ")[2] for line in known.splitlines()}
    new = next((w for w in re.findall("[A-Za-z]{7,}", turn) if w not in have), None)
    return json.dumps({"scs": [{"text": new, "evidence": "turn"}] if new else []})


def end_of(prompt: str) -> str:
    """A stand-in summariser: how long the prompt is, and its last words."""
    return f"{len(prompt)} characters, ending in {' '.join(prompt.split()[-12:])}"


PROVIDERS: dict[str, Callable[[], Runtime]] = {"stub_letter": lambda: StubRuntime(echo_letter), "stub_judge": lambda: StubRuntime(yes_if_long), "stub_extractor": lambda: StubRuntime(first_new_word), "stub_summary": lambda: StubRuntime(end_of)}


def runtime(provider: str, options: dict | None = None) -> Runtime:
    """The runtime of a provider; a server's key is read from the variable ``CHAT_KEY_NAME`` names, if any."""
    if provider in PROVIDERS:
        return PROVIDERS[provider]()
    kind, _, rest = provider.partition(":")
    if kind == "local":
        return LocalModel(rest)
    if kind == "flaky":
        n, _, inner = rest.partition(":")
        return FlakyRuntime(runtime(inner, options), int(n))
    if kind == "chat":
        url, _, model = rest.partition("#")
        return ChatServer(url, model, os.environ.get("CHAT_KEY_NAME"), options)
    if kind == "serve":
        # SERVED_<name>: url, model and command, parted by white space; {port} stands for a free port
        url, model, *command = shlex.split(credential(f"SERVED_{rest}"))
        return SharedServer(rest, command, url, model, linger=float(os.environ.get("SERVED_LINGER", served.LINGER)))
    raise ValueError(f"no runtime {provider}; there are {', '.join(sorted(PROVIDERS))}, local:, chat:, serve: and flaky:")


_KEPT: dict[tuple[str, str], Runtime] = {}


def kept_runtime(provider: str, options: dict | None = None) -> Runtime:
    """This process's runtime of a provider, made at its first use and closed when the process ends."""
    key = provider, json.dumps(options or {}, sort_keys=True)
    if key not in _KEPT:
        _KEPT[key] = runtime(provider, options)
        atexit.register(_KEPT[key].close)
    return _KEPT[key]


def forget_runtime(provider: str, options: dict | None = None) -> None:
    """Close and drop a kept runtime, such as one whose server has gone."""
    if found := _KEPT.pop((provider, json.dumps(options or {}, sort_keys=True)), None):
        atexit.unregister(found.close)
        found.close()


def caught(call: Callable[[], Answer]) -> Answer | Exception:
    try:
        return call()
    except Exception as e:
        return e


def raised(found: Answer | Exception) -> Answer:
    if isinstance(found, Exception):
        raise found
    return found


def tried(model: Runtime, talks: Sequence[list[dict]]) -> list[Answer | Exception]:
    """An answer or a failure for each talk; no good answer is asked for twice.

    A runtime with ``each`` tells them apart itself.  Any other answers a batch or fails as a
    whole; then nothing of it has been answered, and its halves are tried, down to single talks.
    """
    each = getattr(model, "each", None)
    if each is not None:
        return each(talks)
    try:
        found = model.answers(talks)
        if len(found) != len(talks):
            raise ValueError(f"{len(found)} answers to {len(talks)} talks")
        return list(found)
    except Exception:
        if len(talks) == 1:
            return [caught(lambda: with_backoff(lambda: model.answers(talks), 3, 0.0)[0])]
        middle = len(talks) // 2
        return tried(model, talks[:middle]) + tried(model, talks[middle:])


def with_backoff(call: Callable[[], object], attempts: int = 6, cap: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Repeat a call that fails, after the server's hint or twice the last pause, at most ``cap`` seconds.

    A refusal (``ValueError``) will not change and is not tried again.
    """
    for i in range(attempts):
        try:
            return call()
        except ValueError:
            raise
        except Exception as e:
            if i == attempts - 1:
                raise
            sleep(min(cap, getattr(e, "retry_after", None) or 2.0**i))
    raise ValueError("at least one attempt is needed")


def generated(df: DataFrame, provider: str, messages: str, id_cols: Sequence[str], partitions: int | None = None, options: dict | None = None) -> DataFrame:
    """``id_cols, output, status, error``: one model for each worker, called by batches.

    A talk that fails is an error row, and only what failed is tried again.  Talks are
    Python objects by ``TALKS_TOGETHER`` at most, so a worker's memory has that bound.
    ``partitions`` sets how many workers call side by side; ``options`` go to the server.
    """
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in id_cols)
    ids = list(id_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, TALKS_TOGETHER) for whole in batches for at in range(0, whole.num_rows, TALKS_TOGETHER)):
            talks = batch.column(messages).to_pylist()
            found = tried(kept_runtime(provider, options), talks)
            if all(isinstance(a, OSError) for a in found):  # the server has gone: reach it, or start it, anew
                forget_runtime(provider, options)
                found = tried(kept_runtime(provider, options), talks)
            rows = [(None, "error", str(a)) if isinstance(a, Exception) else (a.said, "success", None) for a in found]
            columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ids], *columns], [*ids, "output", "status", "error"])

    spread = df if partitions is None else df.repartition(partitions, *ids)
    return spread.select(*ids, messages).mapInArrow(run, f"{fields}, output string, status string, error string")


def seeded(seed: int | None = None) -> random.Random:
    """A generator of its own; the environment's ``GLOBAL_SEED`` counts where none is given."""
    return random.Random(int(os.environ.get("GLOBAL_SEED", "42")) if seed is None else seed)


def write_batch_files(requests: DataFrame, path: str, model: str, messages: str = "messages", key: str = "custom_id", most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """Requests as JSON lines below ``<path>/bin=<n>``, each bin within a hosted service's limits; ``key, bin``.

    ``key`` is a whole number; bins hold neighbouring keys.  Each folder is one upload.
    """
    body = F.struct(F.lit(model).alias("model"), F.col(messages).alias("messages"))
    line = F.to_json(F.struct(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body")))
    lines = requests.select(F.col(key).alias("id"), line.alias("value"))
    bins = byte_bins(lines.withColumn("size", F.octet_length("value") + 1), most_rows, most_bytes, "id", "size")
    lines.join(bins, "id").select("bin", "value").repartition("bin").sortWithinPartitions("bin").write.mode("overwrite").partitionBy("bin").text(path)
    return bins.withColumnRenamed("id", key)


#: Fixed value: the fields of a hosted batch's result lines that are read.
_RESULT = "struct<custom_id: string, response: struct<status_code: int, body: struct<choices: array<struct<message: struct<content: string>>>>>, error: struct<message: string>>"


def read_batch_files(spark: SparkSession, path: str, key: str = "custom_id") -> DataFrame:
    """``key, output, error`` of result lines; a line that is not JSON stops the job."""
    r = F.from_json("value", _RESULT, {"mode": "FAILFAST"})
    body = F.col("r.response.body.choices")
    bad = F.when(F.col("r.response.status_code") >= 400, F.concat(F.lit("status "), F.col("r.response.status_code").cast("string")))
    rows = spark.read.text(path).filter(F.trim("value") != "").select(r.alias("r"))
    return rows.select(F.col("r.custom_id").cast("long").alias(key), F.get(body, F.lit(0))["message"]["content"].alias("output"), F.coalesce(F.col("r.error.message"), bad).alias("error"))


def batch_results(requests: DataFrame, results: DataFrame, key: str = "custom_id") -> DataFrame:
    """Requests with the outputs of a hosted batch job; one that is missing or failed has status ``error``."""
    joined = requests.join(results, key, "left")
    return joined.withColumn("status", F.when(F.col("output").isNull(), "error").otherwise("success"))
