"""Batch files of a hosted service, sent in waves under a limit of tokens in flight, resumed from a log.

Requests without a result are written as files within the service's limits
(``runtimes.write_batch_files``), and each file goes through written, sending, sent and
read, or expired.  States are events of a log, so a driver that starts again goes on from
them: a file that was being sent is looked up at the service by its name before it is sent
again.  What a file that expired or failed leaves open is written anew in the next round,
together with the requests the service refused.  The driver handles files, never requests.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.messages import total_tokens
from palimpsest.operators.calls import PartedLog
from palimpsest.operators.runtimes import BATCH_BYTES, BATCH_ROWS, read_batch_files, write_batch_files

EVENTS = "seq int, name string, path string, tokens long, state string, service_id string"
RESULTS = "custom_id long, output string, error string, round int"
#: Tokens that a service takes at once, where it does not say.
TOKENS_IN_FLIGHT = 30_000_000


class BatchService(Protocol):
    """Where files are sent.  ``status`` is running, done, expired or failed; ``fetch`` writes result lines below a path."""

    def submit(self, path: str, name: str) -> str: ...

    def find(self, name: str) -> str | None: ...

    def status(self, service_id: str) -> str: ...

    def fetch(self, service_id: str, path: str) -> None: ...


@dataclass
class FileState:
    name: str
    path: str
    tokens: int
    state: str
    service_id: str | None


class BatchWaves:
    """The batch job below ``root``; requests are ``custom_id`` (a key) and ``messages``."""

    def __init__(self, spark: SparkSession, root: str, service: BatchService, model: str, most_tokens: int = TOKENS_IN_FLIGHT, most_rows: int = BATCH_ROWS, most_bytes: int = BATCH_BYTES):
        self.spark, self.root, self.service, self.model = spark, root, service, model
        self.most_tokens, self.most_rows, self.most_bytes = most_tokens, most_rows, most_bytes
        self.events, self.found = PartedLog(spark, f"{root}/events", EVENTS), PartedLog(spark, f"{root}/results", RESULTS)
        rows = self.events.read().orderBy("seq", "name").collect()  # a few rows a file
        self.seq = max((r.seq for r in rows), default=-1)
        self.files = {r.name: FileState(r.name, r.path, r.tokens, r.state, r.service_id) for r in rows}

    def _note(self, *files: FileState) -> None:
        """Append the files' states as one part, so they count together or not at all."""
        if not files:
            return
        self.seq += 1
        rows = [(self.seq, f.name, f.path, f.tokens, f.state, f.service_id) for f in files]
        self.events.append(self.spark.createDataFrame(rows, EVENTS), f"{self.seq:08d}")
        self.files.update({f.name: f for f in files})

    def _in(self, *states: str) -> list[FileState]:
        return sorted((f for f in self.files.values() if f.state in states), key=lambda f: f.name)

    def results(self, requests: DataFrame) -> DataFrame:
        """``custom_id, output, status, error``: one row a request, its good answer if there is one."""
        best = self.found.read().groupBy("custom_id").agg(F.max_by(F.struct("output", "error"), F.struct(F.col("output").isNotNull(), "round")).alias("b"))
        joined = requests.select("custom_id").join(best.select("custom_id", "b.*"), "custom_id", "left")
        return joined.withColumn("status", F.when(F.col("output").isNull(), "error").otherwise("success"))

    def plan(self, requests: DataFrame, number: int) -> int:
        """Write the files of a round for the requests without a good answer; how many there are."""
        good = self.found.read().filter("output is not null").select("custom_id")
        left = requests.join(good, "custom_id", "left_anti")
        if left.isEmpty():
            return 0
        path = f"{self.root}/files/round={number:04d}"
        bins = write_batch_files(left, path, self.model, most_rows=self.most_rows, most_bytes=self.most_bytes)
        sizes = left.select("custom_id", total_tokens(F.col("messages")).cast("long").alias("t")).join(bins, "custom_id").groupBy("bin").agg(F.sum("t").alias("t"))
        made = [FileState(f"round-{number:04d}-{r.bin:06d}", f"{path}/bin={r.bin}", r.t, "written", None) for r in sizes.orderBy("bin").collect()]  # a row a file
        self._note(*made)
        return len(made)

    def step(self) -> None:
        """Look at what runs, read what is done, and send what fits beside what still runs."""
        for f in self._in("sending"):  # the driver ended before it knew
            known = self.service.find(f.name)
            self._note(FileState(f.name, f.path, f.tokens, "sent" if known else "written", known))
        for f in self._in("sent"):
            status = self.service.status(f.service_id)
            if status == "done":
                into = f"{self.root}/answers/{f.name}"
                self.service.fetch(f.service_id, into)
                number = int(f.name.split("-")[1])
                self.found.append(read_batch_files(self.spark, into).withColumn("round", F.lit(number)), f.name)
                self._note(FileState(f.name, f.path, f.tokens, "read", f.service_id))
            elif status in ("expired", "failed"):
                self._note(FileState(f.name, f.path, f.tokens, "expired", f.service_id))
        flying = sum(f.tokens for f in self._in("sent"))
        for f in self._in("written"):
            if flying and flying + f.tokens > self.most_tokens:
                break  # files go in order; one larger than the limit goes alone
            self._note(FileState(f.name, f.path, f.tokens, "sending", None))
            self._note(FileState(f.name, f.path, f.tokens, "sent", self.service.submit(f.path, f.name)))
            flying += f.tokens

    def run(self, requests: DataFrame, rounds: int = 3, pause: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
        """Rounds until every request has a good answer, or ``rounds`` are through; gives ``results``."""
        number = max((int(name.split("-")[1]) for name in self.files), default=-1)
        while True:
            while self._in("written", "sending", "sent"):
                self.step()
                if self._in("sending", "sent"):
                    sleep(pause)
            number += 1
            if number >= rounds or not self.plan(requests, number):
                return self.results(requests)
