"""Batch files in waves against a local stand-in of a hosted service."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.messages import MESSAGES
from palimpsest.operators.waves import BatchWaves


class Service:
    """Answers in capitals after one look; a named file expires once, ``refuse`` fails in the first round only."""

    def __init__(self, expires=()):
        self.jobs, self.asked, self.expires, self.most_flying = {}, [], set(expires), 0

    def submit(self, path, name):
        lines = [json.loads(x) for p in glob.glob(f"{path}/*.txt") for x in open(p)]
        assert name not in self.jobs and lines
        self.asked += [int(x["custom_id"]) for x in lines]
        self.jobs[name] = {"lines": lines, "looks": 0, "state": "running"}
        self.most_flying = max(self.most_flying, sum(j["state"] == "running" for j in self.jobs.values()))
        return f"id-{name}"

    def find(self, name):
        return f"id-{name}" if name in self.jobs else None

    def status(self, service_id):
        job, name = self.jobs[service_id[3:]], service_id[3:]
        job["looks"] += 1
        if job["looks"] > 1:
            job["state"] = "expired" if name in self.expires else "done"
        return job["state"]

    def fetch(self, service_id, path):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/lines.txt", "w") as f:
            for x in self.jobs[service_id[3:]]["lines"]:
                said = x["body"]["messages"][-1]["content"]
                bad = "refuse" in said and "round-0000" in service_id
                body = {"choices": [] if bad else [{"message": {"content": said.upper()}}]}
                f.write(json.dumps({"custom_id": x["custom_id"], "response": {"status_code": 500 if bad else 200, "body": body}, "error": None}) + "\n")


@pytest.fixture(scope="module")
def requests(spark):
    rows = [(i, [("user", f"say {i}" if i != 5 else "refuse 5")]) for i in range(20)]
    return spark.createDataFrame(rows, f"custom_id long, messages {MESSAGES}").cache()


def test_every_request_ends_with_one_result(spark, tmp_path, requests):
    service = Service(expires={"round-0000-000001"})
    waves = BatchWaves(spark, str(tmp_path), service, "m", most_tokens=45, most_rows=4)
    out = waves.run(requests, pause=0, sleep=lambda _: None).orderBy("custom_id").collect()
    assert [(r.custom_id, r.output, r.status) for r in out] == [(i, f"SAY {i}" if i != 5 else "REFUSE 5", "success") for i in range(20)]
    expired = sorted(int(x["custom_id"]) for x in service.jobs["round-0000-000001"]["lines"])
    assert sorted(service.asked) == sorted([*range(20), *{*expired, 5}])  # nothing that was answered is sent again
    assert service.most_flying == 2  # 20 tokens a file, 45 at most


def test_a_driver_that_ends_anywhere_goes_on(spark, tmp_path, requests):
    class Stop(Exception):
        pass

    class Breaking(Service):
        breaks = 0

        def submit(self, path, name):
            done = super().submit(path, name)
            if name.endswith("1") and not Breaking.breaks:
                Breaking.breaks = 1
                raise Stop  # sent, but the driver never hears of it
            return done

    service, few = Breaking(), requests.filter("custom_id < 9 and custom_id <> 5")
    make = lambda: BatchWaves(spark, str(tmp_path), service, "m", most_rows=4)
    with pytest.raises(Stop):
        make().run(few, pause=0, sleep=lambda _: None)
    again = make()
    assert [f.state for f in again.files.values()] == ["sent", "sending"]
    again.step()
    out = make().run(few, pause=0, sleep=lambda _: None)
    assert out.filter("status = 'success'").count() == 8 and sorted(service.asked) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert make().run(few).count() == 8 and len(service.asked) == 8


def test_rounds_end_with_errors_left(spark, tmp_path, requests):
    service = Service(expires={f"round-{i:04d}-000000" for i in range(2)})
    out = BatchWaves(spark, str(tmp_path), service, "m").run(requests.filter("custom_id < 3"), rounds=2, pause=0, sleep=lambda _: None)
    assert out.filter("status = 'error' and output is null").count() == 3 and len(service.asked) == 6
    assert BatchWaves(spark, f"{tmp_path}/none", service, "m").run(requests.filter(F.lit(False))).count() == 0
