"""Model runtimes against a local test server, batch files, and tables whose writing breaks off."""

import json
import sys
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from palimpsest.functions.messages import MESSAGES
from palimpsest.operators import runtimes as U
from palimpsest.sources import writers

SEEN: dict = {}


class Chat(BaseHTTPRequestHandler):
    """Answers with the last message in capitals; ``busy`` once with 429, ``refuse`` always with 400."""

    def log_message(self, *args):
        return None

    def do_GET(self):
        self.send_response(200)
        self.end_headers()

    def do_POST(self):
        asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        said = asked["messages"][-1]["content"]
        SEEN.setdefault("keys", set()).add(self.headers.get("Authorization"))
        SEEN[said] = SEEN.get(said, 0) + 1
        code = 429 if "busy" in said and SEEN[said] == 1 else 400 if "refuse" in said else 200
        self.send_response(code)
        if code == 429:
            self.send_header("Retry-After", "0.05")
        self.end_headers()
        if code == 200:
            self.wfile.write(json.dumps({"choices": [{"message": {"content": said.upper()}}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}).encode())
        else:
            self.wfile.write(b"no")


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def talk(text):
    return [{"role": "user", "content": text}]


def test_chat_server_answers_in_order_and_waits_when_told(url, monkeypatch):
    monkeypatch.setenv("MY_KEY", "k1")
    server = U.ChatServer(url, "m", "MY_KEY")
    texts = [f"say {i}" for i in range(20)] + ["busy now"]
    assert [a.said for a in server.answers([talk(t) for t in texts])] == [t.upper() for t in texts]
    assert SEEN["busy now"] == 2 and "Bearer k1" in SEEN["keys"]
    with pytest.raises(ValueError, match="refused the request: 400"):
        server.answers([talk("refuse this")])
    assert SEEN["refuse this"] == 1  # a refusal is not tried again
    server.close()


def test_generated_through_a_server(spark, url):
    rows = [Row(i=i, messages=[Row(role="user", content=t)]) for i, t in enumerate(["one", "refuse two", "busy three"])]
    out = U.generated(spark.createDataFrame(rows, f"i int, messages {MESSAGES}"), f"chat:{url}#m", "messages", ["i"]).orderBy("i").collect()
    assert [(r.output, r.status) for r in out] == [("ONE", "success"), (None, "error"), ("BUSY THREE", "success")]
    assert "400" in out[1].error


def test_served_model_is_started_and_stopped(tmp_path):
    import socket

    with socket.socket() as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    script = tmp_path / "serve.py"
    script.write_text(f"import sys; sys.path.insert(0, {str(__file__.rsplit('/', 2)[0])!r})\nfrom http.server import ThreadingHTTPServer\nfrom tests.test_runtimes import Chat\nThreadingHTTPServer(('127.0.0.1', {port}), Chat).serve_forever()\n")
    model = U.ServedModel([sys.executable, str(script)], f"http://127.0.0.1:{port}", "m", patience=60)
    assert model.answers([talk("hi")])[0] == U.Answer("HI", 3, 1)
    model.close()
    assert model.process.poll() is not None
    with pytest.raises(RuntimeError, match="did not get ready"):
        U.ServedModel([sys.executable, "-c", "raise SystemExit(1)"], f"http://127.0.0.1:{port}", "m", patience=20)


def shout(talks):
    SEEN["most"] = max(SEEN.get("most", 0), len(talks))
    return [t[-1]["content"] + "!" for t in talks]


def test_local_model_is_called_in_bounded_batches():
    model = U.LocalModel("tests.test_runtimes:shout", 4)
    module = sys.modules["tests.test_runtimes"]
    assert [a.said for a in model.answers([talk(str(i)) for i in range(10)])] == [f"{i}!" for i in range(10)]
    assert module.SEEN["most"] == 4
    assert isinstance(U.runtime("local:tests.test_runtimes:shout"), U.LocalModel)
    with pytest.raises(ValueError, match="no runtime"):
        U.runtime("nothing")


def test_credentials(monkeypatch, tmp_path):
    monkeypatch.delenv("A_KEY", raising=False)
    with pytest.raises(ValueError, match="A_KEY_FILE"):
        U.credential("A_KEY")
    (tmp_path / "k").write_text("from file\n")
    monkeypatch.setenv("A_KEY_FILE", str(tmp_path / "k"))
    assert U.credential("A_KEY") == "from file"
    monkeypatch.setenv("A_KEY", "direct")
    assert U.credential("A_KEY") == "direct"


def test_batch_files_hold_limits_and_come_back(spark, tmp_path):
    rows = [Row(custom_id=i, messages=[Row(role="user", content="w" * (10 * i))]) for i in range(12)]
    requests = spark.createDataFrame(rows, f"custom_id long, messages {MESSAGES}")
    bins = U.write_batch_files(requests, f"{tmp_path}/in", "m", most_rows=5, most_bytes=600)
    lines = spark.read.text(f"{tmp_path}/in").select("value", "bin").collect()
    assert len(lines) == 12 and {json.loads(r.value)["custom_id"] for r in lines} == {str(i) for i in range(12)}
    for b in {r.bin for r in lines}:
        assert sum(r.bin == b for r in lines) <= 5 and sum(len(r.value) + 1 for r in lines if r.bin == b) <= 600
    assert {(r.custom_id, r.bin) for r in bins.collect()} == {(int(json.loads(r.value)["custom_id"]), r.bin) for r in lines}
    good = [json.dumps({"custom_id": str(i), "response": {"status_code": 200, "body": {"choices": [{"message": {"content": f"a{i}"}}]}}}) for i in range(10)]
    bad = [json.dumps({"custom_id": "10", "response": {"status_code": 500, "body": None}}), ""]
    spark.createDataFrame([(x,) for x in good + bad], "value string").coalesce(1).write.text(f"{tmp_path}/out")
    done = U.batch_results(requests.select("custom_id"), U.read_batch_files(spark, f"{tmp_path}/out")).orderBy("custom_id").collect()
    assert [(r.output, r.status) for r in done] == [(f"a{i}", "success") for i in range(10)] + [(None, "error")] * 2
    assert done[10].error == "status 500"


def test_a_write_that_breaks_off_leaves_a_whole_table(spark, tmp_path):
    path, one = f"{tmp_path}/t", spark.range(3).withColumnRenamed("id", "source_row_index")
    failing = one.select(F.when(F.col("source_row_index") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("source_row_index")).alias("source_row_index"))
    with pytest.raises(Exception, match="broken"):
        writers.write_dataset(failing, path, ("source_row_index",))
    assert not writers.complete(spark, path)
    assert writers.write_dataset(one, path, ("source_row_index",)).count() == 3  # the broken one is written anew
    with pytest.raises(Exception, match="broken"):
        writers.replace_table(failing, path)
    assert writers.recovered(spark, path) and spark.read.parquet(path).count() == 3
    # broken off between the two moves: the staged table is the new one
    spark.range(5).write.parquet(f"{path}__new")
    files, where = writers.file_system(spark, path)
    files.rename(where, writers.file_system(spark, f"{path}__old")[1])
    assert writers.recovered(spark, path) and spark.read.parquet(path).count() == 5
    assert not writers.exists(spark, f"{path}__old") and not writers.exists(spark, f"{path}__new")
    # a folder without the committer's mark is not a table
    files.delete(writers.file_system(spark, f"{path}/_SUCCESS")[1], False)
    assert not writers.recovered(spark, path)
