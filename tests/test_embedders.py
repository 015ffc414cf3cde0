"""Embedders, the probe of an endpoint, and the re-embedding job."""

import json
import threading
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from episodica.functions.embedders import HashEmbedder, Health, HttpEmbedder, probed
from episodica.plans.reembed import ReembedJob
from episodica.sources.store import EpisodeStore

NOW = datetime(2024, 6, 1, tzinfo=UTC)


@pytest.fixture
def endpoint():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            reply = {"bad": (500, b"no"), "junk": (200, b"{"), "none": (200, b'{"data": []}')}.get(body["input"], (200, b'{"data": [{"embedding": [1, 2]}]}'))
            self.send_response(reply[0])
            self.end_headers()
            self.wfile.write(reply[1])

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", seen
    server.shutdown()


def test_http_embedder(endpoint):
    url, seen = endpoint
    e = HttpEmbedder(url, "m", token="t")
    assert e.generate("x") == [1.0, 2.0]
    assert seen == [("/v1/embeddings", "Bearer t", {"model": "m", "input": "x"})]
    for text in ("bad", "junk", "none"):
        with pytest.raises(Exception):
            e.generate(text)


class Failing:
    model = "m"

    def generate(self, text):
        raise OSError("down")


def test_probe():
    first = probed(Failing(), 4)
    assert (first.state, first.failures, first.error) == ("degraded", 1, "down")
    assert probed(HashEmbedder(dim=5), 4, first).failures == 2
    assert probed(HashEmbedder(dim=4), 4, first).state == "ok" and Health().state == "unknown"


def test_job(spark, tmp_path):
    store = EpisodeStore(spark, f"file://{tmp_path}/store", dim=4)
    store.append(spark.createDataFrame([("a", "one", "test"), ("b", "two", "test")], "id string, content string, source string"), NOW)
    job = ReembedJob(store, HashEmbedder("m", 4), 4)
    assert not job.status().running
    assert job.start(NOW).running
    with pytest.raises(RuntimeError):
        job.start(NOW)
    end = job.wait(120)
    assert (end.running, end.total, end.done, end.failed, end.error) == (False, 2, 2, 0, "") and end.finished >= end.started
    assert job.start(NOW, force=True).force and job.wait(120).done == 2
    with pytest.raises(ValueError):
        ReembedJob(store, HashEmbedder("m", 5), 4).start(NOW)
    with pytest.raises(OSError):
        ReembedJob(store, Failing(), 4).start(NOW)
