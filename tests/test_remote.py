"""Downloads, and models behind an HTTP endpoint on this machine."""

import http.server
import json
import threading
import zipfile

import numpy as np
import pytest

from sievebench import remote
from sievebench.operators import ranking as R
from sievebench.sources import download


class Endpoint(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Endpoint.seen.append((self.path, self.headers.get("Authorization")))
        if len(Endpoint.seen) == 1:
            self.send_response(503)
            self.end_headers()
            return
        if body["model"] == "wrong":
            self.send_response(404)
            self.end_headers()
            return
        if self.path.endswith("embeddings"):
            made = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]}
        else:
            made = {"choices": [{"message": {"content": " about " + body["messages"][1]["content"] + " "}}]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(made).encode())

    def log_message(self, *_):
        pass


def test_remote_models(spark, monkeypatch):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Endpoint)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/"
    embedder = remote.RemoteEmbedder(url, "m").bind(None, 0, 0)
    chat = remote.RemoteChat(url, "m", temperature=0).bind(None, embedder, 0, 0)
    rows = spark.createDataFrame([("a", "one"), ("b", "three")], "qid string, prompt string")
    got = {r["qid"]: (r["text"], r["vector"]) for r in chat.complete(rows).collect()}
    assert got == {"a": ("about one", [9.0, 1.0]), "b": ("about three", [11.0, 1.0])}
    assert Endpoint.seen[0][0] == "/v1/chat/completions" and chat.to_config()["temperature"] == 0
    assert embedder.encode(spark.createDataFrame([(None,)], "text string")).first()["vector"] is None
    with pytest.raises(Exception, match="404"):
        remote.RemoteChat(url, "wrong").bind(None, embedder, 0, 0).complete(rows).collect()
    server.shutdown()


def test_downloads(tmp_path):
    source = tmp_path / "x.zip"
    with zipfile.ZipFile(source, "w") as z:
        z.writestr("a/b.txt", "hello")
    digest = download.fetch(source.as_uri(), str(tmp_path / "raw" / "y.zip"))
    assert digest == download.digest_of(str(source)) == download.fetch("file:///nowhere", str(tmp_path / "raw" / "y.zip"), digest)
    assert download.extract(str(tmp_path / "raw" / "y.zip"), str(tmp_path / "out")) == ["a/b.txt"] and (tmp_path / "out" / "a" / "b.txt").read_text() == "hello"
    with pytest.raises(ValueError, match="digest"):
        download.fetch(source.as_uri(), str(tmp_path / "z.zip"), "0" * 64)
    assert not (tmp_path / "z.zip").exists()
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../../evil.txt", "x")
    with pytest.raises(ValueError, match="outside"):
        download.extract(str(tmp_path / "bad.zip"), str(tmp_path / "out"))


def test_resampled_means(spark):
    rng = np.random.default_rng(0)
    x = rng.random((40, 2))
    scores = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i long, one double, two double")
    got = R.resampled_means(scores, ["one", "two"], 300)
    assert got.shape == (300, 2) and np.allclose(got.mean(0), x.mean(0), atol=0.03) and np.allclose(got.std(0), x.std(0) / 40**0.5, rtol=0.3)
    assert R.resampled_means(scores.limit(0), ["one", "two"], 5).size == 0
