"""A source that is read by a cursor, against a server of this process: nothing is lost or repeated, over restarts too."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest

from opsloom.sources.pull import PullSource, _Api


@pytest.fixture
def api():
    rows = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
            after = q.get("after")
            found = sorted((r for r in rows if after is None or r["at"]["id"] > type(r["at"]["id"])(after)), key=lambda r: r["at"]["id"], reverse=q["order"] == "desc")
            body = json.dumps({"data": {"rows": found[: int(q["limit"])]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield rows, f"http://127.0.0.1:{server.server_port}/x"
    server.shutdown()


def test_batch_and_stream_over_restarts(spark, api, tmp_path):
    rows, url = api
    spark.dataSource.register(PullSource)
    options = {"url": url, "cursor": "at.id", "rows": "data.rows", "page": "4", "start": "0"}

    def add(*ids):
        rows.extend([{"at": {"id": i}, "n": n} for n, i in enumerate(ids, len(rows))])

    def run():
        spark.readStream.format("pull").options(**options).load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(once=True).start().awaitTermination()
        return sorted(json.loads(r.body)["n"] for r in spark.read.schema("cursor string, body string").parquet(f"{tmp_path}/out").collect())

    assert spark.read.format("pull").options(**options).load().count() == 0
    add(*range(1, 30), *[30] * 9, 31, 31)  # groups of one value across the ends of pages
    batch = spark.read.format("pull").options(**options).load().collect()
    assert sorted(json.loads(r.body)["n"] for r in batch) == list(range(40))
    assert run() == list(range(40))
    assert run() == list(range(40))
    add(*range(40, 53))
    assert run() == list(range(53))


def test_pages_of_texts(api):
    rows, url = api
    rows.extend({"at": {"id": f"2024-01-0{1 + i // 5}"}, "n": i} for i in range(17))
    a = _Api({"url": url, "cursor": "at.id", "rows": "data.rows", "page": "3"})
    assert [json.loads(b)["n"] for _, b in a.between(None, a.newest())] == list(range(17))
    assert [json.loads(b)["n"] for _, b in a.between("2024-01-01", "2024-01-02")] == list(range(5, 10))
    with pytest.raises(ValueError):
        _Api({"url": "file:///etc/passwd", "cursor": "id"})
