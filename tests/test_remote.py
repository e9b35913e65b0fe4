"""Remote sources against a server on this machine."""

import hashlib
import random
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corpusmill.sources import remote


@pytest.fixture(scope="module")
def host(tmp_path_factory):
    folder = tmp_path_factory.mktemp("www")
    pq.write_table(pa.table({"id": list(range(1000)), "text": [f"row {k}" for k in range(1000)], "other": ["x" * 50] * 1000}), folder / "a.parquet", row_group_size=300)
    (folder / "lines.txt").write_text("".join(f"line {k}\n" for k in range(5_000)))
    failures = {"left": 0}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            path = folder / self.path.lstrip("/")
            if failures["left"]:
                failures["left"] -= 1
                self.send_error(503)
                return
            if not path.exists():
                self.send_error(404)
                return
            data = path.read_bytes()
            a, b = (int(x) for x in self.headers["Range"].removeprefix("bytes=").split("-"))
            part = data[a : b + 1]
            self.send_response(206)
            self.send_header("Content-Range", f"bytes {a}-{a + len(part) - 1}/{len(data)}")
            self.send_header("Content-Length", str(len(part)))
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", folder, failures
    server.shutdown()


def test_ranges_read_as_the_file(host):
    url, folder, failures = host
    data = (folder / "a.parquet").read_bytes()
    rng = random.Random(1)
    with remote.Ranges(f"{url}/a.parquet", chunk=1000, keep=3, pause=0.01) as f:
        for _ in range(60):
            a, n = rng.randrange(len(data) + 50), rng.randrange(4000)
            f.seek(a)
            assert f.read(n) == data[a : a + n]
        assert len(f.held) <= 3
        failures["left"] = 2
        f.seek(-10, 2)
        f.held.clear()
        assert f.read() == data[-10:]
    with remote.Ranges(f"{url}/a.parquet", chunk=1000, budget=3000) as f, pytest.raises(OSError, match="more than"):
        f.read()


def test_remote_parquet(spark, host):
    url = host[0]
    groups = remote.row_groups(spark, [f"{url}/a.parquet"])
    assert sorted(r.rows for r in groups.collect()) == [100, 300, 300, 300]
    whole = remote.remote_rows(groups, "id long, text string", 7).orderBy("place").collect()
    assert sorted(r.id for r in whole) == list(range(1000)) and all(r.text == f"row {r.id}" for r in whole) and whole[0].id != 0
    assert {r.origin for r in whole} >= {"a.parquet:rg0:row0", "a.parquet:rg3:row99"}
    rest = remote.remote_rows(groups, "id long", 7, 400).orderBy("place").collect()
    assert [r.id for r in rest] == [r.id for r in whole[400:]]
    with pytest.raises(Exception, match="a row group of"):
        remote.row_groups(spark, [f"{url}/a.parquet"], 1000).collect()


def test_samples_of_lines(spark, host):
    urls = spark.createDataFrame([(f"{host[0]}/lines.txt",)], "url string")
    assert [r.line for r in remote.sampled_lines(urls, 3).collect()] == ["line 0", "line 1", "line 2"]
    got = remote.sampled_lines(urls, 200, 5).collect()
    assert len(got) == 200 and [r.at for r in got] == sorted(r.at for r in got) and all(r.line == f"line {r.at}" for r in got)
    assert 2000 < sum(r.at for r in got) / 200 < 3000 and len(remote.sampled_lines(urls, 9_999, 5).collect()) == 5_000


def test_blobs_are_checked(spark, host):
    url, folder, _ = host
    good = hashlib.sha1((folder / "lines.txt").read_bytes()).hexdigest()
    rows = spark.createDataFrame([(f"{url}/lines.txt", good), (f"{url}/a.parquet", good), (f"{url}/none", good)], "url string, sha1 string")
    got = {r.url.rsplit("/", 1)[1]: (r.content and len(r.content), r.fault) for r in remote.fetched(rows).collect()}
    assert got == {"lines.txt": ((folder / "lines.txt").stat().st_size, None), "a.parquet": (None, "hash_differs"), "none": (None, "missing")}


def test_cache_keeps_pinned_and_last_used(spark):
    rows = [("a", 50, 9, False), ("b", 50, 1, True), ("c", 60, 8, False), ("d", 10, 7, False), ("e", 10, None, None), ("f", None, 9, False)]
    df = spark.createDataFrame(rows, "sha256 string, bytes long, used_at long, pinned boolean")
    assert {r.sha256 for r in remote.cache_plan(df, 110).collect() if r.kept} == {"a", "b", "f"}
    assert {r.sha256 for r in remote.cache_plan(df, 0).collect() if r.kept} == {"b"}
