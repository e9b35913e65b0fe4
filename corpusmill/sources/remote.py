"""Files on web hosts: ranges, row groups, samples of lines, blobs, and a plan of what a cache keeps.

Readers run inside tasks, a row of a DataFrame naming what to read, so a list of files is read
by all executors.
"""

from __future__ import annotations

import heapq
import io
import random
import time
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from hashlib import sha1

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest row group that is read, in bytes, uncompressed.
GROUP_BYTES = 512 << 20


class Ranges(io.RawIOBase):
    """A seekable file over HTTP ranges: whole chunks, fetched by a few threads, the last used kept.

    budget bounds the bytes fetched over the file's life. A failed request is tried again, with
    growing pauses; a server that ignores ranges, or a file that changes its size, is an error.
    """

    def __init__(self, url: str, chunk: int = 1 << 20, keep: int = 32, budget: int = 4 << 30, threads: int = 4, tries: int = 3, pause: float = 0.2) -> None:
        self.url, self.chunk, self.keep, self.budget, self.tries, self.pause = url, chunk, keep, budget, tries, pause
        self.fetched, self.place = 0, 0
        self.held: OrderedDict[int, bytes] = OrderedDict()
        self.pool = ThreadPoolExecutor(threads)
        self.size = self._request(0, 1)[1]

    def _request(self, begin: int, end: int) -> tuple[bytes, int]:
        """The bytes of a range, and the size of the whole file."""
        for attempt in range(self.tries):
            try:
                asked = urllib.request.Request(self.url, headers={"Range": f"bytes={begin}-{end - 1}"})  # noqa: S310
                with urllib.request.urlopen(asked, timeout=60) as answer:  # noqa: S310
                    if answer.status != 206:
                        raise ValueError(f"{self.url}: the server doesn't give ranges")
                    return answer.read(), int(answer.headers["Content-Range"].rsplit("/", 1)[1])
            except OSError:
                if attempt + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2**attempt)
        raise AssertionError

    def _load(self, wanted: list[int]) -> None:
        missing = [k for k in wanted if k not in self.held]
        spans = [(k * self.chunk, min(self.size, (k + 1) * self.chunk)) for k in missing]
        self.fetched += sum(b - a for a, b in spans)
        if self.fetched > self.budget:
            raise OSError(f"{self.url}: more than {self.budget} bytes")
        for k, (a, b), (data, size) in zip(missing, spans, self.pool.map(lambda s: self._request(*s), spans), strict=True):
            if size != self.size or len(data) != b - a:
                raise ValueError(f"{self.url}: the file changed")
            self.held[k] = data

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.size}[whence])
        return self.place

    def readinto(self, buffer) -> int:
        data = self.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def read(self, size: int = -1) -> bytes:
        end = self.size if size is None or size < 0 else min(self.size, self.place + size)
        if end <= self.place:
            return b""
        wanted = list(range(self.place // self.chunk, -(-end // self.chunk)))
        self._load(wanted)
        out = b"".join(self.held[k] for k in wanted)[self.place - wanted[0] * self.chunk :][: end - self.place]
        for k in wanted:
            self.held.move_to_end(k)
        while len(self.held) > self.keep:
            self.held.popitem(last=False)
        self.place = end
        return out

    def close(self) -> None:
        self.pool.shutdown(wait=False)
        super().close()


def row_groups(spark: SparkSession, urls: list[str], most: int = GROUP_BYTES) -> DataFrame:
    """(url, row_group, rows, bytes) of Parquet files, read from their footers by tasks; a row group above `most` bytes is an error."""
    import pyarrow.parquet as pq

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for url in pdf["url"]:
                with Ranges(url) as f:
                    meta = pq.ParquetFile(f).metadata
                    out += [(url, g, meta.row_group(g).num_rows, meta.row_group(g).total_byte_size) for g in range(meta.num_row_groups)]
            yield pd.DataFrame(out, columns=["url", "row_group", "rows", "bytes"])

    listed = spark.createDataFrame([(u,) for u in urls], "url string").repartition(max(1, len(urls)))
    return listed.mapInPandas(on, "url string, row_group int, rows long, bytes long").withColumn("bytes", guarded(F.col("bytes"), most))


def guarded(size: Column, most: int = GROUP_BYTES) -> Column:
    """The size of a row group; an error where it is above the most that a task may hold."""
    return F.when(size > most, F.raise_error(F.concat(F.lit("a row group of "), size.cast("string"), F.lit(f" bytes; the most is {most}"))).cast("long")).otherwise(size)


def remote_rows(groups: DataFrame, columns: str, seed: int, skip: int = 0) -> DataFrame:
    """The columns (DDL) of all rows of row groups, with `origin` (file:rgN:rowM), in a seeded order by `place`; the first `skip` places are left out.

    Only these columns are fetched. The order depends on seed and origin alone, so a later read
    may skip what an earlier one took.
    """
    from corpusmill.operators.windows import numbered

    spark = groups.sparkSession
    names = spark.createDataFrame([], columns).columns

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for pdf in frames:
            for url, g in zip(pdf["url"], pdf["row_group"], strict=True):
                with Ranges(url) as f:
                    rows = pq.ParquetFile(f).read_row_group(g, columns=names).to_pandas()
                rows["origin"] = [f"{url.rsplit('/', 1)[-1]}:rg{g}:row{k}" for k in range(len(rows))]
                yield rows

    rows = groups.repartition("url", "row_group").mapInPandas(on, f"{columns}, origin string")
    return numbered(rows.withColumn("_s", F.xxhash64(F.lit(seed), "origin")), ["_s", "origin"], "place").drop("_s").filter(F.col("place") >= skip)


def sampled_lines(urls: DataFrame, k: int, seed: int | None = None) -> DataFrame:
    """(url, at, line): the first k lines of every URL, or with a seed k lines each equally likely, in file order.

    A file is streamed once; no more than k lines of it are held.
    """

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out: list[tuple[str, int, str]] = []
            for url in pdf["url"]:
                with Ranges(url) as f, io.BufferedReader(f, 1 << 20) as lines:
                    if seed is None:
                        own = [(n, line) for n, line in zip(range(k), lines, strict=False)]
                    else:
                        rng = random.Random(f"{seed}:{url}")
                        own = heapq.nsmallest(k, ((rng.random(), n, line) for n, line in enumerate(lines)))
                        own = sorted((n, line) for _, n, line in own)
                out += [(url, n, line.decode("utf-8", "replace").rstrip("\r\n")) for n, line in own]
            yield pd.DataFrame(out, columns=["url", "at", "line"])

    return urls.select("url").repartition("url").mapInPandas(on, "url string, at long, line string")


def fetched(rows: DataFrame, fetch: Callable[[str], bytes] | None = None) -> DataFrame:
    """(url, content, fault) of url and sha1: content is null and fault says why where it is missing or has another hash."""

    def over_http(url: str) -> bytes:
        with Ranges(url) as f:
            return f.read()

    get = fetch or over_http

    def on(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for url, want in zip(pdf["url"], pdf["sha1"], strict=True):
                try:
                    data = get(url)
                    ok = sha1(data).hexdigest() == want  # noqa: S324
                    out.append((url, data if ok else None, None if ok else "hash_differs"))
                except (OSError, ValueError):
                    out.append((url, None, "missing"))
            yield pd.DataFrame(out, columns=["url", "content", "fault"], dtype=object)

    return rows.select("url", "sha1").mapInPandas(on, "url string, content binary, fault string")


def cache_plan(entries: DataFrame, budget: int, key: str = "sha256", size: str = "bytes", used: str = "used_at", pinned: str = "pinned") -> DataFrame:
    """entries with `kept`: pinned ones, then the last used, as long as they fit into the budget together.

    Pinned entries are kept whatever they hold. Ties in use go by key; once one entry doesn't
    fit, all that were used before it go.
    """
    from corpusmill.operators.windows import running

    order = entries.withColumn("_free", ~F.coalesce(F.col(pinned), F.lit(False))).withColumn("_age", -F.coalesce(F.col(used).cast("double"), F.lit(0.0)))
    total = running(order, size, ["_free", "_age", key])
    return total.withColumn("kept", ~F.col("_free") | (F.col("cum") <= budget)).select(*entries.columns, "kept")
