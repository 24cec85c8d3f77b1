"""A Spark data source over one remote ZIP archive, read by HTTP range requests.

``spark.read.format("remote_zip").option("url", ...)``: one row a member (name, size, content).
The central directory is read once by the driver; members are dealt to partitions in
order of their place, and each partition keeps its own connection and block cache. Large
reads bypass the cache. Requests are retried with capped exponential waits. A server
without range support is refused.
"""

from __future__ import annotations

import http.client
import io
import operator
import time
import urllib.error
import urllib.parse
import zipfile
from collections import OrderedDict
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith

BLOCK, CACHED_BLOCKS, DIRECT_BLOCKS, RETRIES, LONGEST_WAIT = 512 << 10, 16, 4, 4, 8.0


class RangeFile(io.RawIOBase):
    """A seekable file over HTTP ranges; counts requests and bytes."""

    def __init__(self, url: str, block: int = BLOCK, retries: int = RETRIES):
        self.url, self.block, self.retries, self.at = url, block, retries, 0
        self.requests = self.bytes_read = 0
        self.cache: OrderedDict[int, bytes] = OrderedDict()
        self.link: http.client.HTTPConnection | None = None
        status, headers, _ = self._get("bytes=0-0")
        if status != 206 or "/" not in (headers.get("Content-Range") or ""):
            raise OSError(f"no range support: {url}")
        self.size = int(headers["Content-Range"].rpartition("/")[2])

    def _get(self, span: str, hops: int = 5) -> tuple[int, http.client.HTTPMessage, bytes]:
        """Status, headers and body, over one connection that is kept; it is made anew where it broke."""
        for attempt in range(self.retries + 1):
            try:
                self.requests += 1
                parts = urllib.parse.urlsplit(self.url)
                if self.link is None:
                    kind = http.client.HTTPSConnection if parts.scheme == "https" else http.client.HTTPConnection
                    self.link = kind(parts.netloc, timeout=60)
                self.link.request("GET", urllib.parse.urlunsplit(("", "", parts.path or "/", parts.query, "")), headers={"Range": span})
                r = self.link.getresponse()
                if r.status == 200:  # the whole file: not read
                    self.close_link()
                    return r.status, r.headers, b""
                data = r.read()
                if r.status in (301, 302, 303, 307, 308) and hops and r.headers.get("Location"):
                    self.url = urllib.parse.urljoin(self.url, r.headers["Location"])
                    self.close_link()
                    return self._get(span, hops - 1)
                if r.status < 500:
                    if r.status >= 400:
                        raise urllib.error.HTTPError(self.url, r.status, r.reason, r.headers, None)
                    return r.status, r.headers, data
                raise ConnectionError(f"status {r.status}")
            except urllib.error.HTTPError:
                raise
            except (OSError, http.client.HTTPException):
                self.close_link()
                if attempt == self.retries:
                    raise
                time.sleep(min(LONGEST_WAIT, 0.25 * 2**attempt))
        raise AssertionError

    def close_link(self) -> None:
        if self.link is not None:
            self.link.close()
            self.link = None

    def _fetch(self, start: int, stop: int) -> bytes:
        _, _, data = self._get(f"bytes={start}-{stop - 1}")
        if len(data) != stop - start:
            raise OSError(f"{len(data)} bytes of {stop - start}: {self.url}")
        self.bytes_read += len(data)
        return data

    def _block(self, i: int) -> bytes:
        if i not in self.cache:
            self.cache[i] = self._fetch(i * self.block, min(self.size, (i + 1) * self.block))
            if len(self.cache) > CACHED_BLOCKS:
                self.cache.popitem(last=False)
        self.cache.move_to_end(i)
        return self.cache[i]

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        stop = self.size if n is None or n < 0 else min(self.size, self.at + n)
        if stop <= self.at:
            return b""
        if stop - self.at > DIRECT_BLOCKS * self.block:
            data = self._fetch(self.at, stop)
        else:
            first, last = self.at // self.block, (stop - 1) // self.block
            data = b"".join(self._block(i) for i in range(first, last + 1))[self.at - first * self.block :][: stop - self.at]
        self.at += len(data)
        return data

    def readinto(self, b) -> int:
        data = self.read(len(b))
        b[: len(data)] = data
        return len(data)


#: Filters that a directory entry answers.
TESTS = {
    EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le,
    In: lambda x, values: x in values, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v), StringContains: lambda x, v: v in x,
}


@dataclass
class Members(InputPartition):
    names: list[str]


class RemoteZipReader(DataSourceReader):
    """Filters on name and size are answered by the archive's directory: members that they exclude are never fetched."""

    def __init__(self, options: dict):
        self.tests: list = []
        self.url, self.block = options["url"], int(options.get("block", BLOCK))
        self.per = int(options.get("membersPerPartition", 64))
        self.prefix, self.suffix = options.get("prefix", ""), options.get("suffix", "")

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            test = TESTS.get(type(f))
            if test is not None and f.attribute in (("name",), ("size",)):
                self.tests.append((f.attribute[0], test, f.value))
            else:
                yield f

    def _wanted(self, info: zipfile.ZipInfo) -> bool:
        own = {"name": info.filename, "size": info.file_size}
        return not info.is_dir() and info.filename.startswith(self.prefix) and info.filename.endswith(self.suffix) and all(test(own[c], v) for c, test, v in self.tests)

    def partitions(self) -> list[Members]:
        with zipfile.ZipFile(RangeFile(self.url, self.block)) as z:
            found = sorted((i.header_offset, i.filename) for i in z.infolist() if self._wanted(i))
        names = [n for _, n in found]
        return [Members(names[i : i + self.per]) for i in range(0, len(names), self.per)] or [Members([])]

    def read(self, partition: Members):
        if not partition.names:
            return
        with zipfile.ZipFile(RangeFile(self.url, self.block)) as z:
            for name in partition.names:
                data = z.read(name)
                yield name, len(data), data


class RemoteZip(DataSource):
    @classmethod
    def name(cls) -> str:
        return "remote_zip"

    def schema(self) -> str:
        return "name string, size long, content binary"

    def reader(self, schema) -> RemoteZipReader:
        return RemoteZipReader(self.options)


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Registers data sources (this one by default) and lets them answer filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in sources or (RemoteZip,):
        spark.dataSource.register(source)
