"""Byte ranges of local files and of objects behind HTTP."""

from __future__ import annotations

import json
import re
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from urllib.parse import urljoin, urlsplit

from pyarrow import fs


def checked(start: int, end: int, size: int) -> tuple[int, int]:
    """A half-open range inside 0..size, or ValueError."""
    if any(not isinstance(v, int) or isinstance(v, bool) for v in (start, end)):
        raise ValueError("a range has whole bounds")
    if not 0 <= start <= end <= size:
        raise ValueError(f"range [{start}, {end}) isn't inside 0..{size}")
    return start, end


def clean_headers(headers: dict | None) -> dict[str, str] | None:
    """Request headers as strings, without nulls; None if none is left."""
    return {str(k): str(v) for k, v in (headers or {}).items() if v is not None} or None


def total_of(content_range: str | None) -> int | None:
    m = re.fullmatch(r"bytes\s+\d+-\d+/(\d+)", (content_range or "").strip(), re.IGNORECASE)
    return int(m[1]) if m else None


def name_of(url: str, fallback: str = "remote-source") -> str:
    parts = [p for p in urlsplit(url).path.split("/") if p]
    return parts[-1] if parts else fallback


def store_of(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores: what pyarrow knows), and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:/", place):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", place))
    return fs.LocalFileSystem(), place


@dataclass(frozen=True)
class LocalBytes:
    """A file on a file system that driver and executors see, by path or URI."""

    path: str
    kind: str = "local"

    def size(self) -> int:
        store, path = store_of(self.path)
        info = store.get_file_info(path)
        if info.type != fs.FileType.File:
            raise FileNotFoundError(self.path)
        return info.size

    def read(self, start: int, end: int) -> bytes:
        checked(start, end, self.size())
        store, path = store_of(self.path)
        with store.open_input_file(path) as f:
            return f.read_at(end - start, start)

    def read_all(self) -> bytes:
        return self.read(0, self.size())


@dataclass(frozen=True)
class Part:
    """`count` ranges of a payload, each of `length` bytes and `step` apart from `start` on, one after another in a file."""

    path: str
    at: int
    start: int
    length: int
    step: int = 0
    count: int = 1

    def pieces(self, start: int, end: int) -> list[tuple[int, int, int]]:
        """Of a range of the payload what stands in this part: (place in the range, place in the file, bytes)."""
        step = self.step or self.length
        low = max(0, (start - self.start - self.length) // step + 1)
        out = []
        for i in range(low, self.count):
            a = self.start + i * step
            if a >= end:
                break
            b, c = max(a, start), min(a + self.length, end)
            if b < c:
                out.append((b - start, self.at + i * self.length + b - a, c - b))
        return out


@dataclass(frozen=True)
class PartBytes:
    """A payload in part files, as a manifest tells: where the file system can't write in place. What no part holds is zero."""

    path: str
    kind: str = "parts"
    known: tuple[int, tuple[Part, ...]] | None = field(default=None, repr=False, compare=False)

    def manifest(self) -> tuple[int, tuple[Part, ...]]:
        if self.known is None:
            m = json.loads(LocalBytes(self.path).read_all())
            folder = self.path.rpartition("/")[0]
            object.__setattr__(self, "known", (m["size"], tuple(Part(f"{folder}/{p[0]}", *p[1:]) for p in m["parts"])))
        return self.known

    def size(self) -> int:
        return self.manifest()[0]

    def read(self, start: int, end: int) -> bytes:
        size, parts = self.manifest()
        checked(start, end, size)
        out = bytearray(end - start)
        for part in parts:
            for place, at, n in part.pieces(start, end):
                out[place : place + n] = LocalBytes(part.path).read(at, at + n)
        return bytes(out)

    def read_all(self) -> bytes:
        return self.read(0, self.size())


@dataclass(frozen=True)
class HttpBytes:
    """An object read by Range requests. A reply that isn't partial is an error, so a server without ranges can't send the whole object for each task."""

    url: str
    headers: dict[str, str] = field(default_factory=dict)
    known_size: int | None = None
    kind: str = "http"
    whole: bytes | None = field(default=None, repr=False, compare=False)

    def ask(self, method: str = "GET", **more: str):
        return urllib.request.urlopen(urllib.request.Request(self.url, headers=(clean_headers(self.headers) or {}) | more, method=method), timeout=60)

    def size(self) -> int:
        """By HEAD, else by the total of a one-byte range."""
        if self.known_size is not None:
            return self.known_size
        try:
            with self.ask("HEAD") as reply:
                if (length := reply.headers.get("Content-Length")) is not None:
                    return int(length)
        except urllib.error.URLError:
            pass
        with self.ask(Range="bytes=0-0") as reply:
            total = total_of(reply.headers.get("Content-Range"))
        if total is None:
            raise OSError(f"{self.url}: its size is unknown")
        return total

    def read(self, start: int, end: int) -> bytes:
        size = self.size()
        checked(start, end, size)
        if start == end:
            return b""
        if (start, end) == (0, size):
            return self.read_all()  # kept, so asked for once
        with self.ask(Range=f"bytes={start}-{end - 1}") as reply:
            if reply.status != 206:
                raise OSError(f"{self.url}: status {reply.status} for a range")
            if (total := total_of(reply.headers.get("Content-Range"))) is not None:
                object.__setattr__(self, "known_size", total)  # a size told before may be stale
            return reply.read()

    def read_all(self) -> bytes:
        """The whole object, asked for once; for headers and other small ones."""
        if self.whole is None:
            with self.ask() as reply:
                object.__setattr__(self, "whole", reply.read())
            object.__setattr__(self, "known_size", len(self.whole))
        return self.whole


Bytes = LocalBytes | PartBytes | HttpBytes


def open_bytes(place: str, headers: dict[str, str] | None = None) -> Bytes:
    if re.match(r"https?://", place):
        return HttpBytes(place, clean_headers(headers) or {})
    return PartBytes(place) if place.endswith(".parts") else LocalBytes(place)


def joined(ranges: list[tuple[int, int]], gap: int) -> list[list[int]]:
    """Indices of ranges in order of their start, in groups that one read takes: a gap of at most `gap` bytes is read over."""
    out: list[list[int]] = []
    end = None
    for i in sorted(range(len(ranges)), key=lambda i: ranges[i]):
        if end is None or ranges[i][0] > end + gap:
            out.append([])
            end = ranges[i][1]
        out[-1].append(i)
        end = max(end, ranges[i][1])
    return out


def packed(costs: list[int], target: int) -> list[list[int]]:
    """Indices in their order, in groups whose costs come to the target at most; one alone may exceed it."""
    out: list[list[int]] = []
    held = 0
    for i, cost in enumerate(costs):
        if not out or held + cost > target:
            out.append([])
            held = 0
        out[-1].append(i)
        held += cost
    return out


def load_options(source: dict) -> dict[str, str]:
    """Options of the cube data source from a load request of kind envi-local or envi-http; older names of the fields are accepted."""
    pick = lambda *names: next((source[n] for n in names if isinstance(source.get(n), str) and source[n].strip()), None)
    kind = source.get("kind")
    if kind == "envi-local":
        header, data = pick("headerFile", "hdrFile"), pick("dataFile", "imgFile")
    elif kind == "envi-http":
        header, data = pick("headerUrl", "hdrUrl"), pick("dataUrl", "imgUrl")
    else:
        raise ValueError(f"unsupported load source kind: {kind}")
    if not header or not data:
        raise ValueError(f"{kind} takes a header and a data place")
    return {"header": header.strip(), "data": data.strip()} | {f"http.{k}": v for k, v in (clean_headers(source.get("headers")) or {}).items()}


def resolve(url: str, base: str) -> str:
    return urljoin(base, url)
