"""Fetching pages through a caller's function: redirects walked by hand, failures as statuses, look-ups remembered."""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: get(url) -> (status, headers, body); it raises OSError where nothing answers.
Get = Callable[[str], tuple[int, dict, bytes]]

# Statuses of our own, most redirects, bytes of a body that are read, characters of an error's body that are kept, and kinds that are no text.
UNREACHED, TOO_MANY, CIRCLE = 0, 310, 311
MOST_HOPS, MOST_BYTES, MOST_ERROR = 10, 10 << 20, 65_536
BINARY = ("image/", "video/", "audio/", "font/", "application/pdf", "application/zip", "application/octet-stream")


def walked(url: str, get: Get, clock: Callable[[], float] = time.monotonic) -> dict:
    """One page with the URLs it went through (first to last), the first redirect's status, lower-cased headers, the time of the last answer, and its text."""
    chain, at, first = [url], url, None
    start = clock()
    while True:
        start = clock()
        try:
            status, headers, body = get(at)
        except OSError as e:
            return {"final": at, "chain": chain, "redirect_code": first, "status": UNREACHED, "headers": {}, "ms": int((clock() - start) * 1000), "body": "", "error": str(e) or type(e).__name__}
        ms = int((clock() - start) * 1000)
        headers = {k.lower(): v for k, v in headers.items()}
        out = {"final": at, "chain": chain, "redirect_code": first, "status": status, "headers": headers, "ms": ms, "body": "", "error": None}
        if 300 <= status < 400 and headers.get("location"):
            first = out["redirect_code"] = first or status
            to = urljoin(at, headers["location"])
            if to in chain:
                return out | {"status": CIRCLE, "chain": [*chain, to]}
            if len(chain) > MOST_HOPS:
                return out | {"status": TOO_MANY}
            chain, at = [*chain, to], to
            continue
        if headers.get("content-type", "").lower().startswith(BINARY) or len(body) > MOST_BYTES:
            return out
        text = body.decode("utf-8", "replace")
        return out | {"body": text[:MOST_ERROR] if status >= 400 else text}


SCHEMA = "url string, final string, chain array<string>, redirect_code int, status int, headers map<string,string>, ms long, body string, error string"


def fetched(urls: DataFrame, get: Get, per_task: int = 500) -> DataFrame:
    """A row for each different URL of urls (url), fetched once; so many to a task, and hosts spread over tasks."""
    n = urls.select("url").where("url is not null").distinct()
    types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 16):
                rows = [(u, *(list(x.items()) if k == "headers" else x for k, x in walked(u, get).items())) for u in b.column(0).slice(at, 16).to_pylist()]
                order = ["url", "final", "chain", "redirect_code", "status", "headers", "ms", "body", "error"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], order)

    return n.repartition(max(1, -(-n.count() // per_task)), F.xxhash64("url")).mapInArrow(run, SCHEMA)


class Remembered:
    """Look-ups kept for so many seconds, at most `most` of them: the oldest go first."""

    def __init__(self, look_up: Callable, seconds: float = 60, most: int = 5000, clock: Callable[[], float] = time.monotonic):
        self._look_up, self._seconds, self._most, self._clock, self._held = look_up, seconds, most, clock, {}

    def __call__(self, name: str):
        now = self._clock()
        found = self._held.get(name)
        if found is None or now - found[1] >= self._seconds:
            self._held.pop(name, None)
            while len(self._held) >= self._most:
                del self._held[next(iter(self._held))]
            found = self._held[name] = (self._look_up(name), now)
        return found[0]


def synthesized(title: Column, items: Column) -> Column:
    """A page made of what a tool returned: items are structs (title, url, text)."""
    e = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    one = lambda x: F.concat(F.lit("<article><h2>"), e(x["title"]), F.lit('</h2><a href="'), e(x["url"]), F.lit('">'), e(x["url"]), F.lit("</a><p>"), e(x["text"]), F.lit("</p></article>"))
    return F.concat(F.lit("<!doctype html><html><head><title>"), e(title), F.lit("</title></head><body><h1>"), e(title), F.lit("</h1>"), F.array_join(F.transform(items, one), ""), F.lit("</body></html>"))
