"""A batch and streaming data source over a paginated service.

spark.dataSource.register(PagedSource); spark.read.format("paged").option("url", ...).load(). Pages are fetched on the
executors, by offset. What fetches a page is chosen by the option fetcher, "module:function"; the default speaks HTTP.
"""

from __future__ import annotations

import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..errors import check_status

DELAY = "4.15"  # seconds between pages of a service, unless the option delay says otherwise


def http_fetcher(options: dict, offset: int) -> tuple[int, dict]:
    """Status and body of the page at offset."""
    query = {"offset": offset, "limit": options.get("page", "500")} | json.loads(options.get("params", "{}"))
    request = urllib.request.Request(f"{options['url']}?{urllib.parse.urlencode(query)}")
    if options.get("token"):
        request.add_header("Authorization", f"Bearer {options['token']}")
    try:
        with urllib.request.urlopen(request, timeout=float(options.get("timeout", "10"))) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, {}


def file_fetcher(options: dict, offset: int) -> tuple[int, dict]:
    """Pages saved as offset.json in the folder at url, on this machine's disk alone: any other address is refused, and saved_entries() reads such.

    status.json is a failure. A file that is not there is an empty page after the last one, and FileNotFoundError before it.
    """
    from pathlib import Path

    if "://" in (url := options["url"]).removeprefix("file://"):
        raise ValueError(f"{url} is not a folder of this machine")
    folder = Path(url.removeprefix("file://"))
    if (folder / "status.json").exists():
        return json.loads((folder / "status.json").read_text()), {}
    page = folder / f"{offset}.json"
    if page.exists():
        return 200, json.loads(page.read_text())
    if any(p.stem.isdecimal() and int(p.stem) > offset for p in folder.glob("*.json")):
        raise FileNotFoundError(f"no page at {page}, but later ones")
    return 200, {"data": []}


def pages(options: dict, offset: int, last: int | None = None):
    """(offset, entries) of one page after another, up to last pages, from the entry at offset on.

    Pages are asked for where they begin, whatever the offset of the first entry. An empty page, or one that names no next, is the final one. A page that times out is asked for again, as often as
    retries says; other failures raise what their status stands for.
    """
    module, _, name = options.get("fetcher", f"{__name__}:http_fetcher").partition(":")
    fetch = getattr(importlib.import_module(module), name)
    step, done, tries = int(options.get("page", "500")), 0, 0
    delay = float(options.get("delay", DELAY if fetch is http_fetcher else "0"))
    begun = int(options.get("offset", "0")) % step  # pages begin a multiple of their size after the first
    while last is None or done < last:
        passed = (offset - begun) % step
        try:
            status, body = fetch(options, offset - passed)
        except TimeoutError:
            tries += 1
            if tries > int(options.get("retries", "3")):
                raise
            continue
        check_status(status, options.get("url", ""))
        if len(entries := body.get("data") or []) <= passed:
            return
        yield offset, entries[passed:]
        done, tries, offset = done + 1, 0, offset - passed + step
        if not body.get("paging"):
            return
        time.sleep(delay)


class _Run(InputPartition):
    def __init__(self, offset: int, count: int | None):
        self.offset, self.count = offset, count


class PagedReader(DataSourceReader):
    """Options offset and max_pages; with readers over 1 and max_pages set, runs of pages are read side by side."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self):
        start, step = int(self.options.get("offset", "0")), int(self.options.get("page", "500"))
        most, readers = self.options.get("max_pages"), int(self.options.get("readers", "1"))
        if most is None or readers == 1:
            return [_Run(start, None if most is None else int(most))]
        each = -(-int(most) // readers)
        return [_Run(start + k * each * step, min(each, int(most) - k * each)) for k in range(readers) if k * each < int(most)]

    def read(self, partition):
        for offset, entries in pages(self.options, partition.offset, partition.count):
            for k, entry in enumerate(entries):
                yield offset + k, json.dumps(entry)


class PagedStream(SimpleDataSourceStreamReader):
    """Follows the service: each trigger takes the entries that have appeared since the last, those of a page that still fills with them.

    With max_pages a trigger takes no more than so many pages and leaves the rest for the next.
    """

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self):
        return {"offset": int(self.options.get("offset", "0"))}

    def read(self, start):
        rows, at, most = [], start["offset"], self.options.get("max_pages")
        for offset, entries in pages(self.options, at, None if most is None else int(most)):
            rows += [(offset + k, json.dumps(e)) for k, e in enumerate(entries)]
            at = offset + len(entries)
        return iter(rows), {"offset": at}

    def readBetweenOffsets(self, start, end):
        if start["offset"] < end["offset"]:
            for offset, entries in pages(self.options, start["offset"]):
                yield from ((offset + k, json.dumps(e)) for k, e in enumerate(entries) if offset + k < end["offset"])
                if offset + len(entries) >= end["offset"]:
                    return


class PagedSource(DataSource):
    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "position bigint, entry string"

    def reader(self, schema):
        return PagedReader(self.options)

    def simpleStreamReader(self, schema):
        return PagedStream(self.options)
