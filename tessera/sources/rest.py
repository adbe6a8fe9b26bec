"""A paged REST source with linear back-off, as a Spark data source; and downloads with a final rename."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.operators import corpus
from tessera.sources import npy


def get(url: str, tries: int = 8, wait: float = 1.0, open_=urllib.request.urlopen) -> bytes:
    """The body; code 429 is tried again after 1, 2, 3 ... waits."""
    for k in range(1, tries + 1):
        try:
            with open_(url) as r:
                return r.read()
        except urllib.error.HTTPError as e:
            if e.code != 429 or k == tries:
                raise
            time.sleep(wait * k)
    raise AssertionError


class _Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedRows(DataSource):
    """Options: url with {offset} and {length}, total, page (rows of one request, 100). Rows: (offset, row)."""

    @classmethod
    def name(cls):
        return "paged_rest"

    def schema(self):
        return "offset long, row string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.total, self.page = options["url"], int(options["total"]), int(options.get("page", "100"))

    def partitions(self):
        return [_Page(k, min(self.page, self.total - k)) for k in range(0, self.total, self.page)]

    def read(self, partition):
        body = json.loads(get(self.url.format(offset=partition.offset, length=partition.length)))
        for k, row in enumerate(body.get("rows", [])):
            yield partition.offset + k, json.dumps(row.get("row", row))


def download(url: str, path: str) -> str:
    """Fetch to ``path`` unless it exists; a broken transfer leaves only a .part file."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            f.write(get(url))
        os.replace(f"{path}.part", path)
    return path


def unpack(archive: str, folder: str) -> str:
    """Extract once; a marker file says that it was done."""
    marker = os.path.join(folder, ".extracted")
    if not os.path.exists(marker):
        with zipfile.ZipFile(archive) as z:
            z.extractall(folder)
        open(marker, "w").close()
    return folder


def stratified_corpus(parts: dict[str, DataFrame], path: str, per_part: int, total: int, seed: int = 7) -> DataFrame:
    """A sampled corpus of several paged sources (offset, row), kept as a table at ``path`` and made only once.

    Each row gets its part's name and an id; of the first 3 * per_part rows of each part, per_part are drawn, and
    of all those ``total``.
    """
    both = None
    for name, rows in parts.items():
        own = rows.select(F.lit(name).alias("language"), F.concat_ws(":", F.lit(name), F.lpad(F.col("offset").cast("string"), 12, "0")).alias("id"), "row")
        both = own if both is None else both.union(own)
    return npy.cached(corpus.stratified_sample(both, "language", "id", per_part, total, seed), path)
