"""Literature search as a Python data source: ``spark.read.format("literature")``.

Options: ``term``, ``retmax``, ``endpoint`` (base address), ``api_key``.  Ids are found page by page
when the plan is made; each partition then fetches one batch of records.  Requests keep the
service's rate, which the partitions divide, and are tried four times with growing pauses.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestar import schemas
from lodestar.sources.files import arrow_schema, parse_records

ENDPOINT = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
PAGE, BATCH, ATTEMPTS = 10_000, 200, 4
RATE, RATE_WITH_KEY = 3.0, 10.0

Get = Callable[[str], str]


def http_get(url: str) -> str:
    with urlopen(url, timeout=60) as response:
        return response.read().decode("utf-8", "replace")


class Client:
    """Searches ids and fetches records.  ``get`` and ``sleep`` can be replaced in tests."""

    def __init__(self, endpoint: str = ENDPOINT, api_key: str | None = None, get: Get = http_get, sleep=time.sleep, share: int = 1):
        """``share`` clients run at the same time and divide the service's rate among them."""
        self.endpoint, self.api_key, self.get, self.sleep = endpoint.rstrip("/"), api_key, get, sleep
        self.gap, self.last = share / (RATE_WITH_KEY if api_key else RATE), 0.0

    def request(self, path: str, **params) -> str:
        if self.api_key:
            params["api_key"] = self.api_key
        for attempt in range(ATTEMPTS):
            wait = self.last + self.gap - time.monotonic()
            if wait > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            try:
                return self.get(f"{self.endpoint}/{path}?{urlencode(params)}")
            except Exception:
                if attempt == ATTEMPTS - 1:
                    raise
                self.sleep(2.0**attempt)
        raise AssertionError

    def search(self, term: str, retmax: int) -> list[str]:
        ids: list[str] = []
        while len(ids) < retmax:
            size = min(PAGE, retmax - len(ids))
            body = self.request("esearch.fcgi", db="pubmed", term=term, retstart=len(ids), retmax=size, retmode="json", sort="relevance")
            page = json.loads(body).get("esearchresult", {}).get("idlist", [])
            ids += page
            if len(page) < size:
                break
        return ids[:retmax]

    def fetch(self, ids: list[str]) -> list[dict]:
        return parse_records(self.request("efetch.fcgi", db="pubmed", id=",".join(ids), retmode="xml"))


class Batch(InputPartition):
    def __init__(self, ids: list[str], of: int = 1):
        self.ids, self.of = ids, of


class LiteratureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def client(self, share: int = 1) -> Client:
        return Client(self.options.get("endpoint", ENDPOINT), self.options.get("api_key"), share=share)

    def partitions(self) -> list[InputPartition]:
        ids = self.client().search(self.options["term"], int(self.options.get("retmax", 400)))
        cuts = range(0, len(ids), BATCH)
        return [Batch(ids[i : i + BATCH], len(cuts)) for i in cuts] or [Batch([])]

    def read(self, partition: Batch) -> Iterator:
        import pyarrow as pa

        if partition.ids and (rows := self.client(partition.of).fetch(partition.ids)):
            yield from pa.Table.from_pylist(rows, schema=arrow_schema(schemas.DOCUMENTS)).to_batches()


class LiteratureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "literature"

    def schema(self) -> str:
        return schemas.DOCUMENTS

    def reader(self, schema) -> LiteratureReader:
        return LiteratureReader(dict(self.options))
