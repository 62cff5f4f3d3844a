"""Search API as a Spark data source, with a transport that can be replaced."""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docketry.functions.text import mask_text
from docketry.sources.xml_records import RECORD_SCHEMA, MalformedResponse, parse_tree, records_of

#: Environment of the process that makes the request: address of the free-search service, access key.
ENDPOINT_VARIABLE = "PATENT_SEARCH_ENDPOINT"
KEY_VARIABLE = "PATENT_SEARCH_KEY"
TIMEOUT_SECONDS = 30
MAX_COUNT = 20


@dataclass(frozen=True)
class Response:
    status: int
    body: bytes


# The names of the service's request parameters.
def request_url(word: str, count: int, key: str, endpoint: str, page: int = 1) -> str:
    query = {
        "word": word, "patent": "true", "utility": "true", "docsStart": str(page),
        "docsCount": str(count), "lastvalue": "", "accessKey": key,
    }
    return endpoint + "?" + urllib.parse.urlencode(query)


class HttpTransport:
    """One GET request. An HTTP error still is a response; no connection raises."""

    def get(self, word: str, count: int, key: str) -> Response:
        url = request_url(word, count, key, os.environ[ENDPOINT_VARIABLE])
        request = urllib.request.Request(url, headers={"User-Agent": "docketry/0.1"})
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as answer:
                return Response(answer.status, answer.read())
        except urllib.error.HTTPError as error:
            return Response(error.code, error.read())
        except (urllib.error.URLError, TimeoutError) as error:
            raise RuntimeError(mask_text(f"The search service can't be reached: {error}", key)) from None


class FolderTransport:
    """Answers from saved files ``<word>.xml`` (status 200) or ``<word>.<status>.xml``; for tests."""

    def __init__(self, folder: str):
        self.folder = folder

    def get(self, word: str, count: int, key: str) -> Response:
        for name in sorted(os.listdir(self.folder)):
            parts = name.split(".")
            if parts[0] == word and parts[-1] == "xml":
                with open(os.path.join(self.folder, name), "rb") as file:
                    return Response(int(parts[1]) if len(parts) > 2 else 200, file.read())
        raise RuntimeError("The search service can't be reached: no saved response.")


class SavedTransport:
    """Always answers with one saved body; needs no file that executors would have to share."""

    def __init__(self, body: str):
        self.body = body

    def get(self, word: str, count: int, key: str) -> Response:
        return Response(200, self.body.encode())


def check_arguments(word: str, key: str, count: int) -> None:
    """Raised before any plan is built."""
    if not key:
        raise ValueError("An access key is required.")
    if not 1 <= count <= MAX_COUNT:
        raise ValueError(f"count must be between 1 and {MAX_COUNT}.")
    if not (word or "").strip():
        raise ValueError("A search word is required.")


class Query(InputPartition):
    def __init__(self, word: str):
        super().__init__(word)


class SearchReader(DataSourceReader):
    def __init__(self, options, form: str):
        self.words = [w for w in options.get("word", "").split("\n") if w.strip()]
        self.count = int(options.get("count", MAX_COUNT))
        self.folder, self.saved = options.get("folder"), options.get("saved")
        self.form = form

    def partitions(self):
        return [Query(word) for word in self.words]

    def read(self, partition):
        transport = (
            SavedTransport(self.saved) if self.saved else FolderTransport(self.folder) if self.folder else HttpTransport()
        )
        # The key is read where the request is made, so that no plan, option or log carries it.
        key = os.environ.get(KEY_VARIABLE, "")
        if isinstance(transport, HttpTransport) and not (key and os.environ.get(ENDPOINT_VARIABLE)):
            raise ValueError(f"{KEY_VARIABLE} and {ENDPOINT_VARIABLE} must be set on every executor.")
        answer = transport.get(partition.value, self.count, key)
        if self.form == "response":
            yield (partition.value, answer.status, answer.body)
            return
        try:
            rows, ok = list(records_of(parse_tree(answer.body))), True
        except MalformedResponse:
            if answer.status < 400:
                raise
            rows, ok = [], False
        if self.form == "status":
            yield (partition.value, answer.status, ok, len(rows))
        else:
            for row in rows:
                yield (partition.value, *row)


FORMS = {
    "records": f"word string, {RECORD_SCHEMA}",
    "status": "word string, http_status int, is_xml boolean, n_records int",
    "response": "word string, http_status int, body binary",
}


class SearchSource(DataSource):
    """``spark.read.format("patent_search").option("word", ...)``; several words on several lines.

    Each word is a partition. ``form`` is ``records``; ``status``, one diagnostic row per word (HTTP status,
    is the body XML, number of records), which tells a failed request from an empty result; or
    ``response``, the HTTP status and the body as received. ``folder`` reads
    saved responses from a folder all executors see, ``saved`` is a response itself; both replace the
    network.
    """

    @classmethod
    def name(cls):
        return "patent_search"

    def schema(self):
        return FORMS[self.options.get("form", "records")]

    def reader(self, schema):
        return SearchReader(self.options, self.options.get("form", "records"))


def search(
    spark: SparkSession,
    word: str,
    count: int = MAX_COUNT,
    folder: str | None = None,
    saved: str | None = None,
    form: str = "records",
) -> DataFrame:
    """Records for a search word; with ``form``, diagnostics or the response itself (:class:`SearchSource`).

    The service's address and the access key come from the environment of the process that makes the
    request.
    """
    offline = {k: v for k, v in (("folder", folder), ("saved", saved)) if v}
    check_arguments(word, "saved" if offline else os.environ.get(KEY_VARIABLE, ""), count)
    if not offline and not os.environ.get(ENDPOINT_VARIABLE):
        raise ValueError(f"{ENDPOINT_VARIABLE} isn't set.")
    spark.dataSource.register(SearchSource)
    reader = spark.read.format("patent_search").option("word", word).option("count", count)
    return reader.option("form", form).options(**offline).load()
