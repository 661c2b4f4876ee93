"""A Python data source of JSON documents behind HTTP: one document or many pages per key, with polite retries, an archive and an audit."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds to wait when a server is busy: at least, at most, and how often to try.
WAIT_LEAST, WAIT_MOST, TRIES = 2.0, 30.0, 4


def wait_of(header: str | None, least: float = WAIT_LEAST, most: float = WAIT_MOST) -> float:
    """The seconds that a Retry-After header asks for, kept within bounds; the least where it gives none."""
    try:
        return min(max(float(header or 0), least), most)
    except ValueError:
        return least


def fetch(url: str, tries: int = TRIES, least: float = WAIT_LEAST, timeout: float = 30.0) -> tuple[int, str | None]:
    """(status, body) of a document; a busy server (429, 503) is asked again, any other refusal gives its status and no body."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            if e.code not in (429, 503) or k + 1 == tries:
                return e.code, None
            time.sleep(wait_of(e.headers.get("Retry-After"), least))
    return 0, None


class Keys(InputPartition):
    def __init__(self, keys: list[str]):
        self.keys = keys


class JsonHttpReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.template, self.keys = options["url"], json.loads(options["keys"])
        self.parts, self.pause = int(options.get("partitions", "3")), float(options.get("pause", "0"))
        self.least, self.archive = float(options.get("wait", str(WAIT_LEAST))), options.get("archive")
        self.following, self.most = options.get("next"), int(options.get("pages", "10000"))

    def partitions(self) -> list[InputPartition]:
        return [Keys(self.keys[i :: self.parts]) for i in range(min(self.parts, len(self.keys)))] or [Keys([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        asked = False
        for key in partition.keys:
            page, more = "1", True
            for number in range(1, (self.most if self.following else 1) + 1):
                if asked and self.pause:
                    time.sleep(self.pause)
                asked = True
                status, body = fetch(self.template.replace("{key}", urllib.parse.quote(key, safe="")).replace("{page}", urllib.parse.quote(page, safe="")), least=self.least)
                digest = hashlib.sha256(body.encode()).hexdigest() if body is not None else None
                if self.archive and body is not None:
                    keep(self.archive, f"{digest}.json", body)
                following = next_page(body, self.following) if self.following else None
                more = following is not None
                yield key, number, status, body, digest, not more and status == 200
                if not more:
                    break
                page = following


def next_page(body: str | None, field: str) -> str | None:
    """The page that a document names in ``field`` (dots go into objects), or none."""
    try:
        at = json.loads(body or "null")
    except ValueError:
        return None
    for name in field.split("."):
        at = at.get(name) if isinstance(at, dict) else None
    return None if at is None or at == "" else str(at)


def keep(folder: str, name: str, body: str) -> None:
    """Writes a document into a folder that all executors share, given by path or URI."""
    from pyarrow import fs

    files, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as out:
        out.write(body.encode())


class JsonHttpSource(DataSource):
    """``format("json_http")`` with options url (holding {key}), keys (a JSON list), partitions, pause, wait, archive (a shared folder).

    With ``next``, the field that names the following page, pages of a key are read one after another into {page}, from 1, up to
    ``pages`` (10,000); ``last`` marks the one that ended in order.
    """

    @classmethod
    def name(cls) -> str:
        return "json_http"

    def schema(self) -> T.StructType:
        fields = {"key": T.StringType(), "page": T.IntegerType(), "status": T.IntegerType(), "body": T.StringType(), "sha256": T.StringType(), "last": T.BooleanType()}
        return T.StructType([T.StructField(k, v) for k, v in fields.items()])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return JsonHttpReader(self.options)


def read_json_http(spark: SparkSession, url: str, keys: Sequence[str], **options: object) -> DataFrame:
    """key, page, status, body (null where refused), sha256, last: fetched by as many tasks as ``partitions`` (3)."""
    spark.dataSource.register(JsonHttpSource)
    return spark.read.format("json_http").options(url=url, keys=json.dumps(list(keys)), **{k: str(v) for k, v in options.items()}).load()


def audit(pages: DataFrame) -> DataFrame:
    """What came of each key: pages, characters, the status of its last page, and whether it was read to its end."""
    return pages.groupBy("key").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce(F.length("body"), F.lit(0))).alias("characters"), F.max_by("status", "page").alias("status"), F.bool_or("last").alias("whole"))
