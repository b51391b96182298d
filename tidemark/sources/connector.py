"""Providers as sources: a registry of what each one covers and how its payloads are read, and a data source that reads stored pages as payloads.

    spark.dataSource.register(StoredPages)
    spark.read.format("stored_pages").option("path", folder).option("provider", "example.com").load()
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


@dataclass(frozen=True)
class Provider:
    """parse: payload rows (of `StoredPages`) -> candidate rows."""

    key: str
    origin: str
    tier: str
    games: tuple[str, ...]
    parse: Callable[[DataFrame], DataFrame]


@dataclass
class Registry:
    known: dict[str, Provider] = field(default_factory=dict)

    def register(self, provider: Provider) -> None:
        self.known[provider.key] = provider

    def unregister(self, key: str) -> None:
        self.known.pop(key, None)

    def for_games(self, games: list[str] | None = None) -> list[Provider]:
        """Providers that cover one of the games, in order of key; no games ask for all."""
        return [p for _, p in sorted(self.known.items()) if not games or set(p.games) & set(games)]

    def in_scope(self, installs: DataFrame, game: str) -> DataFrame:
        """The rows of installs with `provider`: one for each provider that covers their game."""
        covered = [(p.key, g) for p in self.for_games() for g in p.games]
        table = installs.sparkSession.createDataFrame(covered, "provider string, _game string")
        return installs.join(table, installs[game] == table["_game"]).drop("_game")

    def read(self, spark: SparkSession, key: str, path: str) -> DataFrame:
        """The candidates of a provider's stored pages."""
        spark.dataSource.register(StoredPages)
        return self.known[key].parse(spark.read.format("stored_pages").option("path", path).option("provider", key).load())


@dataclass
class _Group(InputPartition):
    file: str
    group: int


class StoredPages(DataSource):
    """Pages (page_id, url, html) of a Parquet table, given by `path`, as payloads: packed, with their hash. `provider`: only pages of hosts that end so. A partition is a row group of a file, and yields its
    rows batch by batch; paths are opened by Arrow, which knows local ones, hdfs:// and s3://."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "page_id long, provider string, url string, body binary, sha256 string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.provider = options["path"], options.get("provider")

    def partitions(self) -> list[_Group]:
        import pyarrow.dataset as ds

        pieces = ds.dataset(self.path, format="parquet").get_fragments()
        return [_Group(f.path, g.id) for f in pieces for g in f.row_groups] or [_Group("", 0)]

    def read(self, partition: _Group) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        if not partition.file:
            return
        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        kinds = pa.schema([("page_id", pa.int64()), ("provider", pa.string()), ("url", pa.string()), ("body", pa.binary()), ("sha256", pa.string())])
        with system.open_input_file(partition.file) as file:
            # a row group is read piece by piece, not a column at once
            for batch in pq.ParquetFile(file, buffer_size=1 << 20, pre_buffer=False).iter_batches(256, row_groups=[partition.group], columns=["page_id", "url", "html"]):
                rows = []
                for page, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    provider = ".".join((urlsplit(url or "").hostname or "").split(".")[-2:])
                    if self.provider in (None, provider):
                        raw = (html or "").encode("utf-8", "surrogatepass")
                        rows.append((page, provider, url, gzip.compress(raw, 1, mtime=0), hashlib.sha256(raw).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)


def titles(payloads: DataFrame) -> DataFrame:
    """page_id, name: what a page calls itself, for providers without a mapper of their own."""
    from tidemark.sources.payloads import unpacked

    return unpacked(payloads.select("page_id", "body")).select("page_id", F.nullif(F.regexp_extract("text", "(?is)<title>(.*?)</title>", 1), F.lit("")).alias("name"))
