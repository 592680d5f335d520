"""A data source of paginated collections as they land: ``spark.read.format("pages")`` and ``spark.readStream.format("pages")``.

A collector fetches a series from a cursor on, page by page, and a page's first row is the last of the page before. Its pages land as folders ``symbol=S/from=N``, where N
is the cursor, of JSON lines with ``t`` and ``v``. Each page is a partition of its own and gives the rows behind its cursor, the first page of a symbol those at it too, so that a row is given
once without looking at another page. A stream's offset is the last cursor of each symbol: it goes on behind it after a restart. Files are opened by Arrow's file systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "symbol string, t long, v double"


@dataclass
class Page(InputPartition):
    symbol: str
    cursor: int
    first: bool
    path: str


def _listed(path: str) -> dict[str, list[tuple[int, str]]]:
    """Cursors and folders of each symbol's pages, in order."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    found: dict[str, list[tuple[int, str]]] = {}
    for info in files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = info.path.rsplit("/", 2)
        if info.type == fs.FileType.Directory and parts[-1].startswith("from=") and parts[-2].startswith("symbol="):
            found.setdefault(unquote(parts[-2][7:]), []).append((int(parts[-1][5:]), info.path))
    return {s: sorted(p) for s, p in sorted(found.items())}


def _rows(path: str, page: Page) -> Iterator[tuple]:
    from pyarrow import fs

    files = fs.FileSystem.from_uri(path)[0] if ":" in path else fs.LocalFileSystem()
    seen = set()
    for info in sorted(files.get_file_info(fs.FileSelector(page.path)), key=lambda i: i.path):
        if not info.base_name.startswith((".", "_")):
            with files.open_input_stream(info.path) as f:
                for line in f.read().splitlines():
                    row = json.loads(line)
                    if row["t"] not in seen and (row["t"] > page.cursor or page.first and row["t"] == page.cursor):
                        seen.add(row["t"])
                        yield page.symbol, row["t"], row.get("v")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Page]:
        return [Page(s, cursor, i == 0, folder) for s, pages in _listed(self.path).items() for i, (cursor, folder) in enumerate(pages)] or [Page("", 0, False, "")]

    def read(self, page: Page) -> Iterator[tuple]:
        if page.path:
            yield from _rows(self.path, page)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: pages[-1][0] for s, pages in _listed(self.path).items()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [
            Page(s, cursor, i == 0, folder) for s, pages in _listed(self.path).items() for i, (cursor, folder) in enumerate(pages)
            if s in end and cursor <= end[s] and (s not in start or cursor > start[s])
        ]

    def read(self, page: Page) -> Iterator[tuple]:
        yield from _rows(self.path, page)

    def commit(self, end: dict) -> None:
        pass


class Pages(DataSource):
    """``path`` is the collection's folder."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pages)


def land(rows: DataFrame, path: str, limit: int, step_ms: int, since: int = 0, until: int | None = None) -> None:
    """Write ``symbol, t, v`` as pages of ``limit`` steps from each symbol's first time on, each page's last row being the next one's first; of these the pages from number ``since`` to before ``until``."""
    page = limit * step_ms
    x = rows.join(rows.groupBy("symbol").agg(F.min("t").alias("start")), "symbol")
    n = F.floor((F.col("t") - F.col("start")) / page)
    edge = ((F.col("t") - F.col("start")) % page == 0) & (n > 0)
    x = x.withColumn("n", F.explode(F.when(edge, F.array(n - 1, n)).otherwise(F.array(n)))).withColumn("from", F.col("start") + F.col("n") * page)
    x = x.where((F.col("n") >= since) & (F.lit(until is None) | (F.col("n") < (until or 0))))
    x.select("symbol", "from", "t", "v").repartition("symbol", "from").sortWithinPartitions("symbol", "from", "t").write.partitionBy("symbol", "from").mode("append").json(path)
