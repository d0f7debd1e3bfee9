"""Landed board pages as a data source: ``spark.read.format("boards")`` and ``spark.readStream.format("boards")``.

Pages are landed many to a file, under
``<path>/landing=<time and number>/kind=<kind>/shelf=<n>/``: Parquet files of
board, page and body; a board's shelf is a hash of its name, and a landing
counts once it is written in full.  So files grow with shelves and landings,
not with boards or pages.  A shelf is a partition, unless the option
``together`` asks for several in each; of a page that was landed again the last
answer counts.  As a stream the offset names the landings that were taken, and
each shelf's task finds from their page numbers what every board has ready:
each board goes on where it stopped, however many pages others have landed
meanwhile, and pages that land out of order wait for those before them.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from matchloom.sources import boards

SCHEMA = "kind string, board_token string, page_no int, body string"
#: Parts of a kind's boards: tasks that can read them at once.
SHELVES = 32
#: Pages that a task holds at once.
BATCH_PAGES = 256
_FILE = re.compile(r"landing=([^/]+)/kind=([^/]+)/shelf=(\d+)/([^/]+)$")
_DONE = re.compile(r"landing=([^/]+)/_SUCCESS$")


@dataclass(frozen=True)
class Shelf:
    """Files of a shelf in the order of their landings; of the first ``seen`` ones a stream has taken what was ready (None: not a stream)."""

    kind: str
    number: int
    files: tuple[str, ...]
    seen: int | None = None


class Shelves(InputPartition):
    def __init__(self, shelves: list[Shelf]) -> None:
        self.shelves = shelves


def _reached(numbers: dict[str, set[int]]) -> dict[str, int]:
    """The last page of each board that no page is missing before."""
    out = {}
    for board, pages in numbers.items():
        last = 0
        for n in sorted(pages):
            if n <= last + 1:
                last = n
        out[board] = last
    return out


class Landing:
    """The landed pages under a path of any file system that Arrow knows."""

    def __init__(self, options: dict[str, str]) -> None:
        if not options.get("path"):
            raise ValueError("the boards source needs a path")
        self.path, self.kinds = options["path"], frozenset(filter(None, options.get("kinds", "").split(",")))
        self.together = max(1, int(options.get("together", "1")))

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")

    def files(self) -> tuple[set[str], list[tuple[str, str, int, str]]]:
        """The landings written in full, and their files (landing, kind, shelf, path) in order."""
        from pyarrow import fs

        system, root = self._open()
        found = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file]
        done = {m[1] for m in map(_DONE.search, found) if m}
        files = [(m[1], unquote(m[2]), int(m[3]), m.string) for m in map(_FILE.search, found) if m and m[1] in done and not m[4].startswith((".", "_"))]
        return done, sorted(f for f in files if not self.kinds or f[1] in self.kinds)

    def dealt(self, taken: set[str] | None = None, upto: set[str] | None = None) -> list[Shelves]:
        """Partitions of all shelves, or of those with landings in ``upto`` that are not in ``taken``."""
        by_shelf: dict[tuple[str, int], list[tuple[bool, str, str]]] = {}
        for landing, kind, shelf, path in self.files()[1]:
            if upto is None or landing in upto:
                by_shelf.setdefault((kind, shelf), []).append((taken is not None and landing not in taken, landing, path))
        shelves = []
        for (kind, shelf), files in sorted(by_shelf.items()):
            seen = None if taken is None else sum(not new for new, _, _ in files)
            if seen is None or seen < len(files):
                shelves.append(Shelf(kind, shelf, tuple(path for _, _, path in sorted(files)), seen))
        return [Shelves(shelves[k : k + self.together]) for k in range(0, len(shelves), self.together)]

    @staticmethod
    def _ready(system, shelf: Shelf) -> dict[tuple[str, int], int]:
        """Pages to give out and the file that has the last answer of each."""
        import pyarrow.parquet as pq

        where: dict[tuple[str, int], int] = {}
        before: dict[str, set[int]] = {}
        now: dict[str, set[int]] = {}
        for n, path in enumerate(shelf.files):
            with system.open_input_file(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(columns=["board", "page"]):
                    for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                        where[key] = n
                        now.setdefault(key[0], set()).add(key[1])
                        if n < (shelf.seen or 0):
                            before.setdefault(key[0], set()).add(key[1])
        if shelf.seen is None:
            return where
        last, ready = _reached(before), _reached(now)
        return {key: n for key, n in where.items() if last.get(key[0], 0) < key[1] <= ready[key[0]]}

    def read(self, partition: Shelves | None) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        system, _ = self._open()
        for shelf in partition.shelves if partition is not None else ():  # Spark asks so where there are no pages
            whole = shelf.seen is None and len(shelf.files) == 1
            ready = {} if whole else self._ready(system, shelf)
            for n, path in enumerate(shelf.files):
                with system.open_input_file(path) as f:
                    for batch in pq.ParquetFile(f).iter_batches(BATCH_PAGES, columns=["board", "page", "body"]):
                        if not whole:
                            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                            batch = batch.filter(pa.array([ready.get(key) == n for key in keys], pa.bool_()))
                        if batch.num_rows:
                            yield pa.RecordBatch.from_arrays([pa.array([shelf.kind] * batch.num_rows, pa.string()), *batch.columns], ["kind", "board_token", "page_no", "body"])


class BoardReader(Landing, DataSourceReader):
    def partitions(self) -> list[Shelves]:
        return self.dealt()


class BoardStreamReader(Landing, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"landings": []}

    def latestOffset(self) -> dict:
        return {"landings": sorted(self.files()[0])}

    def partitions(self, start: dict, end: dict) -> list[Shelves]:
        return self.dealt(set(start["landings"]), set(end["landings"]))

    def commit(self, end: dict) -> None:
        pass


class BoardSource(DataSource):
    """Options: ``path``, ``kinds`` (separated by commas; all if absent) and ``together`` (shelves of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "boards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BoardReader:
        return BoardReader(dict(self.options))

    def streamReader(self, schema) -> BoardStreamReader:
        return BoardStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BoardSource)


def land(bodies: DataFrame, kind: str | Column, path: str) -> None:
    """Write pages (board_token, page_no, body) of one kind, or of the kinds in a column, where the source finds them."""
    shelf = F.pmod(F.xxhash64("board_token"), F.lit(SHELVES)).cast("int")
    rows = bodies.select((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), shelf.alias("shelf"), F.col("board_token").alias("board"), F.col("page_no").cast("int").alias("page"), "body")
    dealt = rows.repartition("kind", "shelf").sortWithinPartitions("kind", "shelf", "board", "page")
    dealt.write.partitionBy("kind", "shelf").parquet(f"{path}/landing={time.time_ns():020d}-{uuid.uuid4().hex}")


def listings(spark: SparkSession, path: str, kinds: list[str] | None = None, together: int = 1) -> DataFrame:
    """Unified rows of all landed pages; each kind's pages are read once."""
    read = lambda k: spark.read.format("boards").option("kinds", k).option("together", together).load(path).drop("kind")
    return reduce(DataFrame.unionByName, [boards.enumerate_board(k, read(k)) for k in kinds or list(boards.ADAPTERS)])


def walked(pages: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """One row per page for :func:`matchloom.operators.catalog.completeness`; ``source_id`` is kind and board."""
    return boards.pages_of_kinds(pages, kinds or None).withColumn("source_id", F.concat_ws("/", "kind", "board_token"))


__all__ = ["BoardSource", "SCHEMA", "land", "listings", "register", "walked"]
