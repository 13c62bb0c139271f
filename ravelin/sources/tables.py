"""Stored tables of documents, chunks and query logs, changed by transactions; a paged source; sinks of samples and reports."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import Files


class Conflict(RuntimeError):
    """Another writer changed what this one had read."""


class TableStore:
    """Tables under one root of a Hadoop file system, changed by transactions over any of them.

    The state of all tables is the newest entry of a commit log: for each table the folders that hold its rows. A transaction reads
    the tables as one entry has them, writes rows to folders of its own, and commits by creating the next entry, which succeeds for
    one writer only. A writer that comes second looks at what was committed since its snapshot: if none of the tables that it
    read or replaced has changed, its changes are put on top; if one has, ``Conflict`` is raised, or ``run`` does the work anew.
    Rows that are only added conflict with nothing. A writer that dies leaves folders that no entry names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def versions(self) -> list[int]:
        return sorted(int(x.removesuffix(".json")) for x in self.files.names("_log") if x.endswith(".json"))

    def entry(self, version: int) -> dict:
        """``tables``: each table's folders; ``replaced`` and ``added``: the tables that this commit changed."""
        return json.loads(self.files.get(f"_log/{version}.json")) if version >= 0 else {"tables": {}, "replaced": [], "added": []}

    def snapshot(self) -> Transaction:
        return Transaction(self, (self.versions() or [-1])[-1])

    def run(self, work: Callable[[Transaction], None], attempts: int = 20) -> int:
        """Does the work in a transaction and commits it; does it anew on the newer tables after a conflict. The new version."""
        for last in range(attempts):
            transaction = self.snapshot()
            work(transaction)
            try:
                return transaction.commit()
            except Conflict:
                if last == attempts - 1:
                    raise
        raise ValueError("attempts must be positive")

    def read(self, name: str) -> DataFrame | None:
        return self.snapshot().read(name)

    def vacuum(self, keep: int = 10, grace_s: float = 86_400.0) -> list[str]:
        """Deletes old entries but ``keep``, and folders that no kept entry names and that are older than ``grace_s``: readers of
        kept versions and writers at work lose nothing."""
        found = self.versions()
        kept = {f for v in found[-keep:] for folders in self.entry(v)["tables"].values() for f in folders}
        gone = []
        for name in (x for x in self.files.names("") if x != "_log"):
            for folder in self.files.names(name):
                if f"{name}/{folder}" not in kept and self.files.age(f"{name}/{folder}") > grace_s:
                    self.files.delete(f"{name}/{folder}")
                    gone.append(f"{name}/{folder}")
        for v in found[:-keep]:
            self.files.delete(f"_log/{v}.json")
        return sorted(gone)

    def write(self, name: str, table: DataFrame) -> DataFrame:
        self.run(lambda t: t.write(name, table))
        return self.read(name)

    def upsert(self, name: str, rows: DataFrame, key: str) -> DataFrame:
        """New rows take the place of those with their key; of a key that repeats in ``rows`` one row stays."""
        self.run(lambda t: t.upsert(name, rows, key))
        return self.read(name)

    def replace_chunks(self, name: str, docs: DataFrame, chunks: DataFrame) -> DataFrame:
        """The chunks (doc_id, ..) of these documents (doc_id) in place of all that they had, also where they have none now."""
        self.run(lambda t: t.replace_chunks(name, docs, chunks))
        return self.read(name)

    def ordered_chunks(self, name: str) -> DataFrame:
        """All chunks ever stored and not replaced, by document and place."""
        return self.read(name).orderBy("doc_id", "chunk_index")

    def log(self, queries: DataFrame, citations: DataFrame) -> None:
        """Adds queries (log_id, query_text, answer_text, index_version, latency_ms) and their citations (log_id, chunk_id, rank, score)
        in one commit; citations of no query are left out."""

        def both(t: Transaction) -> None:
            t.add("query_logs", queries)
            t.add("citations", citations.join(queries.select("log_id"), "log_id", "left_semi").select(*citations.columns))

        self.run(both)

    def logs(self) -> tuple[DataFrame, DataFrame]:
        t = self.snapshot()
        return t.read("query_logs"), t.read("citations")


class Transaction:
    """The tables as one version has them, and this writer's changes to them, which it sees itself."""

    def __init__(self, store: TableStore, version: int):
        self.store, self.version = store, version
        self.base = store.entry(version)["tables"]
        self.seen: set[str] = set()
        self.replaced: dict[str, list[str]] = {}
        self.added: dict[str, list[str]] = {}

    def folders(self, name: str) -> list[str]:
        return [*self.replaced.get(name, self.base.get(name, [])), *self.added.get(name, [])]

    def read(self, name: str) -> DataFrame | None:
        self.seen.add(name)
        found = self.folders(name)
        return self.store.spark.read.parquet(*(f"{self.store.root}/{f}" for f in found)) if found else None

    def _put(self, name: str, rows: DataFrame) -> str:
        folder = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store.root}/{folder}")
        return folder

    def write(self, name: str, rows: DataFrame) -> None:
        """These rows in place of all others."""
        folder = self._put(name, rows)
        self.added.pop(name, None)
        self.replaced[name] = [folder]

    def add(self, name: str, rows: DataFrame) -> None:
        self.added.setdefault(name, []).append(self._put(name, rows))

    def upsert(self, name: str, rows: DataFrame, key: str) -> None:
        rows, old = rows.dropDuplicates([key]), self.read(name)
        self.write(name, rows if old is None else old.join(rows.select(key), key, "left_anti").unionByName(rows))

    def replace_chunks(self, name: str, docs: DataFrame, chunks: DataFrame) -> None:
        old = self.read(name)
        self.write(name, chunks if old is None else old.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(chunks))

    def commit(self) -> int:
        """The version that holds the changes; without changes the one that was read."""
        if not self.replaced and not self.added:
            return self.version
        mine, at, tables = self.seen | set(self.replaced), self.version, self.base
        while True:
            if at > self.version and mine & (set(entry["replaced"]) | set(entry["added"])):
                raise Conflict(f"{sorted(mine & (set(entry['replaced']) | set(entry['added'])))} changed in version {at}")
            made = {name: list(f) for name, f in tables.items()} | self.replaced
            for name, folders in self.added.items():
                made[name] = [*made.get(name, []), *folders]
            text = json.dumps({"tables": made, "replaced": sorted(self.replaced), "added": sorted(self.added)}, sort_keys=True)
            if self.store.files.create(f"_log/{at + 1}.json", text):
                self.version, self.base = at + 1, made
                self.seen, self.replaced, self.added = set(), {}, {}
                return at + 1
            at += 1
            entry = self.store.entry(at)
            tables = entry["tables"]


def write_reproducible(rows: DataFrame, path: str, *, name_col: str = "dataset_name", id_col: str = "id", files: int = 1) -> None:
    """JSON lines in the order of name ('' for none) and id as a string, keys sorted, line feeds: equal rows give equal bytes, taken
    file after file in order of the files' names, however many files there are. Each file is a range of the order, sorted by the
    task that writes it."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    keyed = rows.select(F.coalesce(F.col(name_col), F.lit("")).alias("n"), F.col(id_col).cast("string").alias("i"), line.alias("value"))
    ordered = keyed.repartition(1) if files == 1 else keyed.repartitionByRange(files, "n", "i", "value")
    ordered.sortWithinPartitions("n", "i", "value").select("value").write.text(path, lineSep="\n")


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file of any file system, streamed."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    total = hashlib.sha256()
    try:
        while len(part := bytes(stream.readNBytes(1 << 20))):
            total.update(part)
    finally:
        stream.close()
    return total.hexdigest()


def write_report(spark: SparkSession, folder: str, tag: str, stamp: str, metrics: DataFrame, inputs: dict[str, str], **about) -> dict:
    """A report ``{tag}_{stamp}.json`` of the first row of metrics, digests of the input files and what else is said."""
    first = metrics.first()
    report = about | {"timestamp_utc": stamp, "inputs_sha256": {k: file_digest(spark, v) for k, v in sorted(inputs.items())}, "metrics": first.asDict(recursive=True) if first else {}}
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{tag}_{stamp}.json")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(json.dumps(report, sort_keys=True, indent=1, default=str).encode()))
    out.close()
    return report


class Throttled(Exception):
    """A service asks to come again after so many seconds."""

    def __init__(self, seconds: float):
        super().__init__(f"come again in {seconds} s")
        self.seconds = seconds


class PagedSource(DataSource):
    """Rows of a paged service, as one JSON string a row. Options: ``total`` rows, ``wanted`` (places, comma-parted) and ``page`` rows
    a page; ``attempts`` to fetch a page, ``backoff`` seconds, twice as many after each failure, and ``patience``, the seconds that a
    page may wait in all. ``fetch`` (a class attribute of a subclass) gets a first row and a number of rows; it may raise
    ``Throttled``, whose waiting time is then kept. Only pages that hold wanted rows are fetched, each by a task of its own.

    A page that stays out of reach gives one row with ``failed``, so the other pages are not lost with it; see ``fetch_pages``."""

    fetch: Callable[[int, int], list[dict]] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "place long, row string, failed string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, type(self).fetch)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, fetch: Callable[[int, int], list[dict]] | None):
        self.page, self.fetch = int(options.get("page", 100)), fetch
        self.wanted = sorted(int(x) for x in options.get("wanted", "").split(",") if x) or list(range(int(options.get("total", 0))))
        self.attempts, self.backoff, self.patience = int(options.get("attempts", 6)), float(options.get("backoff", 1.0)), float(options.get("patience", 600.0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(first) for first in sorted({x // self.page * self.page for x in self.wanted})] or [InputPartition(-1)]

    def _rows(self, first: int) -> list[dict]:
        waited = 0.0
        for attempt in range(self.attempts):
            try:
                return self.fetch(first, self.page)
            except Exception as error:
                pause = error.seconds if isinstance(error, Throttled) else self.backoff * 2**attempt
                waited += pause
                if attempt == self.attempts - 1 or waited > self.patience:
                    raise
                time.sleep(pause)
        raise ValueError("attempts must be positive")

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        first = partition.value
        if first < 0:
            return
        try:
            rows = self._rows(first)
        except Exception as error:
            yield first, None, f"{type(error).__name__}: {error}"
            return
        for place in self.wanted:
            if first <= place < first + self.page and place - first < len(rows):
                yield place, json.dumps(rows[place - first], sort_keys=True), None


def fetch_pages(store: TableStore, name: str, source: str, wanted: list[int], page: int = 100, rounds: int = 3, **options) -> DataFrame:
    """The rows (place, row) at the wanted places of a registered paged source, in the store's table of that name. Each round
    fetches the pages of places that the table does not hold yet and commits what came; so a run that failed or died goes on
    with the missing pages only, and no row is there twice. Places are few (a sample); an error names what is missing after all rounds."""
    spark = store.spark
    for _ in range(rounds):
        old = store.read(name)
        known = {r["place"] for r in old.select("place").collect()} if old is not None else set()
        missing = [x for x in wanted if x not in known]
        if not missing:
            break

        def some(t: Transaction, missing: list[int] = missing) -> None:
            held = t.read(name)
            got = spark.read.format(source).options(wanted=",".join(map(str, missing)), page=str(page), **{k: str(v) for k, v in options.items()}).load().filter("failed is null").select("place", "row")
            t.add(name, got if held is None else got.join(held.select("place"), "place", "left_anti").select("place", "row"))

        store.run(some)
    rows = store.read(name)
    known = {r["place"] for r in rows.select("place").collect()} if rows is not None else set()
    if lost := sorted(set(wanted) - known):
        raise OSError(f"{len(lost)} of {len(wanted)} rows are missing, the first at place {lost[0]}")
    return rows


def sampled_places(total: int, k: int, seed: str) -> list[int]:
    """k of the places 0..total-1, drawn with a seed, in order."""
    import random

    return sorted(random.Random(seed).sample(range(total), min(k, total)))
