"""Index versions: written beside, checked, activated by one pointer file, rolled back, garbage collected."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import numbered
from .shared import Files, written


class IndexIntegrityError(RuntimeError):
    pass


class VersionStore:
    """Versions under one root of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self.path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.files = Files(spark, root)
        self.fs = self.files.fs

    @staticmethod
    def digest(table: DataFrame) -> str:
        """Of the rows, in any order: the sum of their hashes, and their number."""
        row = table.select(F.xxhash64(*sorted(table.columns)).cast("decimal(38,0)").alias("h")).agg(F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("s"), F.count("*").alias("n")).first()
        return f"{row['s']}:{row['n']}"

    def _put(self, name: str, text: str) -> None:
        """A file that appears whole or not at all, for one writer only."""
        if not self.files.create(name, text):
            raise FileExistsError(f"{name}: another writer was first")

    def _get(self, name: str) -> dict | None:
        if not self.fs.exists(self.path(name)):
            return None
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.root}/{name}").collect()))

    def write(self, version: str, table: DataFrame, **about) -> dict:
        if self.fs.exists(self.path(version)):
            raise FileExistsError(version)
        temporary = f".tmp-{version}"
        try:
            table.write.mode("overwrite").parquet(f"{self.root}/{temporary}/data")
            manifest = about | {"version_id": version, "digest": self.digest(self.spark.read.parquet(f"{self.root}/{temporary}/data"))}
            self._put(f"{temporary}/manifest.json", json.dumps(manifest, sort_keys=True))
            self.fs.rename(self.path(temporary), self.path(version))
        except Exception:
            self.fs.delete(self.path(temporary), True)
            raise
        return manifest

    def read(self, version: str) -> DataFrame:
        manifest = self._get(f"{version}/manifest.json")
        if not manifest:
            raise IndexIntegrityError(f"{version}: no manifest")
        table = self.spark.read.parquet(f"{self.root}/{version}/data")
        if self.digest(table) != manifest["digest"]:
            raise IndexIntegrityError(f"{version}: digest differs")
        return table

    def _pointers(self) -> list[int]:
        if not self.fs.exists(self.path("registry")):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self.path("registry"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def registry(self) -> dict:
        """The newest registry; older ones stay until a newer one is there, so none is ever missing."""
        found = self._pointers()
        return self._get(f"registry/{found[-1]}.json") if found else {}

    def change(self, decide: Callable[[dict], dict], keep: int = 3) -> dict:
        """Puts ``decide(states)`` in place of the states, decided anew on the newer states when another writer was first."""
        while True:
            found = self._pointers()
            states = decide(self._get(f"registry/{found[-1]}.json") if found else {})
            if self.files.create(f"registry/{(found or [-1])[-1] + 1}.json", json.dumps(states)):
                for old in found[: max(0, len(found) - keep)]:
                    self.fs.delete(self.path(f"registry/{old}.json"), False)
                return states

    def _move(self, version: str, was: str, to: str, **about) -> None:
        def decide(states: dict) -> dict:
            if states.get(version, {}).get("status") != was:
                raise ValueError(f"{version} is not {was}")
            return states | {version: states[version] | {"status": to} | about}

        self.change(decide)

    def begin(self, version: str, created_at: int, **about) -> None:
        def decide(states: dict) -> dict:
            if version in states:
                raise ValueError(f"{version} is there")
            return states | {version: about | {"status": "building", "created_at": created_at}}

        self.change(decide)

    def ready(self, version: str) -> None:
        self._move(version, "building", "ready")

    def failed(self, version: str, error: str) -> None:
        self._move(version, "building", "failed", error=error[:2000])

    def collect_garbage(self, keep: int = 3) -> list[str]:
        """Removes the data of versions that are neither active nor among the newest ready ones, nor still being built."""
        states = self.registry()
        ready = sorted(((v["created_at"], k) for k, v in states.items() if v["status"] == "ready"), key=lambda x: (-x[0], x[1]))[:keep]
        kept = {k for k, v in states.items() if v["status"] in ("active", "building")} | {k for _, k in ready}
        gone = [k for k in sorted(states) if k not in kept and self.fs.exists(self.path(k))]
        for k in gone:
            self.fs.delete(self.path(k), True)
        return gone

    def activate(self, version: str) -> None:
        """One version is active at any time: the one before is ready again, in the same step."""

        def decide(states: dict) -> dict:
            if states.get(version, {}).get("status") != "ready":
                raise ValueError(f"{version} is not ready")
            now = {k: v | {"status": "ready"} if v["status"] == "active" else v for k, v in states.items()}
            return now | {version: states[version] | {"status": "active"}}

        self.change(decide)

    def rollback(self) -> str:
        chosen = []

        def decide(states: dict) -> dict:
            active = next((k for k, v in states.items() if v["status"] == "active"), None)
            ready = sorted((v["created_at"], k) for k, v in states.items() if v["status"] == "ready")
            if not active or not ready:
                raise ValueError("no version to roll back to")
            chosen.append(ready[-1][1])
            return states | {active: states[active] | {"status": "rolled_back"}, chosen[-1]: states[chosen[-1]] | {"status": "active"}}

        self.change(decide)
        return chosen[-1]


def kept_versions(versions: DataFrame, keep: int = 3) -> DataFrame:
    """Active versions and the newest ready ones, of which each task hands on ``keep``. versions: version_id, status, created_at."""
    ready = versions.filter(F.col("status") == "ready").orderBy(F.desc("created_at"), "version_id").limit(keep)
    return versions.filter(F.col("status") == "active").unionByName(ready)


def reusable(versions: DataFrame, corpus_sha: str, embedder: str) -> DataFrame:
    """The newest ready or active version of this corpus and embedder."""
    found = versions.filter((F.col("corpus_sha256") == corpus_sha) & (F.col("embedder_id") == embedder) & F.col("status").isin("ready", "active"))
    return found.agg(F.max_by("version_id", F.struct("created_at", "version_id")).alias("version_id"))


def row_numbers(chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows 0.. of the chunks in order of document and index, whatever the type of the document's id: ranges of the order, numbered
    side by side and raised by the counts of the ranges before."""
    keys = written(chunks.select("doc_id", "chunk_index", "chunk_id"), "chunks")  # read twice, without the texts
    return numbered(keys, ["doc_id", "chunk_index"], "row", parts).select("chunk_id", "row")
