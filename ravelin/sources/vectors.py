"""Vector indexes named by their content, checked while they are read.

Each row is stored with a hash of its id and vector; the hashes of a file's rows are combined to the file's digest, and the digests
of all files, in order of their names, to the root of the index, a SHA-256. The manifest beside the files has the digests, the
registry of versions has the root: an index is read only if both agree, if each file's stored hashes give its digest (a scan of
that one column), and if each row's hash is that of its id and vector (looked at as the search reads it). So a flipped byte, a row
or file that is lost, doubled or swapped for another index's, fails the search instead of changing its answer."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dense import dense_topk
from .versions import IndexIntegrityError, VersionStore

#: The column that holds a row's hash.
HASH = "content_hash"


def digests(rows: DataFrame) -> dict[str, str]:
    """Per file: number, sum and exclusive or of its rows' stored hashes. The driver gets a row a file."""
    parts = F.concat_ws(":", F.count("*"), F.sum(F.col(HASH).cast("decimal(38,0)")).cast("string"), F.bit_xor(HASH).cast("string"))
    return {r["name"]: r["digest"] for r in rows.groupBy(F.col("_metadata.file_name").alias("name")).agg(parts.alias("digest")).collect()}


def root_of(files: dict[str, str]) -> str:
    return hashlib.sha256("\n".join(f"{name} {digest}" for name, digest in sorted(files.items())).encode()).hexdigest()


class VectorIndex:
    """Vectors (id, vector) as versions of a ``VersionStore``."""

    def __init__(self, store: VersionStore):
        self.store, self.spark = store, store.spark

    def write(self, version: str, vectors: DataFrame, created_at: int, **about) -> str:
        """Stores and registers a version, ready to be activated; its root. A version that fails is registered as failed."""
        folder = f"{self.store.root}/{version}/data"
        self.store.begin(version, created_at, **about)
        try:
            hashed = vectors.select("id", "vector").withColumn(HASH, F.xxhash64("id", "vector"))
            hashed.write.parquet(folder)
            files = digests(self.spark.read.parquet(folder))
            manifest = {"version_id": version, "files": files, "root": root_of(files)}
            if not self.store.files.create(f"{version}/manifest.json", json.dumps(manifest, sort_keys=True)):
                raise FileExistsError(version)
            self.store.change(lambda states: states | {version: states[version] | {"status": "ready", "root": manifest["root"]}})
        except Exception as error:
            self.store.failed(version, str(error))
            raise
        return manifest["root"]

    def active(self) -> str:
        found = [k for k, v in self.store.registry().items() if v["status"] == "active"]
        if not found:
            raise IndexIntegrityError("no active version")
        return found[0]

    def read(self, version: str | None = None) -> DataFrame:
        """id and vector of a version (the active one), whose rows are checked as they are read."""
        version = version or self.active()
        if not self.store.files.names(version) or "manifest.json" not in self.store.files.names(version):
            raise IndexIntegrityError(f"{version}: no manifest")
        manifest = json.loads(self.store.files.get(f"{version}/manifest.json"))
        if not root_of(manifest["files"]) == manifest["root"] == self.store.registry().get(version, {}).get("root"):
            raise IndexIntegrityError(f"{version}: manifest and registry name different contents")
        rows = self.spark.read.parquet(f"{self.store.root}/{version}/data")
        stored = digests(rows)
        if stored != manifest["files"]:
            wrong = sorted(k for k in stored.keys() | manifest["files"].keys() if stored.get(k) != manifest["files"].get(k))
            raise IndexIntegrityError(f"{version}: digest of {wrong[0]} differs")
        right = F.xxhash64("id", "vector") == F.col(HASH)
        told = F.raise_error(F.concat(F.lit(f"{version}: content of row "), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(" differs from its hash")))
        return rows.select("id", F.when(right, F.col("vector")).otherwise(told.cast(rows.schema["vector"].dataType)).alias("vector"))

    def search(self, queries: DataFrame, top_k: int = 10, version: str | None = None) -> DataFrame:
        """``dense_topk`` over a stored version."""
        return dense_topk(queries, self.read(version), top_k)
