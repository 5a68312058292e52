"""The history index as a table with versions: of its parts only those that a batch touches are written anew.

A version is a manifest that names a folder for each part of the repos. A batch writes folders of its own and then the next manifest,
by one rename, so readers see the old version or the new one, and a batch that dies leaves the old one. Folders that no kept manifest names are swept.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftwood.functions import fixed
from driftwood.operators import history
from driftwood.operators.tables import dropped, written

PARTS = 256


class VersionedIndex:
    """An index of entries `schema` (repo, sha, ts, type, ...) at `path`, by version of the features; one writer at a time.

    parts holds for a new index; an old one keeps its own. An index of other features counts as empty, and its next version replaces it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, features: int, parts: int = PARTS, keep: int = 2):
        self.spark, self.path, self.features, self.parts, self.keep = spark, path.rstrip("/"), features, parts, keep
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.files = self._place("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, name: str) -> list[str]:
        where = self._place(name)
        return sorted(s.getPath().getName() for s in self.files.listStatus(where)) if self.files.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._listed("manifests") if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """Of a version, by default the newest; without any, one of no parts."""
        known = self.versions()
        if not known:
            return {"version": 0, "features": self.features, "parts": self.parts, "batch": -1, "folders": {}}
        source = self.files.open(self._place(f"manifests/v{known[-1] if version is None else version}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    @staticmethod
    def part(repo: Column | str, parts: int) -> Column:
        return F.pmod(F.xxhash64(repo), F.lit(parts)).cast("int")

    def _folders(self, held: dict, parts: list[int] | None = None) -> DataFrame:
        some = [f for p, f in held["folders"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in some]) if some else self.spark.createDataFrame([], self.schema)

    def read(self, repo: str | None = None, version: int | None = None) -> DataFrame | None:
        """All entries of a version, or those of one repo, from its part alone; None if the index is of other features."""
        held = self.manifest(version)
        if held["features"] != self.features:
            return None
        if repo is None:
            return self._folders(held)
        at = self.spark.range(1).select(self.part(F.lit(repo), held["parts"])).first()[0]
        return self._folders(held, [at]).where(F.col("repo") == repo)

    def update(self, fresh: DataFrame, window: int = fixed.WINDOW, batch: int | None = None) -> int:
        """The version after adding entries that the index lacks; each touched repo keeps its newest `window`.

        A batch number that the index has already seen changes nothing, so that one that is run again after a failure counts once. Null repos are a repo.
        """
        held = self.manifest()
        if held["features"] != self.features:
            held = {**held, "folders": {}, "features": self.features, "batch": -1}
        if batch is not None and batch <= held["batch"]:
            return held["version"]
        at = self.part("repo", held["parts"])
        new = written(fresh.select(*self.schema.names).dropDuplicates(["repo", "sha"]))
        touched = [r[0] for r in new.select(at.alias("p")).distinct().collect()]  # as many as there are parts at most
        folder = f"data/{uuid.uuid4().hex}"
        if touched:
            old = self._folders(held, touched)
            both = old.unionByName(new.join(old.select("repo", "sha"), (new["repo"].eqNullSafe(old["repo"])) & (new["sha"] == old["sha"]), "left_anti"))
            kept = history.newest(both, window).withColumn("part", at)
            kept.repartition(len(touched), "part").sortWithinPartitions("part", "repo").write.partitionBy("part").parquet(f"{self.path}/{folder}")
        dropped(new)
        made = {n.removeprefix("part="): f"{folder}/{n}" for n in self._listed(folder) if n.startswith("part=")}
        after = {"version": held["version"] + 1, "features": self.features, "parts": held["parts"], "batch": held["batch"] if batch is None else batch, "folders": held["folders"] | made}
        self._commit(after)
        self._sweep()
        return after["version"]

    def _commit(self, manifest: dict) -> None:
        draft, final = self._place(f"manifests/.{uuid.uuid4().hex}"), self._place(f"manifests/v{manifest['version']}.json")
        out = self.files.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if self.files.exists(final) or not self.files.rename(draft, final):
            self.files.delete(draft, False)
            raise RuntimeError(f"version {manifest['version']} was written meanwhile")

    def _sweep(self) -> None:
        known = self.versions()
        for version in known[: -self.keep]:
            self.files.delete(self._place(f"manifests/v{version}.json"), False)
        named = {f for v in known[-self.keep :] for f in self.manifest(v)["folders"].values()}
        for folder in self._listed("data"):
            for part in self._listed(f"data/{folder}"):
                if part.startswith("part=") and f"data/{folder}/{part}" not in named:
                    self.files.delete(self._place(f"data/{folder}/{part}"), True)
            if not any(f.startswith(f"data/{folder}/") for f in named):
                self.files.delete(self._place(f"data/{folder}"), True)
