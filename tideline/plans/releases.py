"""Releases as folders behind a pointer, a run ledger, and fits cached by their input's digest."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.cdc import IntegrityError, dataset_digest


class ReleaseError(ValueError):
    """A release is not in the state that the step needs."""


class Releases:
    """staging -> active -> superseded; one active release at a time.

    Data lie under <root>/data/<id>. The state of all releases is one small JSON file a version,
    written aside and renamed to its number; the newest number is the state, so a crash at any
    point leaves the old state or the new one. Of two writers of one number the later fails.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._version = 0

    def _read(self) -> dict:
        self._version = max(self._versions(), default=0)
        if not self._version:
            return {}
        return json.loads(self.spark.read.option("wholetext", True).text(self._state_path(self._version)).first()[0])

    def _state_path(self, version: int) -> str:
        return f"{self.root}/state/{version:012d}.json"

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.root}/state")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [int(n[:-5]) for n in names if n.endswith(".json")]

    def _write(self, state: dict, kept: int = 5) -> None:
        at = self._path(self._state_path(self._version + 1))
        temp = self._path(f"{self.root}/state/.new-{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(at) or not self._fs.rename(temp, at):
            self._fs.delete(temp, False)
            raise ReleaseError("the state changed meanwhile")
        self._version += 1
        for old in sorted(self._versions())[:-kept]:
            self._fs.delete(self._path(self._state_path(old)), False)

    def _step(self, release: str, need: str, to: str) -> None:
        state = self._read()
        if state.get(release, {}).get("status") != need:
            raise ReleaseError(f"{release} is {state.get(release, {}).get('status', 'absent')}, not {need}")
        if to == "active":
            for other in state.values():
                if other["status"] == "active":
                    other["status"] = "superseded"
            state[release]["activated_at"] = time.time()
        state[release]["status"] = to
        self._write(state)

    def stage(self, release: str, datasets: dict[str, tuple[DataFrame, str]]) -> None:
        """Write datasets (frame, key column) with their counts and digests."""
        state = self._read()
        if release in state:
            raise ReleaseError(f"{release} is there already")
        seals = {}
        for name, (df, key) in datasets.items():
            path = f"{self.root}/data/{release}/{name}"
            df.write.mode("overwrite").parquet(path)
            seal = dataset_digest(self.spark.read.parquet(path), key, sorted(df.columns), 16).first()
            seals[name] = {"key": key, "rows": seal["row_count"] or 0, "digest": seal["digest"]}
        state[release] = {"status": "staging", "datasets": seals, "activated_at": None}
        self._write(state)

    def verify(self, release: str) -> None:
        for name, seal in self._read()[release]["datasets"].items():
            df = self.spark.read.parquet(f"{self.root}/data/{release}/{name}")
            now = dataset_digest(df, seal["key"], sorted(df.columns), 16).first()
            if (now["row_count"] or 0, now["digest"]) != (seal["rows"], seal["digest"]):
                raise IntegrityError(f"{release}/{name} differs from its seal")

    def activate(self, release: str) -> None:
        self.verify(release)
        self._step(release, "staging", "active")

    def restore(self, release: str) -> None:
        self.verify(release)
        self._step(release, "superseded", "active")

    def discard(self, release: str) -> None:
        self._step(release, "staging", "discarded")
        self._fs.delete(self._path(f"{self.root}/data/{release}"), True)

    def prune(self, keep: int) -> dict:
        """Delete the oldest superseded release beyond the `keep` newest."""
        state = self._read()
        old = sorted((k for k, v in state.items() if v["status"] == "superseded"), key=lambda k: -state[k]["activated_at"])[keep:]
        gone = old[-1:]
        for k in gone:
            self._fs.delete(self._path(f"{self.root}/data/{k}"), True)
            state[k]["status"] = "deleted"
        self._write(state)
        return {"deleted_count": len(gone), "has_more": len(old) > 1, "paths": gone}

    def status(self) -> dict[str, str]:
        return {k: v["status"] for k, v in self._read().items()}

    def table(self, name: str) -> DataFrame:
        """The dataset of the active release."""
        for k, v in self._read().items():
            if v["status"] == "active":
                return self.spark.read.parquet(f"{self.root}/data/{k}/{name}")
        raise ReleaseError("no release is active")


class RunLedger:
    """Ordered stages of a run with wall seconds, the driver's CPU seconds, and row counts; counting belongs to the stage."""

    def __init__(self, stages: list[str]):
        self.stages, self.rows = stages, []

    def run(self, stage: str, work: Callable[[], DataFrame | None]) -> DataFrame | None:
        at = len(self.rows)
        if at >= len(self.stages) or self.stages[at] != stage:
            raise ReleaseError(f"stage {stage} is out of order")
        wall, cpu = time.time(), time.process_time()
        row = {"stage": stage, "status": "failed"}
        self.rows.append(row)
        out = work()
        rows = None if out is None else out.count()
        row |= {"status": "finished", "wall_s": time.time() - wall, "driver_cpu_s": time.process_time() - cpu, "rows": rows}
        return out


def cached_fit(spark: SparkSession, root: str, source: DataFrame, key: str, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of fit(source), kept under the digest of source's rows."""
    digest = dataset_digest(source, key, sorted(source.columns), 64).first()["digest"]
    path = f"{root.rstrip('/')}/{digest}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        fit(source).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
