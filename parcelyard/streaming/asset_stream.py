"""Random access to assets by chunks (A7, F4, J9), and jobs with progress and cancellation (K1-K3)."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as C
from ..plans.packages import Package


class AssetStream:
    """A seekable, read-only view of one asset. A read fetches and decodes the chunks it covers; the last is kept."""

    def __init__(self, package: Package, asset_id: str):
        self.package, self.asset_id, self.position = package, asset_id, 0
        rows = package.chunk_table().filter(F.col("asset_id") == asset_id).orderBy("chunk_idx").collect()
        if not rows:
            raise FileNotFoundError(asset_id)
        self.sizes = [r["original_size"] for r in rows]
        self.length = sum(self.sizes)
        self._held: tuple[int, bytes] | None = None

    def seek(self, offset: int, whence: int = 0) -> int:
        """Moves within 0 and the length; places outside are moved to the nearest end."""
        base = (0, self.position, self.length)[whence]
        self.position = max(0, min(self.length, base + offset))
        return self.position

    def read(self, n: int = -1) -> bytes:
        end = self.length if n < 0 else min(self.length, self.position + n)
        out, at = [], 0
        need = []
        for i, size in enumerate(self.sizes):
            if at < end and at + size > self.position:
                need.append((i, at, size))
            at += size
        have = {}
        missing = [i for i, _, _ in need if not (self._held and self._held[0] == i)]
        if missing:
            one = self.package.toc.filter(F.col("asset_id") == self.asset_id)
            rows = C.decode(self.package.chunks(one).filter(F.col("chunk_idx").isin(missing)), F.col("method"))
            have = {r["chunk_idx"]: bytes(r["raw"]) for r in rows.select("chunk_idx", "raw").collect()}
        if self._held:
            have.setdefault(*self._held)
        for i, start, _ in need:
            out.append(have[i][max(0, self.position - start) : end - start])
        if need:
            self._held = (need[-1][0], have[need[-1][0]])
        self.position = max(self.position, end)
        return b"".join(out)


class Resources:
    """Loads assets through an overlay of mounted packages and keeps what it has loaded, by id and type (K1)."""

    def __init__(self, packages: list[Package]):
        self.packages = packages
        self._kept: dict[tuple[str, type], object] = {}
        self._lock = threading.Lock()

    def load(self, asset_id: str, kind: type = bytes) -> object:
        """The content as ``bytes`` or ``str``; the package mounted last wins."""
        with self._lock:
            if (asset_id, kind) in self._kept:
                return self._kept[asset_id, kind]
        for p in reversed(self.packages):
            one = p.toc.filter(F.col("asset_id") == asset_id)
            got = p.read(one).collect()
            if got:
                raw = bytes(got[0]["content"])
                value = raw.decode() if kind is str else raw
                with self._lock:
                    return self._kept.setdefault((asset_id, kind), value)
        raise FileNotFoundError(asset_id)

    def unload(self) -> None:
        with self._lock:
            self._kept.clear()


class Job:
    """A job that can be cancelled from another thread, and tells its finished and all tasks (K2, K3)."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag = spark, f"job-{uuid.uuid4().hex}"

    def run(self, work: Callable[[], object]) -> object:
        self.spark.addTag(self.tag)
        try:
            return work()
        finally:
            self.spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.spark.interruptTag(self.tag)

    def progress(self) -> tuple[int, int]:
        status = self.spark.sparkContext.statusTracker()
        done = total = 0
        for stage in status.getActiveStageIds():
            info = status.getStageInfo(stage)
            if info:
                done, total = done + info.numCompletedTasks, total + info.numTasks
        return done, total
