"""A table of files that changes by commits: appended exactly once, erased by rewriting."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CommittedTable:
    """Files in folders under ``path``, and in ``_commits`` one small file for each commit: what it adds,
    what it takes away, and facts of its own.  Folders without a commit, as failed jobs leave them, are
    not read.  A commit's file is renamed into place, so it is there as a whole or not at all, and one
    of a name that exists is refused: a batch that is run again adds nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._store = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop.Path("/".join((self.path, *names) if names and "://" not in names[0] else names or (self.path,)))

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(f.getPath().getName() for f in self._store.listStatus(at)) if self._store.exists(at) else []

    def commits(self) -> dict[str, dict]:
        """Facts of all commits by their names, in order."""
        if not any(not n.startswith(".") for n in self._names("_commits")):
            return {}
        rows = self.spark.read.text(f"{self.path}/_commits", pathGlobFilter="*.json").collect()
        found = [json.loads(r.value) for r in rows]
        return {c["name"]: c for c in sorted(found, key=lambda c: c["no"])}

    def _commit(self, known: dict[str, dict], name: str, **facts) -> None:
        record = json.dumps({"name": name, "no": 1 + max((c["no"] for c in known.values()), default=-1), **facts})
        draft, final = self._path("_commits", f".{uuid.uuid4().hex}"), self._path("_commits", f"{name}.json")
        out = self._store.create(draft, False)
        out.write(bytearray(record.encode()))
        out.close()
        if self._store.exists(final) or not self._store.rename(draft, final):
            self._store.delete(draft, False)
            raise FileExistsError(f"{name} has been committed by another writer")

    def append(self, name: str, frames: dict[str, DataFrame], **facts) -> bool:
        """Adds rows to parts of the table under a name that is committed once; False if it has been.  A
        folder that an earlier attempt completed is taken as it is."""
        known = self.commits()
        if name in known:
            return False
        added = {}
        for part, rows in frames.items():
            folder = f"{part}/batch-{name}"
            if not self._store.exists(self._path(folder, "_SUCCESS")):
                rows.write.mode("overwrite").parquet(f"{self.path}/{folder}")
            added[part] = [f"{folder}/{n}" for n in self._names(folder) if n.endswith(".parquet")]
        self._commit(known, name, add=added, drop=[], **facts)
        return True

    def files(self, part: str) -> list[str]:
        live: dict[str, None] = {}
        for c in self.commits().values():
            live |= dict.fromkeys(c["add"].get(part, ()))
            for f in c["drop"]:
                live.pop(f, None)
        return list(live)

    def read(self, part: str, schema: str | None = None) -> DataFrame:
        files = self.files(part)
        if not files:
            return self.spark.createDataFrame([], schema or "void_ int")
        return self.spark.read.parquet(*(f"{self.path}/{f}" for f in files))

    def erase(self, part: str, gone: Callable[[DataFrame], DataFrame], kept: Callable[[DataFrame], DataFrame], name: str | None = None) -> int:
        """Rewrites the files that hold rows of ``gone``, without them; the others stay.  Returns how many
        files were rewritten.  The old files are deleted after the commit, so a rewrite that fails leaves
        the table as it was."""
        rows = self.read(part)
        if not self.files(part):
            return 0
        touched = gone(rows.withColumn("_file", F.col("_metadata.file_path"))).select("_file").distinct()
        names = {r[0].rsplit(f"/{part}/", 1)[-1] for r in touched.collect()}
        old = [f for f in self.files(part) if f.removeprefix(f"{part}/") in names]
        if not old:
            return 0
        name = name or f"erase-{uuid.uuid4().hex}"
        folder = f"{part}/{name}"
        kept(self.spark.read.parquet(*(f"{self.path}/{f}" for f in old))).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        added = [f"{folder}/{n}" for n in self._names(folder) if n.endswith(".parquet")]
        self._commit(self.commits(), name, add={part: added}, drop=old)
        for f in old:
            self._store.delete(self._path(f), False)
        return len(old)


def route_late(rows: DataFrame, path: str, ts: str, delay_s: float = 0.0) -> CommittedTable:
    """Reads a stream to its end and puts its rows into the parts ``clean`` and ``late`` of a table: late
    is what lies behind the watermark, the highest time of all earlier batches less ``delay_s``.  A batch
    that is run again finds the same watermark in the commits, and adds nothing twice."""
    table = CommittedTable(rows.sparkSession, path)

    def put(batch: DataFrame, batch_id: int) -> None:
        highs = [c["high"] for n, c in table.commits().items() if c["batch"] < batch_id and c["high"] is not None]
        us = F.unix_micros(F.col(ts).cast("timestamp"))
        behind = us < max(highs) - int(delay_s * 1_000_000) if highs else F.lit(False)
        high = batch.agg(F.max(us)).first()[0]
        frames = {"clean": batch.filter(~behind | behind.isNull()), "late": batch.filter(behind)}
        table.append(f"{batch_id:09d}", frames, batch=batch_id, high=high)

    writer = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_progress")
    writer.foreachBatch(put).start().awaitTermination()
    return table


def run_to_end(rows: DataFrame, path: str, timers: bool = True) -> tuple[DataFrame, int]:
    """Runs a stream over all that there is; what it wrote, and the rows of state that it has left.

    State is in RocksDB.  Batches without data let event-time timers run; a stream in processing time
    (state with a time to live) would have one after the other for ever, so it goes without
    (``timers=False``)."""
    spark = rows.sparkSession
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": str(timers).lower()}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        writer = rows.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/_progress")
        query = writer.format("parquet").option("path", f"{path}/rows").start()
        query.awaitTermination()
        last = query.lastProgress
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    state = sum(o.numRowsTotal for o in last.stateOperators) if last else 0
    return spark.read.schema(rows.schema).parquet(f"{path}/rows"), state


def source(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files under ``path`` as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def run_in_parts(parts: list[DataFrame], build: Callable[[DataFrame], DataFrame], path: str, timers: bool = True) -> DataFrame:
    """What a stream writes that meets ``parts`` one after the other: each is added to its files, and the
    stream goes on from its checkpoint until it has read them."""
    for n, part in enumerate(parts):
        part.write.parquet(f"{path}/in/{n}")
        out, _ = run_to_end(build(source(part.sparkSession, f"{path}/in", part.schema)), f"{path}/out", timers)
    return out
