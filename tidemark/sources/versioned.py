"""A table of versions: each batch opens versions of what is new or changed and closes what is gone.

A batch is written to a folder of its own and counts once the ledger names it.
The ledger is a folder of small files, numbered without gaps; a file is created
only if its number is free, so of two writers one wins and the other one starts
again from the new state. A batch whose id the ledger has writes nothing, and
one that breaks off leaves a folder that nothing reads.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import StructType


class VersionedStore:
    """Versions of rows by ``key``; ``schema`` is that of a batch. Null keys are refused, of a batch's rows with one key the last by digest counts."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema
        self.columns = [f.name for f in schema]
        self.stored = StructType([*schema, *StructType.fromDDL("_digest string, _state string, _number long, _at timestamp")])

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ledger(self) -> list[dict]:
        """The committed batches in their order: number, batch, at, folder, counts."""
        where, fs = self._fs(f"{self.folder}/ledger")
        if not fs.exists(where):
            return []
        lines = self.spark.read.text(f"{self.folder}/ledger").collect()  # one short line a batch
        return sorted((json.loads(r.value) for r in lines), key=lambda x: x["number"])

    def _commit(self, entry: dict) -> bool:
        """Create the ledger's next file; False if another writer has done so."""
        where, fs = self._fs(f"{self.folder}/ledger/{entry['number']:09d}")
        try:
            out = fs.create(where, False)
        except Exception as error:  # the file is there: py4j wraps the reason
            if fs.exists(where):
                return False
            raise error
        out.write(bytearray(json.dumps(entry).encode() + b"\n"))
        out.close()
        return True

    def _deltas(self) -> DataFrame:
        folders = [e["folder"] for e in self.ledger()]
        if not folders:
            return self.spark.createDataFrame([], self.stored)
        return self.spark.read.schema(self.stored).parquet(*folders)

    def latest(self) -> DataFrame:
        """(key, _digest, _state) of the last entry of each key, gone ones included; reads no other column."""
        last = F.max_by(F.struct("_digest", "_state"), "_number").alias("last")
        return self._deltas().groupBy(self.key).agg(last).select(self.key, "last.*")

    def merge(self, batch: DataFrame, batch_id: str, at: str, *, whole: bool = False, retries: int = 5) -> dict:
        """Write a batch that holds from ``at`` on; counts of rows by state: new, changed, gone (same ones aren't written).

        ``whole``: the batch is all there is, so keys that it lacks are gone. Times must not go back: ValueError.
        """
        content = [c for c in self.columns if c != self.key]
        digest = F.sha2(F.concat(*(F.concat(F.coalesce(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in content)), 256)
        given = batch.filter(F.col(self.key).isNotNull()).select(*self.columns, digest.alias("_digest"))
        given = given.groupBy(self.key).agg(F.max_by(F.struct(*content, "_digest"), "_digest").alias("v")).select(self.key, "v.*")
        for _ in range(retries):
            ledger = self.ledger()
            if any(e["batch"] == batch_id for e in ledger):
                return next(e["counts"] for e in ledger if e["batch"] == batch_id)
            if ledger and at < ledger[-1]["at"]:
                raise ValueError(f"{at} is before the last batch's {ledger[-1]['at']}")
            number = len(ledger)
            old = self.latest().select(self.key, F.col("_digest").alias("_old"), (F.col("_state") == "gone").alias("_gone"))
            both = given.join(old, self.key, "full")
            there = F.col("_digest").isNotNull()
            state = F.when(there & (F.col("_old").isNull() | F.col("_gone")), "new").when(there & (F.col("_old") != F.col("_digest")), "changed")
            if whole:
                state = state.when(~there & ~F.col("_gone"), "gone")
            folder = f"{self.folder}/delta/{number:09d}-{uuid.uuid4().hex}"
            changes = both.withColumn("_state", state).filter("_state is not null")
            changes.select(*self.columns, "_digest", "_state", F.lit(number).cast("long").alias("_number"), F.lit(at).cast("timestamp").alias("_at")).write.parquet(folder)
            written = {r["_state"]: r["count"] for r in self.spark.read.schema(self.stored).parquet(folder).groupBy("_state").count().collect()}
            counts = {s: written.get(s, 0) for s in ("new", "changed", "gone")}
            if self._commit({"number": number, "batch": batch_id, "at": at, "folder": folder, "counts": counts}):
                return counts
        raise RuntimeError(f"other writers were faster {retries} times")

    def history(self) -> DataFrame:
        """Every version with valid_from and valid_to (null: still valid)."""
        order = W.Window.partitionBy(self.key).orderBy("_number")  # the versions of one key
        ended = self._deltas().withColumn("valid_to", F.lead("_at").over(order)).filter("_state <> 'gone'")
        return ended.select(*self.columns, F.col("_at").alias("valid_from"), "valid_to")

    def as_of(self, at: str) -> DataFrame:
        """The rows valid at a moment; a version is valid from its start and no longer at its end."""
        moment = F.lit(at).cast("timestamp")
        return self.history().filter((F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))).select(*self.columns)

    def follow(self, stream: DataFrame, checkpoint: str, at: str, name: str = "stream"):
        """A started stream that merges each micro-batch once, even if it is run again after a failure."""

        def take(batch: DataFrame, number: int) -> None:
            self.merge(batch, f"{name}-{number}", at)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
