"""Reservations of credits in a commit log, so that two writers can't both take the last ones.

A commit is a numbered file that names the rows it adds. It is put in place only if its number is free; who comes second reads what the first has
taken and decides anew. The state is what the commits say in their order, so it is the same whoever reads it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import history

RESERVED = "reservation_id string, at timestamp, credits long, state string"
SETTLED = "reservation_id string, credits long, succeeded boolean"


class CommitLog:
    """Numbered JSON entries in a folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._jvm, self._conf = jvm, conf
        self._path = lambda name="": jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))
        self._fs = self._path().getFileSystem(conf)
        self._fs.mkdirs(self._path("log"))

    def entries(self) -> list[dict]:
        """All entries in order. Numbers have no gaps."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path("log")) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        rows = self.spark.read.text([f"{self.folder}/log/{n}" for n in names]).select("value", F.col("_metadata.file_name").alias("name")).collect()
        return [json.loads(r.value) for r in sorted(rows, key=lambda r: r.name)]

    def put(self, number: int, entry: dict) -> bool:
        """Makes entry the one of this number; False if it has one. The entry is whole once it can be seen: it is written aside, then linked (local files) or
        renamed without overwriting, both of which fail if the name is taken."""
        aside, place = self._path(f"log/.{uuid.uuid4().hex}"), self._path(f"log/{number:012}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if self._fs.getUri().getScheme() == "file":
                file = self._jvm.java.io.File
                self._jvm.java.nio.file.Files.createLink(file(place.toUri().getPath()).toPath(), file(aside.toUri().getPath()).toPath())
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self._conf).rename(aside, place, options)
        except Exception as error:
            if "AlreadyExists" not in str(error):
                raise
            return False
        finally:
            self._fs.delete(aside, False)
        return True


class ReservationLedger:
    """Reservations under a monthly allowance. reserve() and settle() may be called by any number of writers at once."""

    def __init__(self, spark: SparkSession, folder: str, allowance: int) -> None:
        self.spark, self.folder, self.allowance, self.log = spark, folder.rstrip("/"), allowance, CommitLog(spark, folder)

    def _rows(self, entries: list[dict], kind: str, schema: str) -> DataFrame:
        places = [f"{self.folder}/{e['rows']}" for e in entries if e["kind"] == kind]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def ledger(self, entries: list[dict] | None = None) -> DataFrame:
        """reservation_id, at, credits, state (reserved, success, failed), from all commits. The first outcome of a reservation counts."""
        entries = self.log.entries() if entries is None else entries
        settled = None
        for i, e in enumerate(entries):
            if e["kind"] == "settled":
                rows = self._rows([e], "settled", SETTLED).withColumn("commit", F.lit(i))
                settled = rows if settled is None else settled.unionAll(rows)
        reserved = self._rows(entries, "reserved", RESERVED)
        if settled is None:
            return reserved
        first = settled.groupBy("reservation_id").agg(F.min(F.struct("commit", "credits", "succeeded")).alias("o")).select("reservation_id", "o.credits", "o.succeeded")
        return history.settle(reserved, first)

    def _commit(self, kind: str, make) -> DataFrame:
        """Writes what make(ledger) gives and commits it under the next number; decides anew when another writer was first."""
        while True:
            entries = self.log.entries()
            name = f"{kind}-{uuid.uuid4().hex}"
            made = make(self.ledger(entries))
            made.write.parquet(f"{self.folder}/{name}")
            if self.log.put(len(entries), {"kind": kind, "rows": name}):
                return self.spark.read.schema(made.schema).parquet(f"{self.folder}/{name}")
            self.log._fs.delete(self.log._path(name), True)

    def reserve(self, requests: DataFrame, credits: int = 1) -> DataFrame:
        """requests (reservation_id, at) with state: reserved, in the order of at and id as far as the month's allowance goes, else refused. A request whose id
        has a reservation already gets it back and takes nothing, so a repeated call is harmless."""
        kind = F.col("reservation_id").cast("string").alias("reservation_id")
        asked = requests.select(kind, "at").dropDuplicates(["reservation_id"])

        def decide(ledger: DataFrame) -> DataFrame:
            new = asked.join(ledger.select("reservation_id"), "reservation_id", "left_anti")
            taken = history.reserve(ledger, new, self.allowance, credits).filter("state = 'reserved'")
            return taken.select("reservation_id", "at", F.col("credits").cast("long").alias("credits"), "state")

        self._commit("reserved", decide)
        held = self.ledger().select("reservation_id", F.lit(True).alias("held"))
        return asked.join(held, "reservation_id", "left").select("reservation_id", "at", F.when(F.col("held"), "reserved").otherwise("refused").alias("state"))

    def settle(self, outcomes: DataFrame) -> None:
        """outcomes (reservation_id, credits, succeeded): what reservations really cost. Those of unknown or settled reservations change nothing."""
        rows = outcomes.select(F.col("reservation_id").cast("string").alias("reservation_id"), F.col("credits").cast("long").alias("credits"), "succeeded")
        self._commit("settled", lambda ledger: rows)

    def usage(self) -> DataFrame:
        return history.usage(self.ledger(), "month", self.allowance)
