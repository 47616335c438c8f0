"""Removal of repeated lines with levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetdelta.llm.common import encoded, per_batch
from sheetdelta.session import cut, scratch_path

#: Bytes that are stripped at both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, least: int) -> bytes | None:
    """Digest of the stripped line in lower case (A-Z only); None if it has under ``least`` code points."""
    line = line.strip(BLANK)
    if len(line) < least or len(line) < 4 * least and len(line.decode()) < least:
        return None
    return xxhash.xxh3_128_digest(line.lower())


class LineRuns:
    """Line hashes of all batches so far, in levels of sorted runs.

    A run is a table bucketed and sorted by hash, with the hashes that its batch brought
    first, the number of their documents and the largest key. No hash is in two runs. A
    batch is joined to the runs without moving them: what no run holds becomes the run of
    the batch, the rest is noted beside it as repeats. ``fanout`` runs of a level are
    merged to one run of the next, so a hash is rewritten once per level and a batch meets
    a logarithmic number of runs. All tables lie in the shared folder.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4) -> None:
        self.spark, self.fanout = spark, fanout
        # as many as a shuffle makes, so that an aggregated batch meets the runs as it is
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.repeats: list[str] = []

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = rows.write.partitionBy("known").bucketBy(self.buckets, "hash").sortBy("hash")
        writer.option("path", scratch_path(self.spark, name)).saveAsTable(name)
        return name

    def _held(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("not known").select("hash", "docs", "keeper")

    def add(self, lines: DataFrame) -> DataFrame:
        """Adds a batch of (hash, key), distinct; returns its rows (hash, docs, keeper, known)."""
        batch = lines.groupBy("hash").agg(F.count("*").alias("docs"), F.max("key").alias("keeper"))
        known = F.lit(False)
        for k, name in enumerate(self.runs()):
            run = self.spark.table(name).filter("not known").select("hash", F.lit(True).alias(f"in{k}"))
            batch, known = batch.join(run.hint("merge"), "hash", "left"), known | F.col(f"in{k}").isNotNull()
        name = self._write(batch.select("hash", "docs", "keeper", known.alias("known")))
        self.repeats.append(name)
        self._push(name, 0)
        return self.spark.table(name)

    def _push(self, name: str, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            merged = None
            for run in self.levels[level]:
                merged = self._held(run) if merged is None else merged.unionByName(self._held(run))
            self.levels[level] = []
            self._push(self._write(merged.withColumn("known", F.lit(False)).repartition(self.buckets, "hash")), level + 1)

    def common(self, least: int) -> DataFrame:
        """(hash, keeper) of hashes in at least ``least`` documents of all batches.

        Only hashes that a later batch repeated, or that one batch brought often enough, are gathered.
        """
        again = None
        for name in self.repeats:
            part = self.spark.table(name).filter("known").select("hash", "docs", "keeper")
            again = part if again is None else again.unionByName(part)
        # one row per repeated hash, so that a run gives each of its rows at most once
        again = cut(again.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper")))
        more = again.select("hash", F.col("docs").alias("_docs"), F.col("keeper").alias("_keeper"))
        found = None
        for name in self.runs():
            own = self._held(name).join(more, "hash", "left").select(
                "hash", (F.col("docs") + F.coalesce("_docs", F.lit(0))).alias("docs"), F.greatest("keeper", "_keeper").alias("keeper"),
            ).filter(F.col("docs") >= least)
            found = own if found is None else found.unionByName(own)
        return found.select("hash", "keeper")

    def drop(self) -> None:
        """Forgets the tables; their files go when the session ends."""
        for name in {*self.repeats, *self.runs()}:
            self.spark.sql(f"drop table if exists {name}")


def line_hashes(docs: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(hash, key) of the distinct lines of every row with a key that are long enough."""

    def work(batch) -> dict[str, object]:
        found = [{line_key(line, least) for line in t.split(b"\n")} - {None} for t in encoded(batch.column(1))]
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return {"hash": pa.array([h for f in found for h in f], pa.binary()), "key": batch.column(0).take(pa.array(owner))}

    kind = docs.schema[key].dataType.simpleString()
    return per_batch(docs.filter(F.col(key).isNotNull()).select(key, F.col(text).cast("string")), work, f"hash binary, key {kind}")


def drop_repeated_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, batches: int = 6, fanout: int = 3,
) -> DataFrame:
    """Each row's text without lines that many documents hold: key, n_lines, n_dropped, kept.

    Lines are compared stripped and with A-Z lowered. One of ``least_chars`` code points
    or more that ``least_docs`` documents hold is dropped, with all its places, except from
    the document with the largest key. Null and empty texts are one empty line. Rows with
    one key are one document for this count, a row each in the result. A row with a null
    key is no document: it keeps all its lines. Other columns are not read. The documents
    come in ``batches`` deliveries by a hash of the key, which are added to the runs one by
    one; their number changes the work, not the result.
    """
    spark = docs.sparkSession
    lines = line_hashes(docs, key, text, least_chars)
    path = scratch_path(spark, "lines")
    lines.withColumn("batch", F.pmod(F.xxhash64("key"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"hash binary, key {docs.schema[key].dataType.simpleString()}, batch int").parquet(path)
    runs = LineRuns(spark, fanout)
    # rows may share a key, and then hold a line once each
    repeated_keys = bool(docs.groupBy(key).agg(F.count("*").alias("n")).filter(f"n > 1 and {_quoted(key)} is not null").limit(1).count())
    lines = lines.distinct() if repeated_keys else lines
    for batch in range(batches):
        runs.add(lines.filter(F.col("batch") == batch).select("hash", "key"))
    common = cut(runs.common(least_docs))
    runs.drop()
    wrong = lines.join(common, "hash").filter(F.col("key") < F.col("keeper")).groupBy("key").agg(F.collect_list("hash").alias("hashes"))
    plain = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    joined = plain.join(wrong, "key", "left").select("key", "text", "hashes")

    def work(batch) -> dict[str, object]:
        total, dropped, kept = [], [], []
        for value, hashes in zip(encoded(batch.column(1)), batch.column(2).to_pylist()):
            own = value.split(b"\n")
            total.append(len(own))
            if hashes:
                gone = set(hashes)
                own = [line for line in own if line_key(line, least_chars) not in gone]
                value = b"\n".join(own)
            dropped.append(total[-1] - len(own))
            kept.append(value.decode())
        return {"key": batch.column(0), "n_lines": total, "n_dropped": dropped, "kept": kept}

    kind = docs.schema[key].dataType.simpleString()
    return per_batch(joined, work, f"key {kind}, n_lines long, n_dropped long, kept string").withColumnRenamed("key", key)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
