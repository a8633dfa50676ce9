"""Stored tables that follow their sources: snapshots of partitions, and a manifest of what is current.

A stored table is a folder with data in ``data/snapshot=<id>/<partition columns>/`` and a manifest, one file for each
commit. A commit names the source files' fingerprint and, for every partition, the snapshot that holds it, its rows and
a digest of them. ``refresh`` does nothing while the fingerprint stays. After a change it computes the digests anew, writes
only the partitions whose digest differs to a new snapshot, and commits; files of unchanged partitions stay where they
are, and readers of an earlier commit keep theirs. The manifest has one row per partition (book or
lexicon), which is what the driver holds; digests are summed on the executors.

Rows are sorted inside, so that the bounds of a chapter or of a range of numbers pass over the rest of a file."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern import schemas
from lectern.operators.search import POSTINGS

_MANIFEST = "fingerprint string, partition string, snapshot string, n_rows long, digest string, commit long"
_FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType())])


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A digest of the names, sizes and times of all files below the paths; their content is not read, and one row reaches the driver."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select(*_FILES.fieldNames())
    one = files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes"), F.sum(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)")).alias("d")).first()
    return f"{one['n']}-{one['bytes']}-{one['d']}"


@dataclass(frozen=True)
class StoredTable:
    """A table below ``path`` with these columns, in folders by ``parts`` and sorted by ``order`` inside."""

    spark: SparkSession
    path: str
    schema: T.StructType
    parts: tuple[str, ...]
    order: tuple[str, ...]

    def _partition(self):
        return F.to_json(F.struct(*self.parts), {"ignoreNullFields": "false"})

    def manifest(self) -> DataFrame | None:
        """The rows of the last commit, or None before the first."""
        try:
            commits = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest")
        except AnalysisException:  # no such folder
            return None
        last = commits.agg(F.max("commit")).first()[0]
        return None if last is None else commits.where(F.col("commit") == last)

    def _digests(self, rows: DataFrame) -> DataFrame:
        """One row per partition: its rows, and the sum of their hashes, which does not depend on their order."""
        whole = F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(self.schema.fieldNames())]).cast("decimal(38,0)"))
        return rows.groupBy(self._partition().alias("partition")).agg(F.count("*").alias("n_rows"), whole.cast("string").alias("digest"))

    def _write(self, rows: DataFrame, snapshot: str) -> None:
        keys = [*self.parts, *self.order]
        ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
        ordered.withColumn("snapshot", F.lit(snapshot)).write.mode("append").partitionBy("snapshot", *self.parts).parquet(f"{self.path}/data")

    def refresh(self, source_rows: Callable[[], DataFrame], source: str) -> list[str]:
        """Makes the stored table equal to the rows that the sources of that fingerprint give. Returns the partitions that were written."""
        before = self.manifest()
        old = {} if before is None else {r["partition"]: r for r in before.where("partition IS NOT NULL").collect()}
        at = None if before is None else before.select("fingerprint", "commit").first()
        if at and at["fingerprint"] == source:
            return []
        rows = source_rows().select(*self.schema.fieldNames())
        snapshot = uuid.uuid4().hex
        if old:
            now = {r["partition"]: r for r in self._digests(rows).collect()}
            changed = [p for p, r in now.items() if p not in old or (old[p]["digest"], old[p]["n_rows"]) != (r["digest"], r["n_rows"])]
            if changed:
                self._write(rows.where(self._partition().isin(changed)), snapshot)
        else:  # everything is new: written in one pass, and the digests read back
            self._write(rows, snapshot)
            now = {r["partition"]: r for r in self._digests(self._snapshot([snapshot])).collect()}
            changed = list(now)
        entries = [(source, p, snapshot if p in changed else old[p]["snapshot"], r["n_rows"], r["digest"]) for p, r in now.items()]
        commit = (at["commit"] if at else 0) + 1
        # an empty table has one row without a partition, which holds the fingerprint
        table = self.spark.createDataFrame(entries or [(source, None, None, 0, None)], _MANIFEST.rsplit(",", 1)[0])
        table.coalesce(1).write.mode("append").json(f"{self.path}/manifest/commit={commit}")
        return sorted(changed)

    def current(self, source: str) -> DataFrame | None:
        """The rows if the last commit is of these sources, else None; nothing is written."""
        manifest = self.manifest()
        at = None if manifest is None else manifest.select("fingerprint").first()
        return self.read() if at and at["fingerprint"] == source else None

    def _snapshot(self, snapshots: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("snapshot", T.StringType())])
        return self.spark.read.schema(schema).parquet(f"{self.path}/data").where(F.col("snapshot").isin(snapshots)).select(*self.schema.fieldNames())

    def read(self) -> DataFrame:
        """The rows of the last commit. Partitions are read from their snapshots; filters on the partition columns pass over folders, others over parts of files."""
        manifest = self.manifest()
        held = [] if manifest is None else [(r["snapshot"], r["partition"]) for r in manifest.where("partition IS NOT NULL").collect()]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema.fields, T.StructField("snapshot", T.StringType())])
        by_snapshot: dict[str, list[str]] = {}
        for snapshot, partition in held:
            by_snapshot.setdefault(snapshot, []).append(partition)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/data")
        if len(by_snapshot) == 1:
            current = F.col("snapshot") == next(iter(by_snapshot))
        else:
            current = F.lit(False)
            for snapshot, partitions in by_snapshot.items():
                current = current | ((F.col("snapshot") == snapshot) & self._partition().isin(partitions))
        return rows.where(current).select(*self.schema.fieldNames())


def verses(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, schemas.VERSES, ("version", "engs"), ("chap", "sec"))


def lexicon(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, schemas.LEXICON, ("dic_type",), ("num", "sn"))


#: Folders of chapters by their number.
CHAPTER_BUCKETS = 64
#: Up to so many chapters are named in the filter of a scan, which then passes over parts of files too.
NAMED_CHAPTERS = 1000


def chapter_bucket(chap: Column) -> Column:
    return F.pmod(chap, F.lit(CHAPTER_BUCKETS)).cast("int")


def by_chapter(spark: SparkSession, path: str) -> StoredTable:
    """Verses (version, engs, chap, sec, txt) of all books in folders by version and a bucket of the chapter's number."""
    schema = T.StructType([*schemas.VERSES.fields, T.StructField("bucket", T.IntegerType())])
    return StoredTable(spark, path, schema, ("version", "bucket"), ("chap", "engs", "sec"))


def asked_chapters(stored: DataFrame, asked: DataFrame, *keys: str) -> DataFrame:
    """The rows of a table by chapter that a join of it with ``asked`` (chap, and other ``keys``) can need, without the rest of its folders.

    The chapters' buckets, ``CHAPTER_BUCKETS`` at most, and up to ``NAMED_CHAPTERS`` chapters are looked up first and named in the scan. Rows without a chapter meet nothing."""
    numbers = asked.where("chap IS NOT NULL").select("chap").distinct()
    buckets = [r["b"] for r in numbers.select(chapter_bucket(F.col("chap")).alias("b")).distinct().collect()]
    some = [r["chap"] for r in numbers.limit(NAMED_CHAPTERS + 1).collect()]
    rows = stored.where(F.col("bucket").isin(buckets))
    rows = rows.where(F.col("chap").isin(some)) if len(some) <= NAMED_CHAPTERS else rows
    for key in keys:  # as versions, of which there are few
        rows = rows.where(F.col(key).isin([r[key] for r in asked.select(key).distinct().collect()]))
    return rows


def pair_index(spark: SparkSession, path: str) -> StoredTable:
    return StoredTable(spark, path, POSTINGS, ("bucket",), ("pair", "engs", "chap"))
