"""Documents and their chunks in storage: replaced, deleted and compacted without rewriting what is not touched.

Under one path lie ``documents`` and ``chunks``, both in folders by a hash of the document's id (``bucket``), ``tombstones``
(documents that are gone, by the version that removed them) and ``commits`` (one line per change).

``put`` appends new documents; one of the same company and file name as a stored one replaces it. ``remove`` deletes
documents, ``remove_companies`` all documents of companies; chunks go with their document. None of these touches a stored
file: rows of an older version than their document's tombstone are left out when reading. ``compact`` rewrites only the
buckets that hold such rows, by dynamic partition overwrite; the files of all other buckets stay as they are.

A change counts from its line in ``commits`` on, which is written last: what a failed change left is never read, and
the change can be made again. Compaction can be repeated at any point as well. One change at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from veritrail.operators.documents import latest_documents
from veritrail.session import Job, _files

BUCKETS = 64
TABLES = ("documents", "chunks")
NAME = ["company_id", "filename"]
_STAMP = [StructField("version", LongType()), StructField("batch", StringType()), StructField("bucket", IntegerType())]
_COMMITS = "version long, batch string, buckets int"


class DocumentStore:
    """The tables under ``path``, created by the first ``put``.

    ``documents`` needs doc_id, company_id, filename; ``chunks`` needs doc_id. Other columns are kept as they are."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _commits(self) -> list[tuple[int, str, int]]:
        folder, files = _files(self.spark, f"{self.path}/commits")
        rows = self.spark.read.schema(_COMMITS).json(f"{self.path}/commits").collect() if files.exists(folder) else []
        return sorted(tuple(r) for r in rows)

    def _shape(self, table: str) -> StructType:
        return self.spark.read.parquet(f"{self.path}/layout/{table}").schema

    def _stored(self, table: str) -> DataFrame:
        """All committed rows of a table, replaced ones among them."""
        rows = self.spark.read.schema(StructType([*self._shape(table).fields, *_STAMP])).parquet(f"{self.path}/{table}")
        return rows.where(F.col("batch").isin([batch for _, batch, _ in self._commits()]))

    def _tombstones(self) -> DataFrame:
        folder, files = _files(self.spark, f"{self.path}/tombstones")
        key = self._shape("documents")["doc_id"]
        shape = StructType([key, *_STAMP])
        rows = self.spark.read.schema(shape).parquet(f"{self.path}/tombstones") if files.exists(folder) else self.spark.createDataFrame([], shape)
        return rows.where(F.col("batch").isin([batch for _, batch, _ in self._commits()]))

    def _living(self, rows: DataFrame, tombstones: DataFrame) -> DataFrame:
        gone = tombstones.groupBy("doc_id").agg(F.max("version").alias("_gone"))
        return rows.join(gone, "doc_id", "left").where("_gone IS NULL OR version >= _gone").drop("_gone")

    def _read(self, table: str) -> DataFrame:
        return self._living(self._stored(table), self._tombstones()).select(*self._shape(table).names)

    def documents(self) -> DataFrame:
        return self._read("documents")

    def chunks(self) -> DataFrame:
        return self._read("chunks")

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")

    def _append(self, table: str, rows: DataFrame, version: int, batch: str, buckets: int) -> None:
        stamped = rows.withColumns({"version": F.lit(version).cast("long"), "batch": F.lit(batch), "bucket": self._bucket(buckets)})
        stamped.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/{table}")

    def _commit(self, version: int, batch: str, buckets: int) -> None:
        self.spark.createDataFrame([(version, batch, buckets)], _COMMITS).coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def _next(self) -> tuple[int, str, int]:
        """Version, name and number of buckets of a change; the first change fixes the buckets."""
        commits = self._commits()
        return (commits[-1][0] + 1 if commits else 1), uuid.uuid4().hex, commits[0][2] if commits else self.buckets

    def put(self, documents: DataFrame, chunks: DataFrame) -> None:
        """Store documents and their chunks. Of several new ones with a company and file name the greatest id stays;
        stored ones with that name, or with the id of a new one, are replaced."""
        version, batch, buckets = self._next()
        job = Job(self.spark, "put")
        new = job.keep(latest_documents(documents), "new")
        if version == 1:
            for table, like in zip(TABLES, (documents, chunks)):
                self.spark.createDataFrame([], like.schema).write.mode("overwrite").parquet(f"{self.path}/layout/{table}")
        else:
            stored = self.documents().select("doc_id", *NAME)
            same_name = stored.join(new.select(*NAME), NAME, "left_semi").select("doc_id")
            same_id = stored.join(new.select("doc_id"), "doc_id", "left_semi").select("doc_id")
            self._append("tombstones", job.keep(same_name.unionByName(same_id).distinct(), "gone"), version, batch, buckets)
        self._append("documents", new.select(*self._shape("documents").names), version, batch, buckets)
        own = chunks.join(new.select("doc_id"), "doc_id", "left_semi")
        self._append("chunks", own.select(*self._shape("chunks").names), version, batch, buckets)
        self._commit(version, batch, buckets)
        job.drop("new", "gone")

    def remove(self, documents: DataFrame) -> None:
        """Delete the documents with these ids (``doc_id``), and their chunks."""
        version, batch, buckets = self._next()
        self._append("tombstones", documents.select("doc_id").distinct(), version, batch, buckets)
        self._commit(version, batch, buckets)

    def remove_companies(self, companies: DataFrame) -> None:
        """Delete the companies' documents (``company_id``), and their chunks."""
        self.remove(self.documents().join(companies.select("company_id"), "company_id", "left_semi"))

    def compact(self) -> list[int]:
        """Rewrite the buckets that hold replaced or deleted rows, and forget the tombstones. Gives the buckets."""
        commits, tombstones = self._commits(), self._tombstones()
        touched = sorted(r["bucket"] for r in tombstones.select("bucket").distinct().collect())  # one per folder at most
        if not touched:
            return []
        job = Job(self.spark, "compact")
        for table in TABLES:
            dirty = self._stored(table).where(F.col("bucket").isin(touched))
            kept = job.keep(self._living(dirty, tombstones).select(*dirty.columns), table)
            kept.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
                "bucket").parquet(f"{self.path}/{table}")
            left = {r["bucket"] for r in kept.select("bucket").distinct().collect()}
            for bucket in set(touched) - left:  # no row is left to overwrite the folder with
                folder, files = _files(self.spark, f"{self.path}/{table}/bucket={bucket}")
                files.delete(folder, True)
        for bucket in touched:  # only now: until here the tombstones hide whatever was not rewritten yet
            folder, files = _files(self.spark, f"{self.path}/tombstones/bucket={bucket}")
            files.delete(folder, True)
        job.drop(*TABLES)
        assert commits == self._commits(), "the store was changed while it was compacted"
        return touched
