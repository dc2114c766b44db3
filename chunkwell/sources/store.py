"""Collections of chunks as Parquet folders in buckets of their ids; a numbered manifest says which folders count.

A collection is a folder `<root>/<collection>`.  Its records lie in `data/<write>/_bucket=<n>`, by hash of
their id.  A write reads and makes anew only the buckets that its records fall into; the manifest of the
next number names, for each bucket, the folder that counts, so the others keep their files.  A manifest is
written aside and then published under its number, which fails if another writer was first; the write is then
made again from that writer's manifest.  So a reader never sees half a write, of two writers none loses
rows, and a writer that dies leaves nothing but folders that no manifest names.

Folders that only manifests older than the last KEPT name are removed when those are older than
`keep_seconds`, so that a read that was planned before may end; folders that none names, after ORPHAN_SECONDS.

A collection may be indexed: its vectors are then put into cells, and its files are in the order of cells (see
`operators.cells`).  Later writes put their records into the same cells.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.ml.clustering import KMeansModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkwell.functions.text import chunk_id, collection_name
from chunkwell.operators import cells as indexed
from chunkwell.operators.retrieval import EMBEDDING, VECTOR, Embedder, nearest_to_each
from chunkwell.schema import CHUNK

RECORD = f"id string, {CHUNK}, embedding {EMBEDDING}, vector {VECTOR}, cell int"
ERROR = "file_path string, error string"
BUCKETS = 16
KEPT = 2
KEEP_SECONDS, ORPHAN_SECONDS = 3600, 7 * 86_400


def with_ids(chunks: DataFrame) -> DataFrame:
    """Add `id`; later chunks of one id within the rows get `_<n>` from 2 on."""
    plain = chunk_id("repo_name", "file_path", "start_line", "end_line")
    order = Window.partitionBy("_id").orderBy("file_path", "seq", "content")
    n = F.row_number().over(order)
    named = chunks.withColumn("_id", plain).withColumn("_n", n)
    return named.withColumn("id", F.when(F.col("_n") == 1, F.col("_id")).otherwise(F.concat_ws("_", "_id", F.col("_n").cast("string")))).drop("_id", "_n")


def merged(existing: DataFrame, new: DataFrame, mode: str = "upsert") -> DataFrame:
    """Rows after a write: new rows replace those of their id; `replace` leaves only the new ones."""
    if mode == "replace":
        return new
    if mode != "upsert":
        raise ValueError(mode)
    return existing.join(new.select("id").distinct(), "id", "left_anti").unionByName(new)


def as_records(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of records, and more; those of records that the rows lack are empty or null."""
    none = {"embedding": F.array()}
    kinds = {f.name: f.dataType for f in rows.sparkSession.createDataFrame([], RECORD).schema}
    column = lambda n: F.col(n) if n in rows.columns else none.get(n, F.lit(None))
    return rows.select(*(column(n).cast(t).alias(n) for n, t in kinds.items()), *more)


def embedded(records: DataFrame, embedder: Embedder, text: str = "content") -> DataFrame:
    """Records with the column that the embedder adds."""
    return embedder.add(records, text)


def scratch_store(spark: SparkSession, name: str, buckets: int = BUCKETS) -> Store:
    """A new store below the folder that the cluster shares: spark.checkpoint.dir, else the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return Store(spark, f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}", buckets=buckets)


@dataclass(frozen=True)
class Manifest:
    """The folders of a collection's buckets, relative to it, and of its centres."""

    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    centres: str | None = None

    def names(self) -> set[str]:
        return {*self.folders.values(), *([self.centres] if self.centres else [])}


class Store:
    """Collections below a root folder of any store that Spark writes and that renames whole files; files of at most `max_records` records, if given."""

    def __init__(self, spark: SparkSession, root: str, max_records: int = 0, buckets: int = BUCKETS, keep_seconds: float = KEEP_SECONDS) -> None:
        self.spark, self.root, self.max_records, self.buckets, self.keep_seconds = spark, root.rstrip("/"), max_records, buckets, keep_seconds
        self._jvm = spark._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._links = self._fs.getUri().getScheme() == "file"
        self._fs.mkdirs(self._path(self.root))

    # -------------------------------------------------------- folders

    def _normal(self, name: str) -> str:
        return self.spark.range(1).select(collection_name(F.lit(name)).alias("n")).collect()[0]["n"]

    def list(self) -> list[str]:
        """Names of the collections, in order; an unreadable root has none."""
        try:
            return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory() and s.getPath().getName()[0] != ".")
        except Py4JJavaError:
            return []

    def exists(self, name: str) -> bool:
        return self._normal(name) in self.list()

    def _listed(self, path: str) -> list[tuple[str, float, int]]:
        """Names, ages in seconds and sizes of what a folder holds; nothing if it is missing."""
        at = self._path(path)
        if not self._fs.exists(at):
            return []
        return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000, s.getLen()) for s in self._fs.listStatus(at)]

    def _remove(self, path: str) -> bool:
        return self._fs.delete(self._path(path), True)

    # -------------------------------------------------------- manifests

    def _manifests(self, normal: str) -> list[tuple[int, float]]:
        """Numbers and ages of a collection's manifests, the last first; empty files are of writers that died."""
        found = self._listed(f"{self.root}/{normal}/manifests")
        return sorted(((int(n), age) for n, age, size in found if n.isdigit() and size), reverse=True)

    def _manifest(self, normal: str, number: int) -> Manifest:
        stream = self._fs.open(self._path(f"{self.root}/{normal}/manifests/{number:012d}"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _last(self, normal: str) -> tuple[int, Manifest | None]:
        """The highest number in use, whatever its file, and the manifest that counts."""
        names = [int(n) for n, _, _ in self._listed(f"{self.root}/{normal}/manifests") if n.isdigit()]
        whole = self._manifests(normal)
        return max(names, default=0), self._manifest(normal, whole[0][0]) if whole else None

    def _publish(self, normal: str, number: int, manifest: Manifest) -> bool:
        """Give a manifest its number; False if another writer has it."""
        folder = f"{self.root}/{normal}/manifests"
        aside, target = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{number:012d}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        try:
            if self._links:  # a rename would replace the file there, a link does not
                local = lambda path: self._jvm.java.io.File(path.toUri().getPath()).toPath()
                self._jvm.java.nio.file.Files.createLink(local(target), local(aside))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(aside, target, self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        finally:
            self._fs.delete(aside, False)
        return True

    def _clean(self, normal: str) -> None:
        """Remove manifests that are neither among the last nor young, and the folders that no other names."""
        base, found = f"{self.root}/{normal}", self._manifests(normal)
        old = [n for k, (n, age) in enumerate(found) if k >= KEPT and age >= self.keep_seconds]
        kept: set[str] = set().union(*(self._manifest(normal, n).names() for n, _ in found if n not in old))
        gone = set().union(*(self._manifest(normal, n).names() for n in old)) - kept
        for folder in gone:
            self._remove(f"{base}/{folder}")
        for n in old:
            self._remove(f"{base}/manifests/{n:012d}")
        for kind in ("data", "centres"):
            for name, age, _ in self._listed(f"{base}/{kind}"):
                if age >= ORPHAN_SECONDS and not any(f"{f}/".startswith(f"{kind}/{name}/") for f in kept):
                    self._remove(f"{base}/{kind}/{name}")

    # -------------------------------------------------------- records

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, folder: str, buckets: int) -> dict[str, str]:
        """Write records in buckets, each in the order of its cells; the folders made, by bucket."""
        dealt = rows.withColumn("_bucket", self._bucket(buckets)).repartition(buckets, "_bucket").sortWithinPartitions("_bucket", "cell")
        dealt.write.option("maxRecordsPerFile", self.max_records).partitionBy("_bucket").parquet(folder)
        return {n.partition("=")[2]: n for n, _, _ in self._listed(folder) if n.startswith("_bucket=")}

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(*paths) if paths else self.spark.createDataFrame([], RECORD)

    def read(self, name: str) -> DataFrame:
        """Records of a collection; none if it is missing."""
        normal = self._normal(name)
        manifest = self._last(normal)[1]
        return self._read([f"{self.root}/{normal}/{f}" for f in manifest.folders.values()] if manifest else [])

    def fetch(self, name: str, ids: list[str]) -> DataFrame:
        """Records of some ids, from their buckets only."""
        normal = self._normal(name)
        manifest = self._last(normal)[1]
        if manifest is None or not ids:
            return self._read([])
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string").select(self._bucket(manifest.buckets).alias("b")).distinct().collect()
        folders = [manifest.folders[str(r["b"])] for r in wanted if str(r["b"]) in manifest.folders]
        return self._read([f"{self.root}/{normal}/{f}" for f in folders]).where(F.col("id").isin(*ids))

    def errors(self, name: str) -> DataFrame:
        """What failed in the writes of a collection: file_path, error."""
        at = f"{self.root}/.errors/{self._normal(name)}"
        return self.spark.read.schema(ERROR).parquet(at) if self._listed(at) else self.spark.createDataFrame([], ERROR)

    def write(self, name: str, records: DataFrame, mode: str = "upsert", failed: Column | None = None) -> None:
        """Merge records into a collection, made if missing; no records change nothing.  The records are computed once.

        Rows for which `failed` holds are no records but errors of their file, told by their content, and go to the table of errors.
        """
        if mode not in ("upsert", "replace"):
            raise ValueError(mode)
        normal = self._normal(name)
        base, fresh = f"{self.root}/{normal}", not self._listed(f"{self.root}/{normal}")
        staged = f"{base}/data/new-{uuid.uuid4().hex}"
        as_records(records).write.parquet(staged)
        new = self._read([staged])
        try:
            if failed is not None:
                lost = new.where(failed).select("file_path", F.col("content").alias("error"))
                lost.write.mode("append").parquet(f"{self.root}/.errors/{normal}")
                new = new.where(~failed)
            if not new.take(1):
                if fresh:
                    self._remove(base)
                return
            while True:
                number, before = self._last(normal)
                if self._publish(normal, number + 1, self._merge(base, before, new, mode)):
                    break
            self._clean(normal)
        finally:
            self._remove(staged)

    def _merge(self, base: str, before: Manifest | None, new: DataFrame, mode: str) -> Manifest:
        """The manifest after a write to a collection of which `before` counts; only buckets with new ids are made anew."""
        model = self._model(base, before)
        new = indexed.with_cell(new, model).select(*new.columns) if model is not None else new
        old = before or Manifest(self.buckets)
        touched = {str(r["b"]) for r in new.select(self._bucket(old.buckets).alias("b")).distinct().collect()}
        there = [] if mode == "replace" else [f"{base}/{f}" for b, f in old.folders.items() if b in touched]
        folder = f"data/v-{uuid.uuid4().hex}"
        made = self._write(merged(self._read(there), new, mode), f"{base}/{folder}", old.buckets)
        kept = {} if mode == "replace" else {b: f for b, f in old.folders.items() if b not in touched}
        return replace(old, folders=kept | {b: f"{folder}/{n}" for b, n in made.items()})

    def write_all(self, records: DataFrame, name: Column) -> None:
        """Put records into the collections that their `name` column says, in one pass; these then hold nothing else."""
        staged = f"{self.root}/.new-{uuid.uuid4().hex}"
        rows = as_records(records.withColumn("_collection", collection_name(name)), "_collection").withColumn("_bucket", self._bucket(self.buckets)).where("_collection <> ''")
        rows.repartition("_collection", "_bucket").write.option("maxRecordsPerFile", self.max_records).partitionBy("_collection", "_bucket").parquet(staged)
        for part, _, _ in self._listed(staged):
            if not part.startswith("_collection="):
                continue
            normal, folder = part.partition("=")[2], f"data/v-{uuid.uuid4().hex}"
            self._fs.mkdirs(self._path(f"{self.root}/{normal}/data"))
            self._fs.rename(self._path(f"{staged}/{part}"), self._path(f"{self.root}/{normal}/{folder}"))
            made = {n.partition("=")[2]: f"{folder}/{n}" for n, _, _ in self._listed(f"{self.root}/{normal}/{folder}") if n.startswith("_bucket=")}
            while not self._publish(normal, self._last(normal)[0] + 1, Manifest(self.buckets, made)):
                pass
            self._clean(normal)
        self._remove(staged)

    def delete(self, name: str) -> bool:
        """Remove a collection; False if it was missing or could not be removed."""
        try:
            self._remove(f"{self.root}/.errors/{self._normal(name)}")
            return bool(self.exists(name) and self._remove(f"{self.root}/{self._normal(name)}"))
        except Py4JJavaError:
            return False

    # -------------------------------------------------------- vectors

    def _model(self, base: str, manifest: Manifest | None) -> KMeansModel | None:
        return KMeansModel.load(f"{base}/{manifest.centres}") if manifest is not None and manifest.centres else None

    def index(self, name: str, cells: int | None = None) -> bool:
        """Put a collection's vectors into cells and its files in their order; False if it has no vectors."""
        normal = self._normal(name)
        base = f"{self.root}/{normal}"
        while True:
            number, before = self._last(normal)
            if before is None:
                return False
            rows = self.read(name)
            model = indexed.train(rows, "id", cells=cells)
            if model is None:
                return False
            centres, folder = f"centres/c-{uuid.uuid4().hex}", f"data/v-{uuid.uuid4().hex}"
            model.save(f"{base}/{centres}")
            made = self._write(indexed.with_cell(rows, model).select(*rows.columns), f"{base}/{folder}", before.buckets)
            if self._publish(normal, number + 1, replace(before, folders={b: f"{folder}/{n}" for b, n in made.items()}, centres=centres)):
                self._clean(normal)
                return True

    def nearest(self, name: str, points: dict[int, list[float]], k: int, probes: int | None = indexed.PROBES) -> DataFrame:
        """The k records nearest to each point (query_no, rank, id, distance): among the cells nearest to it where the collection is indexed, else, or with probes None, among all."""
        normal = self._normal(name)
        manifest = self._last(normal)[1]
        model = self._model(f"{self.root}/{normal}", manifest)
        queries = self.spark.createDataFrame(list(points.items()), "query_no long, point array<double>")
        rows = self.read(name).select("id", "vector", "cell")
        if model is not None and probes is not None:
            return indexed.search(rows, model, queries, k, probes, key="id")
        found = nearest_to_each(rows, queries, k, key="id", embedding="vector")
        return found.select("query_no", "rank", "id", "distance")
