"""A versioned store: immutable segments of Parquet tables, tombstones, and a log of manifests of which the last is current.

A write adds segments that hold its own rows only, and tombstones: the keys of
older rows that it replaces or deletes. A row counts if no tombstone of a later
version has its key. The manifest names the segments and tombstones with their
versions; compact() writes all live rows as one segment again, and a write that
leaves MAX_SEGMENTS segments does so itself. Manifest n + 1 is added by a
rename that fails if another writer has added it meanwhile: that write raises
StaleWrite and changes nothing. Readers see all of a write or nothing; pinned()
keeps one manifest for all that is read through it. Paths go through Hadoop's
file system, so the store may lie anywhere. Postings are written where they are
made, in runs sorted by term, and compact() sorts them as a whole: a query's
terms touch few pages of each run, and then few row groups. Writes deal out no
postings, and texts only of repeated ids and of an upsert that keeps older places
(or of inputs so small that one task would read them all).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar import schema
from lodestar.functions import scalars
from lodestar.operators import filters as flt
from lodestar.operators import textsearch
from lodestar.session import spread

TABLES = {"chunks": schema.CHUNKS, "files": schema.FILES, "vectors": schema.VECTORS, "postings": schema.POSTINGS, "doclen": "chunk_id string, dl bigint"}
#: the key of each table, and whose tombstones count for it
KEYS = {"chunks": ("chunk_id", "chunks"), "postings": ("chunk_id", "chunks"), "doclen": ("chunk_id", "chunks"), "vectors": ("chunk_id", "vectors"), "files": ("doc_id", "files")}
MAX_SEGMENTS = 32
#: bytes of rows of postings that a task sorts, about, and how many times what Spark takes for the size of postings they have as rows
SORT_BYTES, POSTINGS_GROW = 256 << 20, 8
#: bytes of tombstones, which aren't compressed, that are broadcast to the rows they are for; with more, rows and tombstones are dealt by key
BROADCAST_BYTES = 16 << 20
CODEC = "zstd"


class IndexNotReady(RuntimeError):
    """The store has no snapshot yet."""


class StaleWrite(RuntimeError):
    """Another writer has added a version since this one read the store."""


class Store:
    def __init__(self, spark: SparkSession, root: str, analyzer: str = "words", blanks: bool = False):
        """blanks: chunks of blank text are put like others."""
        self.spark, self.root, self.analyzer, self.blanks = spark, root.rstrip("/"), analyzer, blanks
        self._pin: dict | None = None

    def pinned(self) -> Store:
        """This store as it is now, for any number of reads."""
        out = Store(self.spark, self.root, self.analyzer, self.blanks)
        out._pin = self.manifest()
        return out

    # --- files and manifest ---

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _versions(self) -> dict[int, str]:
        fs, at = self._fs(f"{self.root}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return {int(n.removesuffix(".json")): n for n in names if n.removesuffix(".json").isdigit()}

    def manifest(self) -> dict:
        if self._pin is not None:
            return self._pin
        versions = self._versions()
        if not versions:
            return {"version": 0, "tables": {}, "gone": {}}
        row = self.spark.read.text(f"{self.root}/manifests/{versions[max(versions)]}", wholetext=True).first()
        return json.loads(row["value"])

    def _add(self, manifest: dict) -> None:
        """Adds a manifest under its version, or raises StaleWrite if there is one."""
        fs, fresh = self._fs(f"{self.root}/manifests/{uuid.uuid4().hex}.tmp")
        _, at = self._fs(f"{self.root}/manifests/{manifest['version']:08d}.json")
        stream = fs.create(fresh, True)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)  # none: the target must not be there
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, at, options)
        except Py4JJavaError as error:
            fs.delete(fresh, False)
            if fs.exists(at):
                raise StaleWrite(f"version {manifest['version']} of {self.root} was written by another writer") from error
            raise

    def _write(self, df: DataFrame, path: str, codec: str = CODEC) -> None:
        df.write.option("compression", codec).parquet(f"{self.root}/{path}")

    def _union(self, paths: list, ddl: str, version: str) -> DataFrame:
        parts = [self.spark.read.schema(ddl).parquet(f"{self.root}/{path}").withColumn(version, F.lit(v)) for path, v in paths]
        return reduce(DataFrame.unionAll, parts)

    def table(self, name: str) -> DataFrame:
        manifest, (key, group) = self.manifest(), KEYS[name]
        segments = manifest["tables"].get(name)
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        later = [g for g in manifest["gone"].get(group, []) if g[1] > min(v for _, v in segments)]
        last = max((v for _, v in later), default=0)
        parts = [self._union(some, TABLES[name], "_version") for some in ([s for s in segments if s[1] < last], [s for s in segments if s[1] >= last]) if some]
        if later:  # the first part holds all rows that they may be for
            gone = self._union(later, f"{key} string", "_until").groupBy(F.col(key).alias("_gone")).agg(F.max("_until").alias("_until"))
            # neither way sorts the rows
            gone = F.broadcast(gone) if sum(self._bytes(path) for path, _ in later) <= BROADCAST_BYTES else gone.hint("shuffle_hash")
            parts[0] = parts[0].join(gone, (F.col(key) == F.col("_gone")) & (F.col("_version") < F.col("_until")), "left_anti")
        return reduce(DataFrame.unionAll, parts).drop("_version")

    def _bytes(self, path: str) -> int:
        fs, at = self._fs(f"{self.root}/{path}")
        return fs.getContentSummary(at).getLength()

    def commit(self, put: dict[str, DataFrame], base: dict | None = None, gone: dict[str, DataFrame] | None = None, whole: bool = False, moved: dict[str, str] | None = None) -> int:
        """Adds rows and tombstones on top of base (the manifest they were made from); whole: the rows are the tables from now on.

        moved: paths of staged() tables whose rows are added as they are; the folders move when all else is written.
        """
        base = base or self.manifest()
        version = base["version"] + 1
        tables, tombs = ({name: [tuple(x) for x in paths] for name, paths in base[part].items()} for part in ("tables", "gone"))
        folder = f"segments/{version:08d}-{uuid.uuid4().hex[:8]}"
        for group, keys in (gone or {}).items():
            path = f"{folder}/gone-{group}"
            self._write(keys, path, "uncompressed")  # their size tells how many they are
            tombs[group] = [*tombs.get(group, []), (path, version)]
        for name, df in put.items():
            path = f"{folder}/{name}"
            self._write(schema.conform(df, TABLES[name]), path)
            tables[name] = [(path, version)] if whole else [*tables.get(name, []), (path, version)]
        for name, stage in (moved or {}).items():
            fs, at = self._fs(f"{self.root}/{stage}")
            _, to = self._fs(f"{self.root}/{folder}/{name}")
            fs.mkdirs(to.getParent())
            if not fs.rename(at, to):
                raise OSError(f"{stage} did not move to {folder}/{name}")
            tables[name] = [*tables.get(name, []), (f"{folder}/{name}", version)]
        oldest = {group: min((v for name, paths in tables.items() if KEYS[name][1] == group for _, v in paths), default=version) for group in tombs}
        tombs = {group: [t for t in paths if t[1] > oldest[group]] for group, paths in tombs.items()}
        try:
            self._add({"version": version, "tables": tables, "gone": tombs})
        except StaleWrite:
            self._delete(folder)
            raise
        if not whole and max(map(len, tables.values()), default=0) > MAX_SEGMENTS:
            self.compact()
        return version

    def compact(self) -> int:
        """Writes the live rows of every table as one segment."""
        now = self.pinned()
        live = {name: now.table(name) for name in now.manifest()["tables"]}
        if "postings" in live:
            live["postings"] = self._by_term(live["postings"])
        return self.commit(live, now.manifest(), whole=True)

    def _by_term(self, postings: DataFrame) -> DataFrame:
        """Postings in parts that are sorted in memory; a frequent term may take several."""
        parts = POSTINGS_GROW * int(str(postings._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // SORT_BYTES
        few = parts <= int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return (postings.repartitionByRange("term", "chunk_id") if few else postings.repartitionByRange(parts, "term", "chunk_id")).sortWithinPartitions("term", "chunk_id")

    def _delete(self, path: str) -> None:
        fs, at = self._fs(f"{self.root}/{path}")
        fs.delete(at, True)

    def staged(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """df written once below the store, and its path there, to be deleted when the write that reads it is over."""
        path = f"staging/{name}-{uuid.uuid4().hex}"
        self._write(df, path)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{path}"), path

    @property
    def chunks(self) -> DataFrame:
        return self.table("chunks")

    @property
    def files(self) -> DataFrame:
        return self.table("files")

    @property
    def vectors(self) -> DataFrame:
        return self.table("vectors")

    def text_index(self) -> textsearch.TextIndex:
        at = self.pinned()
        if "postings" not in at.manifest()["tables"]:
            raise IndexNotReady(f"{self.root} has no text index")
        return textsearch.TextIndex(at.table("postings"), at.table("doclen"), self.analyzer)

    # --- writes ---

    def _index(self, chunks: DataFrame) -> dict[str, DataFrame]:
        """Postings are derived from chunks in the same write."""
        index = textsearch.build(chunks, self.analyzer, unique=True)
        return {"postings": index.postings, "doclen": index.doclen}

    def _staged_once(self, chunks: DataFrame) -> tuple[DataFrame, str]:
        """chunks staged, of several rows of one id the last one: only rows of such ids are dealt out and sorted."""
        few = 0 < len(chunks.inputFiles()) < self.spark.sparkContext.defaultParallelism
        rows, stage = self.staged(spread(chunks) if few else chunks, "chunks")
        twice = rows.groupBy(F.col("chunk_id").alias("_twice")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_twice")
        if twice.isEmpty():
            return rows, stage
        last = Window.partitionBy("chunk_id").orderBy(F.col("ord").desc_nulls_last(), F.col("text").desc(), F.col("doc_id").desc())
        same = F.col("chunk_id").eqNullSafe(F.col("_twice"))
        kept = rows.join(twice, same, "left_semi").withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        try:
            return self.staged(rows.join(twice, same, "left_anti").unionAll(kept), "chunks")
        finally:
            self._delete(stage)

    def upsert(self, chunks: DataFrame, files: DataFrame | None = None, vectors: DataFrame | Callable[[DataFrame], DataFrame] | None = None, mode: str = "replace") -> int:
        """Puts chunks, files and vectors; blank chunks go nowhere, unless the store takes blanks.

        mode `replace` drops a document's old chunks; `upsert` replaces equal
        ids only, and keeps the ord of an id that was there. Of several rows of
        one chunk_id that of the largest ord (then text) stays. vectors may be
        a function of the chunks that stay; of a table's several vectors of one
        chunk_id the least stays.
        """
        now = self.pinned()
        fresh = schema.conform(chunks, schema.CHUNKS)
        if not self.blanks:
            fresh = fresh.where(scalars.is_valid_chunk(F.col("text")))
        fresh, stage = self._staged_once(fresh)
        old = now.chunks.select("chunk_id", "doc_id", F.col("ord").alias("_ord"))
        ids = fresh.select("chunk_id")
        replaced, removed = old.join(ids, "chunk_id", "left_semi").select("chunk_id"), None
        put = fresh
        if mode == "replace":
            removed = old.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi").join(ids, "chunk_id", "left_anti").select("chunk_id")
        else:
            put = fresh.join(old.select("chunk_id", "_ord"), "chunk_id", "left").withColumn("ord", F.coalesce("_ord", "ord")).drop("_ord")
        tables = self._index(fresh) | ({"chunks": put} if removed is None else {})
        gone = {"chunks": replaced if removed is None else replaced.unionAll(removed)}
        stale = [] if removed is None else [removed]
        if vectors is not None:
            new = vectors(fresh) if callable(vectors) else vectors
            least = Window.partitionBy("chunk_id").orderBy("vec")
            new = schema.conform(new, schema.VECTORS).where("size(vec) = dim").withColumn("_n", F.row_number().over(least)).where("_n = 1").drop("_n")
            known = ids if callable(vectors) else ids.unionAll(old.select("chunk_id") if removed is None else old.select("chunk_id").join(removed, "chunk_id", "left_anti"))
            tables["vectors"] = new.join(known.distinct(), "chunk_id", "left_semi")
            stale.append(ids if callable(vectors) else new.select("chunk_id"))
        if stale:
            gone["vectors"] = now.vectors.select("chunk_id").join(reduce(DataFrame.unionAll, stale), "chunk_id", "left_semi")
        if files is not None:  # last, so a failed write leaves no file without chunks
            first = Window.partitionBy("doc_id").orderBy("source_uri", "content_sha256")
            tables["files"] = schema.conform(files, schema.FILES).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
            gone["files"] = now.files.select("doc_id").join(tables["files"], "doc_id", "left_semi")
        try:
            return self.commit(tables, now.manifest(), gone, moved={} if removed is None else {"chunks": stage})
        finally:
            self._delete(stage)

    def delete(self, clauses: list, batch: int = 1000, allow_all: bool = False) -> dict:
        """Deletes the chunks of a filter with their vectors, postings and orphaned files; the report counts them."""
        if not clauses and not allow_all:
            raise ValueError("a delete without a filter takes everything: say allow_all=True")
        total = self._bury(flt.predicate(clauses), files=True)
        return {"total_ids": total, "db_deleted": total, "text_delete_attempts": total, "vector_delete_attempts": total, "batches": -(-total // batch)}

    def delete_ids(self, ids: list[str]) -> dict:
        total = self._bury(F.coalesce(F.col("chunk_id").isin(*ids), F.lit(False)) if ids else F.lit(False))
        return {"total_ids": total, "db_deleted": total}

    def _bury(self, where: Column, files: bool = False) -> int:
        """Adds tombstones for chunks with their postings and vectors (and for files that are left without chunks); how many chunks."""
        now = self.pinned()
        ids = now.chunks.where(where).select("chunk_id", "doc_id")
        gone = {"chunks": ids.select("chunk_id"), "vectors": ids.select("chunk_id")}
        if files:
            gone["files"] = ids.select("doc_id").distinct().join(now.chunks.where(~where).select("doc_id"), "doc_id", "left_anti")
        total = ids.count()
        self.commit({}, now.manifest(), gone)
        return total

    def _bury_files(self, now: Store, ids: DataFrame) -> int:
        n = ids.count()
        self.commit({}, now.manifest(), {"files": ids})
        return n

    def delete_files(self, doc_ids: list[str]) -> int:
        """Deletes file records by document."""
        now = self.pinned()
        return self._bury_files(now, now.files.where(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False)).select("doc_id"))

    def cleanup_orphans(self) -> int:
        """Drops file records without chunks."""
        now = self.pinned()
        return self._bury_files(now, now.files.join(now.chunks.select("doc_id"), "doc_id", "left_anti").select("doc_id"))

    def rebuild_text_index(self) -> int:
        now = self.pinned()
        return self.commit(self._index(now.chunks), now.manifest(), whole=True)

    def rebuild_if_empty(self) -> bool:
        """Rebuilds the text index if it has no rows; whether it did."""
        empty = self.table("doclen").isEmpty()
        if empty:
            self.rebuild_text_index()
        return empty

    def counts(self) -> dict[str, int]:
        now = self.pinned()
        return {name: now.table(name).count() for name in ("chunks", "files", "vectors", "doclen")}

    def reset(self, confirm: str = "") -> None:
        if confirm != "RESET":
            raise ValueError("say confirm='RESET' to delete the store")
        fs, at = self._fs(self.root)
        fs.delete(at, True)

    def vacuum(self) -> int:
        """Compacts if rows were replaced or deleted, then deletes unnamed segments and all older manifests; how many folders of segments."""
        if any(self.manifest()["gone"].values()):
            self.compact()
        versions, manifest = self._versions(), self.manifest()
        used = {path.split("/")[1] for part in ("tables", "gone") for paths in manifest[part].values() for path, _ in paths}
        for version in sorted(versions)[:-1]:
            self._delete(f"manifests/{versions[version]}")
        fs, at = self._fs(f"{self.root}/segments")
        gone = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName() not in used] if fs.exists(at) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
