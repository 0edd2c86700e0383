"""The chunk store: immutable Parquet segments, named by numbered manifests.

A write adds one segment (chunks, vectors, lengths and postings of the batch)
and the keys that die with it, so it costs the batch and a read of the lengths,
not the store. Readers see the segments of the highest manifest; a row counts
unless its key died in a later write. When `compact_at` segments have gathered,
they are rewritten as one.

A manifest is created under the next number and never changed or moved. A job
that fails before it leaves files that nothing names; a manifest torn by a crash
doesn't parse and is passed over; of two writers with one number the second
fails. `vacuum` deletes what the newest manifests don't name.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bm25
from .dedup import first_by, upsert

CHUNKS = "id string, content string, source_url string, title string, heading_path array<string>, chunk_index int, total_chunks int, token_count int, content_hash string"
EMBEDDINGS = "chunk_id string, vector array<float>, dimensions int"
META = "key string, value string"
POSTINGS = "key string, dl int, col string, pos int, term string"
LENGTHS = "key string, source_url string, dl int"
TABLES = {"chunks": CHUNKS, "embeddings": EMBEDDINGS, "postings": POSTINGS, "lengths": LENGTHS}
#: The column of each table that names the chunk.
KEY = {"chunks": "id", "embeddings": "chunk_id", "postings": "key", "lengths": "key"}
DEAD = "dead_key string, dead_at long"
EMPTY = {"segments": [], "dead": [], "chunks": 0, "tokens": 0, "meta": None}


class Store:
    def __init__(self, spark: SparkSession, path: str, compact_at: int = 8):
        self.spark, self.path, self.compact_at = spark, path.rstrip("/"), compact_at

    # --- manifests

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _read(self, name: str) -> dict | None:
        fs, p = self._fs(f"{self.path}/manifests/{name}")
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:
            return None
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The highest one that is whole; `next` is the number that a write from here on takes."""
        names = self._names("manifests")
        found = next(filter(None, map(self._read, reversed(names))), EMPTY)
        return found | {"next": int(names[-1].split(".")[0]) + 1 if names else 1}

    def _commit(self, new: dict) -> None:
        """Fails if another write has taken the number that this one began with."""
        fs, p = self._fs(f"{self.path}/manifests/{new['next']:020d}.json")
        stream = fs.create(p, False)
        stream.write(bytearray(json.dumps({k: v for k, v in new.items() if k != "next"}).encode()))
        stream.close()

    def _write(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> str:
        to = f"{name}/{uuid.uuid4().hex}"
        df.write.options(**(options or {})).parquet(f"{self.path}/{to}")
        return to

    # --- reading

    def _rows(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def _live(self, name: str, m: dict, wanted: Column | None = None) -> DataFrame:
        """Rows of a table that no later write has replaced. wanted: a test that goes to the scan."""
        out = None
        for s in m["segments"]:
            if name not in s["tables"]:
                continue
            rows = self._rows([s["tables"][name]], TABLES[name])
            rows = rows.filter(wanted) if wanted is not None else rows
            dead = [d["path"] for d in m["dead"] if d["at"] > s["at"]]
            if dead:
                gone = self._rows(dead, DEAD).select("dead_key")
                rows = rows.join(gone, F.col(KEY[name]) == F.col("dead_key"), "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], TABLES[name])

    def table(self, name: str) -> DataFrame:
        m = self.manifest()
        if name == "meta":
            return self._rows([m["meta"]] if m["meta"] else [], META)
        return self._live(name, m)

    def search(self, query: str, k: int = 5) -> DataFrame:
        """Reads the postings of the query's terms, and the k chunks found."""
        m = self.manifest()
        return bm25.search(self._live("chunks", m), query, k, post=self._live("postings", m, bm25.wanted(query)), stats=bm25.Stats(m["chunks"], m["tokens"]))

    def vector(self, chunk_id: str) -> list[float]:
        row = self._live("embeddings", self.manifest(), F.col("chunk_id") == chunk_id).first()
        if row is None:
            raise KeyError(chunk_id)
        return list(row["vector"])

    def meta(self, key: str) -> str | None:
        row = self.table("meta").filter(F.col("key") == key).first()
        return row["value"] if row else None

    def with_vectors(self) -> DataFrame:
        """Chunks with their vectors; null where there is none."""
        v = self.table("embeddings").select(F.col("chunk_id").alias("id"), "vector", "dimensions")
        return self.table("chunks").join(v, "id", "left")

    # --- writing

    def _dead(self, m: dict, gone: DataFrame) -> tuple[dict, dict]:
        """Writes the keys of `gone` (rows of lengths) as dead; the manifest's new parts."""
        at = m["next"]
        path = self._write(gone.select(F.col("key").alias("dead_key"), F.lit(at).cast("long").alias("dead_at")), "dead")
        rows = self._rows([path], DEAD)
        lost = self._live("lengths", m).join(rows, F.col("key") == F.col("dead_key"), "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        return {"path": path, "at": at}, {"chunks": m["chunks"] - lost["n"], "tokens": m["tokens"] - lost["t"]}

    def index(self, chunks: DataFrame, embeddings: DataFrame | None = None, prune: bool = True) -> None:
        """Upserts by chunk id; ids of a batch are distinct. With `prune`, chunks that a source no longer has go with their vectors and postings."""
        m = self.manifest()
        at = m["next"]
        tables = {"chunks": self._write(chunks.select(*(c.split()[0] for c in CHUNKS.split(", "))), "chunks", {"parquet.bloom.filter.enabled#id": "true"})}
        new = self._rows([tables["chunks"]], CHUNKS)
        if embeddings is not None:
            tables["embeddings"] = self._write(embeddings.select("chunk_id", "vector", "dimensions"), "embeddings", {"parquet.bloom.filter.enabled#chunk_id": "true"})
        tables["lengths"] = self._write(_lengths(new), "lengths")
        # A new segment's postings stay where they are made, each file in order of term; compaction puts them in one order.
        tables["postings"] = self._write(bm25.postings(new).sortWithinPartitions("term").select("key", "dl", "col", "pos", "term"), "postings", {"parquet.bloom.filter.enabled#term": "true"})
        added = self._rows([tables["lengths"]], LENGTHS).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("t")).first()
        out = dict(m) | {"segments": [*m["segments"], {"at": at, "tables": tables}]}
        if m["segments"]:
            old = self._live("lengths", m)
            gone = old.join(new.select(F.col("id").alias("key")), "key", "left_semi")
            if prune:
                gone = gone.unionByName(old.join(new.select("source_url").distinct(), "source_url", "left_semi").select(*gone.columns))
            dead, sums = self._dead(m, gone.select("key").distinct())
            out |= sums | {"dead": [*m["dead"], dead]}
        out |= {"chunks": out["chunks"] + added["n"], "tokens": out["tokens"] + added["t"]}
        self._commit(out)
        if len(out["segments"]) >= self.compact_at:
            self.compact()

    def delete_sources(self, urls: DataFrame) -> None:
        """urls: source_url. Chunks without a source stay, unless a null is among the urls."""
        m = self.manifest()
        wanted = urls.select(F.col("source_url").alias("_u")).distinct()
        gone = self._live("lengths", m).join(wanted, F.col("source_url").eqNullSafe(F.col("_u")), "left_semi")
        dead, sums = self._dead(m, gone)
        self._commit(dict(m) | sums | {"dead": [*m["dead"], dead]})
        if len(m["dead"]) >= 4 * self.compact_at:
            self.compact()

    def delete_source(self, url: str) -> None:
        self.delete_sources(self.spark.createDataFrame([(url,)], "source_url string"))

    def set_metas(self, rows: DataFrame, version: str | None = None) -> None:
        """rows: key, value, and the column that says which of several values of a key is the newest."""
        m = self.manifest()
        old = self._rows([m["meta"]] if m["meta"] else [], META)
        new = first_by(rows, ["key"], [-F.col(version)]) if version else rows
        self._commit(dict(m) | {"meta": self._write(upsert(old, new.select("key", "value"), ["key"]), "meta")})

    def set_meta(self, key: str, value: str) -> None:
        self.set_metas(self.spark.createDataFrame([(key, value)], META))

    def compact(self) -> None:
        """One segment of what is live; nothing is dead any more."""
        m = self.manifest()
        at = m["next"]
        tables = {}
        for name in TABLES:
            live = self._live(name, m)
            if name == "postings":
                # by term, and by key within it, so that a frequent term is dealt over many files
                live = live.repartitionByRange("term", "key").sortWithinPartitions("term", "key")
            tables[name] = self._write(live, name, {f"parquet.bloom.filter.enabled#{'term' if name == 'postings' else KEY[name]}": "true"})
        self._commit(dict(m) | {"segments": [{"at": at, "tables": tables}], "dead": []})

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest `keep`, and files that those don't name. Returns how many were deleted.

        Call it while no writer is at work: a batch that isn't committed yet is named by no manifest.
        """
        names = self._names("manifests")
        stay, gone = names[-keep:], names[:-keep]
        named: set[str] = set()
        for m in filter(None, map(self._read, stay)):
            named |= {p for s in m["segments"] for p in s["tables"].values()} | {d["path"] for d in m["dead"]} | {m["meta"]}
        old = [f"manifests/{x}" for x in gone] + [f"{t}/{x}" for t in (*TABLES, "dead", "meta") for x in self._names(t) if f"{t}/{x}" not in named]
        for path in old:
            fs, p = self._fs(f"{self.path}/{path}")
            fs.delete(p, True)
        return len(old)


def _lengths(chunks: DataFrame) -> DataFrame:
    one = chunks.withColumn("_k", F.struct("id", "source_url"))
    return bm25.lengths(one, "_k").select(F.col("key.id").alias("key"), F.col("key.source_url").alias("source_url"), "dl")
