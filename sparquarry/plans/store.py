"""A store: append-only tables of frames, statistics and codes under one manifest per generation.

A commit writes new Parquet folders, then a manifest that names every live folder;
renaming the manifest into place is the commit.  Readers pin a generation, so they
never see a half-written one.  Opening takes the newest manifest all of whose
folders exist.  Statistics are stored, never scores: every scorer works from the
same postings.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import UnsupportedError
from ..functions.vectors import usable
from ..operators import codecs, fusion, scorers, vector_search
from ..operators.index import TextIndex
from ..operators.partitions import CUSTOM, Partitioning, TimeWindow, forgotten, members
from .files import Files
from .schema import Busy, NotCalibrated, Record, Schema, StoreError, VectorField, auto_key, check_record, decode_key, dumps, encode_key
from .search import HalfLife, Range, Rrf, RrfChannel, Search

TABLES = {
    "frames": "frame_id long, collection string, key binary, role string, created_at long, updated_at long, parent_frame_id long, text string",
    "tombstones": "frame_id long",
    "postings": "text_space string, term string, frame_id long, tf int",
    "doc_stats": "text_space string, frame_id long, total_terms int, unique_terms int",
    "vectors": "space string, vector_id long, frame_id long, collection string, code binary, sketch array<long>, embedding array<float>",
}
EMPTY = {"generation": 0, "tables": {t: [] for t in TABLES}, "collections": {}, "bases": {}, "spaces": {}, "profiles": {}, "next_frame": 1, "next_vector": 1}


class Snapshot:
    """One generation of a store, for reading."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict):
        self.spark, self.root, self.manifest = spark, root, manifest

    def table(self, name: str) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in self.manifest["tables"][name]]
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def schema(self, collection: str) -> Schema:
        doc = self.manifest["collections"].get(collection)
        if doc is None:
            raise StoreError(f"unknown collection {collection!r}")
        return Schema.from_json(doc) or Schema()

    def collections(self) -> list[str]:
        return sorted(self.manifest["collections"])

    def spaces(self) -> list[dict]:
        return [{"name": n, "auto": n.startswith("~auto/"), "calibrated": bool(c)} for n, c in sorted(self.manifest["spaces"].items())]

    def base_of(self, collection: str) -> str:
        """Partitions share the spaces and text statistics of their base."""
        return next((b for b in self.manifest["bases"] if collection.startswith(b + ":")), collection)

    def space_of(self, collection: str, field: VectorField) -> str:
        return field.space or f"~auto/{self.base_of(collection)}/{field.name}"

    def all_frames(self) -> DataFrame:
        return self.table("frames")

    def active_frames(self) -> DataFrame:
        return self.table("frames").join(self.table("tombstones"), "frame_id", "left_anti")

    def frames(self, collection: str) -> DataFrame:
        self.schema(collection)
        return self.active_frames().where(F.col("collection") == collection)

    def vectors(self, space: str) -> DataFrame:
        return self.table("vectors").where(F.col("space") == space).join(self.table("tombstones"), "frame_id", "left_anti")

    def members(self, collection: str) -> DataFrame:
        return self.frames(collection).select("frame_id").orderBy("frame_id")

    def keys(self, collection: str) -> list:
        return [decode_key(r[0]) for r in self.frames(collection).select("key").collect()]

    def get(self, collection: str, key) -> dict | None:
        return self.get_many(collection, [key])[0]

    def get_many(self, collection: str, keys: list) -> list[dict | None]:
        """In the order of keys, None where there is no such record."""
        raw = [encode_key(k) for k in keys]
        rows = self.frames(collection).where(F.col("key").isin([bytearray(k) for k in set(raw)])).collect() if raw else []
        found = {bytes(r["key"]): r for r in rows}
        return [self._stored(found[k]) if k in found else None for k in raw]

    @staticmethod
    def _stored(r) -> dict:
        return {"key": decode_key(r["key"]), "collection": r["collection"], "text": r["text"] or None, "created_at": r["created_at"], "role": r["role"], "frame_id": r["frame_id"], "parent_frame_id": r["parent_frame_id"]}

    def children(self, collection: str, key) -> DataFrame:
        parent = self.get(collection, key)
        frames = self.frames(collection)
        return frames.where(F.col("parent_frame_id") == (parent["frame_id"] if parent else -1)).orderBy("frame_id")

    def read_vectors(self, collection: str, field: str) -> DataFrame:
        """frame_id, embedding: decoded, of unit length, or as stored in a space without a codec."""
        f = self._vector_field(collection, field)
        space = self.space_of(collection, f)
        rows = self.vectors(space).where(F.col("collection") == collection)
        if f.codec is None:
            return rows.select("frame_id", "embedding")
        return rows.select("frame_id", codecs.decode_column(self._codec(space), F.col("code")).alias("embedding"))

    def _vector_field(self, collection: str, name: str) -> VectorField:
        schema = self.schema(collection)
        found = next((f for f in schema.fields if f.name == name), None)
        if found is None:
            raise StoreError(f"unknown field {name!r}")
        if not isinstance(found, VectorField):
            raise StoreError(f"{name!r} is no vector field")
        return found

    def _codec(self, space: str) -> codecs.Codec:
        doc = self.manifest["spaces"].get(space)
        if not doc:
            raise NotCalibrated(f"space {space!r} is not calibrated")
        return codecs.from_json(doc)

    def time_range(self, start: int, end: int, collection: str | None = None) -> DataFrame:
        rows = self.active_frames().where(F.col("created_at").between(start, end))
        rows = rows if collection is None else rows.where(F.col("collection") == collection)
        return rows.orderBy("created_at", "frame_id")

    def stats(self) -> dict:
        total, dead = self.all_frames().count(), self.table("tombstones").select("frame_id").distinct().count()
        vectors = self.table("vectors")
        active = vectors.join(self.table("tombstones"), "frame_id", "left_anti").count()
        return {"frames": total, "active_frames": total - dead, "vectors": vectors.count(), "active_vectors": active, "tombstone_ratio": dead / total if total else 0.0, "file_bytes": sum(b for _, _, b in self.storage())}

    def needs_compaction(self, ratio: float) -> bool:
        return self.stats()["tombstone_ratio"] >= ratio

    def storage(self) -> list[tuple[str, int, int]]:
        """(table, folders, bytes)"""
        files = Files(self.spark)
        return [(t, len(p), sum(files.size(f"{self.root}/{x}") for x in p)) for t, p in sorted(self.manifest["tables"].items())]

    def export(self, collection: str) -> DataFrame:
        """One JSON line (value) per record."""
        schema = self.schema(collection)
        dims = {self.space_of(collection, f): f for f in schema.vector_fields}
        v = self.table("vectors").where(F.col("space").isin(list(dims))).select("frame_id", "space")
        named = F.create_map(*[x for s, f in dims.items() for x in (F.lit(s), F.struct(F.lit(f.name).alias("field"), F.lit(f.dim).alias("dim")))]) if dims else None
        rows = self.frames(collection)
        if named is None:
            rows = rows.withColumn("vectors", F.array().cast("array<struct<field:string,dim:int>>"))
        else:
            per = v.groupBy("frame_id").agg(F.sort_array(F.collect_set(named[F.col("space")])).alias("vectors"))
            rows = rows.join(per, "frame_id", "left")
        readable = F.udf(lambda k: k if isinstance(k := decode_key(k), str) else k.hex() if isinstance(k, bytes) else str(k), "string")
        return rows.select(F.to_json(F.struct(readable("key").alias("key"), "collection", "created_at", "text", F.coalesce("vectors", F.array().cast("array<struct<field:string,dim:int>>")).alias("vectors"))).alias("value"))

    # search

    def profile(self, name: str) -> scorers.Scorer | fusion.FusionProfile:
        doc = self.manifest["profiles"].get(name)
        if doc is None:
            raise StoreError(f"unknown profile {name!r}")
        kind = scorers.Scorer if doc["kind"] == "scorer" else fusion.FusionProfile
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in doc.items() if k != "kind"}
        return kind(**known)

    def query_text(self, collection: str, query: str, scorer: scorers.Scorer | str, k: int | None = 10, channel_k: int | None = None) -> DataFrame:
        """One scorer, given or a profile's, over a collection: rank, frame_id, score; with channel_k by votes first."""
        scorer = self.profile(scorer) if isinstance(scorer, str) else scorer
        if not isinstance(scorer, scorers.Scorer):
            raise StoreError("the profile is no scorer")
        index = self.text_index(collection)
        if channel_k is not None:
            found = scorers.approximate_search(index, query, scorer, k or scorers.BM25_DEFAULT_TOP, channel_k)
            found = found.join(self.frames(collection).select("frame_id"), "frame_id", "left_semi")
        else:
            found = scorers.search(index, {0: query}, scorer, k, self.frames(collection))
        return found.select("rank", "frame_id", "score")

    def query_vector(self, collection: str, field: str, query, k: int = 10, channel_k: int | None = None, rerank: str = "full") -> DataFrame:
        """vector_id, distance, frame_id of the nearest; smaller is nearer."""
        f = self._vector_field(collection, field)
        if len(query) != f.dim:
            raise StoreError(f"the query has {len(query)} components, field {field!r} {f.dim}")
        space = self.space_of(collection, f)
        rows = self.vectors(space).where(F.col("collection") == collection)
        if f.codec is None:
            near = vector_search.nearest(rows, list(query), k, f.metric)
        else:
            near = codecs.code_search(rows, self._codec(space), list(query), k, channel_k=channel_k, metric=f.metric, rerank=rerank)
        return near.join(rows.select("vector_id", "frame_id"), "vector_id").orderBy("distance", "vector_id")

    def query_hybrid(self, collection: str, query: str, scorer: scorers.Scorer | str, field: str, vector, profile: fusion.FusionProfile | str, k: int = 10, channel_k: int = 100) -> DataFrame:
        """frame_id, score: a text and a vector channel of channel_k rows each, fused by a profile."""
        profile = self.profile(profile) if isinstance(profile, str) else profile
        scorer = self.profile(scorer) if isinstance(scorer, str) else scorer
        name = "bm25" if scorer.name == "bm25" else "tfidf" if scorer.name.startswith(("tfidf", "count")) else "jaccard"
        text = self.query_text(collection, query, scorer, channel_k).select("frame_id", "score")
        near = self.query_vector(collection, field, vector, channel_k).groupBy("frame_id").agg(F.min("distance").alias("score"))
        return fusion.fuse(profile, {name: text, "vector": near}, k)

    def explain(self, collection: str, search: Search) -> str:
        """The physical plan of a search, for tracing."""
        return self.search(collection, search)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def text_index(self, collection: str) -> TextIndex:
        field = self.schema(collection).text_field
        if field is None:
            raise UnsupportedError("the collection has no text field")
        space = self.base_of(collection)
        pick = lambda t: self.table(t).where(F.col("text_space") == space).drop("text_space")
        return TextIndex(pick("postings"), pick("doc_stats"), field.analyzer, self.table("tombstones"))

    def search(self, collection: str, search: Search) -> DataFrame:
        """rank, key, score, collection, frame_id."""
        return self._search([collection], collection, search)

    def search_view(self, base: str, window: TimeWindow, search: Search) -> DataFrame:
        """One search with one fusion over all partitions that the window touches."""
        parts = Partitioning(base, self.manifest["bases"][base]["kind"])
        names = self.spark.createDataFrame([(c,) for c in self.collections()] or [("",)], "collection string")
        found = [r[0] for r in members(names, parts, window).collect()]
        return self._search(found, found[0] if found else base, search)

    def _search(self, names: list[str], like: str, search: Search) -> DataFrame:
        search.check()
        scope = self.active_frames().where(F.col("collection").isin(names))
        frames = scope.select("frame_id", "created_at")
        if not names or search.k == 0:
            return self.spark.createDataFrame([], "rank int, key binary, score double, collection string, frame_id long")
        ranged = search.recency_by if isinstance(search.recency_by, Range) else None
        channels = []
        if t := search.text_channel:
            field = self.schema(like).text_field
            if field is None or field.name != t.field:
                known = [f.name for f in self.schema(like).fields]
                raise StoreError(f"{t.field!r} is a vector field" if t.field in known else f"unknown field {t.field!r}")
            found = scorers.search(self.text_index(like), {0: t.query}, t.scorer, fusion.over_fetch(search.k, "text", scoped=True), frames)
            channels.append(("text", found.select("frame_id", "score")))
        for v in search.vector_channels:
            channels.append(("vector", self._vector_channel(like, names, v, search, ranged)))
        if ranged:
            channels = [(kind, fusion.in_range(c, frames, ranged.start, ranged.end)) for kind, c in channels]
        only = [c for _, c in channels]
        if isinstance(search.fusion, Rrf):
            weights = [1.0] * len(only)
            if isinstance(search.recency_by, RrfChannel):
                only, weights = [*only, fusion.recency_channel(only, frames)], [*weights, search.recency_by.weight]
            fused = fusion.rrf(only, None, search.fusion.k, weights)
        else:
            fused = fusion.weighted(only, [search.fusion.text if kind == "text" else search.fusion.vector for kind, _ in channels], None)
        if isinstance(search.recency_by, HalfLife):
            fused = fusion.half_life(fused, frames, search.now_at if search.now_at is not None else int(time.time()), search.recency_by.days, None)
        best = fused.orderBy(F.desc("score"), "frame_id").limit(search.k)
        order = Window.orderBy(F.desc("score"), "frame_id")
        return best.join(scope.select("frame_id", "key", "collection"), "frame_id").withColumn("rank", F.row_number().over(order)).select("rank", "key", "score", "collection", "frame_id").orderBy("rank")

    def _vector_channel(self, like: str, names: list[str], v, search: Search, ranged) -> DataFrame:
        field = self._vector_field(like, v.field)
        if len(v.query) != field.dim:
            raise StoreError(f"the query has {len(v.query)} components, field {v.field!r} {field.dim}")
        k, space = fusion.over_fetch(search.k, "vector", ranged=ranged is not None), self.space_of(like, field)
        codec = self._codec(space) if field.codec else None
        rows = self.vectors(space).where(F.col("collection").isin(names))
        owner = rows.select("vector_id", "frame_id")
        if codec is None:
            near = vector_search.nearest(rows, list(v.query), k, field.metric)
        else:
            near = codecs.code_search(rows, codec, list(v.query), k, channel_k=v.channel_k, metric=field.metric, rerank=v.rerank)
        return near.join(owner, "vector_id").select("frame_id", (-F.col("distance")).alias("score"))


class Store:
    """Opens or creates a store in a folder; hits of searches are DataFrames."""

    def __init__(self, spark: SparkSession, root: str, create: bool | None = None):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        found = self._recover()
        if create is True and found is not None:
            raise StoreError("the store exists already")
        if create is False and found is None:
            raise StoreError("there is no such store")
        self.manifest = found or json.loads(json.dumps(EMPTY))
        self.declared: dict[str, Any] = {}

    def _recover(self) -> dict | None:
        """The newest manifest that parses and whose folders all exist."""
        for name in reversed(self.files.list(f"{self.root}/_commits")):
            try:
                doc = json.loads(self.files.read(f"{self.root}/_commits/{name}"))
                if all(self.files.exists(f"{self.root}/{p}") for t in doc["tables"].values() for p in t):
                    return doc
            except (ValueError, KeyError):
                continue
        return None

    def refresh(self) -> None:
        self.manifest = self._recover() or self.manifest

    def reader(self) -> Snapshot:
        return Snapshot(self.spark, self.root, self.manifest)

    def collection(self, name: str, schema: Schema) -> None:
        """Declares; kept from the next commit on.  An existing schema may only grow."""
        if name.startswith("~"):
            raise StoreError("names that start with ~ are reserved")
        docs = self.manifest["collections"] | self.declared.get("collections", {})
        old = Schema.from_json(docs[name]) if name in docs else None
        schema = old.extend(schema) if old else schema
        if old != schema:
            self.declared.setdefault("collections", {})[name] = schema.to_json()

    def partitioned(self, base: str, schema: Schema, kind: str) -> None:
        self.declared.setdefault("bases", {})[base] = {"kind": kind, "schema": schema.to_json()}

    def register_profile(self, name: str, profile: scorers.Scorer | fusion.FusionProfile) -> None:
        """Keeps a scorer's or a fusion's settings by name, from the next commit on; a name keeps its settings."""
        doc = dataclasses.asdict(profile) | {"kind": "scorer" if isinstance(profile, scorers.Scorer) else "fusion"}
        doc = json.loads(dumps(doc))
        if (self.manifest["profiles"] | self.declared.get("profiles", {})).get(name, doc) != doc:
            raise StoreError(f"profile {name!r} exists with other settings")
        self.declared.setdefault("profiles", {})[name] = doc

    def writer(self) -> Writer:
        out = self.try_writer()
        if out is None:
            raise Busy("another writer is active")
        return out

    def try_writer(self) -> Writer | None:
        lock = f"{self.root}/_writer.lock"
        if self.files.exists(lock):
            return None
        self.files.write(lock, uuid.uuid4().hex, overwrite=False)
        return Writer(self, lock)

    def publish(self, manifest: dict) -> int:
        """Moves the manifest of the next generation into place; Busy if another has it."""
        manifest["generation"] = self.manifest["generation"] + 1
        name = f"{manifest['generation']:012d}.json"
        temp = f"{self.root}/_temp-{uuid.uuid4().hex}.json"
        self.files.write(temp, dumps(manifest))
        if not self.files.exists(f"{self.root}/_commits"):
            fs, p = self.files._at(f"{self.root}/_commits")
            fs.mkdirs(p)
        if not self.files.rename(temp, f"{self.root}/_commits/{name}"):
            self.files.delete(temp)
            raise Busy("another commit came first")
        self.manifest, self.declared = json.loads(dumps(manifest)), {}
        return manifest["generation"]

    def load(self, collection: str, rows: DataFrame) -> dict:
        """One commit of a whole table: key (string), created_at, and columns named as the fields.  Nothing is collected.

        Of rows with one key the newest counts.  Frame ids follow created_at, then key: rows
        are range-partitioned and numbered within their task, and one count per task gives each
        task's first number.
        """
        with self.writer() as writer:
            schema, manifest = writer._schema(collection), json.loads(json.dumps(self.manifest))
            manifest["collections"] |= self.declared.get("collections", {})
            snap, spark = Snapshot(self.spark, self.root, manifest), self.spark
            tag = f"gen-{manifest['generation'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            fields = [f.name for f in schema.fields if f.name in rows.columns]
            for f in schema.vector_fields:
                if f.name in fields and not rows.where(F.col(f.name).isNotNull() & ~usable(F.col(f.name), f.dim)).isEmpty():
                    raise StoreError(f"field {f.name!r} holds vectors of another size or with components that are not finite")
            newest = rows.groupBy("key").agg(F.max_by(F.struct(*fields), "created_at").alias("f"), F.max("created_at").cast("long").alias("created_at"))
            ordered = newest.repartitionByRange("created_at", "key").sortWithinPartitions("created_at", "key").withColumn("at", F.monotonically_increasing_id())
            staged_path = f"{self.root}/_staging/{tag}"
            try:
                ordered.write.parquet(staged_path)
                staged = spark.read.schema(ordered.schema).parquet(staged_path).withColumn("task", F.shiftright("at", 33))
                counts = {r["task"]: r["n"] for r in staged.groupBy("task").agg(F.count(F.lit(1)).alias("n")).collect()}
                first, total = {}, 0
                for task in sorted(counts):
                    first[task], total = total, total + counts[task]
                starts = spark.createDataFrame([(t, n + manifest["next_frame"]) for t, n in first.items()], "task long, start long")
                numbered = staged.join(F.broadcast(starts), "task").withColumn("frame_id", F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1))
                numbered = numbered.select("frame_id", F.concat(F.lit(bytearray(b"\x01")), F.encode("key", "UTF-8")).alias("raw"), "created_at", "f.*")
                old = snap.active_frames().where(F.col("collection") == collection).join(numbered.select(F.col("raw").alias("key")), "key", "left_semi").select("frame_id")
                last = snap.active_frames().join(old, "frame_id", "left_anti").agg(F.max("created_at")).first()[0]
                if last is not None and total and numbered.agg(F.min("created_at")).first()[0] < last:
                    raise StoreError("created_at must not fall from one frame to the next")
                text = F.col(schema.text_field.name) if schema.text_field and schema.text_field.name in fields else F.lit(None).cast("string")
                out = {"tombstones": old, "frames": numbered.select("frame_id", F.lit(collection).alias("collection"), F.col("raw").alias("key"), F.lit("document").alias("role"), "created_at", F.col("created_at").alias("updated_at"), F.lit(None).cast("long").alias("parent_frame_id"), text.alias("text"))}
                if schema.text_field and schema.text_field.name in fields:
                    index = TextIndex.build(numbered.where(text.isNotNull() & (text != "")).select("frame_id", text.alias("text")), schema.text_field.analyzer)
                    for name, df in (("postings", index.postings), ("doc_stats", index.doc_stats)):
                        out[name] = df.withColumn("text_space", F.lit(snap.base_of(collection))).select(*[x.split()[0] for x in TABLES[name].split(", ")])
                for i, f in enumerate(f for f in schema.vector_fields if f.name in fields):
                    some = numbered.where(F.col(f.name).isNotNull()).select((F.col("frame_id") - manifest["next_frame"] + manifest["next_vector"] + i * total).alias("vector_id"), "frame_id", F.lit(collection).alias("collection"), F.col(f.name).cast("array<float>").alias("embedding"))
                    part = writer.coded(manifest, snap.space_of(collection, f), f, some)
                    out["vectors"] = out["vectors"].union(part) if "vectors" in out else part
                manifest["next_vector"] += total * len(schema.vector_fields)
                manifest["next_frame"] += total
                for name, df in out.items():
                    df.write.parquet(f"{self.root}/{name}/{tag}")
                    manifest["tables"][name].append(f"{name}/{tag}")
                return {"changed": True, "generation": self.publish(manifest), "rows": total}
            finally:
                self.files.delete(staged_path)

    def compact(self, recalibrate: bool = False) -> dict:
        """Rewrites the active rows as a new generation; children of tombstoned parents become roots."""
        before = self.reader()
        dead = before.table("tombstones").select("frame_id").distinct()
        n_dead = dead.count()
        if not n_dead:
            return {"changed": False, "dropped_frames": 0, "bytes_before": before.stats()["file_bytes"], "bytes_after": before.stats()["file_bytes"]}
        writer = self.writer()
        try:
            manifest = json.loads(json.dumps(self.manifest))
            tag = f"gen-{manifest['generation'] + 1:012d}-{uuid.uuid4().hex[:8]}"
            parents = dead.select(F.col("frame_id").alias("parent_frame_id"), F.lit(True).alias("gone"))
            frames = before.active_frames().join(parents, "parent_frame_id", "left").withColumn("parent_frame_id", F.when(F.col("gone").isNull(), F.col("parent_frame_id"))).drop("gone")
            alive = lambda t: before.table(t).join(dead, "frame_id", "left_anti")
            tables = {"frames": frames, "postings": alive("postings"), "doc_stats": alive("doc_stats"), "vectors": alive("vectors")}
            if recalibrate:
                tables["vectors"] = self._recalibrated(before, tables["vectors"], manifest)
            manifest["tables"] = {t: [] for t in TABLES}
            for t, df in tables.items():
                columns = [c.split()[0] for c in TABLES[t].split(", ")]
                df.select(*columns).write.parquet(f"{self.root}/{t}/{tag}")
                manifest["tables"][t] = [f"{t}/{tag}"]
            size = before.stats()["file_bytes"]
            self.publish(manifest)
            return {"changed": True, "dropped_frames": n_dead, "bytes_before": size, "bytes_after": self.reader().stats()["file_bytes"]}
        finally:
            writer.close()

    def _recalibrated(self, before: Snapshot, vectors: DataFrame, manifest: dict) -> DataFrame:
        out = vectors.where(F.col("code").isNull())
        for space, doc in list(manifest["spaces"].items()):
            if not doc:
                continue
            old = codecs.from_json(doc)
            plain = vectors.where(F.col("space") == space).withColumn("embedding", codecs.decode_column(old, F.col("code"))).drop("code", "sketch")
            new = codecs.calibrate_qam(plain, old.dim, old.amp_bits, old.phase_bits) if isinstance(old, codecs.Qam) else codecs.calibrate_upq(plain, old.dim)
            manifest["spaces"][space] = new.to_json()
            out = out.unionByName(codecs.encode_table(plain, new).withColumn("embedding", F.lit(None).cast("array<float>")))
        return out


class Writer:
    """Stages records; commit() publishes them.  Leaving the context without a commit drops what is staged."""

    def __init__(self, store: Store, lock: str):
        self.store, self.lock = store, lock
        self.staged: dict[tuple[str, bytes], tuple[int, Record | None]] = {}
        self.order = 0
        self.forget: list[DataFrame] = []

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self.lock:
            self.store.files.delete(self.lock)
            self.lock = ""

    def _schema(self, collection: str) -> Schema:
        docs = self.store.manifest["collections"] | self.store.declared.get("collections", {})
        if collection not in docs:
            raise StoreError(f"unknown collection {collection!r}")
        return Schema.from_json(docs[collection]) or Schema()

    def _guard(self, collection: str, key: bytes) -> None:
        """A staged version with vectors of a calibrated space can't be replaced before a commit."""
        old = self.staged.get((collection, key))
        if old and old[1]:
            snap = self.store.reader()
            for f in self._schema(collection).vector_fields:
                if f.name in old[1].fields and (f.codec is None or self.store.manifest["spaces"].get(snap.space_of(collection, f))):
                    raise UnsupportedError("the key was put in this batch already; commit first")

    def _committed(self, collection: str, key) -> bool:
        return collection in self.store.manifest["collections"] and self.store.reader().get(collection, key) is not None

    def put(self, collection: str, record: Record) -> None:
        check_record(self._schema(collection), record)
        key = encode_key(record.key)
        self._guard(collection, key)
        if record.parent is not None and self.staged.get((collection, encode_key(record.parent)), (0, None))[1] is None and not self._committed(collection, record.parent):
            raise StoreError("the parent does not exist")
        self.order += 1
        record.created_at = int(time.time()) if record.created_at is None else record.created_at
        self.staged.pop((collection, key), None)
        self.staged[collection, key] = (self.order, record)

    def put_auto(self, collection: str, fields: dict, **options) -> str:
        key = auto_key()
        self.put(collection, Record(key, fields, **options))
        return key

    def put_many(self, collection: str, keys: list, vectors, field: str = "dense", texts: list[str] | None = None, text_field: str = "body", created_at: int | None = None) -> None:
        """vectors: a contiguous float32 array, one row per key."""
        import numpy as np

        if not isinstance(vectors, np.ndarray) or vectors.dtype != np.float32 or not vectors.flags["C_CONTIGUOUS"]:
            raise TypeError("vectors must be a contiguous float32 array")
        if vectors.ndim != 2 or len(vectors) != len(keys) or (texts is not None and len(texts) != len(keys)):
            raise ValueError("keys, vectors and texts must be as many")
        for i, key in enumerate(keys):
            self.put(collection, Record(key, {field: vectors[i].tolist()} | ({text_field: texts[i]} if texts else {}), created_at))

    def put_into(self, base: str, record: Record, route: Callable[[Record], str] | None = None) -> str:
        """Routes by created_at (or now) to the partition of the base, made when it is new."""
        import datetime as dt

        spec = (self.store.manifest["bases"] | self.store.declared.get("bases", {}))[base]
        record.created_at = int(time.time()) if record.created_at is None else record.created_at
        if spec["kind"] == CUSTOM:
            period = route(record)
        else:
            day = dt.date(1970, 1, 1) + dt.timedelta(days=record.created_at // 86400)
            period = day.isoformat() if spec["kind"] == "day" else day.isoformat()[:7]
        name = f"{base}:{period}"
        docs = self.store.manifest["collections"] | self.store.declared.get("collections", {})
        if name not in docs:
            self.store.declared.setdefault("collections", {})[name] = spec["schema"]
        self.put(name, record)
        return name

    def delete(self, collection: str, key) -> bool:
        raw = encode_key(key)
        self._guard(collection, raw)
        staged = self.staged.pop((collection, raw), None)
        there = self._committed(collection, key)
        if there:
            self.order += 1
            self.staged[collection, raw] = (self.order, None)
        return there or bool(staged and staged[1])

    def forget_before(self, base: str, cutoff: int) -> int:
        """Tombstones the partitions that ended by the cutoff; how many frames that were."""
        kind = self.store.manifest["bases"][base]["kind"]
        if kind == CUSTOM:
            raise UnsupportedError("custom partitions have no end")
        gone = forgotten(self.store.reader().active_frames(), Partitioning(base, kind), cutoff).select("frame_id")
        n = gone.count()
        if n:
            self.forget.append(gone)
        return n

    def commit(self) -> dict:
        store, manifest = self.store, json.loads(json.dumps(self.store.manifest))
        manifest["collections"] |= store.declared.get("collections", {})
        manifest["bases"] |= store.declared.get("bases", {})
        manifest["profiles"] |= store.declared.get("profiles", {})
        if manifest == store.manifest and not self.staged and not self.forget:
            return {"changed": False, "generation": manifest["generation"]}
        snap = Snapshot(store.spark, store.root, manifest)
        tables = self._tables(snap, manifest)
        tag = f"gen-{manifest['generation'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{store.root}/{name}/{tag}")
            manifest["tables"][name].append(f"{name}/{tag}")
        generation = store.publish(manifest)
        self.staged, self.forget = {}, []
        return {"changed": True, "generation": generation}

    def _tables(self, snap: Snapshot, manifest: dict) -> dict[str, DataFrame]:
        spark, out = self.store.spark, {}
        dead = list(self.forget)
        puts = [(c, k, r) for (c, k), (_, r) in sorted(self.staged.items(), key=lambda x: x[1][0]) if r is not None]
        if self.staged:
            named = spark.createDataFrame([(c, bytearray(k)) for c, k in self.staged], "collection string, key binary")
            dead.append(snap.active_frames().join(named, ["collection", "key"], "left_semi").select("frame_id"))
        if dead:
            gone = dead[0]
            for d in dead[1:]:
                gone = gone.union(d)
            out["tombstones"] = gone.distinct()
        if not puts:
            return out
        times = [r.created_at for _, _, r in puts]
        last = snap.active_frames().join(out["tombstones"], "frame_id", "left_anti").agg(F.max("created_at")).first()[0] if out else None
        if any(b < a for a, b in zip(times, times[1:])) or (last is not None and times[0] < last):
            raise StoreError("created_at must not fall from one frame to the next")
        ids = {(c, k): manifest["next_frame"] + i for i, (c, k, _) in enumerate(puts)}
        rows, texts, vectors = [], [], []
        for c, k, r in puts:
            fid, schema = ids[c, k], self._schema(c)
            parent = None
            if r.parent is not None:
                p = encode_key(r.parent)
                parent = ids.get((c, p)) or snap.get(c, r.parent)["frame_id"]
            text = r.fields.get(schema.text_field.name) if schema.text_field else None
            rows.append((fid, c, bytearray(k), "chunk" if parent else "document", r.created_at, r.created_at, parent, text))
            if text:
                texts.append((c, fid, text))
            vectors += [(c, f, fid, [float(x) for x in r.fields[f.name]]) for f in schema.vector_fields if f.name in r.fields]
        manifest["next_frame"] += len(puts)
        out["frames"] = spark.createDataFrame(rows, TABLES["frames"])
        self._text_tables(snap, texts, out)
        if vectors:
            out["vectors"] = self._vector_table(snap, manifest, vectors)
        return out

    def _text_tables(self, snap: Snapshot, texts: Iterable[tuple], out: dict) -> None:
        by_space: dict[str, tuple] = {}
        for c, fid, text in texts:
            by_space.setdefault(snap.base_of(c), (c, []))[1].append((fid, text))
        for space, (c, rows) in by_space.items():
            index = TextIndex.build(self.store.spark.createDataFrame(rows, "frame_id long, text string"), self._schema(c).text_field.analyzer)
            for name, df in (("postings", index.postings), ("doc_stats", index.doc_stats)):
                part = df.withColumn("text_space", F.lit(space)).select(*[x.split()[0] for x in TABLES[name].split(", ")])
                out[name] = out[name].union(part) if name in out else part

    def _vector_table(self, snap: Snapshot, manifest: dict, vectors: list) -> DataFrame:
        """Codes; a space without a codec yet is calibrated from its first vectors, in put order."""
        spark, by_space, parts = self.store.spark, {}, []
        for c, f, fid, v in vectors:
            by_space.setdefault(snap.space_of(c, f), (f, []))[1].append((manifest["next_vector"], fid, c, v))
            manifest["next_vector"] += 1
        for space, (f, rows) in by_space.items():
            df = spark.createDataFrame(rows, "vector_id long, frame_id long, collection string, embedding array<float>")
            parts.append(self.coded(manifest, space, f, df))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out


    @staticmethod
    def coded(manifest: dict, space: str, f: VectorField, rows: DataFrame) -> DataFrame:
        """Rows of vectors (vector_id, frame_id, collection, embedding) as the space keeps them; calibrates a new space."""
        if f.codec is None:
            manifest["spaces"].setdefault(space, "")
            return rows.select(F.lit(space).alias("space"), "vector_id", "frame_id", "collection", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("array<long>").alias("sketch"), "embedding")
        if not manifest["spaces"].get(space):
            sample = rows.orderBy("vector_id").limit(f.sample_target)
            codec = codecs.calibrate_qam(sample, f.dim, f.amp_bits, f.phase_bits) if f.codec == "qam" else codecs.calibrate_upq(sample, f.dim)
            manifest["spaces"][space] = codec.to_json()
        table = codecs.encode_table(rows, codecs.from_json(manifest["spaces"][space]))
        return table.select(F.lit(space).alias("space"), "vector_id", "frame_id", "collection", "code", "sketch", F.lit(None).cast("array<float>").alias("embedding"))


class Loader:
    """Bulk puts with a commit after each batch, and before a key repeats within one."""

    def __init__(self, writer: Writer, every: int = 10_000):
        self.writer, self.every, self.seen = writer, every, set()

    def put(self, collection: str, record: Record) -> None:
        key = (collection, encode_key(record.key))
        if key in self.seen or len(self.seen) >= self.every:
            self.flush()
        self.writer.put(collection, record)
        self.seen.add(key)

    def flush(self) -> None:
        self.writer.commit()
        self.seen.clear()
