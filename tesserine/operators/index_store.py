"""Stored indexes: postings, lengths, entity rows and vectors as Parquet with a manifest, validated when loaded.

A folder holds `postings` (sorted by token in each file, with Bloom filters, so that a search reads the row groups of its own
tokens), `entities`, `vectors` where there are any, and `manifest.json`. It is a version (storage.Versions): readers of an older
one are not disturbed, and one that fails a check was never the index.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import BM25_B, BM25_K1, RetrievalConfig
from ..functions import text as T
from ..storage import Versions, read_bytes, stored, write_bytes
from .ordinals import embedding_rows
from . import retrieval as R
from .traces import index_problems

SCHEMA_VERSION, IMPLEMENTATION, TOKENIZER = 1, "tesserine-bm25", "tokens-1"


class IndexMismatch(ValueError):
    """A stored index that is missing, stale, corrupt, or built with other settings."""


def configuration_fingerprint(k1: float = BM25_K1, b: float = BM25_B) -> str:
    said = {"implementation": IMPLEMENTATION, "tokenizer": TOKENIZER, "pattern": T.TOKEN, "code": T.CODE, "k1": k1, "b": b}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode()).hexdigest()


def binding(chunks: DataFrame) -> dict:
    """Rows and two sums over hashes of (chunk_id, text): the same for the same chunks in any order, computed in one pass."""
    h = F.xxhash64(F.col("chunk_id"), F.sha2(F.coalesce("text", F.lit("")), 256))
    row = chunks.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftrightunsigned(h, 20).cast("decimal(38,0)")), F.lit(0))).first()
    return {"rows": row[0], "xor": str(row[1]), "sum": str(row[2])}


@dataclass(frozen=True)
class SparseIndex:
    spark: SparkSession
    path: str
    manifest: dict = field(hash=False)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def search(self, queries: DataFrame, k: int, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
        """bm25() from the stored postings; reads only those of the queries' tokens while these are few."""
        asked = R.query_tokens(queries)
        few = [r[0] for r in asked.select("token").distinct().limit(R.LITERALS + 1).collect()]
        rows = self.table("postings")
        if k <= 0 or not few or not self.manifest["chunk_count"]:
            return R.no_ranking(rows, queries)
        hits = rows.where(F.col("token").isin(few)) if len(few) <= R.LITERALS else rows.join(asked.select("token").distinct(), "token", "left_semi")
        salt = R.hash_salt(asked)
        held = stored(R.chunk_rows(hits.select("chunk_id", "dl", F.array_repeat(R.token_hash(salt, F.col("token")), F.col("tf").cast("int")).alias("has"))), "chunk-tokens")
        return R.bm25_scores(held, asked, salt, self.manifest["chunk_count"], self.manifest["average_length"], k, config)

    def metadata_candidates(self, queries: DataFrame, k: int) -> DataFrame:
        """The metadata channel from the stored entity rows."""
        return R.metadata_candidates(self.table("entities"), queries, k)


def build_sparse(chunks: DataFrame, path: str, config: RetrievalConfig = RetrievalConfig(), vectors: DataFrame | None = None, vector_settings: dict | None = None) -> SparseIndex:
    """Writes the index of chunks (chunk_id, text and, for the metadata channel, entity, field, page) and, if given, their
    vectors (chunk_id, embedding), as a new version. One tokenising pass; the mean length comes from the postings."""
    spark = chunks.sparkSession
    made: dict = {}

    def write(folder: str) -> None:
        rows = R.postings(chunks).sortWithinPartitions("token", "chunk_id")
        rows.write.option("parquet.bloom.filter.enabled#token", "true").parquet(f"{folder}/postings")
        if {"entity", "field", "page"} <= set(chunks.columns):
            chunks.select("chunk_id", "entity", "field", "page").write.parquet(f"{folder}/entities")
        total, words = spark.read.parquet(f"{folder}/postings").agg(F.coalesce(F.sum("tf"), F.lit(0)), F.count_distinct("token")).first()
        bound = binding(chunks)
        manifest = {
            "schema_version": SCHEMA_VERSION, "implementation": IMPLEMENTATION, "tokenizer": TOKENIZER, "configuration_fingerprint": configuration_fingerprint(config.k1, config.b),
            "k1": config.k1, "b": config.b, "chunk_count": bound["rows"], "average_length": total / bound["rows"] if bound["rows"] else 0.0, "vocabulary_size": words, "binding": bound,
        }
        if vectors is not None:
            own = embedding_rows(chunks).join(vectors.select("chunk_id", "embedding"), "chunk_id")
            own.sortWithinPartitions("vector_row").write.parquet(f"{folder}/vectors")
            dims = spark.read.parquet(f"{folder}/vectors").agg(F.max(F.size("embedding")), F.count("*")).first()
            manifest |= {"vector_count": dims[1], "vector_dimension": dims[0], "vector_settings": vector_settings or {}}
        manifest["manifest_fingerprint"] = manifest_fingerprint(manifest)
        write_bytes(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True).encode())
        made.update(manifest)

    version = Versions(spark, path).publish(write)
    return SparseIndex(spark, version["path"], made)


def manifest_fingerprint(manifest: dict) -> str:
    return hashlib.sha256(json.dumps({k: v for k, v in manifest.items() if k != "manifest_fingerprint"}, sort_keys=True).encode()).hexdigest()


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of the current version; None if there is no index."""
    found = Versions(spark, path).current()
    body = read_bytes(spark, f"{found['path']}/manifest.json") if found else None
    return None if body is None else json.loads(body)


def _opened(spark: SparkSession, path: str, manifest: dict) -> SparseIndex:
    return SparseIndex(spark, Versions(spark, path).current()["path"], manifest)


def is_fresh(manifest: dict | None, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig(), vector_settings: dict | None = None) -> bool:
    """Whether an index stands for these chunks and settings as it is."""
    return (
        manifest is not None and manifest.get("schema_version") == SCHEMA_VERSION and manifest.get("manifest_fingerprint") == manifest_fingerprint(manifest)
        and manifest.get("configuration_fingerprint") == configuration_fingerprint(config.k1, config.b) and (vector_settings is None or manifest.get("vector_settings") == vector_settings)
        and manifest.get("binding") == binding(chunks)
    )


def load_sparse(spark: SparkSession, path: str, chunks: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig(), deep: bool = False) -> SparseIndex:
    """The stored index. IndexMismatch if there is none, its settings are others, it is bound to other chunks (where they
    are given) or, with deep, its postings are broken."""
    manifest = read_manifest(spark, path)
    if manifest is None:
        raise IndexMismatch(f"no index at {path}")
    if manifest.get("schema_version") != SCHEMA_VERSION or manifest.get("manifest_fingerprint") != manifest_fingerprint(manifest):
        raise IndexMismatch("the manifest is of another version or was changed")
    if manifest.get("configuration_fingerprint") != configuration_fingerprint(config.k1, config.b):
        raise IndexMismatch("the index was built with another tokenizer or other settings")
    if chunks is not None and manifest.get("binding") != binding(chunks):
        raise IndexMismatch("the index is bound to other chunks")
    out = _opened(spark, path, manifest)
    if deep and chunks is not None:
        problems = index_problems(out.table("postings"), chunks.select("chunk_id").withColumn("dl", F.lit(None).cast("long"))).first()
        if problems["bad_postings"] or problems["orphans"]:
            raise IndexMismatch(f"broken postings: {problems.asDict()}")
    return out


def reuse_or_build(chunks: DataFrame, path: str, config: RetrievalConfig = RetrievalConfig()) -> SparseIndex:
    """The stored index if it is fresh, else a new one in its place."""
    manifest = read_manifest(chunks.sparkSession, path)
    return _opened(chunks.sparkSession, path, manifest) if manifest and is_fresh(manifest, chunks, config) else build_sparse(chunks, path, config)


def load_vectors(index: SparseIndex, chunks: DataFrame, settings: dict | None = None) -> DataFrame:
    """The stored vectors (vector_row, chunk_id, embedding, embedding_content_sha256). IndexMismatch if there are none, their
    settings, number or sizes differ from what the manifest says, one is not finite, a row number is missing or repeats, or
    a vector's chunk is gone or has another text."""
    m = index.manifest
    if "vector_count" not in m:
        raise IndexMismatch("the index has no vectors")
    if settings is not None and m["vector_settings"] != settings:
        raise IndexMismatch("the vectors were made with other settings")
    rows = index.table("vectors")
    bad = R.vector_report(rows).agg(F.count("*").alias("n"), F.count_if((F.col("dims") != m["vector_dimension"]) | ~F.col("finite")).alias("bad")).first()
    places = rows.agg(F.count_distinct("vector_row").alias("n"), F.coalesce(F.min("vector_row"), F.lit(0)).alias("low")).first()
    now = chunks.select("chunk_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("now"))
    stale = rows.join(now, "chunk_id", "left").where(~F.col("now").eqNullSafe(F.col("embedding_content_sha256"))).limit(1).count()
    if bad["n"] != m["vector_count"] or bad["bad"] or stale or places["n"] != bad["n"] or places["low"] < 0:
        raise IndexMismatch(f"{bad['n']} vectors, {bad['bad']} of them wrong, {places['n']} row numbers, {'some' if stale else 'none'} without their chunk's text")
    return rows
