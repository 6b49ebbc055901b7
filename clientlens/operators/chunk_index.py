"""An index of chunks and their vectors that is brought up to date, not rebuilt.

A chunk's vector depends on its text alone, so vectors are kept by content hash, in folders that only
grow; a version of the index is a table of chunks (with their hashes) and the list of vector
folders.  A build embeds the texts whose hash has no vector yet, writes the new version's table and
then switches to it by one log entry; until then, and after a build that failed, readers see the
version before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientlens.operators.vectors import hashed_embedding
from clientlens.sources.commits import Versions

CHUNKS = "id string, source long, chunk int, text string, hash string"
VECTORS = "hash string, embedding array<float>"


class ChunkIndex:
    """An index at ``path``.  ``embed`` adds the column ``embedding`` to rows with a ``text``."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame] = hashed_embedding):
        self.spark, self.embed, self.versions = spark, embed, Versions(spark, path)

    def _vectors(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(VECTORS).parquet(*folders) if folders else self.spark.createDataFrame([], VECTORS)

    def build(self, chunks: DataFrame) -> dict:
        """Bring the index to ``chunks`` (id, source, chunk, text); facts of the new version: its number,
        chunks, and embedded (texts that had no vector yet)."""
        try:
            known = list(self.versions.current()[1]["vectors"])
        except FileNotFoundError:
            known = []
        folder = self.versions.folder()
        chunks.select("id", "source", "chunk", "text", F.sha2("text", 256).alias("hash")).write.parquet(f"{folder}/chunks")
        rows = self.spark.read.schema(_typed(chunks)).parquet(f"{folder}/chunks")
        # hashes are narrow; a text that many chunks share is embedded once
        missing = rows.select("hash").distinct().join(self._vectors(known).select("hash"), "hash", "left_anti")
        texts = rows.join(missing, "hash", "left_semi").groupBy("hash").agg(F.first("text").alias("text"))
        self.embed(texts).select("hash", "embedding").write.parquet(f"{folder}/vectors")
        embedded = self.spark.read.schema(VECTORS).parquet(f"{folder}/vectors").count()
        facts = {"vectors": [*known, *([f"{folder}/vectors"] if embedded else [])], "embedded": embedded, "chunks": rows.count(), "schema": _typed(chunks)}
        return {"version": self.versions.switch(folder, **facts), **facts}

    def read(self, version: int | None = None) -> DataFrame:
        """(id, source, chunk, text, embedding) of the current (or a named) version."""
        entry = self.versions.current(version)[1]
        rows = self.spark.read.schema(entry["schema"]).parquet(f"{entry['folder']}/chunks")
        return rows.join(self._vectors(entry["vectors"]), "hash").select("id", "source", "chunk", "text", "embedding")


def _typed(chunks: DataFrame) -> str:
    """The stored chunk table's schema: ``source`` keeps its type."""
    return CHUNKS.replace("source long", f"source {chunks.schema['source'].dataType.simpleString()}")
