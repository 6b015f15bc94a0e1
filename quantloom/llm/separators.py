"""Token counts by a separator scan over flat token files without an index.

A flat file is a run of little-endian ids cut into blocks anywhere, also inside a
document; only the end-of-document id marks where documents end. Every block is
searched on its own as a numpy vector. A prefix scan over the blocks' summaries
(ids, separators, last separator), first within chunks of blocks and then over the
chunks, stitches the documents that cross blocks.

Nulls: a null text counts as empty, a document of 0 tokens; null doc_ids stay. Repeated
rows count as often as they occur; very long texts cross as many blocks as they need.
No rows, no blocks and no documents. write_flat() reads doc_id and text only, so other
columns can't clash; the string of the end token in a text is ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, slices, vocabulary_path

END_ID = 50256  # <|endoftext|>, which no ordinary text encodes to
BLOCK_BYTES = 1 << 19
CHUNK_BLOCKS = 1024


def read_flat_files(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks (file, block, data) of raw files of ids, read by Spark's binary reader."""

    def cut(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content")):
                view = data.as_buffer()
                for k, at in enumerate(range(0, view.size, block_bytes)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([view.slice(at, min(block_bytes, view.size - at)).to_pybytes()])], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(cut, "file string, block long, data binary")


def write_flat(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, block_bytes: int = BLOCK_BYTES) -> None:
    """Tokenize ``docs`` (doc_id, text) to flat files of uint16 ids at ``path``/kind=block, one file a task.

    The order of documents, which a flat file doesn't tell, goes to ``path``/kind=order."""
    vocabulary = vocabulary or vocabulary_path()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        enc, end, file = encoder(vocabulary, plain=True), np.uint16(end_id).astype("<u2").tobytes(), f"part-{TaskContext.get().partitionId():06d}"
        names = ["kind", "file", "block", "data", "doc_ids"]
        kept, k, seen = bytearray(), 0, 0

        def row(kind: str, number: int, data: bytes | None, ids: list | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([file]), pa.array([number], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], names)

        for whole in batches:
            for b in slices(whole):
                for raw in enc.encode(b.column("text").to_pylist()):
                    kept += raw
                    kept += end
                yield row("order", seen, None, b.column("doc_id").to_pylist())
                seen += b.num_rows
                while len(kept) >= block_bytes:
                    yield row("block", k, bytes(kept[:block_bytes]), None)
                    del kept[:block_bytes]
                    k += 1
        if kept:
            yield row("block", k, bytes(kept), None)

    rows = docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    rows.mapInArrow(run, "kind string, file string, block long, data binary, doc_ids array<long>").write.partitionBy("kind").option("compression", "zstd").parquet(path)


def read_flat(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Blocks (file, block, data) and order (file, ordinal, doc_id) as write_flat() left them."""
    schema = "file string, block long, data binary, doc_ids array<long>, kind string"
    both = spark.read.schema(schema).parquet(path)
    order = both.where("kind = 'order'").select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id"))
    return both.where("kind = 'block'").select("file", "block", "data"), order.select("file", (F.col("block") + F.col("k")).alias("ordinal"), "doc_id")


def separator_scan(blocks: DataFrame, end_id: int, width: int = 2, chunk_blocks: int = CHUNK_BLOCKS) -> DataFrame:
    """Documents of flat files: file, ordinal, start (in ids), n_tokens (without the end id), closed.

    ``blocks`` has file, block (0, 1, ... in order) and data; each block holds whole ids of
    ``width`` bytes. Two separators in a row are a document of 0 tokens. Ids after a file's
    last separator make one more document with ``closed`` false. Empty files have none."""
    kind = {2: "<u2", 4: "<u4", 8: "<u8"}[width]

    def find(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = [np.frombuffer(d.as_buffer(), dtype=kind) if d.is_valid else np.empty(0, kind) for d in b.column("data")]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            at = pa.array(np.cumsum([0, *map(len, ends)]), pa.int32())
            flat = pa.array(np.concatenate(ends) if ends else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("block"), pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(at, flat)], ["file", "block", "n", "ends"])

    found = common.materialize(blocks.select(F.col("file").cast("string"), F.col("block").cast("long"), "data").mapInArrow(find, "file string, block long, n long, ends array<long>"), "separators")
    found = found.withColumns({"chunk": F.floor(F.col("block") / chunk_blocks), "seps": F.size("ends").cast("long"), "last": F.try_element_at("ends", F.lit(-1))})

    by_chunk = W.partitionBy("file", "chunk").orderBy("block")
    before = by_chunk.rowsBetween(W.unboundedPreceding, -1)
    sums = found.drop("ends").withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.withColumns({"inner_seps": F.coalesce(F.sum("seps").over(before), F.lit(0)), "inner_last": F.max(F.col("inner") + F.col("last")).over(before)})

    by_file = W.partitionBy("file").orderBy("chunk")
    earlier = by_file.rowsBetween(W.unboundedPreceding, -1)
    chunks = sums.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("seps").alias("seps"), F.max(F.col("inner") + F.col("last")).alias("last"))
    chunks = chunks.withColumns({"base": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "base_seps": F.coalesce(F.sum("seps").over(earlier), F.lit(0))})
    chunks = chunks.withColumns({"base_last": F.max(F.col("base") + F.col("last")).over(earlier), "to": F.col("base") + F.col("n")})

    placed = found.drop("seps", "last", "n").join(sums.select("file", "chunk", "block", "inner", "inner_seps", "inner_last"), ["file", "chunk", "block"])
    placed = placed.join(chunks.select("file", "chunk", "base", "base_seps", "base_last"), ["file", "chunk"])
    offset = F.col("base") + F.col("inner")
    placed = placed.select(
        "file", "ends", offset.alias("offset"), (F.col("base_seps") + F.col("inner_seps")).alias("first"),
        (F.coalesce(F.col("base") + F.col("inner_last"), F.col("base_last"), F.lit(-1)) + 1).alias("open_from"),
    )
    docs = placed.select("*", F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open_from")).otherwise(F.col("offset") + F.try_element_at("ends", F.col("k")) + 1)
    docs = docs.select("file", (F.col("first") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("offset") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = chunks.groupBy("file").agg(F.sum("seps").alias("ordinal"), (F.coalesce(F.max(F.col("base") + F.col("last")), F.lit(-1)) + 1).alias("start"), F.max("to").alias("to"))
    tails = tails.where("to > start").select("file", "ordinal", "start", (F.col("to") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(tails)


def op1_separator_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents from flat token files: doc_id, file, ordinal, start, n_tokens."""
    path = common.scratch_path(spark, "flat-tokens")
    write_flat(common.table(spark, sf_dir, "documents"), path)
    blocks, order = read_flat(spark, path)
    return separator_scan(blocks, END_ID).join(order, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
