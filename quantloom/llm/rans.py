"""Token-ID / binary output: static-range asymmetric numeral system (rANS) blocks.

File format: Parquet rows, one per block, in ascending order of ``part``, ``block``.
A block holds the ids of whole documents and decodes without any other block; the
ids of all documents share one frequency table, which a file of its own holds.

Within a block, id ``i`` belongs to lane ``i % lanes``; all lanes advance together
as numpy vectors. States are 64 bits wide and give out 32-bit words. ``words`` is
the stream in the order in which a decoder takes it, ``checkpoints`` are the lanes'
states and the stream's position at every ``every``-th step, and ``crc32`` is the
checksum of the block's ids. A reader starts at all checkpoints of a block at once, so
that their pieces advance together, and each must end in the states and at the place of
the next; decode_steps() decodes one piece alone.

Nulls: null and empty texts are the end id alone, null doc_ids come first. Repeated rows
are written as often as they occur, a very long text is a block of its own or more; a
table without rows gives a file without blocks. Only doc_id and text are read, so other
columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common
from .tokens import encoder, slices, vocabulary_path

SCALE_BITS = 20
LANES = 4096
BLOCK_IDS = 1 << 21
CHECKPOINT_STEPS = 128
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_SCALE = np.uint64(SCALE_BITS)
_SLOT = np.uint64((1 << SCALE_BITS) - 1)
_WORD = np.uint64(0xFFFFFFFF)


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS, at least 1 wherever the count is positive.

    ``counts`` without any positive entry gives id 0 the whole range."""
    counts = np.asarray(counts, dtype=np.float64)
    total = 1 << SCALE_BITS
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), dtype=np.int64)
    if not len(used):
        out[0] = total
        return out
    if len(used) > total // 2:
        raise ValueError("too many ids for the scale")
    share = counts[used] / counts[used].sum() * (total - len(used))
    freq = np.floor(share).astype(np.int64) + 1
    short = total - int(freq.sum())
    freq[np.argsort(-(share - np.floor(share)), kind="stable")[:short]] += 1
    out[used] = freq
    return out


class Table:
    """The shared frequency table in the forms that coding needs."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.id_of_slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.room = self.freq << np.uint64(63 - SCALE_BITS)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> dict:
    """Words, checkpoints and checksum of one block. All ids need a positive frequency."""
    n = len(ids)
    if n and not table.freq[ids].all():
        raise ValueError("an id has no frequency")
    state = np.full(lanes, _LOW, dtype=np.uint64)
    steps = -(-n // lanes)
    out: list[np.ndarray] = []
    given = 0
    points: list[tuple[int, int, bytes]] = []
    for k in range(steps - 1, -1, -1):  # backwards: a decoder runs forwards
        now = ids[k * lanes : (k + 1) * lanes]
        x = state[: len(now)]
        freq = table.freq[now]
        full = x >= table.room[now]
        if full.any():
            out.append((x[full] & _WORD).astype("<u4"))
            given += len(out[-1])
            x = np.where(full, x >> _32, x)
        whole = x // freq
        state[: len(now)] = (whole << _SCALE) + (x - whole * freq) + table.start[now]
        if k % every == 0:
            points.append((k, given, state.astype("<u8").tobytes()))
    points.reverse()
    return {
        "n_ids": n,
        "lanes": lanes,
        "words": b"".join(a.tobytes() for a in reversed(out)),
        "checkpoints": [{"step": k, "word": given - g, "states": s} for k, g, s in points],
        "crc32": zlib.crc32(np.asarray(ids, dtype="<u4").tobytes()),
    }


def decode_steps(block: dict, table: Table, point: int, until: int | None = None) -> np.ndarray:
    """Ids from one checkpoint up to the step ``until`` (the block's end if None)."""
    lanes, n = block["lanes"], block["n_ids"]
    at = block["checkpoints"][point]
    words = np.frombuffer(block["words"], dtype="<u4")
    state = np.frombuffer(at["states"], dtype="<u8").copy()
    steps = -(-n // lanes)
    until = steps if until is None else min(until, steps)
    pos = at["word"]
    out = np.empty(max(0, min(n, until * lanes) - at["step"] * lanes), dtype=np.uint32)
    for k in range(at["step"], until):
        width = min(lanes, n - k * lanes)
        x = state[:width]
        slot = x & _SLOT
        ids = table.id_of_slot[slot]
        x = table.freq[ids] * (x >> _SCALE) + slot - table.start[ids]
        low = np.flatnonzero(x < _LOW)
        if len(low):
            x[low] = (x[low] << _32) | words[pos : pos + len(low)].astype(np.uint64)
            pos += len(low)
        state[:width] = x
        out[(k - at["step"]) * lanes : (k - at["step"]) * lanes + width] = ids
    return out


def decode_block(block: dict, table: Table) -> np.ndarray:
    """All ids of a block, decoded from all its checkpoints in step; raises where a checkpoint or the checksum differs."""
    lanes, n, points = block["lanes"], block["n_ids"], block["checkpoints"]
    words = np.frombuffer(block["words"], dtype="<u4")
    steps, first = -(-n // lanes), np.array([p["step"] for p in points], dtype=np.int64)
    out = np.empty((steps, lanes), dtype=np.uint32)
    if n:
        state = np.stack([np.frombuffer(p["states"], dtype="<u8") for p in points])
        pos, last = np.array([p["word"] for p in points], dtype=np.int64), np.append(first[1:], steps)
        for k in range(int((last - first).max())):
            rows = np.flatnonzero(first + k < last)
            live = slice(0, len(points)) if len(rows) == len(points) else rows
            x = state[live]
            slot = x & _SLOT
            ids = table.id_of_slot[slot]
            x = table.freq[ids] * (x >> _SCALE) + slot - table.start[ids]
            if first[rows[-1]] + k == steps - 1:  # lanes beyond the block's end stand still
                x[-1, n - (steps - 1) * lanes :] = state[live][-1, n - (steps - 1) * lanes :]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                took = np.bincount(low // lanes, minlength=len(rows))
                at = np.repeat(pos[rows] - (np.cumsum(took) - took), took) + np.arange(len(low))
                flat = x.reshape(-1)
                flat[low] = (flat[low] << _32) | words[at].astype(np.uint64)
                pos[rows] += took
            state[live] = x
            out[first[rows] + k] = ids
        if (pos[:-1] != [p["word"] for p in points[1:]]).any() or any(s.astype("<u8").tobytes() != p["states"] for s, p in zip(state, points[1:])):
            raise ValueError("a piece doesn't end where the next begins")
    ids = out.reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != block["crc32"]:
        raise ValueError("checksum differs")
    return ids


def tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, n (ids with the end id), ids (zstd-compressed uint16), counts. Null text: only the end id.

    One row of each batch carries the batch's counts of every id (compressed), the others null."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import zstandard

        enc, press, end = encoder(vocabulary), zstandard.ZstdCompressor(1), np.uint16(end_id).astype("<u2").tobytes()
        for whole in batches:
            for b in slices(whole):
                raw = [r + end for r in enc.encode(b.column("text").to_pylist())]
                counts = np.bincount(np.frombuffer(b"".join(raw), dtype="<u2"), minlength=1 << 16).astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), pa.array([len(r) // 2 for r in raw], pa.int64()), pa.array([press.compress(r) for r in raw], pa.binary()),
                        pa.array([press.compress(counts)] + [None] * (len(raw) - 1), pa.binary()),
                    ],
                    ["doc_id", "n", "ids", "counts"],
                )

    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Counts of every id over all documents; a row an id at most reaches the driver."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import zstandard

        total, press = np.zeros(1 << 16, dtype=np.int64), zstandard.ZstdDecompressor()
        for b in batches:
            for raw in b.column("counts").to_pylist():
                total += np.frombuffer(press.decompress(raw), dtype="<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in tokens.select("counts").where("counts IS NOT NULL").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


_BLOCK = (
    "part int, block int, doc_ids array<long>, doc_lens array<long>, n_ids long, lanes int, words binary, "
    "checkpoints array<struct<step:int,word:long,states:binary>>, crc32 long"
)


def write_blocks(tokens: DataFrame, freq: np.ndarray, path: str, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> None:
    """Write documents in ascending doc_id order (null ids first, then by length and ids) as blocks."""
    shared = tokens.sparkSession.sparkContext.broadcast(freq)  # its size is the vocabulary's

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa
        import zstandard

        table, press, part, k = Table(shared.value), zstandard.ZstdDecompressor(), TaskContext.get().partitionId(), 0
        schema = pa.schema([
            ("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_lens", pa.list_(pa.int64())),
            ("n_ids", pa.int64()), ("lanes", pa.int32()), ("words", pa.binary()),
            ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int64()), ("states", pa.binary())]))), ("crc32", pa.int64()),
        ])

        def close(ids: list, held: list) -> pa.RecordBatch:
            row = encode_block(np.concatenate(held), table, lanes) | {"part": part, "block": k, "doc_ids": ids, "doc_lens": [len(h) for h in held]}
            return pa.RecordBatch.from_pylist([row], schema)

        ids: list = []
        held: list = []
        size = 0
        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), b.column("ids")):
                ids.append(doc)
                held.append(np.frombuffer(press.decompress(raw.as_py()), dtype="<u2"))
                size += len(held[-1])
                if size >= block_ids:
                    yield close(ids, held)
                    ids, held, size, k = [], [], 0, k + 1
        if ids:
            yield close(ids, held)

    order = [F.asc_nulls_first("doc_id"), F.asc("n")]
    parts = max(tokens.rdd.getNumPartitions(), 1)
    dealt = tokens.select("doc_id", "n", "ids").repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids").select("doc_id", "ids")
    dealt.mapInArrow(run, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


def read_documents(spark, path: str, digest: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids themselves where ``digest`` is false) from the files."""
    freq = np.zeros(1, dtype=np.int64)
    rows = spark.read.schema("id long, freq long").parquet(f"{path}/table").collect()  # the vocabulary's size at most
    if rows:
        freq = np.zeros(max(r.id for r in rows) + 1, dtype=np.int64)
        for r in rows:
            freq[r.id] = r.freq
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row per written file
    within = blocks.select("part", "block", (F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("inner"))
    starts = within.join(parts, "part").select("part", "block", (F.col("before") + F.col("inner")).alias("block_start"))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        table = Table(shared.value)
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("n_ids", "lanes", "words", "checkpoints", "crc32")}
                lens = np.array(b.column("doc_lens")[k].as_py(), dtype=np.int64)
                ids = decode_block(row, table).astype("<u4")
                ends = np.cumsum(lens)
                raw, begin = memoryview(ids.tobytes()), ends - lens
                pieces = [raw[4 * s : 4 * e] for s, e in zip(begin.tolist(), ends.tolist())]
                what = pa.array([zlib.crc32(p) for p in pieces], pa.int64()) if digest else pa.array([bytes(p) for p in pieces], pa.binary())
                n = len(lens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("part")[k].as_py()] * n, pa.int32()), pa.array([b.column("block")[k].as_py()] * n, pa.int32()), pa.array(begin), b.column("doc_ids")[k].values, pa.array(lens), what],
                    ["part", "block", "inner", "doc_id", "n_tokens", "what"],
                )

    kind, name = ("long", "ids_crc32") if digest else ("binary", "ids")
    got = blocks.mapInArrow(run, f"part int, block int, inner long, doc_id long, n_tokens long, what {kind}")
    return got.join(starts, ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("inner")).alias("start"), "n_tokens", F.col("what").alias(name))


def write_token_file(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS, lanes: int = LANES) -> None:
    """Encode every text of ``docs`` (doc_id, text) and write the token file at ``path``.

    Null and empty texts are the end id alone; null doc_ids come first; repeated rows
    are written as often as they occur; an empty table gives a file without blocks."""
    spark = docs.sparkSession
    tokens = common.materialize(tokenize(docs, vocabulary or vocabulary_path(), end_id), "token-ids", codec="uncompressed")
    freq = quantize(frequencies(tokens))
    used = np.flatnonzero(freq)
    table = spark.createDataFrame([(int(i), int(freq[i])) for i in used], "id long, freq long")
    table.coalesce(1).write.parquet(f"{path}/table")
    write_blocks(tokens, freq, path, block_ids, lanes)
    common.drop(tokens)


def op2_rans_token_file(spark, sf_dir: str) -> DataFrame:
    """Per document, read back from the written file: doc_id, start, n_tokens, ids_crc32."""
    path = common.scratch_path(spark, "rans")
    write_token_file(common.table(spark, sf_dir, "documents"), path)
    return read_documents(spark, path)
