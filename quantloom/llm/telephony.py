"""Telephony audio columns: store 8-bit coded samples as WAV files, expand them, store resampled PCM.

Three formats: G.711 mu-law and A-law, one byte a sample, expanded by tables of 256
entries; IMA ADPCM, two 4-bit codes a byte in blocks of 192 code bytes behind a 4-byte
header, decoded by numpy in lockstep across all blocks of a batch. ``encode_media``
packs code bytes losslessly into the files, ``read_media`` takes them out again beside
the resampled 16-bit PCM, ``with_features`` reads stored PCM, and ``with_pcm`` adds a
column of PCM to any table of files.

The query stores PCM of OUT_RATE samples a second, several times the input's bytes, of a slice
of the documents at a time: a slice's files and PCM go once its features are computed from them.

Nulls: null codes are empty; an empty payload isn't a file without samples, since
payloads are padded to 192 bytes. Files that aren't WAV files of the three formats
give null codes and null PCM. Very long texts become long files, a few at a time in
memory. Repeated rows give equal rows; no rows, no rows out. encode_media() reads doc_id
and text only; with_pcm() keeps all columns, and where one has the name pcm or pcm_rate,
the new ones are pcm_2, pcm_rate_2 or the first free after that.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from . import common

UNIT = 192
RATE = 8000
OUT_RATE = 16000
#: Of the query's PCM: no less than with_pcm() gives.
QUERY_RATE = OUT_RATE
FORMATS = ("mulaw", "alaw", "ima_adpcm")
_TAGS = {"mulaw": 7, "alaw": 6, "ima_adpcm": 17}
_NAMES = {v: k for k, v in _TAGS.items()}
_HEADER = 4
BLOCK = _HEADER + UNIT
BLOCK_SAMPLES = 1 + 2 * UNIT

# Fixed values of the IMA ADPCM format.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190,
    209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499,
    2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
    22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    step, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(step == 0, low + 8, (low + 264) << np.maximum(step - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


_TABLES = {"mulaw": mulaw_table(), "alaw": alaw_table()}


def _step_tables() -> tuple[np.ndarray, np.ndarray]:
    """Signed change and next index for each (index, code)."""
    code, step = np.arange(16), STEPS[:, None]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    after = np.clip(np.arange(len(STEPS))[:, None] + MOVES[code & 7], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), after.astype(np.int32).ravel()


_CHANGE, _AFTER = _step_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples of mono IMA ADPCM blocks, one row of bytes a block; all blocks advance together."""
    n, width = blocks.shape
    value = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    codes = np.ascontiguousarray(blocks[:, _HEADER:].T)
    out = np.empty((1 + 2 * (width - _HEADER), n), dtype=np.int16)
    out[0] = value
    for k, both in enumerate(codes):
        for half, code in ((1, both & 15), (2, both >> 4)):
            at = index * 16 + code
            value = np.clip(value + _CHANGE[at], -32768, 32767)
            index = _AFTER[at]
            out[2 * k + half] = value
    return np.ascontiguousarray(out.T)


def pack(codes: bytes, kind: str, rate: int = RATE) -> bytes:
    """A WAV file of the code bytes; ADPCM takes them in blocks of UNIT behind an all-zero header."""
    if kind == "ima_adpcm":
        head = bytes(_HEADER)
        data = b"".join(head + codes[at : at + UNIT] for at in range(0, len(codes), UNIT))
        form = struct.pack("<HHIIHHHH", 17, 1, rate, rate * BLOCK // BLOCK_SAMPLES, BLOCK, 4, 2, BLOCK_SAMPLES)
        samples = len(data) // BLOCK * BLOCK_SAMPLES
    else:
        data, samples = codes, len(codes)
        form = struct.pack("<HHIIHHH", _TAGS[kind], 1, rate, rate, 1, 8, 0)
    parts = [(b"fmt ", form), (b"fact", struct.pack("<I", samples)), (b"data", data)]
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(x)) + x + b"\0" * (len(x) % 2) for name, x in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unpack(file: bytes | None) -> tuple[str, int, bytes] | None:
    """Format, rate and data of a WAV file of one of the three formats, else None."""
    if not file or len(file) < 12 or file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        return None
    at, found = 12, {}
    while at + 8 <= len(file):
        size = struct.unpack_from("<I", file, at + 4)[0]
        found[file[at : at + 4]] = file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    form, data = found.get(b"fmt "), found.get(b"data")
    if form is None or data is None or len(form) < 16:
        return None
    tag, channels, rate = struct.unpack_from("<HHI", form)
    if channels != 1 or tag not in _NAMES or tag == 17 and (struct.unpack_from("<H", form, 12)[0] != BLOCK or len(data) % BLOCK):
        return None
    return _NAMES[tag], rate, data


def codes_of(kind: str, data: bytes) -> bytes:
    """The code bytes that pack() was given."""
    if kind != "ima_adpcm":
        return data
    return np.frombuffer(data, np.uint8).reshape(-1, BLOCK)[:, _HEADER:].tobytes()


def expand(files: list[tuple[str, int, bytes] | None]) -> list[np.ndarray | None]:
    """int16 samples of each file; the ADPCM blocks of all files are decoded together."""
    own = [np.frombuffer(f[2], np.uint8).reshape(-1, BLOCK) for f in files if f and f[0] == "ima_adpcm"]
    decoded = decode_adpcm(np.concatenate(own)) if own else None
    out, at = [], 0
    for f in files:
        if f is None:
            out.append(None)
        elif f[0] == "ima_adpcm":
            n = len(f[2]) // BLOCK
            out.append(decoded[at : at + n].ravel())
            at += n
        else:
            out.append(_TABLES[f[0]][np.frombuffer(f[2], np.uint8)])
    return out


#: Parts of the documents whose media and PCM are stored one after another.
SLICES = 6
#: Zero crossings of the resampler's sinc on either side; they lie wider apart the lower the new rate, so that what it can't hold is gone.
LOBES = 6


def _filters(up: int, down: int) -> list[np.ndarray]:
    """Whole-number taps (sum 2**15) of a windowed sinc for each phase."""
    cut = min(1.0, up / down)
    half, out = math.ceil(LOBES / cut), []
    for phase in range(up):
        t = np.arange(-half + 1, half + 1) - phase / up
        taps = np.sinc(t * cut) * np.cos(np.pi * t / (2 * half + 1)) ** 2
        taps = np.round(taps / taps.sum() * 32768).astype(np.int64)
        taps[np.argmax(np.abs(taps))] += 32768 - taps.sum()
        out.append(taps)
    return out


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """int16 samples at another rate, in whole-number arithmetic: the same on every machine."""
    if rate == to or not len(pcm):
        return pcm
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    n = -(-len(pcm) * up // down)
    filters = _filters(up, down)
    half = len(filters[0]) // 2
    kind = np.int32 if max(int(np.abs(t).sum()) for t in filters) * 32768 + 16384 < 2**31 else np.int64
    wide = np.concatenate([np.full(half, pcm[0]), pcm, np.full(half + 1, pcm[-1])]).astype(kind)
    out = np.empty(n, dtype=np.int16)
    for phase, taps in enumerate(filters):
        own = np.arange(phase * pow(down, -1, up) % up if up > 1 else 0, n, up)  # outputs at this phase
        if not len(own):
            continue
        used = np.flatnonzero(taps)
        first, step = own[0] * down // up, down
        total = np.full(len(own), 16384, dtype=kind)
        for k in used:
            at = first + 1 + k
            total += kind(taps[k]) * wide[at : at + step * (len(own) - 1) + 1 : step]
        out[own] = np.clip(total >> 15, -32768, 32767)
    return out


def features(kind: str, pcm: np.ndarray, rate: int) -> str:
    """Whole-number features of samples: peak, root mean square, mean, zero crossings, clipped samples, loudest 20 ms."""
    x = pcm.astype(np.int32)
    if not len(x):
        return f"{kind};{rate};0"
    frame, size = rate // 50, np.abs(x)
    power = np.add.reduceat(x * x, np.arange(0, len(x), frame), dtype=np.int64)  # a square is 2**30 at most
    low = x < 0
    zero = int(np.count_nonzero(low[1:] != low[:-1]))
    return ";".join(map(str, (kind, rate, len(x), int(size.max()), math.isqrt(int(power.sum()) // len(x)), int(x.sum(dtype=np.int64)) // len(x), zero, int(np.count_nonzero(size >= 32124)), math.isqrt(int(power.max()) // frame))))


def _cuts(sizes: Iterable[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    start = total = n = 0
    for n, s in enumerate(sizes, 1):
        total += s
        if total >= most:
            yield start, n
            start, total = n, 0
    if n > start:
        yield start, n


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // UNIT)) * UNIT, b" ")


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's padded payload as the codes of a WAV file, its format picked by the payload's crc32."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            col = b.column("text")
            for i, j in _cuts(len(t) * 2 for t in col.to_pylist()):
                both = [payload_of(t) for t in col.slice(i, j - i).to_pylist()]
                media = [pack(p, FORMATS[zlib.crc32(p) % 3]) for _, p in both]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array([n for n, _ in both], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def with_pcm(media: DataFrame, rate: int = OUT_RATE) -> DataFrame:
    """``media`` with columns pcm (little-endian int16) and pcm_rate; null where a file can't be read."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index("__media")
            col = b.column(at)
            for i, j in _cuts(map(len, (x or b"" for x in col.to_pylist()))):
                part = b.slice(i, j - i)
                files = [unpack(x) for x in col.slice(i, j - i).to_pylist()]
                pcm = [None if x is None else resample(x, f[1], rate).astype("<i2").tobytes() for x, f in zip(expand(files), files)]
                rates = pa.array([None if x is None else rate for x in pcm], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(pcm, pa.binary()), rates], ["row", "pcm", "pcm_rate"])

    rows = media.select(F.struct("*").alias("row"), F.col("media").alias("__media"))
    schema = StructType([rows.schema["row"], StructField("pcm", BinaryType()), StructField("pcm_rate", IntegerType())])
    found = rows.mapInArrow(run, schema)
    return found.select("row.*", F.col("pcm").alias(common.free_name(media, "pcm")), F.col("pcm_rate").alias(common.free_name(media, "pcm_rate")))


def read_media(media: DataFrame, rate: int = OUT_RATE) -> DataFrame:
    """What the stored files hold: payload and its digests, format, and the expanded samples as PCM at ``rate``."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "format", "pcm"]
        for b in batches:
            col = b.column("media")
            for i, j in _cuts(map(len, (x or b"" for x in col.to_pylist()))):
                stored = col.slice(i, j - i).to_pylist()
                files = [unpack(x) for x in stored]
                rows = []
                for raw, f, pcm in zip(stored, files, expand(files)):
                    if f is None:
                        rows.append((None, None, None, len(raw or b""), hashlib.sha256(raw or b"").hexdigest(), None, None))
                        continue
                    codes = codes_of(f[0], f[2])
                    rows.append((len(codes), hashlib.sha256(codes).hexdigest(), zlib.crc32(codes[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), f[0], resample(pcm, f[1], rate).astype("<i2").tobytes()))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), b.column("n_bytes").slice(i, j - i), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, format string, pcm binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def with_features(stored: DataFrame, rate: int) -> DataFrame:
    """read_media()'s rows with a feature of the PCM that they hold instead of format and pcm."""

    @F.pandas_udf("string")
    def of(kinds, pcm):
        import pandas as pd

        return pd.Series([None if p is None else features(k, np.frombuffer(p, "<i2"), rate) for k, p in zip(kinds, pcm)], dtype=object)

    return stored.withColumn("feature", of("format", "pcm")).drop("format", "pcm")


def stored_features(docs: DataFrame, rate: int, slices: int = SLICES) -> DataFrame:
    """Texts as WAV files in media tables, read_media()'s rows of these, PCM included, in tables of their own, and features of what these hold.

    A slice of the documents at a time, by hash of the id: its media and PCM tables go once its features are stored, so
    scratch holds those of one slice and the features of all."""
    fast = {"parquet.compression.codec.zstd.level": "1", "parquet.page.size": str(8 << 20), "parquet.block.size": str(32 << 20)}
    out = None
    for k in range(slices):
        media = common.materialize(encode_media(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == k)), "media", fast)
        pcm = common.materialize(read_media(media, rate), "pcm", fast)
        found = common.materialize(with_features(pcm, rate), "features")
        common.drop(media, pcm)
        out = found if out is None else out.unionByName(found)
    return out


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a WAV file in a media table; its files read back, expanded and stored as resampled PCM; digests and features of what was read."""
    return stored_features(common.table(spark, sf_dir, "documents"), QUERY_RATE)
