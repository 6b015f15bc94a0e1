"""Fill-in-middle over an index of distinct texts.

Documents with the same SHA-256 of their text form a group. A bounded filter over the
digests of groups tells which texts occur once for certain: such a text is its own index
entry, and it never moves. The others meet by digest: the index holds each of their
texts once, with its code point boundaries (byte offsets, the end included) as an
Elias-Fano list. The list is joined back to every document of the group whose bytes are
those of the entry; a document whose bytes differ (a collision) gets an entry of its own.
A join by digest is one that Spark can split, so a group of any size goes to many tasks.

Each document selects its two cuts from the list by hashes of seed and doc_id: both are
uniform over the n + 1 places between code points. Forms: psm puts prefix, suffix and
middle in this order behind their marks, spm suffix, prefix and middle; a text that is
empty, holds a mark or loses the draw stays plain.

Nulls: a null text counts as empty, a null doc_id as no digits after the seed. Rows that
repeat give rows that repeat. Very long texts stay whole. No rows, no rows out. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .exact_dedup import sha256_digest

#: Marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1"
#: In percent: documents that stay plain, and of the others those in the order suffix, prefix, middle.
PLAIN_SHARE, SPM_SHARE = 10, 20
#: Bits of the upper half that share an entry of the directory.
STRIDE = 512
_HEAD = struct.Struct("<QQB")


def encode(raw: bytes) -> bytes:
    """The Elias-Fano list of the code point boundaries of UTF-8 bytes, their end included."""
    at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    at = np.append(at, len(raw))
    low = max(0, ((len(raw) + 1) // len(at)).bit_length() - 1)
    bits = np.zeros(-(-((len(raw) >> low) + len(at) + 1) // STRIDE) * STRIDE, np.uint8)
    bits[(at >> low) + np.arange(len(at))] = 1
    ahead = np.cumsum(bits.reshape(-1, STRIDE).sum(axis=1, dtype=np.int64))
    lower = np.packbits((at[:, None] >> np.arange(low)) & 1, bitorder="little") if low else np.empty(0, np.uint8)
    return _HEAD.pack(len(at), len(raw), low) + np.append(0, ahead[:-1]).astype("<u4").tobytes() + np.packbits(bits, bitorder="little").tobytes() + lower.astype(np.uint8).tobytes()


class Boundaries:
    """An Elias-Fano list that encode() made."""

    def __init__(self, raw: bytes):
        self.count, self.end, self.low = _HEAD.unpack_from(raw)
        parts = -(-((self.end >> self.low) + self.count + 1) // STRIDE)
        self.directory = np.frombuffer(raw, "<u4", parts, _HEAD.size)
        self.upper = np.frombuffer(raw, np.uint8, parts * STRIDE // 8, _HEAD.size + 4 * parts)
        self.lower = np.frombuffer(raw, np.uint8, -1, _HEAD.size + 4 * parts + parts * STRIDE // 8)

    def select(self, k: int) -> int:
        """The byte offset of boundary ``k``."""
        part = int(np.searchsorted(self.directory, k, side="right")) - 1
        bits = np.unpackbits(self.upper[part * STRIDE // 8 : (part + 1) * STRIDE // 8], bitorder="little")
        place = part * STRIDE + int(np.flatnonzero(bits)[k - int(self.directory[part])])
        out = (place - k) << self.low
        for b in range(self.low):
            at = k * self.low + b
            out |= ((int(self.lower[at >> 3]) >> (at & 7)) & 1) << b
        return out


def draws(doc_id: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def form_of(text: Column, h3: Column, h4: Column) -> Column:
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((text == "") | marked | (h3 % 100 >= 100 - PLAIN_SHARE), "plain").when(h4 % 100 < SPM_SHARE, "spm").otherwise("psm")


def indexed(docs: DataFrame, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """doc_id, text and bounds of every document: its group's list, null where a text is its own entry."""
    base = docs.select("doc_id", common.text_or_empty().alias("text")).withColumn("key", digest(F.col("text")))
    shared = common.materialize(base.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "fim-shared")
    split = common.KeyFilter(shared, "key", name="fim-filter").split(base, F.col("key"))
    alone = split.where("NOT __maybe").select("doc_id", "text", F.lit(None).cast("binary").alias("bounds"))
    copies = common.materialize(split.where("__maybe").select("doc_id", "text", "key"), "fim-copies")

    @F.pandas_udf("binary")
    def listed(texts):
        return texts.map(lambda t: encode(t.encode("utf-8", "surrogatepass")))

    entries = copies.groupBy(F.col("key").alias("of")).agg(F.min("text").alias("entry"))
    entries = common.materialize(entries.withColumn("list", listed("entry")), "fim-index")
    met = copies.join(entries, F.col("key") == F.col("of"))
    return alone.unionByName(met.select("doc_id", "text", F.when(F.col("text") == F.col("entry"), F.col("list")).alias("bounds")))


def fill_middle(docs: DataFrame, seed: str = SEED, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """doc_id, n (code points), form, prefix_chars, middle_chars, output of every document."""
    h = draws(F.col("doc_id"), seed)
    rows = indexed(docs, digest).select("doc_id", "text", "bounds", form_of(F.col("text"), h[2], h[3]).alias("form"), h[0].alias("h1"), h[1].alias("h2"))
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for raw, held, form, h1, h2 in zip(*(b.column(c).to_pylist() for c in ("text", "bounds", "form", "h1", "h2"))):
                list_ = Boundaries(held if held is not None else encode(raw))
                n = list_.count - 1
                if form == "plain":
                    out.append((n, None, None, raw))
                    continue
                i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
                x, y = list_.select(i), list_.select(j)
                parts = (p, raw[:x], s, raw[y:], m, raw[x:y]) if form == "psm" else (s, raw[y:], p, raw[:x], m, raw[x:y])
                out.append((n, i, j - i, b"".join(parts)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            n, i, j, text = (pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, kinds))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, b.column("form"), i, j, text.cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = rows.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"), "bounds", "form", "h1", "h2")
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""
    at = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(at[1], at[3], at[2])).when(form == "spm", F.concat(at[2], at[3], at[1])).otherwise(output)


def op12_distinct_text_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    out = fill_middle(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS c2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
f AS (SELECT *, least(c1, c2) AS i, greatest(c1, c2) AS j, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, i) AS pre, substr(t, i + 1, j - i) AS mid, substr(t, j + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
