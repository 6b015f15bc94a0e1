"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are compared as sets of five-word shingles of their lower-cased words (runs
between white space); a text of one to four words is one shingle. Texts with the same
words form one class from the start, and one representative of each goes on. A pair of
texts is compared if their MinHash values agree on a whole band; bands follow from the
threshold so that a pair at it shares one with probability RECALL or more, and a
threshold too low for that is refused. A pair's MinHash values are compared sixteen at a
time; with m of n equal, the pair is dropped once the posterior probability (uniform
prior) that its similarity reaches the threshold is below the tolerance. What survives
is verified exactly on the words. Verified links join classes.

Pairs never leave a task. Each text lies in the cell of its largest bucket; a cell is
dealt into blocks of BLOCK texts (and BLOCK_CHARS characters) on average, by hash. Two
blocks with a bucket in common are compared in one task, every pair that shares a band
and no other, whatever the sizes; so whether a pair is a link depends on its two texts
alone, and each pair lies in one pair of blocks and counts once. The task hands on how
many links each text has and, for each group that they join, edges to one of its texts.
Time within a large group grows with the square of its different texts, as a full count
of links asks; rows moved grow with blocks.

Nulls: a null text counts as empty; texts without words form one class. Null doc_ids
come last in the choice of a class's id; a class of null ids alone has a null id.
Repeated rows fall into one class. Very long texts are blocks of their own in effect:
a block has one text at least. Other columns are read only by keep_one(), which hands
all of them on whatever their names. No rows, no rows out.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS = 5
THRESHOLD = 0.8
HASHES = 128
#: Least probability with which a pair at the threshold shares a band.
RECALL = 0.999
STEP = 16
TOLERANCE = 1e-4
#: Texts and characters of a block of a cell.
BLOCK = 256
BLOCK_CHARS = 4_000_000

_U = np.uint64
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * _U(2) + _U(1)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) * _U(2) + _U(1)
_P = _U(0x9E3779B97F4A7C15)


def words_of(text: Column) -> Column:
    """Lower-cased words with one space between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", " "))


def key_of(words: Column) -> Column:
    return F.substring(F.unhex(F.sha2(words, 256)), 1, 16)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, window: int = 1 << 21) -> np.ndarray:
    """64-bit hashes of the words raw[start:end], which lie in order; memory is bounded by the window and one word."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(end, start[at] + window, side="right")))
            size = end[at:to] - start[at:to]
            first = np.cumsum(size) - size
            place = np.arange(int(size.sum())) - np.repeat(first, size)
            power = np.cumprod(np.concatenate([[_U(1)], np.full(int(size.max()) - 1, _P)]))
            values = _BYTE[raw[place + np.repeat(start[at:to], size)]] * power[place]
            out[at:to] = _mix(np.add.reduceat(values, first))
            at = to
    return out


def shingle_hashes(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts of words_of() that lie one after another, and how many each text has."""
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    full = ends > begin
    space = np.flatnonzero(raw == 32)
    start = np.sort(np.concatenate([begin[full], space + 1]))
    end = np.sort(np.concatenate([ends[full], space]))
    words = word_hashes(raw, start, end)
    upto = np.searchsorted(start, ends, side="left")
    first = np.searchsorted(start, begin, side="left")
    n = upto - first
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    place = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    padded = np.concatenate([words, np.zeros(WORDS, dtype=np.uint64)])
    with np.errstate(over="ignore"):
        total = sum(padded[place + k] * _PLACE[k] for k in range(WORDS)) if len(place) else np.empty(0, np.uint64)
        for d in np.flatnonzero((n > 0) & (n < WORDS)):
            own = words[first[d] : upto[d]]
            total[np.cumsum(count[: d + 1])[-1] - 1] = (own * _PLACE[: len(own)]).sum() + _U(len(own)) * _PLACE[WORDS]
        return _mix(total), count


def minhashes(hashes: np.ndarray, count: np.ndarray, chunk: int = 8192) -> np.ndarray:
    """HASHES 32-bit values a text; all ones where a text has no shingle."""
    out = np.full((len(count), HASHES), 0xFFFFFFFF, dtype=np.uint32)
    of = np.repeat(np.arange(len(count)), count)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), chunk):
            own = of[at : at + chunk]
            values = ((hashes[at : at + chunk, None] * _A) >> _U(32)).astype(np.uint32)
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            docs = own[edge]
            out[docs] = np.minimum(out[docs], np.minimum.reduceat(values, edge, axis=0))
    return out


def fewest_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n = STEP, 2 STEP, ... compared values the least m for which P(similarity >= threshold | m of n) >= tolerance.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail above t is P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def survivors(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places of the pairs of rows of signatures that the incremental comparison keeps."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, m in enumerate(least):
        cols = slice(k * STEP, (k + 1) * STEP)
        equal = equal + (a[alive, cols] == b[alive, cols]).sum(1)
        stay = equal >= m
        alive, equal = alive[stay], equal[stay]
    return alive


def _signatures(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), dtype="<u4").reshape(-1, HASHES)


def sign(docs: DataFrame) -> DataFrame:
    """key, words, sig: one row for each set of texts with the same words (none for texts without words)."""

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            size = np.cumsum([len(x) for x in b.column("words").to_pylist()])
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + 2_000_000, side="right")))
                raws = [x.encode("utf-8", "surrogatepass") for x in b.column("words").slice(at, to - at).to_pylist()]
                hashes, count = shingle_hashes(np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]))
                sigs = pa.array([s.astype("<u4").tobytes() for s in minhashes(hashes, count)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("key").slice(at, to - at), b.column("words").slice(at, to - at), sigs], ["key", "words", "sig"])
                at = to

    rows = docs.select(words_of(F.col("text")).alias("words")).where("words != ''").select(key_of(F.col("words")).alias("key"), "words")
    return rows.dropDuplicates(["key"]).mapInArrow(run, "key binary, words string, sig binary")


def bands(threshold: float = THRESHOLD) -> tuple[int, int]:
    """How many bands of how many values: the longest for which a pair at the threshold shares one with probability RECALL."""
    for rows in range(HASHES, 0, -1):
        n = HASHES // rows
        if 1 - (1 - threshold**rows) ** n >= RECALL:
            return n, rows
    raise ValueError(f"{HASHES} MinHash values are too few for a threshold of {threshold}")


def buckets(signed: DataFrame, n: int, rows: int) -> DataFrame:
    """bucket, key, size for every bucket that holds size = two keys or more."""
    each = F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + k * 4 * rows, 4 * rows)) for k in range(n)])
    held = signed.select(F.explode(each).alias("bucket"), "key")
    shared = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return held.join(common.materialize(shared, "ngram-shared"), "bucket")


def shingles(words: str) -> set:
    w = words.split(" ") if words else []
    return {tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))} if w else set()


def shared_shingles(texts: list[str], a: np.ndarray, b: np.ndarray, columns: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """How many shingles the texts a and b of each pair have in common, and how many each text has."""
    ids: dict[tuple, int] = {}
    own = [np.array([ids.setdefault(x, len(ids)) for x in shingles(t)], dtype=np.int64) for t in texts]
    sizes = np.array([len(x) for x in own])
    both = np.zeros(len(a), dtype=np.int64)
    if not len(ids):
        return both, sizes
    flat, row = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
    seen = np.bincount(flat, minlength=len(ids)) > 1  # the others are in one text only
    flat, row = (np.cumsum(seen) - 1)[flat[seen[flat]]], row[seen[flat]]
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    for at in range(0, int(seen.sum()), columns):
        lo, hi = np.searchsorted(flat, [at, at + columns])
        table = np.zeros((len(own), min(columns, int(seen.sum()) - at)), dtype=np.float32)
        table[row[lo:hi], flat[lo:hi] - at] = 1
        both += (table @ table.T)[a, b].astype(np.int64)
    return both, sizes


def is_link(both, x, y, threshold: float):
    """Whether sets of x and y shingles, both of them in common, are similar enough; numbers or arrays of them."""
    return (both > 0) & (both >= threshold * (x + y - both) - 1e-9)


def components(links: DataFrame, name: str) -> DataFrame:
    """key, label for every key with a link: the smallest key that its links reach."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = common.materialize(edges, f"{name}-edges")
    labels = common.materialize(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-labels")
    while True:
        near = edges.join(labels, edges["b"] == labels["key"]).groupBy("a").agg(F.min("label").alias("near"))
        new = labels.join(near, labels["key"] == near["a"]).select(labels["key"], F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("key").alias("to"), F.col("label").alias("next"))
        new = common.materialize(new.join(jump, "to").select("key", F.least("to", "next").alias("label"), "old"), f"{name}-labels")
        common.drop(labels)
        if new.where("label != old").isEmpty():
            common.drop(edges)
            return new.select("key", "label")
        labels = new


def band_mates(sig: np.ndarray, left: int, n: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows that agree on a band, i < j; with ``left`` rows on the left, one on each side, without any (0) all."""
    total = len(sig)
    x, y = (sig[:left], sig[left:]) if left else (sig, sig)
    found = np.zeros((len(x), len(y)), dtype=bool)
    for k in range(n):
        part = np.ascontiguousarray(sig[:, k * rows : (k + 1) * rows]).view(f"V{4 * rows}")[:, 0]
        code = np.unique(part, return_inverse=True)[1].reshape(total)
        found |= (code[:left, None] == code[None, left:]) if left else (code[:, None] == code[None, :])
    i, j = np.nonzero(found if left else np.triu(found, 1))
    return i, j + left


def linked(left: list[dict], right: list[dict] | None, n: int, rows: int, least: np.ndarray, threshold: float) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Of all pairs of a left and a right row (key, words, sig; right None: of the left ones) that share a band: links by key, and edges that join all that is linked."""
    all_rows = left + (right or [])
    sig = np.frombuffer(b"".join(r["sig"] for r in all_rows), "<u4").reshape(-1, HASHES)
    i, j = band_mates(sig, len(left) if right is not None else 0, n, rows)
    stay = survivors(sig[i], sig[j], least)
    i, j = i[stay], j[stay]
    if not len(i):
        return {}, []
    used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    a, b = at[: len(i)], at[len(i) :]
    both, sizes = shared_shingles([all_rows[k]["words"] for k in used], a, b)
    good = is_link(both, sizes[a], sizes[b], threshold)
    a, b = a[good], b[good]
    count = np.bincount(np.concatenate([a, b]), minlength=len(used))
    label = np.arange(len(used))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    key = [all_rows[k]["key"] for k in used]
    return {key[k]: int(c) for k, c in enumerate(count) if c}, [(key[k], key[to]) for k, to in enumerate(label.tolist()) if k != to]


def compare(signed: DataFrame, members: DataFrame, n: int, rows: int, least: np.ndarray, threshold: float) -> DataFrame:
    """a, b of joining edges, and a, n (b null) of link counts, over all pairs of keys that share a bucket of ``members``."""
    cell = members.groupBy("key").agg(F.max(F.struct("size", "bucket")).alias("x")).select("key", F.col("x.bucket").alias("cell"))
    cell = common.materialize(cell.join(signed.select("key", F.length("words").alias("chars")), "key"), "ngram-cells")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("chars") / BLOCK_CHARS)).alias("blocks")
    sizes = cell.groupBy("cell").agg(blocks).where("blocks > 1")
    dealt = cell.join(sizes, "cell", "left")
    block = F.struct("cell", F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).alias("part"))
    dealt = common.materialize(dealt.select("key", block.alias("block")), "ngram-dealt")

    met = members.select("bucket", "key").join(dealt, "key").select("bucket", "block").distinct()
    met = met.groupBy("bucket").agg(F.sort_array(F.collect_list("block")).alias("met"))  # blocks, not texts
    met = met.select(F.explode(F.sequence(F.lit(1), F.size("met"))).alias("i"), "met")
    pairs = met.select(F.get("met", F.col("i") - 1).alias("x"), F.explode(F.slice("met", F.col("i"), F.size("met"))).alias("y")).distinct()
    pairs = common.materialize(pairs, "ngram-block-pairs")
    packed = signed.join(dealt, "key").groupBy("block").agg(F.collect_list(F.struct("key", "words", "sig")).alias("rows"))  # BLOCK texts on average
    packed = common.materialize(packed, "ngram-blocks")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x, y = b.column("left"), b.column("right")
            for k in range(b.num_rows):
                count, edges = linked(x[k].as_py(), y[k].as_py(), n, rows, least, threshold)
                a = [*count, *(p for p, _ in edges)]
                if a:
                    other, links = [None] * len(count) + [q for _, q in edges], [*count.values()] + [None] * len(edges)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(other, pa.binary()), pa.array(links, pa.int64())], ["a", "b", "n"])

    left = pairs.join(packed.select(F.col("block").alias("x"), F.col("rows").alias("left")), "x")
    alone = left.where("x = y").select("left", F.lit(None).cast(packed.schema["rows"].dataType).alias("right"))
    both = left.where("x != y").join(packed.select(F.col("block").alias("y"), F.col("rows").alias("right")), "y").select("left", "right")
    return alone.unionByName(both).mapInArrow(run, "a binary, b binary, n long")


def join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows (doc_id, row, key, group), degrees (key, links) of linked texts, and whole classes (group, class_id, members).

    ``group`` tells the classes apart; classes has those of two rows or more."""
    (n, width), least = bands(threshold), fewest_equal(threshold, tolerance)
    signed = common.materialize_bucketed(sign(docs), "ngram-signed", "key")
    members = common.materialize(buckets(signed, n, width), "ngram-members")
    within = common.materialize(compare(signed, members, n, width, least, threshold), "ngram-within")
    common.drop(signed, members)
    labels = components(within.where("b IS NOT NULL").select("a", "b"), "ngram-final")

    degrees = common.materialize(within.where("b IS NULL").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("links")), "ngram-degrees")
    rows = docs.select("doc_id", common.row_hash(docs).alias("row"), key_of(words_of(F.col("text"))).alias("key"))
    rows = rows.join(labels, "key", "left").select("doc_id", "row", "key", F.coalesce("label", "key").alias("group"))
    rows = common.materialize(rows, "ngram-rows")
    classes = rows.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return rows, degrees, common.materialize(classes, "ngram-classes")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each class, with the columns of ``docs``."""
    rows, _, classes = join(docs, threshold)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "row")
    first = rows.join(classes.select("group"), "group", "left_semi").groupBy("group").agg(F.min(order).alias("first"))
    first = common.materialize(first, "ngram-first")
    decided = rows.join(first, "group", "left").select("doc_id", "row", (F.col("first").isNull() | order.eqNullSafe(F.col("first"))).alias("kept"))
    return common.keep_rows(docs, decided, "ngram-marks")


def op7_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document its class_id (smallest doc_id), members of the class, texts with its words (copies) and links of its text.

    A link is a verified pair of different texts."""
    rows, degrees, classes = join(common.table(spark, sf_dir, "documents"))
    copies = common.materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "ngram-copies")
    out = rows.join(classes, "group", "left").join(copies, "key", "left").join(degrees, "key", "left")
    one = F.lit(1).cast("long")
    class_id = F.when(F.col("members").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("members", one).alias("members"), F.coalesce("copies", one).alias("copies"), F.coalesce("links", F.lit(0).cast("long")).alias("links"))
