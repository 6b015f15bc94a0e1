"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 512 bytes. Each passage becomes frequencies of
pairs of byte classes and its self-similarity at short lags; an encoder learned with
the rest turns these into 32 numbers. Gated attention weighs the passages, and the
weighted sum gives the document's score. Only document labels are seen in training.

The model is fitted in one task on at most ``Training.documents`` labelled rows, the
first in a hashed order of doc_id, none longer than ``Training.passages`` passages, kept
as 16-bit numbers: 400 MB at the very most. Only its parameters reach the driver; all
other labelled rows and all whole texts are scored by tasks of bounded memory.

Nulls: a null text counts as empty and is one passage of zeros; label rows without
doc_id or quality don't count, several label rows of a document are averaged. Where
no labelled rows of both kinds exist, every score is (label 1 rows + 1) / (rows + 2).
Repeated rows get equal scores; no rows, no rows out. score() hands rows on as a struct
and keep_good() takes that apart, so other columns can't clash whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PASSAGE = 512
LAGS = range(2, 22)
CLASSES = 32
FEATURES = CLASSES * CLASSES + len(LAGS)
THRESHOLD = 0.7
_CHUNK = 2048


@dataclass(frozen=True)
class Training:
    documents: int = 4000
    passages: int = 48
    hidden: int = 32
    gate: int = 16
    epochs: int = 14
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 7


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    groups = [range(97, 123), range(65, 91), range(48, 58), b" ", b"\n\r", b"\t\v\f", range(128, 192), range(192, 256)]
    for k, g in enumerate(groups, 1):
        out[list(g)] = k
    marks = [c for c in range(33, 127) if not out[c]]
    common_marks = b".,;:!?'\"-()/|#$%&*=<>"
    for c in marks:
        out[c] = 9 + common_marks.index(c) if c in common_marks else 31
    return out


_CLASS = _byte_classes()


def passage_bounds(ends: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the passages of texts that lie one after another."""
    begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    count = np.maximum(1, -(-(ends - begin) // passage))
    doc = np.repeat(np.arange(len(ends)), count)
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = begin[doc] + rank * passage
    return start, np.minimum(start + passage, ends[doc]), doc


def features(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One row of FEATURES numbers a passage; passages lie one after another in ``raw``."""
    n = len(start)
    out = np.zeros((n, FEATURES), dtype=np.float32)
    size = end - start
    b = raw[start[0] : end[-1]]
    if not len(b):
        return out
    at = np.repeat(np.arange(n), size)
    inside = np.arange(len(b)) - (start - start[0])[at]
    cls = _CLASS[b]
    code = cls[:-1] * CLASSES + cls[1:] + at[:-1] * (CLASSES * CLASSES)
    pairs = np.bincount(code[inside[1:] > 0], minlength=n * CLASSES * CLASSES).reshape(n, -1)
    long = np.maximum(size, 1)[:, None]
    out[:, : CLASSES * CLASSES] = np.sqrt(pairs / long)
    for k, lag in enumerate(LAGS):
        same = (b[lag:] == b[:-lag]) & (inside[lag:] >= lag)
        out[:, CLASSES * CLASSES + k] = np.bincount(at[lag:][same], minlength=n) / long[:, 0]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(t: Training) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(t.seed)
    shape = {"W": (FEATURES, t.hidden), "V": (t.hidden, t.gate), "U": (t.hidden, t.gate), "w": (t.gate, 1), "c": (t.hidden, 1)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shape.items()}
    p["W"] *= 3
    return p | {"b": np.zeros(t.hidden), "c0": np.zeros(1)}


def attend(p: dict, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
    """Passage encodings, attention and the score of each bag."""
    h = np.tanh(x @ p["W"] + p["b"])
    u, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
    s = ((u * g) @ p["w"])[:, 0]
    top = np.full(bags, -np.inf)
    np.maximum.at(top, bag, s)
    e = np.exp(s - top[bag])
    a = e / np.bincount(bag, e, bags)[bag]
    z = np.zeros((bags, h.shape[1]))
    np.add.at(z, bag, a[:, None] * h)
    return {"h": h, "u": u, "g": g, "a": a, "z": z, "score": _sigmoid((z @ p["c"])[:, 0] + p["c0"][0])}


def gradients(p: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    f = attend(p, x, bag, len(y))
    h, u, g, a = f["h"], f["u"], f["g"], f["a"]
    dl = (weight * (f["score"] - y) / len(y))[:, None]
    dz = dl @ p["c"].T
    da = (h * dz[bag]).sum(1)
    ds = (a * (da - np.bincount(bag, a * da, len(y))[bag]))[:, None]
    dug = ds @ p["w"].T
    du, dg = dug * g * (1 - u * u), dug * u * g * (1 - g)
    dh = a[:, None] * dz[bag] + du @ p["V"].T + dg @ p["U"].T
    pre = dh * (1 - h * h)
    return {"W": x.T @ pre, "b": pre.sum(0), "V": h.T @ du, "U": h.T @ dg, "w": (u * g).T @ ds, "c": f["z"].T @ dl, "c0": dl.sum(0)}


def fit(bags: list[np.ndarray], labels: np.ndarray, t: Training = Training()) -> dict[str, np.ndarray]:
    """Parameters learned from bags of passages and their labels by Adam; both classes weigh alike."""
    share = labels.mean()
    if share in (0, 1):
        return {"prior": np.array([(labels.sum() + 1) / (len(labels) + 2)])}
    p, rng = initial(t), np.random.default_rng(t.seed)
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    for _ in range(t.epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), t.batch):
            own = order[at : at + t.batch]
            x = np.concatenate([bags[i] for i in own]).astype(np.float64)
            bag = np.repeat(np.arange(len(own)), [len(bags[i]) for i in own])
            step += 1
            for k, d in gradients(p, x, bag, labels[own], weight[own]).items():
                d = d + t.decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - t.rate * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in p.items()}


def _encoded(batch) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a batch's texts and where each text ends."""
    import pyarrow as pa

    texts = pa.concat_arrays([batch.column("text").cast(pa.large_binary())])
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    return raw, at[1:] - at[0]


def score_texts(p: dict, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A score for each text; passages are encoded a chunk at a time, then attention spans the whole text."""
    if "prior" in p:
        return np.full(len(ends), float(p["prior"][0]))
    start, end, doc = passage_bounds(ends)
    top, mass, z = np.full(len(ends), -np.inf), np.zeros(len(ends)), np.zeros((len(ends), len(p["b"])))
    for at in range(0, len(start), _CHUNK):
        own = slice(at, at + _CHUNK)
        h = np.tanh(features(raw, start[own], end[own]) @ p["W"] + p["b"])
        s = ((np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"])[:, 0].astype(np.float64)
        first, bag = doc[at], doc[own] - doc[at]
        n = bag[-1] + 1
        new = top[first : first + n].copy()
        np.maximum.at(new, bag, s)
        old = np.exp(top[first : first + n] - new)
        e = np.exp(s - new[bag])
        add = np.zeros((n, h.shape[1]))
        np.add.at(add, bag, e[:, None] * h)
        z[first : first + n] = z[first : first + n] * old[:, None] + add
        mass[first : first + n] = mass[first : first + n] * old + np.bincount(bag, e, n)
        top[first : first + n] = new
    return _sigmoid((z / mass[:, None]) @ p["c"].astype(np.float64)[:, 0] + p["c0"][0])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, t: Training = Training()) -> dict[str, np.ndarray]:
    """Fit on a bounded sample of the labelled documents that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    size = F.octet_length(common.text_or_empty())
    fits = docs.where(size <= PASSAGE * t.passages).select("doc_id")
    sample = known.join(fits, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(t.documents)
    sample = common.materialize(sample, "quality-sample")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                raw, ends = _encoded(b)
                start, end, doc = passage_bounds(ends)
                rows: list[list[bytes]] = [[] for _ in ends]
                for at in range(0, len(start), _CHUNK):
                    for d, x in zip(doc[at : at + _CHUNK].tolist(), features(raw, start[at : at + _CHUNK], end[at : at + _CHUNK]).astype(np.float16)):
                        rows[d].append(x.tobytes())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([b"".join(r) for r in rows], pa.large_binary()).cast(pa.binary())], ["doc_id", "label", "bag"])

    rows = docs.select("doc_id", common.text_or_empty().alias("text")).where(size <= PASSAGE * t.passages)
    rows = rows.join(F.broadcast(sample), "doc_id")  # at most t.documents rows
    bags = rows.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, bag binary").groupBy("doc_id").agg(F.min(F.struct("label", "bag")).alias("x"))
    bags = bags.select("doc_id", "x.*")

    def learn(batches: Iterable) -> Iterator:
        import pyarrow as pa

        labels, held = [], []
        for b in batches:
            labels += b.column("label").to_pylist()
            held += [np.frombuffer(x.as_py(), dtype=np.float16).reshape(-1, FEATURES) for x in b.column("bag")]
        model = fit(held, np.array(labels, dtype=np.float64), t) if held else {"prior": np.array([0.5])}
        names = list(model)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names), pa.array([list(model[k].shape) for k in names], pa.list_(pa.int32())), pa.array([model[k].astype("<f4").tobytes() for k in names], pa.binary())], ["name", "shape", "data"]
        )

    found = bags.repartition(1).sortWithinPartitions("doc_id").mapInArrow(learn, "name string, shape array<int>, data binary").collect()  # parameters only
    common.drop(sample)
    return {r.name: np.frombuffer(r.data, dtype="<f4").reshape(r["shape"]) for r in found} or {"prior": np.array([0.5])}


def score(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """The rows of ``docs`` as a struct ``row`` with their score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts):
        import pandas as pd
        import pyarrow as pa

        out, held, size = [], [], 0
        values = [t.encode("utf-8", "surrogatepass") for t in texts]

        def flush():
            raw = np.frombuffer(b"".join(held), dtype=np.uint8)
            out.append(score_texts(shared.value, raw, np.cumsum([len(h) for h in held])))

        for v in values:
            held.append(v)
            size += len(v)
            if size > 4_000_000:
                flush()
                held, size = [], 0
        if held:
            flush()
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.select(F.struct("*").alias("row"), of(common.text_or_empty()).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, t: Training = Training()) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with the columns of ``docs``."""
    return score(docs, train(docs, labels, t)).where(F.col("score") >= threshold).select("row.*")


def op3_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score(docs, train(docs, common.table(spark, sf_dir, "labels")))
    return rows.select(F.col("row.doc_id").alias("doc_id"), held_out(F.col("row.doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
