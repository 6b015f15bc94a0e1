"""Runs (maximal periodicities) of a text's words in linear time, after Ellert and Fischer.

Words are compared by their order alone: sorting ranks them, and no suffix array or tree
and no hash of substrings is made. One pass over the ranks computes the Lyndon array
(the next smaller suffix of every position) with the previous smaller suffixes and the
length that each of these pairs has in common. A comparison within the last matched
extension is a shifted copy of an earlier one and is read off, and one that leaves it
goes on at its end, so each word is matched once. Every run has a Lyndon root that the
Lyndon array of the order or of the reversed order holds; its extension to the right is
the length in common, the one to the left is less than a period.

Before that a sieve in whole arrays leaves out stretches that can't lie in a run of the
wanted length and exponent: a run of period q repeats each of its words after its first
q at a distance of q or less, so for each power of two only stretches stay in which
words recur at such distances without a gap for long enough. A run lies in one such
stretch whole; what a stretch's border cuts is no run and is left out.

Nulls: a null text has no words. Empty texts have no runs; their collapsed text is
empty. Rows that repeat give rows that repeat, ties of the greatest exponent go to the
smallest start, then period. Texts stay whole however long, one at a time in memory. No
rows, no rows out. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Least words and least exponent of a run.
LEAST, TIMES = 24, 3
#: Periods up to this one make the first scale of the sieve.
FIRST_SCALE = 8


def ranks(words: list[bytes]) -> np.ndarray:
    """Dense ranks of the words in their order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.rank(pa.array(words, pa.binary()), tiebreaker="dense").to_numpy().astype(np.int64)


def lyndon(t: list[int]) -> tuple[list[int], list[int]]:
    """For each i the next j whose suffix is smaller (else the length) and how many symbols both suffixes share; the end is smaller than all symbols."""
    n = len(t)
    after, shared_after, before, shared_before = [n] * n, [0] * n, [-1] * n, [0] * n
    left = right = end = 0  # t[left : left + end - right] == t[right : end], no matched extension reaches further
    stack: list[int] = []
    for j in range(n):
        same, last = 0, -1
        while stack:
            c = stack[-1]
            if last >= 0 and shared_before[last] != same:  # c to last as last to j: the shorter of both decides
                if shared_before[last] < same:
                    before[j], shared_before[j] = c, shared_before[last]
                    break
            else:
                seen = -1
                if j < end and c >= right:
                    d = right - left
                    seen = shared_after[c - d] if after[c - d] == j - d else shared_before[j - d] if before[j - d] == c - d else -1
                if 0 <= seen < end - j:
                    same = seen
                else:
                    if seen >= 0:
                        same = end - j
                    while j + same < n and t[c + same] == t[j + same]:
                        same += 1
                    if j + same >= end:
                        left, right, end = c, j, j + same
                if j + same < n and t[c + same] < t[j + same]:
                    before[j], shared_before[j] = c, same
                    break
            after[c], shared_after[c] = j, same
            last = stack.pop()
        stack.append(j)
    return after, shared_after


def _stretches(near: np.ndarray, least: int) -> np.ndarray:
    """Starts and ends of the stretches of at least so many True."""
    ends = np.flatnonzero(np.diff(near.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return ends[ends[:, 1] - ends[:, 0] >= least]


def zones(rank: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int]]:
    """Disjoint parts of the text of which each run of ``least`` words and exponent ``times`` lies in one."""
    n = len(rank)
    if n < least:
        return []
    order = np.argsort(rank, kind="stable")
    back = np.full(n, n + 1)  # words since the same one
    again = rank[order[1:]] == rank[order[:-1]]
    back[order[1:][again]] = (order[1:] - order[:-1])[again]
    found, scale, below = [], FIRST_SCALE, 0
    while below * times < n:
        s = _stretches(back <= scale, max(1, least - scale, (times - 1) * (below + 1)))
        if len(s):
            found.append(np.column_stack([np.maximum(0, s[:, 0] - scale), s[:, 1]]))
        scale, below = 2 * scale, scale
    out: list[tuple[int, int]] = []
    for a, b in np.sort(np.concatenate(found).view([("a", np.int64), ("b", np.int64)]), axis=0)[:, 0].tolist() if found else []:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(rank: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """start, length, period of every run of ``least`` words and exponent ``times`` or more, by start and period."""
    found, n = set(), len(rank)
    for a, b in zones(rank, least, times):
        part = rank[a:b]
        for t in (part.tolist(), (-part).tolist()):
            after, shared = map(np.array, lyndon(t))
            period = after - np.arange(b - a)
            seen = set()
            for i in np.flatnonzero(shared > (times - 2) * period).tolist():
                p = int(period[i])
                e = i + p + int(shared[i])
                if (p, e) in seen:  # a later root of the same run
                    continue
                seen.add((p, e))
                s = i
                while s and t[s - 1] == t[s - 1 + p]:
                    s -= 1
                cut = (s == 0 and a and rank[a - 1] == rank[a - 1 + p]) or (e == b - a and b < n and rank[b] == rank[b - p])
                if e - s >= max(least, times * p) and not cut:
                    found.add((a + s, e - s, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, of each run only the first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, p in runs:
        drop[s + p] += 1
        drop[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(drop)[:-1] == 0)])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed (the text without repetitions) of every document.

    Words lie between ASCII white space; ``prepare`` may replace a document's words first. ``times`` is 2 or more."""
    if times < 2:
        raise ValueError("a run holds its period twice or more")

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        for b in batches:
            ids, count, runs, texts = b.column("doc_id"), [], [], []
            for doc_id, raw in zip(ids.to_pylist(), b.column("text").to_pylist()):
                words = raw.split()
                words = prepare(doc_id, words) if prepare else words
                found = runs_of(ranks(words), least, times) if len(words) >= least else []
                count.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                texts.append(collapsed(words, found))
            cols = [ids, pa.array(count, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), F.encode(common.text_or_empty(), "UTF-8").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def seeded_repetition(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Of one document in ten the words from a place on repeat with one period; a null id changes nothing."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_lyndon_array_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent, digests of all runs and of the collapsed text of every document."""
    rows = periodic_runs(common.table(spark, sf_dir, "documents"), prepare=seeded_repetition)
    more = lambda a, x: F.when(x["length"] * a["period"] > a["length"] * x["period"], x).otherwise(a)
    line = lambda x: F.concat(*[y for c in ("start", "length", "period") for y in (x[c].cast("string"), F.lit("\n" if c == "period" else ","))])
    rows = rows.withColumn("best", F.aggregate("runs", F.get("runs", F.lit(0)), more))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(F.col("best.length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
