"""License scans with a positional rare-token index, native DataFrame operations only.

Templates are licence wordings, short phrases and full opening paragraphs. Each has a
mandatory key phrase. The index holds its rarest words (highest inverse document
frequency over all documents) with their places, the key phrase's rarest among them. A
file's words are looked up; each hit of a key phrase's rarest word at place p proposes
that the phrase starts at p less the word's place in it. The postings of the template's
other rare words are then intersected by relative position: two of the rare words (or
all, where it has fewer) must stand where that start expects them, SLACK words of
insertions or omissions allowed. The key phrase must stand there word for word. Base
templates are key phrases and nothing else; others count from SHARE of their words on,
each within SLACK words of its place.

Nulls: a null text counts as empty: no words, no labels (empty strings), score 0, no
first and last word. Very long texts are scanned whole; words of a template before the
text's start or after its end count as missing. Repeated rows give equal rows; no rows,
no rows out. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
SHARE = 0.75
RARE = 4
SLACK = 3


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    key: str
    base: bool = False

    @property
    def split(self) -> list[str]:
        return self.words.split()

    @property
    def key_at(self) -> int:
        w, k = self.split, self.key.split()
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)

    @property
    def key_size(self) -> int:
        return len(self.key.split())


TEMPLATES = (
    Template("mit", "under the mit license", "under the mit license", True),
    Template("apache-2", "apache license version 2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", "cc by nc", True),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person"),
    Template("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "creative commons attribution 4 0 international license", "creative commons attribution 4"),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    Template("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    Template("agpl-3", "licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "use copy modify and or distribute"),
    # Opening paragraphs of public licences.
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "free of charge to any person obtaining a copy"),
    Template("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "may not use this file except in compliance with the license"),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "redistributions of source code must retain the above copyright notice"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", "terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "for any purpose with or without fee is hereby granted"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text: Column) -> Column:
    """Words after lower-casing A-Z and taking all ASCII marks for separators, without a regular expression."""
    plain = F.translate(F.coalesce(text, F.lit("")), _LETTERS + _MARKS, _LETTERS.lower() + " " * len(_MARKS))
    return F.array_remove(F.split(plain, " "), "")


def vocabulary(templates: tuple[Template, ...] = TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.split})


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many documents each template word stands; as many rows as template words reach the driver."""
    known = F.array(*map(F.lit, vocabulary(templates)))
    rows = docs.select(F.explode(F.array_intersect(known, words_of(F.col("text")))).alias("word")).groupBy("word").count().collect()
    return {w: 0 for w in vocabulary(templates)} | {r.word: r["count"] for r in rows}


@dataclass(frozen=True)
class Posting:
    """What the index holds of a template: its key phrase's rarest word and the places in the template of all its rare words."""

    template: int
    anchor: str
    anchor_at: int
    rare: tuple[tuple[str, int], ...]


def postings(frequency: dict[str, int], templates: tuple[Template, ...] = TEMPLATES, rare: int = RARE) -> list[Posting]:
    """One entry for each place of each template's key anchor; of equally rare words the first by name."""
    out, order = [], lambda w: (frequency[w], w)
    for t, template in enumerate(templates):
        words = template.split
        anchor = min(template.key.split(), key=order)
        own = {anchor, *sorted(set(words), key=order)[:rare]}
        places = tuple((w, k) for k, w in enumerate(words) if w in own)
        out += [Posting(t, anchor, k, places) for k, w in enumerate(words) if w == anchor and template.key_at <= k < template.key_at + template.key_size]
    return out


def places(words: Column, index: list[Posting], templates: tuple[Template, ...] = TEMPLATES, share: float = SHARE, slack: int = SLACK) -> Column:
    """array<struct<label, base, start, score>> of the accepted places, in no order; a start may lie before the text."""
    array = lambda x: F.array(*map(F.lit, x))
    anchors = array(sorted({p.anchor for p in index}))
    posting = F.array(*[F.struct(F.lit(p.anchor).alias("w"), F.lit(p.template).alias("t"), F.lit(p.anchor_at).alias("k")) for p in index])
    rare_of = {p.template: p.rare for p in index}
    known = F.array(*[
        F.struct(
            array(t.split).alias("words"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.key_at).alias("at"), array(t.key.split()).alias("key"),
            F.array(*[F.struct(F.lit(w).alias("w"), F.lit(k).alias("k")) for w, k in rare_of[n]]).alias("rare"),
            F.lit(min(2, len({w for w, _ in rare_of[n]}))).alias("least"),
        )
        for n, t in enumerate(templates)
    ])
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(anchors, w), i)), lambda i: i.isNotNull())
    proposed = F.flatten(F.transform(hits, lambda i: F.transform(F.filter(posting, lambda p: p.w == F.get(words, i)), lambda p: F.struct(p.t.alias("t"), (i - p.k).alias("s")))))
    proposed = F.filter(F.array_distinct(proposed), lambda c: c.s + F.get(known, c.t)["at"] >= 0)

    def near(c: Column, w: Column, k: Column) -> Column:
        """Whether ``w`` stands within the slack of place ``k`` of a template that starts at c.s."""
        first = F.greatest(c.s + k - slack, F.lit(0))
        return F.array_contains(F.slice(words, first + 1, F.greatest(c.s + k + slack + 1 - first, F.lit(0))), w)

    def score(c: Column) -> Column:
        t = F.get(known, c.t)
        keyed = F.slice(words, c.s + t["at"] + 1, F.size(t["key"])) == t["key"]
        agree = F.size(F.array_distinct(F.transform(F.filter(t["rare"], lambda r: near(c, r.w, r.k)), lambda r: r.w)))
        matched = F.size(F.filter(F.transform(t["words"], lambda w, k: near(c, w, k)), lambda x: x)) / F.size(t["words"])
        return F.struct(t.label.alias("label"), t.base.alias("base"), c.s.alias("start"), F.when(keyed & (agree >= t.least), matched).otherwise(0.0).alias("score"))

    found = F.transform(proposed, score)
    found = F.filter(found, lambda p: (p.score > 0) & (p.base | (p.score >= share)))
    none = F.filter(found, lambda p: F.lit(False))
    return F.when(F.arrays_overlap(words, anchors), found).otherwise(none)


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and the accepted places of every document."""
    index = postings(document_frequencies(docs, templates), templates)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), places(F.col("words"), index, templates).alias("places"))


def summary(scanned: DataFrame) -> DataFrame:
    """The digest columns of scan()'s rows."""
    base = F.filter("places", lambda p: p.base)
    starts = F.transform(base, lambda p: p.start.cast("long"))
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda p: p.label))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("places")).alias("labels"), F.coalesce(F.array_max(F.transform("places", lambda p: p.score)), F.lit(0.0)).alias("score"),
    )


def op10_rare_token_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every document."""
    return summary(scan(common.table(spark, sf_dir, "documents")))


def oracle(templates: tuple[Template, ...] = TEMPLATES) -> str:
    rows = ",\n    ".join(
        f"({t}, '{x.label}', {x.base}, {k}, '{w}', {len(x.split)}, {x.key_at <= k < x.key_at + x.key_size}, {x.key_size}, {x.key_at})" for t, x in enumerate(templates) for k, w in enumerate(x.split)
    )
    return rf"""
WITH t(tid, label, base, k, word, n, in_key, key_n, key_at) AS (VALUES
    {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SEPARATORS}]+') AS ws FROM documents),
u AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM d),
v AS (SELECT * FROM u WHERE word IN (SELECT word FROM t)),
f AS (SELECT x.word, count(DISTINCT v.r) AS df FROM (SELECT DISTINCT word FROM t) x LEFT JOIN v ON v.word = x.word GROUP BY x.word),
ka AS (SELECT tid, word FROM t JOIN f USING (word) WHERE in_key QUALIFY row_number() OVER (PARTITION BY tid ORDER BY df, word) = 1),
ra AS (SELECT tid, word FROM (SELECT DISTINCT tid, word, df FROM t JOIN f USING (word)) QUALIFY row_number() OVER (PARTITION BY tid ORDER BY df, word) <= {RARE} UNION SELECT tid, word FROM ka),
ln AS (SELECT tid, least(2, count(*)) AS least_n FROM ra GROUP BY tid),
c AS (SELECT DISTINCT v.r, t.tid, v.p - t.k AS s, any_value(t.key_at) AS key_at FROM v JOIN t USING (word) JOIN ka ON ka.tid = t.tid AND ka.word = t.word WHERE t.in_key AND v.p - t.k + t.key_at >= 0 GROUP BY v.r, t.tid, v.p - t.k),
h AS (
  SELECT c.r, c.tid, c.s, t.k, any_value(t.word) AS word, any_value(t.label) AS label, any_value(t.base) AS base, any_value(t.n) AS n, any_value(t.key_n) AS key_n,
         bool_or(t.in_key AND v.p = c.s + t.k) AS exact, any_value(ra.word) AS rare
  FROM c JOIN t ON t.tid = c.tid JOIN v ON v.r = c.r AND v.word = t.word AND v.p BETWEEN c.s + t.k - {SLACK} AND c.s + t.k + {SLACK}
  LEFT JOIN ra ON ra.tid = t.tid AND ra.word = t.word GROUP BY c.r, c.tid, c.s, t.k),
m AS (
  SELECT h.r, h.tid, h.s, count(*) / any_value(h.n)::DOUBLE AS score, count_if(h.exact) = any_value(h.key_n) AS keyed, count(DISTINCT h.rare) >= any_value(ln.least_n) AS agreed,
         any_value(h.label) AS label, any_value(h.base) AS base
  FROM h JOIN ln USING (tid) GROUP BY h.r, h.tid, h.s),
x AS (SELECT * FROM m WHERE keyed AND agreed AND (base OR score >= {SHARE})),
g AS (
  SELECT r, count_if(base) AS n_base, min(s) FILTER (WHERE base) AS first_word, max(s) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
  FROM x GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""


OP10_SQL = oracle()
