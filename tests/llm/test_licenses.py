import re

from sqlcheck import check, of_spark

from quantloom.llm import common
from quantloom.llm import licenses as x

TEXTS = [
    "Under the MIT License. under   the-mit\nlicense; under the mit licenses", "Apache License, Version 2.0", "x CC BY-NC 4.0 y cc by nc", "CC BY-NC-ND and cc  by", None, "",
    "This work is licensed under the GNU General Public License, version 3.", "this work licensed under the gnu general public license version 3",
    "Redistribution and use in source and binary forms, with or without changes are permitted", "mit " * 50, "under the mit license " * 3, "é漢 under the mit license ümit", "İ K under the mit license",
    "nc by cc under mit the license", "license version 2", "free of charge to any person",
]


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, t.label) for t in x.TEMPLATES if t.base for i in range(len(w)) if w[i : i + len(t.split)] == t.split]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({n for _, n in found}))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_base_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    for df in (frame(spark, TEXTS), docs):
        want = {r.doc_id: brute(r.text) for r in df.collect()}
        for r in x.summary(x.scan(df)).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
            assert 0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_sql(spark, sf):
    check(x.op10_rare_token_licenses(spark, sf), x.OP10_SQL, sf)
    df = frame(spark, TEXTS)
    check(x.summary(x.scan(df)), x.OP10_SQL, documents=df)


def test_labels_of_its_own(spark):
    got = {r.doc_id: r.labels for r in x.summary(x.scan(frame(spark, TEXTS))).collect()}
    assert got[6] == "gpl-3" and got[8] == "bsd" and got[0] == "mit" and got[9] == "" and got[1] == "apache-2"


def test_inserted_words_and_full_paragraphs(spark):
    mit = next(t for t in x.TEMPLATES if t.label == "mit" and len(t.split) > 40)
    shuffled = "free of charge to any person obtaining a copy " + " ".join(reversed(mit.split))
    texts = [
        "licensed under the new gnu general public license version 2", f"x {mit.words} y", mit.words.replace("hereby ", "").replace("restriction", "any restriction"), shuffled,
        "hereby permission and charge person", mit.words.split("publish")[0], "may not use this file except in compliance with the license",
    ]
    got = {r.doc_id: r.labels for r in x.summary(x.scan(frame(spark, texts))).collect()}
    assert got == {0: "gpl-2", 1: "mit", 2: "mit", 3: got[3], 4: "", 5: "mit", 6: ""}
    check(x.summary(x.scan(frame(spark, texts))), x.OP10_SQL, documents=frame(spark, texts))


def test_odd_rows(spark, odd, none):
    check(x.summary(x.scan(odd)), x.OP10_SQL, documents=odd)
    assert of_spark(x.summary(x.scan(none)))[1] == []
