"""Secret scans: candidates by shape, false positives removed by a random forest; native DataFrame and MLlib operations only.

A candidate is a run of 16 or more of A-Z a-z 0-9 + / = _ - within a word; or eight or
more characters without white space, quotes, commas, semicolons and brackets that an
assignment (= or :) follows a name with a cue such as password or api_key
with, whatever marks they have, anywhere in a word and as often as there are any, also
where name and sign stand in the two words before; or the password of a user in an
address (://user:password@host). A run ends before such a name. A name has at most 64
characters behind its cue; values have no limit. Features are its length,
character classes and transitions between them, distinct characters, how much of it
dictionary words cover, whether it is part of a path, and what the words beside it say.
The forest learns from labelled findings: ``findings`` has word, before, after and label
(1: a secret). No table here has such labels, so ``synthetic_findings`` writes one by
rule from hashes: keys and passwords behind assignments and alone against long words,
numbers, dates, digests named as such, identifiers, paths and placeholders. Findings
written by hand, of kinds and wordings that the rules don't know, measure recall in the
tests.

Nulls: a null text counts as empty and has no candidates; findings without word or
label don't count; where the findings are of one kind only, every probability is that
kind. Very long texts are scanned whole, word by word. Repeated rows repeat their
candidates; no rows, no rows out. candidates() reads doc_id and text only; score() hands
the columns of its input on in a struct, so only ``probability`` is added beside them.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHAPE = r"[A-Za-z0-9+/=_\-]{16,}"
#: Characters of the words on each side that features look at.
NEAR = 64
FINDINGS = 6000
TREES = 24
DEPTH = 7
SEED = 11
THRESHOLD = 0.5
DICTIONARY = (
    "the and that with for this from are was not have you all can has more one about other which their time page search free information site may what news out use any there see only his when "
    "contact here business web also now help get view online first been would how were services some these click its like service than find date back top people list name just over state year day into email "
    "two health world next used work last most products music buy data make them should product system post her city add policy number such please available copyright support message after best software good "
    "video well where info rights public books high school through each links she review years order very privacy book items company read group need many user said does set under general research university "
    "token secret password default example sample test value string config index module class public private return function release version branch commit license image document report module chapter section"
).split()
CUES = "token|secret|passw|api.?key|apikey|access.?key|auth|bearer|credential|private.?key|client.?key|signing"
#: A name with a cue; and where it is followed by an assignment.
NAME = rf"(?:{CUES}|passphrase|pwd)[a-z0-9_\-]{{0,64}}[\"'`]?"
ASSIGN = rf"{NAME}[=:]"
VALUE = r"[^\s\"'`,;()\[\]{}<>]{8,}"
ADDRESS = r"://[^/:@\s\"'`<>]*:([^/@\s\"'`<>]{8,})(?=@)"
#: What is assigned, or a password in an address, or a run that holds no name with an assignment; each in a group.
FOUND = rf"(?i){ASSIGN}[\"'`(\[{{]?({VALUE})|{ADDRESS}|((?:(?!{ASSIGN})[A-Z0-9+/=_\-]){{16,}}+)"
DECOYS = "example|sample|dummy|test|placeholder|uuid|guid|sha|md5|commit|digest|checksum|hash|etag|order|invoice|phone|isbn|card|serial|version|build|revision"


def features(word: Column, before: Column, after: Column) -> dict[str, Column]:
    """Named features of a candidate; none is null."""
    size = F.greatest(F.length(word), F.lit(1)).cast("double")
    lower, near = F.lower(word), F.lower(F.concat(before, F.lit(" "), after))
    count = lambda col, pattern: F.regexp_count(col, F.lit(pattern)).cast("double")
    share = lambda pattern: count(word, pattern) / size
    flag = lambda col, pattern: col.rlike(pattern).cast("double")
    return {
        "length": F.length(word).cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share(r"[+/=_\-]"),
        "other": share(r"[^A-Za-z0-9+/=_\-]"),
        "digit_to_letter": share("[0-9](?=[A-Za-z])"),
        "letter_to_digit": share("[A-Za-z](?=[0-9])"),
        "lower_to_upper": share("[a-z](?=[A-Z])"),
        "upper_to_lower": share("[A-Z](?=[a-z])"),
        "vowel_steps": count(lower, "[bcdfghjklmnpqrstvwxyz](?=[aeiou])") / size,
        "repeats": count(lower, r"(.)(?=\1)") / size,
        "distinct": F.size(F.array_distinct(F.split(word, ""))) / size,
        "only_hex": flag(word, "^[0-9a-fA-F]+$"),
        "only_digits": flag(word, "^[0-9]+$"),
        "only_letters": flag(word, "^[A-Za-z]+$"),
        "dictionary": 1 - F.length(F.regexp_replace(lower, "|".join(sorted({w for w in DICTIONARY if len(w) > 2}, key=lambda w: (-len(w), w))), "")) / size,
        "path": flag(F.concat(before, word, after), r"(://|\.[a-z]{2,4}\b|/[A-Za-z0-9_.\-]+/)"),
        "inner_slashes": share("/"),
        "cue": flag(near, CUES),
        "cue_inside": flag(lower, CUES),
        "decoy": flag(near, DECOYS),
        "assigned": flag(before, r"[=:]\s*[\"']?$"),
        "quoted": flag(before, "[\"'`]$") * flag(after, "^[\"'`]"),
    }


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, word_index, place (in the word), word, before, after of every candidate."""
    text = common.text_or_empty()
    told = text.rlike(rf"(?i){NAME}\s*[=:]") | text.rlike(ADDRESS)
    rows = docs.select("doc_id", F.split(text, r"[\x20\x09-\x0D]+").alias("words"), told.alias("cued"))
    slot = lambda i, by: F.coalesce(F.get(F.col("words"), i + by), F.lit(""))
    near = lambda i: F.concat_ws(" ", F.when(i >= 2, slot(i, -2)), F.when(i >= 1, slot(i, -1)))
    run = lambda w: (F.length(w) >= 16) & w.rlike(SHAPE)
    # A name whose sign or value stands in the next word: the word is read as if they stood together.
    led = lambda w, i: F.when(near(i).rlike(rf"(?i){ASSIGN}\z") | near(i).rlike(rf"(?i){NAME}\s[=:]\z"), "pwd=").when(w.rlike("^[=:]") & near(i).rlike(rf"(?i){NAME}\z"), "pwd").otherwise("")
    plain = F.transform("words", lambda w, i: F.when(run(w), i))
    both = F.transform("words", lambda w, i: F.when((F.length(w) >= 8) & (run(w) | w.rlike(rf"(?i){ASSIGN}[\"'`(\[{{]?{VALUE}|{ADDRESS}") | (led(w, i) != "")), i))
    at = F.array_compact(F.when(F.col("cued"), both).otherwise(plain))
    side = lambda i: F.struct(i.alias("i"), led(slot(i, 0), i).alias("lead"), slot(i, 0).alias("w"), F.concat_ws(" ", slot(i, -2), slot(i, -1)).alias("before"), F.concat_ws(" ", slot(i, 1), slot(i, 2)).alias("after"))
    rows = rows.select("doc_id", "cued", F.explode(F.transform(at, side)).alias("x")).select("doc_id", "x.*").withColumn("w", F.concat("lead", "w"))
    every = lambda k: F.regexp_extract_all("w", F.lit(FOUND), F.lit(k))
    rows = rows.select("doc_id", "i", "lead", "before", "after", F.split("w", FOUND, -1).alias("between"), F.posexplode(F.arrays_zip(*[every(k).alias(f"g{k}") for k in range(4)])).alias("place", "m"))
    word = F.concat(*[F.coalesce(F.col(f"m.g{k}"), F.lit("")) for k in (1, 2, 3)])  # one of them matched
    # What a match holds before the candidate belongs to the part before it.
    rows = rows.withColumn("word", word).withColumn("start", F.length("m.g0") - F.length("word"))
    led_off = F.when(F.col("place") == 0, F.length("lead")).otherwise(0)
    head = F.concat(F.coalesce(F.get("between", F.col("place")), F.lit("")), F.substring(F.col("m.g0"), F.lit(1), F.col("start")))
    head = F.substring(head, led_off + 1, F.length(head))
    tail_of = F.coalesce(F.get("between", F.col("place") + 1), F.lit(""))
    return rows.select(
        "doc_id", F.col("i").cast("long").alias("word_index"), F.col("place").cast("long").alias("place"), "word",
        F.right(F.concat("before", F.lit(" "), head), F.lit(NEAR)).alias("before"), F.left(F.concat(tail_of, F.lit(" "), F.col("after")), F.lit(NEAR)).alias("after"),
    )


def synthetic_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """word, before, after, label: the same table for the same number of rows on every run."""
    pick = lambda salt, *x: F.element_at(F.array(*map(F.lit, x)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(x))) + 1).cast("int"))
    sha = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    base = lambda salt: F.base64(F.unhex(sha(salt)))
    upto = lambda salt, lo, hi: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(hi - lo + 1)) + lo).cast("int")
    cut = lambda text, n: F.left(text, n)
    letters = F.translate(sha("l"), "0123456789", "ghijklmnop")
    syllables = ("an er on th in ti re the he or en nd at st ea ou es ed to ing ion le la de que men te ra do ci os as na co ent ver ung sch lich ein zu ge be").split()
    parts = {"spoken": F.concat(*[pick(f"s{k}", *syllables) for k in range(14)])}
    spoken = F.col("spoken")
    prose = lambda k: F.concat_ws(" ", F.concat(*[pick(f"{k}{i}", *syllables) for i in range(3)]), F.concat(*[pick(f"{k}{i}", *syllables) for i in range(3, 5)]))
    named = lambda k, *names: F.concat(pick(k, *names), pick(f"{k}b", " = ", "=", ": ", '":"', '": "'), pick(f"{k}q", '"', "'", ""))
    parts["cue"] = named("cue", "token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "TOKEN", "API_KEY", "Authorization: Bearer")
    parts["decoy"] = named("decoy", "commit", "sha1", "md5", "digest", "checksum", "etag", "uuid", "order", "invoice", "serial", "build")
    parts |= {"p": prose("p"), "a": prose("a"), "key": pick("kind", *range(8)), "wrong": pick("wrong", *range(10))}
    cue, decoy, key, wrong, prose = F.col("cue"), F.col("decoy"), F.col("key"), F.col("wrong"), F.col
    numbers = F.translate(sha("n"), "abcdef", "483920")
    dashed = F.regexp_replace(sha("u"), "^(.{8})(.{4})(.{4})(.{4})(.{12}).*$", "$1-$2-$3-$4-$5")
    mixed = F.concat(pick("m0", *"TbRqZkW"), F.left(F.regexp_replace(base("m"), "[+/=]", "x"), upto("m1", 3, 8)), pick("m2", *"!@#$%&*.?"), F.left(F.regexp_replace(base("w"), "[+/=]", "7"), upto("m3", 3, 8)), pick("m4", "!", "$", "", "9", "#"))
    secret = (
        F.when(key == 0, cut(sha("a"), F.lit(40))).when(key == 1, cut(sha("b"), upto("bl", 24, 64))).when(key == 2, cut(base("c"), upto("cl", 20, 44)))
        .when(key == 3, F.concat(F.lit("AKIA"), F.upper(cut(F.translate(base("d"), "+/=", "QXZ"), F.lit(16))))).when(key == 4, F.concat(pick("pre", "ghp_", "sk_live_", "xoxb-", "npm_"), cut(F.translate(base("e"), "+/=", "abc"), F.lit(36))))
        .when(key == 5, mixed).when(key == 6, F.concat(F.initcap(F.left(spoken, upto("w6", 4, 9))), pick("m5", "-", "_", "!", "@", "#"), F.right(sha("v"), upto("w7", 3, 6)), pick("m6", "!", "", "?", "$")))
        .otherwise(F.upper(cut(sha("f"), upto("fl", 32, 40))))
    )
    harmless = (
        F.when(wrong == 0, F.concat(F.initcap(F.left(spoken, F.lit(1))), F.substring(spoken, F.lit(2), upto("w0", 15, 23)))).when(wrong == 1, cut(numbers, upto("nl", 16, 20)))
        .when(wrong == 2, cut(sha("g"), F.lit(40))).when(wrong == 3, dashed).when(wrong == 4, F.concat(F.lit("src/"), cut(letters, F.lit(6)), F.lit("/"), cut(spoken, F.lit(9))))
        .when(wrong == 5, pick("place", "xxxxxxxxxxxxxxxxxxxx", "your-api-key-goes-here", "REPLACE_WITH_YOUR_TOKEN", "0000000000000000000000", "example-token-value-123", "changeme-changeme-changeme"))
        .when(wrong == 8, pick("word", "required", "changeme", "expired.", "your-token", "<token>", "undefined", "optional", "forgotten?", "os.environ[X]", "${SECRET}", "********", "see-below", "getenv(KEY)", "settings.TOKEN"))
        .when(wrong == 9, F.left(spoken, upto("w9", 8, 14)))
        .when(wrong == 6, cut(spoken, upto("sl", 16, 28))).otherwise(F.upper(cut(spoken, upto("ul", 16, 26))))
    )
    ids = common.materialize(spark.range(rows).withColumns(parts), "secret-parts").withColumn("label", (F.pmod(F.xxhash64(F.lit("y"), "id"), F.lit(2))).cast("int"))
    yes, quote = F.col("label") == 1, pick("quote", '"', "'", "", ".")
    address = key.isin(5, 6) & (upto("address", 0, 3) == 0)  # a password in an address
    before = F.when(yes & address, F.concat(prose("p"), F.lit(" "), pick("scheme", "postgres", "mysql", "redis", "amqp", "https", "ftp"), F.lit("://"), F.left(spoken, upto("user", 3, 8)), F.lit(":"))).when(yes, F.when((upto("alone", 0, 9) == 0) & ~key.isin(5, 6), prose("p")).otherwise(F.concat_ws(" ", prose("p"), cue))).otherwise(
        F.when((wrong == 2) | ((wrong == 3) & (upto("bare", 0, 1) == 0)), F.concat_ws(" ", prose("p"), decoy)).when(wrong.isin(5, 8, 9), F.concat_ws(" ", prose("p"), cue)).otherwise(F.concat(prose("p"), pick("stop", "", "", ".", ","), F.lit(" ")))
    )
    out = ids.select(F.when(yes, secret).otherwise(harmless).alias("word"), F.right(before, F.lit(NEAR)).alias("before"), F.left(F.concat(F.when(yes & address, F.concat(F.lit("@"), F.right(spoken, F.lit(6)))).otherwise(quote), F.lit(" "), prose("a")), F.lit(NEAR)).alias("after"), "label")
    return common.materialize(out, "secret-findings")  # else its long expressions and the features would be compiled as one


class Scanner:
    """A forest trained on labelled findings, or the one label that they all have."""

    def __init__(self, findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED):
        known = findings.where(F.col("word").isNotNull() & F.col("label").isNotNull())
        rows = known.select(F.col("label").cast("double").alias("label"), *self._columns())
        kinds = sorted(r.label for r in rows.select("label").distinct().limit(3).collect())
        self.names = [c for c in rows.columns if c != "label"]
        self.only = None if len(kinds) == 2 else (kinds[0] if kinds else 0.0)
        self.model: Model | None = None
        if self.only is None:
            rows = common.materialize(rows, "secret-findings")
            self.model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featuresCol="vector").fit(self._vector(rows).select("label", "vector"))

    @staticmethod
    def _columns() -> list[Column]:
        empty = lambda c: F.coalesce(F.col(c), F.lit(""))
        return [c.alias(n) for n, c in features(F.col("word"), empty("before"), empty("after")).items()]

    def _vector(self, rows: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol="vector").transform(rows)

    def score(self, found: DataFrame) -> DataFrame:
        """``found`` (word, before, after and others) with a column probability."""
        if self.model is None:
            return found.withColumn("probability", F.lit(float(self.only)))
        rows = self._vector(found.select(F.struct("*").alias("row"), *self._columns()))
        return self.model.transform(rows.select("row", "vector")).select("row.*", vector_to_array("probability")[1].alias("probability"))


def op6_forest_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document: doc_id, word_index, place, length, sha256 of the candidate, probability, is_secret."""
    scanner = Scanner(synthetic_findings(spark))
    out = scanner.score(candidates(common.table(spark, sf_dir, "documents")))
    return out.select("doc_id", "word_index", "place", F.length("word").alias("length"), F.sha2("word", 256).alias("word_sha256"), "probability", (F.col("probability") >= THRESHOLD).alias("is_secret"))
