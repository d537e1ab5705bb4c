"""Secret scan: candidates by a pattern, false positives removed by a random forest; native.

A candidate is one of

- a private key block, from its BEGIN line to its END line,
- what is assigned to a word for keys (``password = ...``, ``"api_key": "..."``),
  ``SHORT`` characters or more of any kind but spaces and quotes,
- a run of at least ``LEAST`` of the characters that keys are made of, with a
  digit and a letter.

Most of them are no secrets: identifiers, dates, checksums, paths, placeholders.
A random forest tells them apart by length, changes of character class, coverage
by dictionary words, the path around the run and of the file, and the words
beside it.  It is trained here on labelled findings, a table that the caller
passes, of which at most ``FIT_ROWS`` rows are used, those with the smallest
hashes; ``example_findings`` makes one by rule for tables that have none.  The
dictionary is the words of the findings' false positives' world: a short list,
and the ``CORPUS_WORDS`` words that most documents of the corpus hold.

Scanning, features and the forest (Spark's own, in the JVM) are DataFrame
operations.  Texts are scanned where they are read, without a shuffle; only
candidates, a few for each document at most, reach the forest.  Words are
counted over all documents, combined before they are shuffled.

Defined results: null and empty texts have no candidates, an empty table no
findings; repeated rows give repeated findings; texts and candidates of any
length are judged whole; offsets are code points, end exclusive; a null path
says nothing.  Findings without a label or value are left out of the training;
where fewer than two classes are left, every candidate's score is the share of
label 1, or 0.5 without any.  Columns other than the key, text and path are not
read.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm.common import find_all, lower_ascii, materialize, text_of

LEAST = 12
SHORT = 6
FIT_ROWS = 20_000
CORPUS_WORDS = 400
TREES = 30
DEPTH = 8
SEED = 17
NEIGHBOUR_CHARS = 40

#: Word lists of the features.
DICTIONARY = (
    "access account address admin after before build cache class client code config content count create data date default demo dev "
    "document domain example file first function group hash header here home image index item json key last line link list local log "
    "login main message model module name null number object order page param password path photo post private product public query "
    "release report request response result root sample secret section server service session setting source start state static status "
    "string style system table task temp test text time title token type update upload user value version view width xxxx your"
).split()
KEY_WORDS = "token|secret|passwd|password|pwd|api.?key|access.?key|private.?key|credential|bearer|authorization|auth"
OTHER_WORDS = "commit|sha|md5|checksum|digest|integrity|etag|revision|uuid|guid|version|build|isbn|order|invoice|example|sample|placeholder|dummy|page|section|figure|phone|date"

_RUN = "A-Za-z0-9+/_-"
_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]{20,}+-----END [A-Z ]{0,30}PRIVATE KEY-----"
_ASSIGNED = rf"(?<=[=:][\"' ]{{0,2}})(?<=(?i:{KEY_WORDS})[\"']{{0,1}} {{0,2}}[=:]{{1,2}} {{0,2}}[\"']{{0,1}})[^\s\"'<>,;)=:]{{{SHORT},}}+"
_PLAIN_RUN = rf"(?<![{_RUN}])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[{_RUN}]{{{LEAST},}}+"
CANDIDATE = f"{_BLOCK}|{_ASSIGNED}|{_PLAIN_RUN}"

FEATURES = ("length", "transitions", "distinct", "digits", "dictionary", "vowels", "mixed", "hex", "pathlike", "test_path", "key_word", "other_word", "assigned", "quoted")


def corpus_words(docs: DataFrame, text: str = "text", limit: int = CORPUS_WORDS) -> list[str]:
    """The words of four to twelve letters that most documents hold, at most ``limit``."""
    own = F.array_distinct(F.regexp_extract_all(lower_ascii(text_of(text)), F.lit("(?<![a-z])[a-z]{4,12}(?![a-z])"), F.lit(0)))
    counted = docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return [r.w for r in counted.where("n > 1").orderBy(F.desc("n"), "w").limit(limit).collect()]


def features(value: Column, before: Column, after: Column, path: Column, words: tuple[str, ...] = ()) -> list[Column]:
    """One double for each name in ``FEATURES``; ``words`` belong to the dictionary besides the fixed ones."""
    size = F.length(value).cast("double")
    classes = F.translate(F.translate(F.translate(value, string.digits, "0" * 10), string.ascii_uppercase, "A" * 26), string.ascii_lowercase, "a" * 26)
    low, near = lower_ascii(value), lower_ascii(before)
    letters = F.length(F.regexp_replace(low, "[^a-z]", ""))
    yes = lambda test: F.coalesce(test, F.lit(False)).cast("double")
    made = {
        "length": F.least(size, F.lit(200.0)),
        "transitions": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / (size - 1),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(size, F.lit(64.0)),
        "digits": F.length(F.regexp_replace(value, "[^0-9]", "")) / size,
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(sorted({*DICTIONARY, *words}, key=lambda w: (-len(w), w))), "")) / size,
        "vowels": F.length(F.regexp_replace(low, "[^aeiou]", "")) / F.greatest(letters, F.lit(1)),
        "mixed": yes(value.rlike("[A-Z]") & value.rlike("[a-z]")),
        "hex": yes(low.rlike("^[0-9a-f]+$")),
        "pathlike": yes(value.contains("/") | before.rlike("[/.]$") | after.rlike(r"^[/.]\w")),
        "test_path": yes(lower_ascii(path).rlike("test|example|sample|mock|fixture|demo|doc")),
        "key_word": yes(near.rlike(f"(?<![a-z])(?:{KEY_WORDS})(?![a-z])")),
        "other_word": yes(near.rlike(f"(?<![a-z])(?:{OTHER_WORDS})[0-9]*(?![a-z])")),
        "assigned": yes(before.rlike("[=:][ \"']*$")),
        "quoted": yes(before.rlike("[\"']$")),
    }
    return [F.coalesce(made[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES]


def example_findings(spark: SparkSession, rows: int = 4000, seed: int = SEED) -> DataFrame:
    """(value, before, after, path, label): labelled findings, made by rule.

    Secrets are random strings of several alphabets, mostly beside a word for
    keys; the others are what scanners trip over.
    """
    rng = random.Random(seed)
    word = lambda: rng.choice(DICTIONARY)
    of = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    hexes, base64, upper = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits
    beside = ["password=", "passwd: ", 'token = "', "TOKEN=", "api_key = '", "apikey: ", "secret: ", 'client_secret = "', "Authorization: Bearer ", "access key ", "credential=", "auth_token: "]
    plain = ["", "the ", "see ", "and then ", "uses "]

    def secret() -> tuple[str, str]:
        kind = rng.randrange(8)
        if kind == 5:  # passwords: words with digits and signs
            base = rng.choice([word().title() + rng.choice("!@#$%&*") + str(rng.randrange(10, 9999)), of(string.ascii_letters + string.digits + "!@#$%&*._-", rng.randrange(8, 20))])
            return base, rng.choice(["password = ", 'password: "', "passwd=", 'pwd = "', "PASSWORD=", "secret: "])
        if kind == 6:
            return f"eyJ{of(base64, 33)}", rng.choice(plain + beside)
        if kind == 7:
            return rng.choice(["xoxb-", "npm_", "AIza", "dop_v1_", "SG.", "pk_live_", "hf_"]) + of(string.ascii_letters + string.digits, rng.choice([24, 32, 40])), rng.choice(plain + beside)
        if kind == 0:
            return "AKIA" + of(upper, 16), rng.choice(plain + beside)
        if kind == 1:
            return rng.choice(["ghp_", "sk_live_", "glpat-"]) + of(string.ascii_letters + string.digits, rng.choice([24, 36])), rng.choice(plain + beside)
        if kind == 2:
            return of(base64, rng.choice([32, 40, 43, 64])), rng.choice(beside)
        value = of(hexes, rng.choice([16, 18, 20, 24, 32, 40, 64]))
        return (value.upper() if rng.random() < 0.15 else value), rng.choice(beside)

    def other() -> tuple[str, str]:
        kind = rng.randrange(12)
        if kind == 9:  # what stands for a secret, or names one
            return rng.choice(["${PASSWORD}", "os.environ", "$DB_PASSWORD", "process.env", "********", "<password>", "changeme", "required", "string", "getpass()", "None", "undefined", "your-password", "xxxxxxxx"]), rng.choice(beside)
        if kind == 10:
            short = lambda *xs: rng.choice(xs)
            parts = [rng.choice([word().title(), short("By", "Id", "Of", "To", "All", "On", "Map")]) for _ in range(rng.randrange(2, 5))]
            return short("get", "set", "is", "on", "add", word()) + "".join(parts) + str(rng.randrange(0, 99)), rng.choice([*plain, "import ", "class ", "call "])
        if kind == 11:
            joined = rng.choice(["-", "_", "/"]).join([word(), of(string.ascii_lowercase, rng.randrange(3, 6)), word(), f"v{rng.randrange(1, 20)}"])
            return rng.choice([joined, f"{word()}{rng.randrange(1, 9)}/{word()}/{word()}-{rng.randrange(1, 99)}"]), rng.choice(plain)
        near = rng.choice(plain)  # without a word for keys
        if kind == 0:
            return f"{word()}{word().title()}{word().title()}{rng.randrange(10, 999)}", near
        if kind == 1:
            return f"20{rng.randrange(10, 30)}-{rng.randrange(10, 13)}-{rng.randrange(10, 29)}T{rng.randrange(10, 24)}", "date " + near
        if kind == 2:
            return of(hexes, rng.choice([32, 40, 64])), rng.choice(["commit ", "sha256: ", "md5 ", "checksum = ", "etag: ", "revision "])
        if kind == 3:
            return f"{of(hexes, 8)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 4)}-{of(hexes, 12)}", rng.choice(["uuid ", "id ", "guid: ", ""])
        if kind == 4:
            return f"/{word()}/{word()}/{rng.randrange(100, 99999)}-{word()}", rng.choice(["https:/", "src=", ""])
        if kind == 5:
            return f"{word()}-{rng.randrange(10)}-{rng.randrange(10, 99)}-{word()}", "version " + near
        if kind == 6:
            return rng.choice(["your_api_key_here_123", "xxxxxxxxxxxx1234", "changeme12345678", "placeholder_token_01", "example_secret_42"]), rng.choice(beside)
        if kind == 7:
            return f"{of(string.ascii_uppercase, 3)}-20{rng.randrange(10, 30)}-{rng.randrange(100000, 999999)}", rng.choice(["order ", "invoice ", ""])
        return "_".join([word(), word(), word(), str(rng.randrange(10, 99))]), rng.choice([near, f"{word()} = "])

    made = []
    for i in range(rows):
        positive = i % 2 == 0
        value, before = secret() if positive else other()
        path = rng.choice(["src/app.py", "config/prod.env", "web", None] if positive or rng.random() < 0.7 else ["tests/fixtures.py", "docs/example.md"])
        made.append((value, before, rng.choice(["", '"', " ", "\n", "'"]), path, float(positive)))
    return spark.createDataFrame(made, "value string, before string, after string, path string, label double")


def _assembled(rows: DataFrame, words: tuple[str, ...]) -> DataFrame:
    named = rows.select("*", F.array(*features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), words)).alias("f"))
    split = named.select("*", *(F.col("f")[i].alias(f"f_{n}") for i, n in enumerate(FEATURES)))
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(split)


@dataclass(frozen=True)
class Forest:
    """The trained forest with its dictionary; without one every score is ``share``."""

    model: RandomForestClassificationModel | None
    words: tuple[str, ...]
    share: float

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` (value, before, after, path) with ``score``."""
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share))
        return self.model.transform(_assembled(rows, self.words)).withColumn("score", F.round(F.get(vector_to_array("probability"), 1), 6))


def train(findings: DataFrame, words: list[str] | tuple[str, ...] = (), fit_rows: int = FIT_ROWS) -> Forest:
    """Forest on labelled findings (value, before, after, path, label), at most ``fit_rows`` of them."""
    known = findings.where(F.col("label").isNotNull() & F.col("value").isNotNull()).select("value", *(F.coalesce(c, F.lit("")).alias(c) for c in ("before", "after", "path")), F.col("label").cast("double").alias("label"))
    taken = materialize(known.orderBy(F.xxhash64(*known.columns), *known.columns).limit(fit_rows))
    n, good = taken.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, n):
        return Forest(None, tuple(words), good / n if n else 0.5)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    in_order = _assembled(taken, tuple(words)).coalesce(1).sortWithinPartitions(F.xxhash64("value", "before", "after", "path", "label"), "value", "before")
    return Forest(forest.fit(in_order.select("features", "label")), tuple(words), good / n)


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, start, end, value, before, after, path) of every run that could be a secret."""
    source = F.coalesce(F.col(path).cast("string"), F.lit("")) if path else F.lit("")
    rows = docs.select(F.col(key).alias("k"), text_of(text).alias("t"), source.alias("path"))
    runs = rows.where(F.col("t").rlike(CANDIDATE))
    low = F.greatest(F.lit(0), F.col("m.start") - NEIGHBOUR_CHARS)
    found = runs.select("k", "t", "path", F.explode(find_all(F.col("t"), CANDIDATE)).alias("m"))
    return found.select(F.col("k").alias(key), "m.start", "m.end", "m.value", F.substring("t", low + 1, F.col("m.start") - low).alias("before"), F.substring("t", F.col("m.end") + 1, F.lit(10)).alias("after"), "path")


def scan(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """(key, start, end, value, score) of the candidates that a forest trained on the labelled findings holds for secrets."""
    forest = train(findings, corpus_words(docs, text))
    return found(docs, forest, key, text, path, threshold)


def found(docs: DataFrame, forest: Forest, key: str = "doc_id", text: str = "text", path: str | None = None, threshold: float = 0.5) -> DataFrame:
    """The same by a forest that is there."""
    return forest.scored(candidates(docs, key, text, path)).where(F.col("score") > threshold).select(key, "start", "end", "value", "score")
