"""Runs: stage files, run objects, uploads, the judgment cache, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.operators.judge import cache_key
from tandem.sources.scratch import materialize

SIDE = "struct<page:int,text:string,span:array<int>>"
FINDINGS = f"array<struct<id:string,type:string,severity:string,source:string,section:string,pair_id:string,sentence_id:string,en:{SIDE},zh:{SIDE},explanation:string,confidence:double,status:string,dismiss_reason:string,note:string>>"
LANGUAGE = "struct<code:string,name:string,script:string>"
META = f"struct<en_title:string,zh_title:string,company:string,stock_code:string,authoritative:string,authoritative_detected:boolean,en_pages:int,zh_pages:int,unreadable_pages:struct<en:array<int>,zh:array<int>>,languages:struct<en:{LANGUAGE},zh:{LANGUAGE}>,elapsed_s:double>"
COUNTS = "struct<critical:int,material:int,cosmetic:int,unaligned_sections:int,reviewed:int,total:int>"
RUN = f"run_id string, status string, error string, created_at string, meta {META}, counts {COUNTS}, findings {FINDINGS}, unaligned_sections array<struct<lang:string,heading:string,page:int>>, glossary array<struct<en:string,zh:string>>"
LINES = "run_id string, slot string, page int, block_no int, line_no int, text string, size double, bold boolean, x0 double, y0 double, x1 double, y1 double"

AUTHORITATIVE = ("EN", "ZH", "none")


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Stage files with a fixed schema; a broken file gives nulls, a missing one no rows."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str) -> None:
    """Written aside and moved into place by the commit protocol."""
    df.write.mode("overwrite").json(path)


def load_runs(started: DataFrame, finished: DataFrame) -> DataFrame:
    """Run objects of all runs that were started; those without one are running, with zero counts.

    ``started(run_id)``, ``finished`` as ``RUN``.
    """
    zero = F.struct(*(F.lit(0).alias(c) for c in ("critical", "material", "cosmetic", "unaligned_sections", "reviewed", "total")))
    joined = started.select("run_id").join(finished, "run_id", "left")
    return joined.withColumns({"status": F.coalesce("status", F.lit("running")), "counts": F.coalesce("counts", zero), "findings": F.coalesce("findings", F.array().cast(FINDINGS))})


def check_uploads(files: DataFrame) -> DataFrame:
    """Uploads (path, content) with ``error``: an empty file, or one that is no PDF; null where it is fine.

    Spark's ``binaryFile`` reader leaves empty files out; list them apart to report them.
    """
    magic = F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF")
    fine = F.when(F.length("content") == 0, "the file is empty").when(~magic, "the file is not a PDF")
    return files.withColumn("error", fine)


def normalise_authoritative(value: Column) -> Column:
    """EN, ZH or none; the empty text is no choice; anything else is an error."""
    bare = F.trim(value)
    known = F.when(F.upper(bare).isin("EN", "ZH"), F.upper(bare)).when(F.lower(bare) == "none", "none")
    return F.when(bare.isNull() | (bare == ""), F.lit(None).cast("string")).when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("authoritative must be EN, ZH or none, not "), bare)).cast("string"))


def cached(requests: DataFrame, cache: DataFrame, model: str) -> tuple[DataFrame, DataFrame]:
    """Requests (prompt, …) with their recorded response, and those without one.

    ``cache(key, response)``; equi-join on the hash of model and prompt.
    """
    keyed = requests.withColumn("key", cache_key(F.lit(model), F.col("prompt")))
    return keyed.join(cache, "key"), keyed.join(cache, "key", "left_anti")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Recorded responses (key, response); none where nothing was recorded yet."""
    try:
        return spark.read.schema("key string, response string").parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "key string, response string")


def answered(requests: DataFrame, path: str, call: Callable[[DataFrame], DataFrame], model: str, required: dict[str, str], attempts: int = 2) -> tuple[DataFrame, DataFrame]:
    """(answers, failures): requests with a valid response, recorded or new, and those without one after all attempts.

    ``call`` takes requests (key, prompt) and returns (key, response).  Valid
    responses are appended to the cache at ``path``; invalid ones are asked again
    and never recorded.
    """
    spark = requests.sparkSession
    found, left = cached(requests, read_cache(spark, path), model)
    found, left = materialize(found), materialize(left)
    for _ in range(attempts):
        if left.isEmpty():
            break
        made = materialize(call(left.select("key", "prompt")).select("key", "response").where(valid_response(F.col("response"), required)).dropDuplicates(["key"]))
        made.write.mode("append").parquet(path)
        found = found.unionByName(left.join(made, "key"))
        left = materialize(left.join(made, "key", "left_anti"))
    return found, left


def log_rows(calls: DataFrame) -> DataFrame:
    """Requests and responses, numbered within the run in the order of time."""
    return calls.withColumn("n", F.row_number().over(W.partitionBy("run_id").orderBy("ts", "key")))


def valid_response(response: Column, required: dict[str, str]) -> Column:
    """Whether a JSON text is an object with the required keys of these types (array, object, string)."""
    marks = {"array": r"^\s*\[", "object": r"^\s*\{", "string": None}
    test = F.coalesce(response.rlike(r"^\s*\{"), F.lit(False))
    for name, kind in required.items():
        value = F.get_json_object(response, f"$.{name}")
        test &= value.isNotNull() if marks[kind] is None else F.coalesce(value.rlike(marks[kind]), F.lit(False))
    return test


JUDGED = "struct<results:array<struct<pair_id:string,verdict:string,en_span:string,zh_span:string,explanation:string,confidence:double>>>"


def parse_judgments(answers: DataFrame) -> DataFrame:
    """Responses (run_id, tier, response) read into the rows that a recorded provider looks up; malformed ones give none."""
    read = answers.select("run_id", "tier", F.explode(F.from_json("response", JUDGED, {"mode": "PERMISSIVE"})["results"]).alias("x"))
    return read.select("run_id", "tier", "x.*").where("pair_id is not null and verdict is not null")


def export_json(runs: DataFrame) -> DataFrame:
    """(run_id, json): the run object as one JSON text."""
    return runs.select("run_id", F.to_json(F.struct(*runs.columns)).alias("json"))


def guess_language(filename: Column) -> Column:
    """Language code that a file name hints at, or null."""
    name = F.lower(filename)
    hint = lambda *words: name.rlike(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])")
    return F.when(hint("en", "eng", "english"), "en").when(hint("zh", "chi", "tc", "sc", "chinese", "hant", "hans") | name.rlike("[一-鿿]"), "zh").when(hint("fr", "fre", "french"), "fr").when(hint("de", "ger", "german"), "de")
