"""Evidence envelopes and case files: reading captured JSON, and writing one document a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions.text import safe_params, url_path

ENVELOPE = "name string, url string, params map<string,string>, status int, retrieved_at string, from_cache boolean, body string"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Evidence files below a folder, one JSON object each; files that can't be read give a row of nulls and their path."""
    return spark.read.schema(ENVELOPE).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def latest_responses(fetches: DataFrame) -> DataFrame:
    """The cache's content: of each url and parameters the last stored answer of status 200, by fetch_id."""
    key = F.to_json(F.struct("url", F.array_sort(F.map_entries("params")).alias("params")))
    good = fetches.where("status = 200").select(key.alias("cache_key"), F.struct("fetch_id", "body").alias("v"))
    return good.groupBy("cache_key").agg(F.max("v").alias("v")).select("cache_key", "v.fetch_id", "v.body")


def fetch_log(fetches: DataFrame) -> DataFrame:
    """Fetches without bodies, and without parameters whose names speak of secrets."""
    return fetches.select("fetch_id", "name", "url", safe_params(F.col("params")).alias("params"), "status", "from_cache")


def write_cases(cases: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object per case and line, in folders by the case's number; an existing target is an error unless overwrite."""
    cases.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("company_number").json(path)


def first_name(body: Column, keys: tuple[str, ...], nested: tuple[str, ...] = ("version", "name")) -> Column:
    """The first of the keys of a JSON object that holds a text that isn't empty, or an object in which one of the nested keys does."""
    v = F.try_parse_json(body)
    paths = [p for k in keys for p in (f"$.{k}", *(f"$.{k}.{n}" for n in nested))]
    texts = (F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.nullif(F.try_variant_get(v, p, "string"), F.lit(""))) for p in paths)
    return F.coalesce(*texts)


def sections(texts: DataFrame, case: str) -> DataFrame:
    """(case, label, ord, text) -> (case, label, text): texts of one label joined by line feeds, in order; repeated rows count once."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("ord", "text"))), lambda x: x["text"]), "\n")
    return texts.groupBy(case, "label").agg(joined.alias("text"))


def evidence_sections(envelopes: DataFrame) -> DataFrame:
    """Rows of read_envelopes -> (file, label, ord, text): a deck's pages as 'deck p.N', a site's page as 'site /path' of the address asked for.

    What can't be read, and envelopes of other kinds, have no row.
    """
    e = envelopes.where("body is not null")
    pages = F.from_json(F.get_json_object("body", "$.pages"), "map<string,string>")
    deck = e.where(F.col("name") == "deck_text").select("file", F.explode(pages).alias("page", "text")).select("file", F.concat(F.lit("deck p."), "page").alias("label"), F.col("file").alias("ord"), "text")
    path = F.concat(F.lit("site "), url_path(F.coalesce("url", F.get_json_object("body", "$.url"))))
    site = e.where(F.col("name").startswith("site")).select("file", path.alias("label"), F.col("file").alias("ord"), F.get_json_object("body", "$.text").alias("text"))
    return deck.unionByName(site).where("text is not null and text <> ''")


def cache_stats(fetches: DataFrame) -> DataFrame:
    """Per feed ('' for none): answers of status 200, those served from the cache, and the characters they hold; a fetch counts once."""
    each = fetches.where("status = 200").groupBy("feed", "fetch_id").agg(F.max("from_cache").alias("c"), F.max(F.coalesce(F.length("body"), F.lit(0))).alias("n"))
    return each.groupBy(F.coalesce("feed", F.lit("")).alias("feed")).agg(F.count(F.lit(1)).alias("n_entries"), F.count_if("c").alias("n_from_cache"), F.sum("n").alias("n_chars"))


def read_casefiles(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Case files below a folder, one JSON object each, by a declared schema; one that doesn't fit it keeps its path and its text in _corrupt_record."""
    return spark.read.schema(schema + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("file", F.col("_metadata.file_path"))


def write_case_folders(cases: DataFrame, memos: DataFrame, log: DataFrame, evidence: DataFrame, path: str, overwrite: bool = False) -> None:
    """Four data sets below path, each in folders by case: casefile and evidence as JSON, fetch_log without secrets, memo as text.

    Every data set has the column case; evidence has an index row per name. An
    existing target is an error unless overwrite.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    log = log.withColumn("params", safe_params(F.col("params")))
    index = evidence.select("case", "name", "url", "status", "retrieved_at").distinct()
    for name, df in (("casefile", cases), ("fetch_log", log), ("evidence", evidence), ("evidence_index", index)):
        df.write.mode(mode).partitionBy("case").json(f"{path}/{name}")
    memos.select("case", F.col("memo").alias("value")).write.mode(mode).partitionBy("case").text(f"{path}/memo")


def read_decks(spark: SparkSession, path: str, most_bytes: int = 50_000_000) -> DataFrame:
    """Files below a folder as decks: path, n_bytes, sha256, state ('ok', 'oversize', 'not a pdf'); contents beyond most_bytes aren't read, empty files have no row."""
    files = spark.read.format("binaryFile").load(path)
    inside = F.col("length") <= most_bytes
    begins = F.substring("content", 1, 5) == F.encode(F.lit("%PDF-"), "utf-8")
    state = F.when(~inside, "oversize").when(begins, "ok").otherwise("not a pdf")
    return files.select("path", F.col("length").alias("n_bytes"), F.when(inside, F.sha2("content", 256)).alias("sha256"), state.alias("state"))


def clear_cache(fetches: DataFrame, before: Column | None = None) -> DataFrame:
    """What stays of the cache: nothing, or the answers stored since a time."""
    return fetches.limit(0) if before is None else fetches.where(F.col("retrieved_at") >= before)
