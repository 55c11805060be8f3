"""Readers and writers of record files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "strict") -> DataFrame:
    """JSON lines. strict: a bad line fails; lenient: bad lines go; counted: they stay, with the text in `_corrupt_record`."""
    reader = spark.read.schema(schema)
    if mode == "counted":
        whole = T.StructType(T._parse_datatype_string(schema).fields if isinstance(schema, str) else list(schema.fields)).add("_corrupt_record", "string")
        return spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return reader.option("mode", {"strict": "FAILFAST", "lenient": "DROPMALFORMED"}[mode]).json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, a JSON array or JSON lines, by ending and first character."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    many = bool(first) and first[0]["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", many).option("mode", "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(path)


def coerce_outer(text: DataFrame, column: str = "value") -> DataFrame:
    """Rows (pos, record as variant) of a document that is a list, {"data": [..]} or {"0": {..}}."""
    parsed = text.select(F.try_parse_json(column).alias("v"))
    inner = parsed.select(F.coalesce(F.try_variant_get("v", "$.data", "variant"), F.col("v")).alias("v"))
    return text.sparkSession.sql("SELECT t.pos, t.value AS record FROM {rows}, LATERAL variant_explode(v) AS t", rows=inner)


def read_json_or_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, record as variant) of files that are one JSON value each, or else JSON lines, of which bad ones go."""
    whole = spark.read.text(path, wholetext=True)
    # The parser stops behind the first value; within brackets, more than one is an error.
    good = F.try_parse_json(F.concat(F.lit("["), "value", F.lit("]"))).isNotNull()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    single = whole.where(good).select("value")
    bad = whole.select(F.col("_metadata.file_path").alias("file"), "value").where(~good).select("file")
    numbered = lines.join(bad, "file", "left_semi").where(F.trim("value") != "").select(F.try_parse_json("value").alias("record")).where("record IS NOT NULL")
    return coerce_outer(single).unionByName(numbered.select(F.monotonically_increasing_id().cast("int").alias("pos"), "record"))


def is_official(path: Column) -> Column:
    """Whether a file is one of the results: its name does not begin with an underscore, and it is no sample."""
    name = F.element_at(F.split(path, "/"), -1)
    return ~name.startswith("_") & ~F.contains(name, F.lit(".sample."))


def official_files(files: DataFrame) -> DataFrame:
    """Of a list of files (path) the official ones, in order."""
    return files.where(is_official(F.col("path"))).orderBy("path")


def fresh_sources(files: DataFrame) -> DataFrame:
    """From (dataset, path, kind: merged or part, modified) the files to read: the merged one if no part is newer, else the parts."""
    newest = files.groupBy("dataset").agg(F.max(F.when(F.col("kind") == "merged", F.col("modified"))).alias("_m"), F.max(F.when(F.col("kind") == "part", F.col("modified"))).alias("_p"))
    good = F.col("_m").isNotNull() & (F.col("_p").isNull() | (F.col("_m") >= F.col("_p")))
    return files.join(newest, "dataset").where(F.when(good, F.col("kind") == "merged").otherwise(F.col("kind") == "part")).drop("_m", "_p")


def real_and_derived(real: DataFrame, derived: DataFrame | None) -> DataFrame:
    """Rows of both with `is_derived`."""
    marked = real.withColumn("is_derived", F.lit(False))
    return marked if derived is None else marked.unionByName(derived.withColumn("is_derived", F.lit(True)), allowMissingColumns=True)


def light(rows: DataFrame, columns: list[str], key: str = "content_sha1") -> tuple[DataFrame, DataFrame]:
    """Only some columns, of rows that have a key; and how many lack it."""
    none = F.coalesce(key, F.lit("")) == ""
    return rows.where(~none).select(*columns), rows.agg(F.count_if(none).alias("n_without_key"))


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines in UTF-8, in a new folder or added to one."""
    rows.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def merge_outputs(outputs: dict[str, DataFrame], found: list[str]) -> tuple[DataFrame, list[str]]:
    """One table of this run's outputs by name, with `output`; and names that were found and are none of them."""
    parts = [df.withColumn("output", F.lit(name)) for name, df in outputs.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), sorted(set(found) - set(outputs))


def write_vectors(rows: DataFrame, path: str, shard: int = 5000, key: str = "uid") -> None:
    """Vectors with their facts, in folders of about `shard` rows each by the hash of their key, so that a shard is the same in each run."""
    n = max(1, -(-rows.count() // shard))
    rows.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_vectors(spark: SparkSession, path: str, level: str | None = "item") -> DataFrame:
    """Vectors of one level; the filter reaches the files."""
    rows = spark.read.parquet(path)
    return rows if level is None else rows.where(F.col("level") == level)


def shards_to_do(rows: DataFrame, done: DataFrame, key: str, content: Column) -> DataFrame:
    """Shards (shard) of rows whose content is not as a marker (shard, digest) has it. A marker names what it was made of, not only the shard."""
    digest = F.sha1(F.array_join(F.array_sort(F.collect_list(F.sha1(F.concat_ws("|", F.col(key).cast("string"), content)))), ""))
    return rows.groupBy("shard").agg(digest.alias("digest")).join(done, ["shard", "digest"], "left_anti")


def write_split(rows: DataFrame, path: str, *by: str) -> None:
    """One pass routes rows to a folder for each value."""
    rows.write.mode("overwrite").partitionBy(*by).parquet(path)


def manifest(spark: SparkSession, path: str, most: int = 1 << 30) -> DataFrame:
    """path, bytes and sha256 of files; hidden and partial ones are left out by the reader. Files of more than `most` bytes, which a row
    could not hold, are listed without a hash; the filter on length keeps their content from being read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return small.unionByName(files.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("string").alias("sha256")))


def verified(manifest: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, status) of expected files (path, sha256): same, changed, missing, or unknown where one of the hashes is not known; files
    that nobody expects are new."""
    met = manifest.select("path", F.col("sha256").alias("_now"), F.lit(True).alias("_here")).join(expected.select("path", F.col("sha256").alias("_then"), F.lit(True).alias("_known")), "path", "full")
    status = F.when(F.col("_here").isNull(), "missing").when(F.col("_known").isNull(), "new").when(F.col("_now").isNull() | F.col("_then").isNull(), "unknown").when(F.col("_now") == F.col("_then"), "same").otherwise("changed")
    return met.select("path", status.alias("status"))


def registered(register: DataFrame, kind: str, rows: DataFrame, digest: str) -> DataFrame:
    """A register (kind, n_rows, sha256) with the entry of one kind put in or replaced."""
    entry = rows.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(kind).alias("kind"), "n_rows", F.lit(digest).alias("sha256"))
    return upsert(register, entry, ["kind"])


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def pending(rows: DataFrame, done: DataFrame, key: list[str], ok: str | None = None) -> DataFrame:
    """Rows whose key is not in the log yet; with ok, only log rows for which it holds count as done."""
    return rows.join((done.where(ok) if ok else done).select(*key).distinct(), key, "left_anti")
