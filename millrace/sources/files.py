"""Reading and writing of what the pipelines use: files, exports, logs, tables with a key.

Defined results: malformed lines of a log are skipped; a missing path is an empty table;
empty cells of an export are left out of its labelled lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACE = "trace_id string, kind string, started_wall string, total_ms double, stages map<string,double>, cumulative map<string,double>"


def source_list(spark: SparkSession, path: str) -> DataFrame:
    """url, category and note of the sources in a YAML file: a small list, read by the driver."""
    import yaml

    listed = yaml.safe_load(Path(path).read_text()).get("sources") or []
    return spark.createDataFrame([(s.get("url"), s.get("category"), s.get("note")) for s in listed], "url string, category string, note string")


def text_files(spark: SparkSession, path: str, prefixes: dict[str, str] | None = None, default_lang: str = "en") -> DataFrame:
    """doc_id (place in the sorted folder), name, lang and text of every .md and .csv file; `prefixes` maps
    the beginning of a name to its language."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    lang = F.lit(default_lang)
    for prefix, code in (prefixes or {}).items():
        lang = F.when(F.startswith("name", F.lit(prefix)), code).otherwise(lang)
    wanted = read.where(F.col("name").rlike(r"\.(?:md|csv)$"))  # a folder of authored files, not a corpus
    return wanted.select((F.row_number().over(W.orderBy("name")) - 1).alias("doc_id"), "name", lang.alias("lang"), "text")


def labelled(columns: Sequence[str]) -> Column:
    """One row of an export as "name: value; name: value", empty cells left out."""
    cell = lambda c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c))))
    return F.concat_ws("; ", *map(cell, columns))


def labelled_csv(body: Column) -> Column:
    """A whole CSV text (plain commas) as labelled lines."""
    rows = F.split(F.regexp_replace(F.regexp_replace(body, "\r\n?", "\n"), r"^\s+|\s+$", ""), "\n", -1)
    header = F.transform(F.split(F.get(rows, F.lit(0)), ",", -1), lambda c: F.trim(c))
    line = lambda row: F.array_join(
        F.filter(F.zip_with(header, F.transform(F.split(row, ",", -1), lambda c: F.trim(c)), lambda h, c: F.when(c != "", F.concat(h, F.lit(": "), c))), lambda x: x.isNotNull()), "; "
    )
    return F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line), "\n")


def json_lines(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    """Rows of a JSON-lines log; lines that are no JSON object are skipped."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], schema)
    parsed = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), F.try_parse_json("value").alias("j"))
    return parsed.where(F.col("j").isNotNull() & F.schema_of_variant("j").startswith("OBJECT")).select("x.*")


def latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Upsert: of each key the row with the largest `order`, new rows before old ones where equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    row = F.struct(*[c for c in old.columns])
    return both.groupBy(*keys).agg(F.max_by(row, F.struct(order, "_new")).alias("_row")).select("_row.*")


def replace_parts(df: DataFrame, path: str, part: str) -> None:
    """Full rebuild of the parts of a table that `df` holds; the other parts stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def manifest(df: DataFrame, corpus: str) -> DataFrame:
    """Key and value of a build: corpus, rows, columns."""
    counted = df.agg(F.count("*").cast("string").alias("rows"))
    facts = F.create_map(F.lit("corpus"), F.lit(corpus), F.lit("rows"), F.col("rows"), F.lit("columns"), F.lit(",".join(df.columns)))
    return counted.select(F.explode(facts).alias("key", "value"))


def excluded(*branches: tuple[DataFrame, str]) -> DataFrame:
    """ref, stage and reason of the rows that branches leave out; each branch has ref and reason."""
    out = None
    for df, stage in branches:
        part = df.select(F.col("ref").cast(T.StringType()), F.lit(stage).alias("stage"), F.col("reason").cast(T.StringType()))
        out = part if out is None else out.unionByName(part)
    return out
