"""Tokenizer files as relations: id and token, and ranked merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def word_level(spark: SparkSession, path: str) -> DataFrame:
    """id, token from a JSON object of token to id."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("token", "id")).select("id", "token")


def tokenizer_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, token) and (left, right, rank) of a tokenizer.json with a merge list, as pairs or as strings."""
    text = spark.read.text(path, wholetext=True)
    model = F.get_json_object("value", "$.model")
    vocab = text.select(F.explode(F.from_json(F.get_json_object(model, "$.vocab"), "map<string,int>")).alias("token", "id")).select("id", "token")
    raw = F.get_json_object(model, "$.merges")
    flat = F.when(F.startswith(raw, F.lit("[[")), F.from_json(raw, "array<array<string>>")).otherwise(F.transform(F.from_json(raw, "array<string>"), lambda m: F.split(m, " ")))
    merges = text.select(F.posexplode(flat).alias("rank", "m")).select(F.col("m")[0].alias("left"), F.col("m")[1].alias("right"), "rank")
    return vocab, merges


def added_tokens(spark: SparkSession, path: str) -> DataFrame:
    """id, token of a tokenizer.json's added tokens."""
    held = F.from_json(F.get_json_object("value", "$.added_tokens"), "array<struct<id:int,content:string>>")
    return spark.read.text(path, wholetext=True).select(F.explode(held).alias("a")).select("a.id", F.col("a.content").alias("token"))


def ranks(spark: SparkSession, path: str) -> DataFrame:
    """id, bytes from lines of base64 and rank."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("trim(value) <> ''").select(parts[1].cast("int").alias("id"), F.unbase64(parts[0]).alias("bytes"))


def merge_file(spark: SparkSession, path: str) -> DataFrame:
    """left, right, rank from lines of two tokens; a first line that begins with # is a header. The file is one split by its
    nature: a rank is a line's place."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\n"), lambda x: (x != "") & ~F.startswith(x, F.lit("#version")))).alias("rank", "m"))
    return lines.select(F.split_part("m", F.lit(" "), F.lit(1)).alias("left"), F.split_part("m", F.lit(" "), F.lit(2)).alias("right"), "rank")


def by_rank(merges: DataFrame) -> DataFrame:
    """Dense ranks from 0, for tables put together from several files."""
    return merges.withColumn("rank", F.row_number().over(Window.orderBy("rank", "left", "right")) - 1)
