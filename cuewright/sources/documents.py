"""Documents and logs the engine wrote itself, read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions.text import let

FILE_ID = r"-([\w-]{11})$"
PARAGRAPH = r"(?m)^\[[\[(]?((?:\d[\d:]*(?:[.,]\d+)?|(?:\d+h)?(?:\d+m)?\d+s)?)[\])]?\]\(([^)]*)\)[ \t]*(?:\*\*(?:[^*]+)\*\*:[ \t]*)?(?:>> )?(.+)$"


def read_markdown(spark: SparkSession, folder: str, ordered: bool = False) -> DataFrame:
    """(path, title, channel, url, description, speakers, paragraphs, text) of the markdown files of a folder, ordered by path if asked for; files that cannot be read are left out."""
    raw = spark.read.option("pathGlobFilter", "*.md").option("ignoreCorruptFiles", True).text(folder, wholetext=True)
    d = parse_markdown(raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))
    return d.orderBy("path") if ordered else d


def parse_markdown(raw: DataFrame) -> DataFrame:
    """As read_markdown, of (path, raw). The first line of a key counts, comments after two blanks are cut, indented keys are skipped; a speaker's label and the marker of a change are no part of a paragraph's text."""
    at = F.locate("\n---\n", F.col("raw"))
    head = F.regexp_replace(F.when(at > 0, F.substring("raw", F.lit(1), at - 1)).otherwise(F.col("raw")), r"^[-\n]+", "")
    body = F.when(at > 0, F.substring("raw", at + 5, F.length("raw"))).otherwise("")
    lines = F.filter(F.split(head, r"\r?\n"), lambda x: F.contains(x, F.lit(":")) & ~x.startswith(" ") & (F.trim(F.substring_index(x, ":", 1)) != ""))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.substring_index(F.regexp_replace(x, r"^[^:]*:", ""), "  #", 1)).alias("v")))
    meta = F.map_from_entries(let(pairs, lambda x: F.filter(x, lambda p, i: F.array_position(x["k"], p["k"]) == i + 1)))
    d = raw.select("path", meta.alias("m"), body.alias("body"))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(""))
    hit = lambda k: F.regexp_extract_all("body", F.lit(PARAGRAPH), F.lit(k))
    texts = F.transform(hit(3), lambda t: F.trim(t))
    return d.select(
        "path", get("title").alias("title"), get("channel").alias("channel"), get("url").alias("url"), get("about").alias("description"),
        F.filter(F.transform(F.split(get("speakers"), ","), lambda s: F.trim(s)), lambda s: s != "").alias("speakers"),
        F.arrays_zip(hit(1).alias("timestamp"), hit(2).alias("url"), texts.alias("text")).alias("paragraphs"), F.array_join(texts, " ").alias("text"),
    )


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last result of each recording in an append-only JSON log, without failed ones and lines that are no JSON; files follow one another by the time they were written. Schema must hold video_id and failed."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    return last_results(lines.select(F.from_json("value", schema).alias("x"), F.struct("t", "f", "b", "i").alias("at")))


def last_results(rows: DataFrame) -> DataFrame:
    """Of (x, at): the last good x of each recording."""
    good = rows.where("x is not null and x.video_id is not null and x.failed is null")
    return good.groupBy("x.video_id").agg(F.max_by("x", "at").alias("x")).select("x.*")


def read_graph(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_people(spark: SparkSession, path: str) -> DataFrame:
    """(key, name) of a people file, one JSON object; a corrupt file gives none, values that are no text are left out."""
    raw = spark.read.text(path, wholetext=True)
    return people_of(raw)


def people_of(raw: DataFrame) -> DataFrame:
    m = F.from_json("value", "map<string,string>")
    quoted = F.get_json_object("value", "$").isNotNull()
    d = raw.where(quoted).select("value", F.explode(m).alias("key", "name"))
    # A number or object would be cast to text: only what stands in quotes is a name.
    return d.where(F.contains("value", F.concat(F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2)))).select("key", "name")


def transcript_index(files: DataFrame) -> DataFrame:
    """(video_id, stem) of file names (name): the id that ends the stem; the last name in order wins."""
    d = files.where(F.col("name").endswith(".md")).select(F.regexp_replace("name", r"\.md\z", "").alias("stem"))
    d = d.withColumn("video_id", F.regexp_extract("stem", FILE_ID, 1)).where("video_id <> ''")
    return d.groupBy("video_id").agg(F.max("stem").alias("stem"))


def first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The first row of each value within its keys, in order; of rows that tie one stays. Reduced before it is shuffled."""
    rest = [c for c in df.columns if c not in (*keys, value)]
    d = df.groupBy(*keys, value).agg(F.min(F.struct(F.col(order).alias("__o"), *rest)).alias("__x"))
    return d.select(*[F.col(c) if c in (*keys, value) else F.col(f"__x.{c}").alias(c) for c in df.columns])
