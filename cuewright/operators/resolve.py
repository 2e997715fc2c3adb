"""Claimed names resolved against the people a recording's metadata names, and constraints on an attribution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.functions import names as N
from cuewright.functions.text import fold
from cuewright.operators.scan import _join

# Limits of a plausible attribution.
EXPECTED_SPEAKERS, LEAST_COVERAGE = 4, 0.5


def known_people(recordings: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """(video_id, key, name, origin): who channel, title credits and description name, each key once with its longest spelling (the first on a tie).

    corpus: (video_id, key, name) of people other recordings established that this one may mention; the recording's own metadata wins where both have a key.
    """
    r = recordings.select("video_id", F.trim(F.coalesce("channel", F.lit(""))).alias("channel"), "title", "description").where("video_id is not null")
    channel = F.when(F.col("channel") != "", F.array(F.struct(fold(F.col("channel")).alias("key"), F.col("channel").alias("name")))).otherwise(F.array().cast("array<struct<key:string,name:string>>"))
    found = F.concat(channel, N.names_in(N.title_credits(F.col("title"))), N.names_in(F.col("description")))
    own = r.select("video_id", F.posexplode(found).alias("pos", "x")).select("video_id", "x.key", "x.name", "pos").where("key <> ''")
    own = longest(own, ["video_id", "key"], "name", "pos").withColumn("origin", F.lit("own"))
    return own if corpus is None else override(corpus.select("video_id", "key", "name", F.lit("corpus").alias("origin")), own, ["video_id", "key"])


def longest(df: DataFrame, keys: list[str], name: str, pos: str) -> DataFrame:
    """One row a key: the longest spelling, the first on a tie."""
    best = F.max(F.struct(F.length(name).alias("l"), (-F.col(pos)).alias("p"), F.col(name).alias("name")))
    return df.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.name").alias(name))


def override(low: DataFrame, high: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both, those of `high` where both have a key."""
    return low.join(high.select(*keys).distinct(), keys, "left_anti").unionByName(high)


def canonicalise(claims: DataFrame, known: DataFrame) -> DataFrame:
    """(video_id, claimed, name, grounded, stage) of each distinct claim (video_id, claimed).

    A cascade, cheapest first: 1 the same fold; 2 the one name close to it word by word; 3 the same given and family name, if that is one person; 4 for a single word, the one
    name with that family name, else with one close to it. A claim that resolves nowhere stays as it is, not grounded. Every stage joins on the recording and a
    key that loses no match: word counts for 2, given and family name for 3, the family name for 4.
    """
    c = claims.select("video_id", "claimed").where("claimed is not null").distinct().withColumn("key", fold(F.col("claimed"))).withColumn("words", F.size(F.split("key", " ")))
    k = known.select("video_id", F.col("key").alias("kk"), F.col("name").alias("kn")).distinct().withColumn("words", F.size(F.split("kk", " ")))
    one = c.join(k, (c.video_id == k.video_id) & (F.col("key") == F.col("kk"))).select(c.video_id, "claimed", F.col("kn").alias("n1"))
    slack = F.abs(F.length("key") - F.length("kk")) <= F.ceil(0.15 * (F.length("key") + F.length("kk")))
    two = c.join(k, ["video_id", "words"]).where((F.col("key") != "") & slack).where(N.close("kk", "key"))
    two = two.groupBy("video_id", "claimed").agg(F.count(F.lit(1)).alias("c"), F.min("kn").alias("n2")).where("c = 1").drop("c")
    cp, kp = c.withColumn("p", N.parts("claimed")), k.withColumn("p", N.parts("kn"))
    three = cp.join(kp, ["video_id", "p"]).where("p.first <> '' and p.last <> ''")
    three = three.groupBy("video_id", "claimed").agg(F.count_distinct("kk").alias("c"), F.min("kn").alias("n3")).where("c = 1").drop("c")
    single, kl = c.where("words = 1 and key <> ''"), k.withColumn("last", N.surname(F.col("kk")))
    four = single.join(kl, (single.video_id == kl.video_id) & (F.col("key") == F.col("last"))).groupBy(single.video_id, "claimed").agg(F.count(F.lit(1)).alias("c"), F.min("kn").alias("n4")).where("c = 1").drop("c")
    near = F.abs(F.length("key") - F.length("last")) <= F.ceil(0.15 * (F.length("key") + F.length("last")))
    five = single.join(kl.drop("words"), "video_id").where(near).where(N.close("last", "key"))
    five = five.groupBy("video_id", "claimed").agg(F.count(F.lit(1)).alias("c"), F.min("kn").alias("n5")).where("c = 1").drop("c")
    out = c.select("video_id", "claimed")
    for stage in (one, two, three, four, five):
        out = out.join(stage, ["video_id", "claimed"], "left")
    which = F.coalesce(*[F.when(F.col(f"n{i}").isNotNull(), min(i, 4)) for i in range(1, 6)])
    name = F.coalesce("n1", "n2", "n3", "n4", "n5", "claimed")
    return out.select("video_id", "claimed", name.alias("name"), which.isNotNull().alias("grounded"), which.alias("stage"))


def corrected(labels: DataFrame, resolved: DataFrame) -> DataFrame:
    """(video_id, n, claimed, speaker, confidence, grounded): labels with canonical names; who is not grounded is kept, with low confidence."""
    d = labels.select("video_id", "n", F.nullif("speaker", F.lit("")).alias("claimed"), "confidence")
    d = _join(d, resolved.select("video_id", "claimed", "name", "grounded"), ["video_id", "claimed"])
    low = F.col("claimed").isNotNull() & ~F.coalesce("grounded", F.lit(False))
    return d.select("video_id", "n", "claimed", F.coalesce("name", "claimed").alias("speaker"), F.when(low, "low").otherwise(F.col("confidence")).alias("confidence"), F.coalesce("grounded", F.lit(False)).alias("grounded"))


def speakers(labels: DataFrame) -> DataFrame:
    """(video_id, pos, name) of corrected labels: each fold once, by its first label."""
    d = labels.where("speaker is not null").withColumn("key", fold(F.col("speaker")))
    d = d.groupBy("video_id", "key").agg(F.min(F.struct("n", "speaker")).alias("x")).select("video_id", F.col("x.n").alias("pos"), F.col("x.speaker").alias("name"))
    return d


def violations(labels: DataFrame, recordings: DataFrame) -> DataFrame:
    """(video_id, kind, detail, paragraphs) that an attribution (corrected labels, one row a paragraph) breaks."""
    named = labels.where("claimed is not null")
    empty = F.array().cast("array<int>")
    out = named.where("not grounded").groupBy("video_id", "speaker").agg(F.sort_array(F.collect_list(F.col("n").cast("int"))).alias("paragraphs"))
    out = out.select("video_id", F.lit("ungrounded_speaker").alias("kind"), F.concat(F.lit("'"), F.col("speaker"), F.lit("' is not named in the title, description or channel")).alias("detail"), "paragraphs")
    spelled = named.groupBy("video_id", "speaker").agg(F.sort_array(F.collect_set("claimed")).alias("s")).where((F.size("s") > 1) | (F.col("s")[0] != F.col("speaker")))
    spelled = spelled.select("video_id", F.lit("spelling_variants").alias("kind"), F.concat(F.array_join("s", ", "), F.lit(" treated as one person: "), F.col("speaker")).alias("detail"), empty.alias("paragraphs"))
    who = speakers(labels)
    channel = recordings.select("video_id", F.trim("channel").alias("channel")).where("channel <> ''").distinct()
    rival = who.join(channel, "video_id").where((fold(F.col("name")) != fold(F.col("channel"))) & (N.surname(fold(F.col("name"))) != "") & (N.surname(fold(F.col("name"))) == N.surname(fold(F.col("channel")))))
    rival = rival.select("video_id", F.lit("host_guest_conflict").alias("kind"), F.concat(F.col("name"), F.lit(" and the channel "), F.col("channel"), F.lit(" look like one person")).alias("detail"), empty.alias("paragraphs"))
    many = who.groupBy("video_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > EXPECTED_SPEAKERS)
    many = many.select("video_id", F.lit("many_speakers").alias("kind"), F.concat(F.col("c").cast("string"), F.lit(" speakers")).alias("detail"), empty.alias("paragraphs"))
    share = labels.groupBy("video_id").agg(F.count("speaker").alias("a"), F.count(F.lit(1)).alias("c")).where(F.col("a") / F.col("c") < LEAST_COVERAGE)
    share = share.select("video_id", F.lit("sparse_coverage").alias("kind"), F.concat(F.lit("only "), F.col("a").cast("string"), F.lit(" of "), F.col("c").cast("string"), F.lit(" paragraphs attributed")).alias("detail"), empty.alias("paragraphs"))
    return out.unionByName(spelled).unionByName(rival).unionByName(many).unionByName(share)


def better_answer(first: DataFrame, second: DataFrame) -> DataFrame:
    """(video_id, use_second) from violations of a first answer and of its retry (video_id, labels, broken): the retry counts only with labels and strictly fewer violations."""
    a, b = first.select("video_id", F.col("broken").alias("b1")), second.select("video_id", F.col("labels").alias("l2"), F.col("broken").alias("b2"))
    return a.join(b, "video_id", "left").select("video_id", F.coalesce((F.col("l2") > 0) & (F.col("b2") < F.col("b1")), F.lit(False)).alias("use_second"))


def summary(found: DataFrame) -> DataFrame:
    """(video_id, summary): kinds of violations with their counts, in the order of the alphabet."""
    c = found.groupBy("video_id", "kind").agg(F.count(F.lit(1)).alias("c"))
    one = F.when(F.col("c") > 1, F.concat(F.col("kind"), F.lit("×"), F.col("c").cast("string"))).otherwise(F.col("kind"))
    return c.groupBy("video_id").agg(F.array_join(F.sort_array(F.collect_list(one)), ", ").alias("summary"))


def confirmed(labels: DataFrame) -> DataFrame:
    """(key, name) of grounded speakers, for the corpus to remember."""
    d = labels.where("grounded and speaker is not null").select(fold(F.col("speaker")).alias("key"), F.col("speaker").alias("name"))
    return d.groupBy("key").agg(F.min("name").alias("name"))


def learned(labels: DataFrame, corpus: DataFrame) -> DataFrame:
    """(video_id, learned): how many names each recording adds to what a corpus (key, name) knows, recordings taken in the order of their id; only grounded speakers count, each for the first recording that has it."""
    d = labels.where("grounded and speaker is not null").select("video_id", fold(F.col("speaker")).alias("key"))
    first = d.join(corpus.select("key").distinct(), "key", "left_anti").groupBy("key").agg(F.min("video_id").alias("video_id"))
    return first.groupBy("video_id").agg(F.count(F.lit(1)).alias("learned"))


def batches(paragraphs: DataFrame, size: int = 40) -> DataFrame:
    """Adds batch to numbered paragraphs: from 0, numbers stay absolute."""
    return paragraphs.withColumn("batch", F.floor((F.col("n") - 1) / size).cast("int"))


def labels_of(replies: DataFrame, paragraphs: DataFrame, size: int = 40) -> DataFrame:
    """(video_id, n, speaker, confidence) for every paragraph, from replies (video_id, batch, labels array<struct<n,speaker,confidence>>): a label counts only within its batch, the last of several for one paragraph wins."""
    r = replies.select("video_id", "batch", F.posexplode("labels").alias("pos", "l")).select("video_id", "batch", "pos", "l.n", "l.speaker", F.coalesce("l.confidence", F.lit("low")).alias("confidence"))
    last = r.where((F.col("n") > F.col("batch") * size) & (F.col("n") <= (F.col("batch") + 1) * size)).groupBy("video_id", "n").agg(F.max(F.struct("pos", "speaker", "confidence")).alias("x"))
    return paragraphs.select("video_id", "n").join(last, ["video_id", "n"], "left").select("video_id", "n", F.col("x.speaker").alias("speaker"), F.col("x.confidence").alias("confidence"))
