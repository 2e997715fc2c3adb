"""The queries of the training-data problems over the test tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.session import cut, ship, table


def _p10(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.canonical import look_alikes

    ship(spark)
    return look_alikes(table(spark, d, "documents"), "doc_id", "text")


def _p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document and the class of texts that look like its own."""
    from cuewright.llm.canonical import look_classes

    ship(spark)
    return look_classes(table(spark, d, "documents"), "doc_id", "text")


def _p8(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.leakage import leaks

    ship(spark)
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def _p6(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.boilerplate import repeated_lines

    ship(spark)
    found = repeated_lines(table(spark, d, "paragraphs"), table(spark, d, "recordings")).where("not joined")  # short lines of a block do not count here
    return found.select("video_id", "n", F.col("line_no").cast("int").alias("line_no"))


def _p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every paragraph without the blocks of its channel."""
    from cuewright.llm.boilerplate import without_repeated_lines

    ship(spark)
    return without_repeated_lines(table(spark, d, "paragraphs"), table(spark, d, "recordings"))


def _p1(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.turns import speaker_turns

    ship(spark)
    out = speaker_turns(table(spark, d, "paragraphs"), table(spark, d, "known"))
    return out.select("video_id", F.col("first_n").cast("int").alias("first_n"), F.col("last_n").cast("int").alias("last_n"), F.col("ord").cast("int").alias("ord"), "speaker")


def _p1_text(spark: SparkSession, d: str) -> DataFrame:
    """The cleaned speech of every turn, line by line."""
    from cuewright.llm.turns import turn_text

    ship(spark)
    return turn_text(table(spark, d, "paragraphs"), table(spark, d, "known"))


def _p3(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.sentences import sentences

    ship(spark)
    return sentences(table(spark, d, "paragraphs"), ["video_id", "n"], "text")


def _p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the oversized paragraphs and segments."""
    from cuewright.llm.sentences import model
    from cuewright.llm.splitting import split

    ship(spark)
    paragraphs, segments = table(spark, d, "paragraphs"), table(spark, d, "segments")
    w = model(paragraphs, "text")
    a = split(paragraphs.select(F.lit("paragraph").alias("item_kind"), "video_id", F.col("n").cast("int").alias("pos"), "text"), ["item_kind", "video_id", "pos"], "text", 900, 90, w)
    b = split(segments.select(F.lit("segment").alias("item_kind"), "video_id", F.col("seq").cast("int").alias("pos"), "text"), ["item_kind", "video_id", "pos"], "text", 200, 20, w)
    return a.unionByName(b)


def _p4(spark: SparkSession, d: str) -> DataFrame:
    best = F.when(F.col("boundary").isin("section", "line"), "sentence").otherwise(F.col("boundary"))  # a sentence ends at each of them
    return _p4_pieces(spark, d).where("piece = 1").select("item_kind", "video_id", "pos", best.alias("boundary"))


def _p7_members(spark: SparkSession, d: str) -> DataFrame:
    """Every linked spelling and its person."""
    from cuewright.llm.people import variants

    ship(spark)
    names = table(spark, d, "people").select("name", "video_id")
    for c in ("from_name", "to_name"):
        names = names.unionByName(table(spark, d, "edges").select(F.col(c).alias("name"), "video_id"))
    return variants(names, "name", "video_id")


def _p7(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.people import spelling_pairs

    return spelling_pairs(cut(_p7_members(spark, d)))


def _p9(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.mixture import mix

    ship(spark)
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def _p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.mixture import mix

    ship(spark)
    return mix(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def _p9_plan(spark: SparkSession, d: str) -> DataFrame:
    """What each source gives of a mixture measured in characters, a size SQL knows too."""
    from cuewright.llm.mixture import water_fill

    sizes = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.sum("n_chars").alias("size"))
    return water_fill(sizes.join(table(spark, d, "source_targets").select("source").distinct(), "source", "left_semi"), table(spark, d, "source_targets").select("source", "target_share", "max_repeat")).drop("rest")


LETTERED = ("en", "de", "es", "fr", "hi")


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """The cues of the recordings in languages that put blanks between words."""
    spoken = table(spark, d, "recordings").where(F.col("lang").isin(*LETTERED)).select("video_id").distinct()
    return table(spark, d, "segments").select("video_id", "seq", "text").join(spoken, "video_id", "left_semi")


def _p2(spark: SparkSession, d: str) -> DataFrame:
    from cuewright.llm.repetition import judged

    ship(spark)
    return judged(_spoken(spark, d), "video_id", "seq", "text").where("rejected").select("video_id")


def _p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """What the rules say of every cue."""
    from cuewright.llm.repetition import line_rules

    ship(spark)
    return line_rules(_spoken(spark, d), "video_id", "seq", "text")


def _p2_left(spark: SparkSession, d: str) -> DataFrame:
    """What line-first cleaning leaves of every recording."""
    from cuewright.llm.repetition import judged

    ship(spark)
    return judged(_spoken(spark, d), "video_id", "seq", "text")


QUERIES = {"p1_found": _p1, "p1_text": _p1_text, "p2_found": _p2, "p2_lines": _p2_lines, "p2_left": _p2_left, "p3_found": _p3, "p4_found": _p4, "p4_pieces": _p4_pieces, "p6_found": _p6, "p6_clean": _p6_clean, "p7_found": _p7, "p7_members": _p7_members, "p8_found": _p8, "p9_mix": _p9, "p9_shares": _p9_shares, "p9_plan": _p9_plan, "p10_found": _p10, "p10_classes": _p10_classes}
_P2 = r"""
WITH r AS (SELECT DISTINCT video_id FROM recordings WHERE lang IN ('en', 'de', 'es', 'fr', 'hi')),
s AS (SELECT video_id, seq, min(text) AS text FROM segments JOIN r USING (video_id) WHERE seq IS NOT NULL GROUP BY video_id, seq),
a AS (SELECT video_id, seq, string_split_regex(coalesce(text, ''), '[\s\p{Z}]+') AS ws FROM s),
b AS (SELECT video_id, seq, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM a),
c AS (SELECT video_id, seq, i, lower(regexp_replace(w, '^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$', '', 'g')) AS w FROM b),
p AS (SELECT video_id, seq, i, w, row_number() OVER (PARTITION BY video_id ORDER BY seq, i) AS pos FROM c WHERE w <> ''),
g AS (SELECT video_id, pos, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o AS run
      FROM p WINDOW o AS (PARTITION BY video_id ORDER BY pos)),
f AS (SELECT video_id, pos, min(pos) OVER (PARTITION BY video_id, run) AS first FROM g WHERE run IS NOT NULL),
v AS (SELECT DISTINCT video_id, pos + k.k AS at FROM f, (SELECT unnest(range(6)) AS k) k WHERE pos > first)"""
_P2_LINES = (
    _P2
    + r""",
l AS (SELECT p.video_id, seq, count(*) AS words, count(v.at) AS repeated, string_agg(p.w, ' ' ORDER BY p.i) AS said FROM p LEFT JOIN v ON p.video_id = v.video_id AND p.pos = v.at GROUP BY p.video_id, seq),
n AS (SELECT *, count(*) OVER (PARTITION BY video_id, said) AS times FROM l),
m AS (SELECT s.video_id, s.seq, coalesce(words, 0) AS words, coalesce(repeated, 0) AS repeated, words IS NULL AS no_words,
      regexp_matches(lower(coalesce(text, '')), 'https?://|\b\S+@\S+\.\S+|@NAVIGATION@') AS navigation, coalesce(times > 2 OR (repeated > 0 AND repeated * 2 >= words), false) AS boilerplate,
      NOT regexp_matches(coalesce(text, ''), '[.!?…。！？।]+[\p{Pe}\p{Pf}"''”’»]*[\s\p{Z}]*\z') AS no_end
      FROM s LEFT JOIN n USING (video_id, seq)),
q AS (SELECT *, no_words OR navigation OR boilerplate AS removed FROM m)"""
)
_P6 = r"""
WITH src AS (SELECT DISTINCT video_id, channel FROM recordings WHERE channel IS NOT NULL AND video_id IS NOT NULL),
tot AS (SELECT channel, count(*) AS total FROM src GROUP BY channel),
p AS (SELECT video_id, n, min(text) AS text FROM paragraphs WHERE video_id IS NOT NULL AND text IS NOT NULL GROUP BY video_id, n),
l AS (SELECT video_id, n, list_filter(string_split_regex(text, '\r\n|[\n\r]'), lambda x: trim(x) <> '') AS ls FROM p),
x AS (SELECT video_id, n, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM l),
k AS (SELECT video_id, n, line_no, regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\p{L}]+', '', 'g') AS key FROM x),
j AS (SELECT k.*, src.channel, length(key) >= 20 AS counts FROM k JOIN src USING (video_id) WHERE key <> ''),
c AS (SELECT channel, key FROM j JOIN tot USING (channel) WHERE counts GROUP BY channel, key, total HAVING count(DISTINCT video_id) >= 3 AND count(DISTINCT video_id) >= total * 0.1)"""
SQL = {
    "p2_found": _P2
    + r""",
t AS (SELECT video_id, count(*) AS words FROM p GROUP BY video_id),
n AS (SELECT video_id, count(*) AS repeated FROM v GROUP BY video_id)
SELECT video_id FROM t JOIN n USING (video_id) WHERE repeated / words >= 0.3""",
    "p2_lines": _P2_LINES + " SELECT * FROM q",
    "p2_left": _P2_LINES
    + r""",
d AS (SELECT video_id, count(*) AS lines, count(*) FILTER (removed) AS removed, sum(words)::BIGINT AS words, coalesce(sum(words) FILTER (removed), 0)::BIGINT AS lost, sum(repeated)::BIGINT AS repeated FROM q GROUP BY video_id)
SELECT *, CASE WHEN words > 0 THEN repeated / words ELSE 0.0::DOUBLE END AS share, CASE WHEN words > 0 THEN repeated / words ELSE 0 END >= 0.3 AS rejected,
CASE WHEN words > 0 THEN lost / words ELSE 0 END >= 0.3 AS too_little_left FROM d""",
    "p9_plan": r"""
WITH z AS (SELECT source, sum(n_chars) AS size FROM documents WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT source, sum(target_share) AS target_share, min(max_repeat) AS max_repeat FROM source_targets WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT t.*, coalesce(size, 0)::BIGINT AS size, coalesce(size, 0) * max_repeat::DOUBLE AS most FROM t LEFT JOIN z USING (source)),
-- The level at which all that is wanted adds up: the least of the levels that a number of clamped sources leaves, each checked against all sources.
n AS (SELECT sum(size) AS total FROM p),
k AS (SELECT a.source, (SELECT (any_value(n.total) - sum(CASE WHEN b.most / b.target_share < a.most / a.target_share THEN b.most ELSE 0 END)) / sum(CASE WHEN b.most / b.target_share >= a.most / a.target_share THEN b.target_share ELSE 0 END) FROM p b, n) AS level FROM p a WHERE most > 0),
v AS (SELECT max(level) AS level FROM k JOIN p USING (source) WHERE p.most / p.target_share > k.level)
SELECT source, target_share, max_repeat, size, least(most, coalesce(v.level, 1e300) * target_share) AS wanted, least(floor(least(most, coalesce(v.level, 1e300) * target_share) / greatest(size, 1) + 1e-9), max_repeat)::INTEGER AS whole FROM p, v""",
    "p6_found": _P6 + " SELECT video_id, n, line_no::INTEGER AS line_no FROM j JOIN c USING (channel, key) WHERE counts",
    "p6_clean": _P6
    + r""",
e AS (SELECT a.channel, a.video_id, a.n, a.line_no, a.key, b.key AS other FROM j a JOIN j b ON a.video_id = b.video_id AND a.n = b.n AND b.line_no = a.line_no + 1 WHERE a.counts OR b.counts),
f AS (SELECT channel, key, other FROM e JOIN tot USING (channel) GROUP BY channel, key, other, total HAVING count(DISTINCT video_id) >= 3 AND count(DISTINCT video_id) >= total * 0.1),
z AS (SELECT DISTINCT e.channel, e.video_id, e.n, unnest([e.line_no, e.line_no + 1]) AS line_no FROM e JOIN f USING (channel, key, other)),
bad AS (SELECT video_id, n, line_no FROM j JOIN c USING (channel, key) WHERE counts UNION SELECT video_id, n, line_no FROM j JOIN z USING (channel, video_id, n, line_no) WHERE NOT counts),
w AS (SELECT video_id, n, list(line_no) AS bad FROM bad GROUP BY video_id, n),
base AS (SELECT video_id, n, min(text) AS text FROM paragraphs GROUP BY video_id, n)
SELECT base.video_id, base.n, CASE WHEN bad IS NULL THEN base.text ELSE array_to_string([x[1] FOR x IN list_zip(ls, range(1, len(ls) + 1)) IF NOT list_contains(bad, x[2])], chr(10)) END AS text,
coalesce(len(bad), 0)::INTEGER AS removed FROM base LEFT JOIN w ON base.video_id IS NOT DISTINCT FROM w.video_id AND base.n IS NOT DISTINCT FROM w.n LEFT JOIN l ON l.video_id = base.video_id AND l.n = base.n""",
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    from cuewright.llm.repetition import NAVIGATION

    return {name: sql.replace("@NAVIGATION@", "|".join(NAVIGATION)) for name, sql in SQL.items()}
