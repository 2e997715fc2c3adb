"""Queries over names: folding, resolution, constraints, the graph of people, notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuewright.functions import names as N
from cuewright.functions import text as T
from cuewright.operators import graph, render, resolve
from cuewright.session import cut, ship, table
from cuewright.sources import documents


def _people(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "people")


def _claims(spark, d):
    return _people(spark, d).select("video_id", F.col("name").alias("claimed")).where("claimed is not null").distinct()


def _known(spark, d):
    return table(spark, d, "known").select("video_id", "key", "name").distinct()


def fold_key(spark, d):
    return _people(spark, d).where("name is not null").select("person_id", T.fold(F.col("name")).alias("key"), N.is_full_name(F.col("name")).alias("full"))


def tidy_names(spark, d):
    return _people(spark, d).where("name is not null").select("person_id", N.tidy_name(F.col("name")).alias("name"))


def names_in(spark, d):
    """Names in the descriptions of each recording."""
    r = table(spark, d, "recordings").select("video_id", "description").distinct()
    return r.select("video_id", F.explode(N.names_in(F.col("description"))).alias("x")).select("video_id", "x.key", "x.name").distinct()


def title_credits(spark, d):
    return table(spark, d, "recordings").select("video_id", N.title_credits(F.col("title")).alias("credits")).distinct()


def known_longest(spark, d):
    """One name a person's key over the corpus: the longest spelling, the first on a tie."""
    p = _people(spark, d).where("name is not null").withColumn("key", T.fold(F.col("name"))).where("key <> ''")
    return resolve.longest(p, ["key"], "name", "person_id")


def known_override(spark, d):
    k = table(spark, d, "known")
    own, corpus = k.where("origin = 'own'").select("key", "name").distinct(), k.where("origin = 'corpus'").select("key", "name").distinct()
    return resolve.override(corpus, own.groupBy("key").agg(F.min("name").alias("name")), ["key"])


def known_people(spark, d):
    return resolve.known_people(table(spark, d, "recordings")).select("video_id", "key", "name")


def canonical(spark, d):
    ship(spark)
    return resolve.canonicalise(_claims(spark, d), _known(spark, d))


def canonical_exact(spark, d):
    return canonical(spark, d).where("stage = 1").select("video_id", "claimed", "name")


def _stage4(spark, d):
    return canonical(spark, d).where("stage = 4")


def canonical_surname(spark, d):
    """Single words that are the family name of one known person, exactly."""
    s = _stage4(spark, d)
    return s.where(T.fold(F.col("claimed")) == N.surname(T.fold(F.col("name")))).select("video_id", "claimed", "name")


def _labels(spark, d):
    p = table(spark, d, "paragraphs").where("video_id is not null").groupBy("video_id", "n").agg(F.min(F.struct("speaker", F.col("speaker_confidence").alias("confidence"))).alias("x"))
    return p.select("video_id", "n", "x.*")


def _corrected(spark, d):
    ship(spark)
    labels = _labels(spark, d)
    claims = labels.select("video_id", F.nullif("speaker", F.lit("")).alias("claimed")).where("claimed is not null").distinct()
    return cut(resolve.corrected(labels, resolve.canonicalise(claims, _known(spark, d))))  # every constraint reads it


def violations(spark, d):
    return resolve.violations(_corrected(spark, d), table(spark, d, "recordings")).select("video_id", "kind", "detail", F.array_join(F.transform("paragraphs", lambda x: x.cast("string")), ",").alias("paragraphs"))


def violation_summary(spark, d):
    return resolve.summary(resolve.violations(_corrected(spark, d), table(spark, d, "recordings")))


def sparse_coverage(spark, d):
    v = resolve.violations(_corrected(spark, d), table(spark, d, "recordings"))
    return v.where("kind = 'sparse_coverage'").select("video_id", "detail")


def many_speakers(spark, d):
    v = resolve.violations(_corrected(spark, d), table(spark, d, "recordings"))
    return v.where("kind = 'many_speakers'").select("video_id", "detail")


def confirmed(spark, d):
    return resolve.confirmed(_corrected(spark, d))


def label_batches(spark, d):
    p = table(spark, d, "paragraphs").select("video_id", "n").distinct()
    return resolve.batches(p).groupBy("video_id", "batch").agg(F.count(F.lit(1)).alias("paragraphs"), F.min("n").alias("first_n"))


def reply_labels(spark, d):
    """Labels through a model's replies: fenced JSON a batch, with numbers outside it, back to one row a paragraph."""
    labels = resolve.batches(_labels(spark, d).where("n is not null"))
    one = F.struct(F.col("n"), "speaker", F.coalesce("confidence", F.lit("low")).alias("confidence"))
    off = F.array(F.struct(F.lit(0).alias("n"), F.lit("Nobody").alias("speaker"), F.lit("high").alias("confidence")), F.struct(F.lit(99999).alias("n"), F.lit("Nobody").alias("speaker"), F.lit("high").alias("confidence")))
    r = labels.where("speaker is not null").groupBy("video_id", "batch").agg(F.sort_array(F.collect_list(one)).alias("l"))
    r = r.withColumn("reply", F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.concat("l", off).alias("labels"))), F.lit("\n```\nDone {")))
    parsed = r.select("video_id", "batch", T.json_reply(F.col("reply"), "labels array<struct<n:int,speaker:string,confidence:string>>")["labels"].alias("labels"))
    return resolve.labels_of(parsed, labels).select("video_id", "n", "speaker", "confidence")


def _texts(spark, d):
    p = table(spark, d, "paragraphs").where("video_id is not null").groupBy("video_id", "n").agg(F.min("text").alias("text"))
    return p.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))


def quote_is_real(spark, d):
    e = table(spark, d, "edges").select("edge_id", "video_id", "evidence")
    return e.join(_texts(spark, d), "video_id", "left").select("edge_id", F.coalesce(graph.quote_is_real(F.col("evidence"), F.col("text")), F.lit(False)).alias("is_real"))


def quote_supports_exact(spark, d):
    e = table(spark, d, "edges")
    return e.select("edge_id", graph.quote_names(F.col("evidence"), F.col("from_name"), F.col("to_name")).alias("names_an_end"))


def _judged(spark, d):
    ship(spark)
    e = table(spark, d, "edges")
    claims = e.select("video_id", F.explode(F.array("from_name", "to_name")).alias("c")).where("c is not null").select("video_id", N.tidy_name(F.col("c")).alias("claimed")).distinct()
    return graph.judge_edges(e, _texts(spark, d), table(spark, d, "recordings"), cut(resolve.canonicalise(claims, _known(spark, d))))


def edge_verdicts(spark, d):
    return _judged(spark, d).select("edge_id", "source", "target", "verdict")


def edge_urls(spark, d):
    """The url of each edge: the first paragraph with its timestamp, else the recording."""
    r = table(spark, d, "recordings").groupBy("video_id").agg(F.min("url").alias("url"))
    p = table(spark, d, "paragraphs").where("start_ms is not null").join(r, "video_id").select("video_id", "n", "timestamp", T.anchor_url(F.col("url"), F.col("start_ms")).alias("url"))
    return graph.with_urls(table(spark, d, "edges"), p, table(spark, d, "recordings")).select("edge_id", "url")


def graph_merge(spark, d):
    m = graph.merge_people(_people(spark, d).where("video_id is not null"))
    return m.select("key", "name", F.array_join("roles", "|").alias("roles"), "videos", F.array_join("appears_in", ",").alias("appears_in"), "local")


def graph_tiers(spark, d):
    m = graph.merge_people(_people(spark, d).where("video_id is not null"))
    return m.groupBy(graph.tier(F.col("local"), F.col("videos")).alias("tier")).agg(F.count(F.lit(1)).alias("people"))


def people_by_reach(spark, d):
    """The 40 people in most recordings, then by name: a top-k report."""
    m = graph.merge_people(_people(spark, d).where("video_id is not null"))
    return m.orderBy(F.desc("videos"), "name", "key").limit(40).select("key", "name", "videos")


def edges_stated_implied(spark, d):
    e = table(spark, d, "edges")
    return e.groupBy("kind").agg(F.count_if(~F.col("confidence").eqNullSafe("low")).alias("stated"), F.count_if(F.col("confidence") == "low").alias("implied"))


def person_edges(spark, d):
    """Edges of each end by key, either way."""
    e = graph.ends_of(table(spark, d, "edges"))
    return e.groupBy("end").agg(F.count(F.lit(1)).alias("edges"), F.count_if("outgoing").alias("outgoing"))


def _files(spark, d):
    """The transcripts of a folder: those of punctuated recordings, by the names they are written under."""
    r = table(spark, d, "recordings").where("punctuated")
    return documents.transcript_index(r.select(F.concat(T.slug(F.col("title"), F.col("video_id")), F.lit(".md")).alias("name")).distinct())


def notes(spark, d):
    r = table(spark, d, "recordings")
    e = table(spark, d, "edges").join(r.groupBy("video_id").agg(F.min("title").alias("video"), F.min("url").alias("url")), "video_id", "left")
    m = graph.merge_people(_people(spark, d).where("video_id is not null"))
    return render.person_notes(m, e, r, files=_files(spark, d))


def note_statistics(spark, d):
    m = graph.merge_people(_people(spark, d).where("video_id is not null"))
    return render.note_statistics(m, table(spark, d, "edges"))


def note_names(spark, d):
    return _people(spark, d).where("name is not null").select("person_id", render.note_name(F.col("name")).alias("file"))


def co_appeared(spark, d):
    """Pairs of full names in one recording, by key, with the number of recordings; pairs within a recording are its edges."""
    p = graph.merge_people(_people(spark, d).where("video_id is not null")).where("not local and videos > 1").select("key", F.explode("appears_in").alias("video_id"))
    a, b = p.select("video_id", F.col("key").alias("a")), p.select("video_id", F.col("key").alias("b"))
    return a.join(b, "video_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("recordings")).where("recordings > 1")


QUERIES = {f.__name__: f for f in (
    fold_key, tidy_names, names_in, title_credits, known_longest, known_override, known_people, canonical, canonical_exact, canonical_surname, violations, violation_summary, sparse_coverage, many_speakers, confirmed, label_batches,
    reply_labels, quote_is_real, quote_supports_exact, edge_verdicts, edge_urls, graph_merge, graph_tiers, people_by_reach, edges_stated_implied, person_edges, notes, note_statistics, note_names, co_appeared,
)}


def _fold(c: str) -> str:
    c = f"strip_accents(replace(replace(replace({c}, chr(160), ' '), chr(8239), ' '), chr(8201), ' '))"
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g'))"


def _tidy(c: str) -> str:
    return rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g'), '[’'']s\b', '', 'g'), '^[ ,.;:!?"''()\[\]]+|[ ,.;:!?"''()\[\]]+$', '', 'g'), '[\s\x{{A0}}]+', ' ', 'g'))"""


_STOP = "[" + ", ".join(f"'{w}'" for w in N.NOT_A_NAME) + "]"
_WORDS = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
_EXACT = f"c AS (SELECT DISTINCT video_id, name AS claimed, {_fold('name')} AS key FROM people WHERE name IS NOT NULL), k AS (SELECT DISTINCT video_id, key AS kk, name AS kn FROM known)"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


def _parts(c: str, out: str, rel: str, carry: str) -> str:
    """CTEs that give (carry, first, last) of the names c in rel, as `{out}`: 'Family, Given' put straight, titles and credentials left out, particles kept with the family."""
    return f"""{out}0 AS (SELECT {carry}, list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x <> '') AS pc FROM {rel}),
{out}1 AS (SELECT {carry}, list_filter(pc, lambda x, i: i = 1 OR len(list_filter(string_split_regex(x, '\\s+'), lambda w: NOT list_contains({_LIST(N.SUFFIXES)}, replace({_fold('w')}, ' ', '')))) > 0) AS pc FROM {out}0),
{out}2 AS (SELECT {carry}, list_filter(list_transform(string_split_regex(CASE WHEN len(pc) > 1 THEN pc[2] || ' ' || pc[1] ELSE coalesce(pc[1], '') END, '\\s+'), lambda w: {_fold('w')}), lambda w: w <> '') AS w FROM {out}1),
{out}3 AS (SELECT {carry}, w[1 + least(coalesce(list_position(list_transform(w, lambda x: list_contains({_LIST(N.TITLES)}, x)), false) - 1, len(w)), greatest(len(w) - 1, 0)):] AS w FROM {out}2),
{out}4 AS (SELECT {carry}, w[:len(w) - least(coalesce(list_position(list_transform(list_reverse(w), lambda x: list_contains({_LIST(N.SUFFIXES)}, x)), false) - 1, len(w)), greatest(len(w) - 1, 0))] AS w FROM {out}3),
{out} AS (SELECT {carry}, coalesce(w[1], '') AS f, CASE WHEN len(w) < 2 THEN '' ELSE array_to_string(w[len(w) - coalesce(list_position(list_transform(list_reverse(w[2:len(w) - 1]), lambda x: list_contains({_LIST(N.PARTICLES)}, x)), false) - 1, greatest(len(w) - 2, 0)):], ' ') END AS z FROM {out}4)"""


def _near(pairs: str, out: str) -> str:
    """CTEs that give the pairs (a, b) of words in `pairs` that are one slip apart, as `out`: twice the longest common subsequence is 0.85 of both lengths or more. A row of its table is the running maximum of what matches add."""
    return f"""{out}0 AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> b AND length(a) >= {N.SLIP_SAFE} AND length(b) >= {N.SLIP_SAFE} AND 200.0 * least(length(a), length(b)) / (length(a) + length(b)) >= {N.SLIP_RATIO}),
{out}1 AS (SELECT a, b, 0 AS i, list_transform(range(1, length(b) + 1), lambda k: 0) AS r FROM {out}0 UNION ALL
SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], CASE WHEN substr(b, k, 1) = substr(a, i + 1, 1) THEN coalesce(r[k - 1], 0) + 1 ELSE 0 END)))) FROM {out}1 WHERE i < length(a)),
{out} AS (SELECT a, b FROM {out}1 WHERE i = length(a) AND 200.0 * r[length(b)] / (length(a) + length(b)) >= {N.SLIP_RATIO})"""


_CASCADE = f"""k AS (SELECT DISTINCT video_id, key AS kk, name AS kn, string_split(key, ' ') AS kw FROM known),
c AS (SELECT DISTINCT video_id, claimed, {_fold('claimed')} AS key, string_split({_fold('claimed')}, ' ') AS cw FROM claims WHERE claimed IS NOT NULL),
s1 AS (SELECT c.video_id, claimed, min(kn) AS n1 FROM c JOIN k ON k.video_id = c.video_id AND kk = key GROUP BY ALL),
d2 AS (SELECT c.video_id, claimed, cw, kw, kn, kk FROM c JOIN k ON k.video_id = c.video_id AND len(kw) = len(cw) WHERE key <> ''),
d5 AS (SELECT c.video_id, claimed, key, kw[-1] AS last, kn, kk FROM c JOIN k USING (video_id) WHERE len(cw) = 1 AND key <> ''),
w AS (SELECT unnest(cw) AS a, unnest(kw) AS b FROM d2 UNION SELECT key, last FROM d5),
{_near('w', 'nr')},
g2 AS (SELECT DISTINCT d2.*, list_zip(cw, kw) AS z FROM d2),
u2 AS (SELECT video_id, claimed, kn, kk, unnest(z) AS p FROM g2),
h2 AS (SELECT video_id, claimed, kk, kn FROM u2 LEFT JOIN nr ON nr.a = p[1] AND nr.b = p[2] GROUP BY ALL HAVING bool_and(p[1] = p[2] OR nr.a IS NOT NULL)),
s2 AS (SELECT video_id, claimed, min(kn) AS n2 FROM h2 GROUP BY ALL HAVING count(*) = 1),
{_parts('claimed', 'pc', 'c', 'video_id, claimed')},
{_parts('kn', 'pk', 'k', 'video_id, kk, kn')},
s3 AS (SELECT pc.video_id, claimed, min(kn) AS n3 FROM pc JOIN pk ON pc.video_id = pk.video_id AND pc.f = pk.f AND pc.z = pk.z WHERE pc.f <> '' AND pc.z <> '' GROUP BY ALL HAVING count(DISTINCT kk) = 1),
s4 AS (SELECT video_id, claimed, min(kn) AS n4 FROM d5 WHERE key = last GROUP BY ALL HAVING count(*) = 1),
s5 AS (SELECT video_id, claimed, min(kn) AS n5 FROM d5 LEFT JOIN nr ON nr.a = key AND nr.b = last WHERE key = last OR nr.a IS NOT NULL GROUP BY ALL HAVING count(*) = 1),
res AS (SELECT c.video_id, claimed, coalesce(n1, n2, n3, n4, n5, claimed) AS name, coalesce(n1, n2, n3, n4, n5) IS NOT NULL AS grounded,
CASE WHEN n1 IS NOT NULL THEN 1 WHEN n2 IS NOT NULL THEN 2 WHEN n3 IS NOT NULL THEN 3 WHEN coalesce(n4, n5) IS NOT NULL THEN 4 END AS stage
FROM c LEFT JOIN s1 USING (video_id, claimed) LEFT JOIN s2 USING (video_id, claimed) LEFT JOIN s3 USING (video_id, claimed) LEFT JOIN s4 USING (video_id, claimed) LEFT JOIN s5 USING (video_id, claimed))"""
_MERGE = f"""p AS (SELECT *, CASE WHEN coalesce(is_local, false) THEN concat_ws('@', {_fold('name')}, video_id) ELSE {_fold('name')} END AS key FROM people WHERE name IS NOT NULL AND video_id IS NOT NULL),
q AS (SELECT * FROM p WHERE key <> ''), s AS (SELECT key, name, min(struct_pack(v := video_id, p := pos)) AS first FROM q GROUP BY key, name),
nm AS (SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(name) DESC, first) AS r FROM s) WHERE r = 1),
rl0 AS (SELECT key, role, min(struct_pack(v := video_id, p := pos)) AS first FROM q WHERE role <> '' GROUP BY key, role), rl AS (SELECT key, string_agg(role, '|' ORDER BY first, role) AS roles FROM rl0 GROUP BY key),
vd AS (SELECT key, count(DISTINCT video_id) AS videos, max(coalesce(is_local, false)) AS local FROM q GROUP BY key), ap AS (SELECT key, string_agg(video_id, ',' ORDER BY video_id) AS appears_in FROM (SELECT DISTINCT key, video_id FROM q) GROUP BY key),
m AS (SELECT key, name, coalesce(roles, '') AS roles, videos, appears_in, local FROM nm JOIN vd USING (key) JOIN ap USING (key) LEFT JOIN rl USING (key))"""
_TEXTS = "t0 AS (SELECT video_id, n, min(text) AS text FROM paragraphs GROUP BY video_id, n), t AS (SELECT video_id, string_agg(text, ' ' ORDER BY n) AS text FROM t0 GROUP BY video_id)"
_LABELS = "l AS (SELECT video_id, n, min(struct_pack(s := speaker, c := speaker_confidence)) AS x FROM paragraphs GROUP BY video_id, n)"
_ATTRIBUTED = f"""WITH RECURSIVE {_LABELS}, l1 AS (SELECT video_id, n, nullif(x.s, '') AS claimed, x.c AS confidence FROM l WHERE video_id IS NOT NULL), claims AS (SELECT DISTINCT video_id, claimed FROM l1), {_CASCADE},
lab AS (SELECT l1.video_id, n, l1.claimed, coalesce(name, l1.claimed) AS speaker, coalesce(grounded, false) AS grounded FROM l1 LEFT JOIN res ON res.video_id = l1.video_id AND res.claimed = l1.claimed),
who0 AS (SELECT video_id, {_fold('speaker')} AS key, min(struct_pack(n := n, s := speaker)) AS x FROM lab WHERE speaker IS NOT NULL GROUP BY ALL), who AS (SELECT video_id, x.s AS name FROM who0),
ch AS (SELECT DISTINCT video_id, trim(channel) AS channel FROM recordings WHERE channel IS NOT NULL AND channel <> ''),
rv AS (SELECT video_id, name, channel, {_fold('name')} AS a, {_fold('channel')} AS b FROM who JOIN ch USING (video_id)),
sp AS (SELECT video_id, speaker, list_sort(list(DISTINCT claimed)) AS s FROM lab WHERE claimed IS NOT NULL GROUP BY ALL),
viol AS (SELECT video_id, 'ungrounded_speaker' AS kind, chr(39) || speaker || chr(39) || ' is not named in the title, description or channel' AS detail, string_agg(n::VARCHAR, ',' ORDER BY n) AS paragraphs FROM lab WHERE claimed IS NOT NULL AND NOT grounded GROUP BY video_id, speaker
UNION ALL SELECT video_id, 'spelling_variants', array_to_string(s, ', ') || ' treated as one person: ' || speaker, '' FROM sp WHERE len(s) > 1 OR s[1] <> speaker
UNION ALL SELECT video_id, 'host_guest_conflict', name || ' and the channel ' || channel || ' look like one person', '' FROM rv WHERE a <> b AND a <> '' AND string_split(a, ' ')[-1] = string_split(b, ' ')[-1]
UNION ALL SELECT video_id, 'many_speakers', count(*) || ' speakers', '' FROM who GROUP BY video_id HAVING count(*) > {resolve.EXPECTED_SPEAKERS}
UNION ALL SELECT video_id, 'sparse_coverage', 'only ' || count(speaker) || ' of ' || count(*) || ' paragraphs attributed', '' FROM lab GROUP BY video_id HAVING count(speaker) / count(*) < {resolve.LEAST_COVERAGE})"""
_JUDGED = f"""WITH RECURSIVE ends AS (SELECT video_id, from_name AS x FROM edges UNION SELECT video_id, to_name FROM edges), claims AS (SELECT DISTINCT video_id, {_tidy('x')} AS claimed FROM ends WHERE x IS NOT NULL), {_CASCADE}, {_TEXTS},
ed AS (SELECT edges.*, t.text AS said, ch.channel, {_tidy('from_name')} AS f, {_tidy('to_name')} AS t, {_WORDS('evidence')} AS ew FROM edges LEFT JOIN t USING (video_id) LEFT JOIN (SELECT video_id, min(trim(channel)) AS channel FROM recordings GROUP BY video_id) ch USING (video_id)),
pw AS (SELECT edge_id, unnest(list_concat({_WORDS('f')}, {_WORDS('t')})) AS a, ew FROM ed), pe AS (SELECT edge_id, a, unnest(ew) AS b FROM pw WHERE length(a) > 3),
{_near('pe', 'ne')},
sup AS (SELECT DISTINCT edge_id FROM pe LEFT JOIN ne USING (a, b) WHERE a = b OR ne.a IS NOT NULL),
ver AS (SELECT ed.edge_id, ed.video_id, coalesce(rf.name, f) AS source, coalesce(rt.name, t) AS target, kind, said, channel, ew, from_name, to_name, sup.edge_id IS NOT NULL OR coalesce(list_has_any(ew, list_filter({_WORDS('f')}, lambda w: length(w) > 2)), false) OR coalesce(list_has_any(ew, list_filter({_WORDS('t')}, lambda w: length(w) > 2)), false) AS ok
FROM ed LEFT JOIN res rf ON rf.video_id = ed.video_id AND rf.claimed = f LEFT JOIN res rt ON rt.video_id = ed.video_id AND rt.claimed = t LEFT JOIN sup USING (edge_id)),
verdicts AS (SELECT edge_id, video_id, source, target, CASE WHEN NOT coalesce(list_contains({_LIST(graph.KINDS)}, kind), false) OR coalesce(from_name, '') = '' OR coalesce(to_name, '') = '' THEN 'malformed'
WHEN NOT coalesce(len(ew) >= {graph.LEAST_WORDS} AND contains(' ' || array_to_string({_WORDS('said')}, ' ') || ' ', ' ' || array_to_string(ew, ' ') || ' ') AND said IS NOT NULL, false) THEN 'rejected' WHEN NOT ok THEN 'irrelevant'
WHEN {_fold('source')} = {_fold('target')} THEN 'self' WHEN coalesce(channel, '') <> '' AND ({_fold('source')} = {_fold('channel')} OR {_fold('target')} = {_fold('channel')}) THEN 'channel' ELSE 'kept' END AS verdict FROM ver)"""


def _names_in(c: str, alias: str) -> str:
    """A list of {key, name} of the runs of capitalised words in c, each fold once."""
    runs = rf"regexp_extract_all(coalesce({c}, ''), '(?:^|[^\pL\pN_])([A-Z][\pL\pN\pM_''’-]*(?:[ \t]+[A-Z][\pL\pN\pM_''’-]*){{1,3}})', 1)"
    kept = f"list_filter({runs}, lambda r: length({_fold('r')}) >= 5 AND NOT list_has_any(list_transform(string_split_regex(r, '[ \\t]+'), lambda w: {_fold('w')}), {_STOP}))"
    return f"list_transform({kept}, lambda r: struct_pack(key := {_fold('r')}, name := trim(r, '.,;:')))"


def _once(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position(list_transform({c}, lambda y: y.key), x.key) = i)"


_QUOTE = lambda c, n: rf"CASE WHEN length({c}) <= {n} THEN {c} ELSE regexp_replace(left({c}, {n}), ' [^ ]*\z', '') || '…' END"
_SQUEEZE = lambda c: rf"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x{{85}}]+', ' ', 'g'))"
_NOTE = lambda c: rf"""coalesce(nullif(trim(regexp_replace({c}, '[\\/:*?"<>|#^\[\]]', '-', 'g'), '. -'), ''), 'unnamed')"""
_LINK = lambda t, c: f"'[[' || {t} || CASE WHEN {c} <> '' AND {c} <> {t} THEN '|' || {c} ELSE '' END || ']]'"
_PHRASES = "CASE " + " ".join(f"WHEN kind = '{k}' THEN CASE WHEN o THEN '{a}' ELSE '{b}' END" for k, (a, b) in graph.KINDS.items()) + " ELSE 'is connected to' END"
_NOTES = f"""r AS (SELECT video_id, min(title) AS title, min(url) AS url FROM recordings GROUP BY video_id),
fl0 AS (SELECT trim(left(trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-') AS s, coalesce(video_id, '') AS id FROM recordings WHERE punctuated),
fl1 AS (SELECT CASE WHEN s = '' THEN coalesce(nullif(id, ''), 'transcript') ELSE s || '-' || id END AS stem FROM fl0),
fl AS (SELECT regexp_extract(stem, '-([\\w-]{{11}})$', 1) AS video_id, max(stem) AS stem FROM fl1 GROUP BY 1 HAVING video_id <> ''),
e0 AS (SELECT edges.*, r.title AS video, r.url, {_fold('from_name')} AS a, {_fold('to_name')} AS b FROM edges LEFT JOIN r USING (video_id)),
e1 AS (SELECT *, a AS "end", true AS o, to_name AS other FROM e0 UNION ALL SELECT *, b, false, from_name FROM e0 WHERE a <> b),
e2 AS (SELECT e1.*, m.key IS NOT NULL AS known, {_SQUEEZE('e1.evidence')} AS q, {_SQUEEZE('video')} AS v, nullif(regexp_extract(coalesce(url, ''), '[?&]v=([\\w-]{{11}})', 1), '') AS vid FROM e1 LEFT JOIN m ON m.key = {_fold('other')} AND NOT m.local),
e3 AS (SELECT *, coalesce(vid, {_QUOTE('v', 40)}) AS scope, {_QUOTE('q', 240)} AS quote FROM e2),
e4 AS (SELECT *, {_NOTE('other')} AS plain, {_NOTE("(CASE WHEN scope <> '' THEN other || ' (' || scope || ')' ELSE other END)")} AS scoped FROM e3),
e5 AS (SELECT "end", confidence IS DISTINCT FROM 'low' AS stated, video_id, pos, edge_id, '- ' || {_PHRASES} || ' ' || CASE WHEN known THEN '[[' || plain || ']]' ELSE {_LINK('scoped', 'other')} END || CASE WHEN quote <> '' THEN chr(10) || '  > ' || quote ELSE '' END ||
CASE WHEN coalesce(url, '') <> '' AND coalesce(timestamp, '') <> '' THEN chr(10) || '  — [' || timestamp || '](' || url || ') in ' || coalesce(video, '') WHEN coalesce(video, '') <> '' THEN chr(10) || '  — ' || video ELSE '' END AS t FROM e4),
by_ AS (SELECT "end" AS key, string_agg(t, chr(10) || chr(10) ORDER BY video_id, pos, edge_id) FILTER (stated) AS said, string_agg(t, chr(10) || chr(10) ORDER BY video_id, pos, edge_id) FILTER (NOT stated) AS implied FROM e5 GROUP BY 1),
sp0 AS (SELECT key, unnest(string_split(appears_in, ',')) AS video_id FROM m WHERE NOT local), sp1 AS (SELECT key, video_id, stem, coalesce(nullif(title, ''), video_id, 'unknown') AS c FROM sp0 LEFT JOIN r USING (video_id) LEFT JOIN fl USING (video_id)),
sp AS (SELECT key, string_agg('- ' || CASE WHEN stem IS NOT NULL THEN {_LINK('stem', 'c')} ELSE c END, chr(10) ORDER BY video_id) AS seen FROM sp1 GROUP BY key),
nt AS (SELECT m.key, {_NOTE('m.name')} AS file, concat_ws(chr(10) || chr(10), '---' || chr(10) || 'tags:' || chr(10) || '  - person' || chr(10) || '  - ' || CASE WHEN videos >= 2 THEN 'person/recurring' ELSE 'person/named' END || chr(10) || 'appearances: ' || videos || chr(10) || '---' || chr(10) || chr(10) || '# ' || m.name,
CASE WHEN roles <> '' THEN '- ' || replace(roles, '|', chr(10) || '- ') END, CASE WHEN said IS NOT NULL THEN '## Connections' || chr(10) || chr(10) || said END,
CASE WHEN implied IS NOT NULL THEN '## Possible connections' || chr(10) || chr(10) || '*The transcript implies these rather than saying them.*' || chr(10) || chr(10) || implied END, CASE WHEN seen IS NOT NULL THEN '## Appears in' || chr(10) || chr(10) || seen END) || chr(10) AS body
FROM m LEFT JOIN by_ USING (key) LEFT JOIN sp USING (key) WHERE NOT local)"""

SQL = {
    "notes": f"WITH {_MERGE}, {_NOTES} SELECT key, CASE WHEN count(*) OVER (PARTITION BY file) > 1 THEN file || ' ' || left(sha1(key), 6) ELSE file END AS file, body FROM nt",
    "known_people": rf"""WITH r AS (SELECT video_id, trim(coalesce(channel, '')) AS ch, trim(regexp_extract(coalesce(title, ''), '(?i)(?:\bft\.?|\bfeat\.?|\bwith\b|\bw/|[—–|]|\s-\s)\s*(.+)$', 1), ' )') AS cr, description FROM recordings WHERE video_id IS NOT NULL),
x AS (SELECT video_id, ch, {_names_in('cr', 't')} AS t, {_names_in('description', 'd')} AS d FROM r),
y AS (SELECT video_id, list_concat(CASE WHEN ch <> '' THEN [struct_pack(key := {_fold('ch')}, name := ch)] ELSE [] END, {_once('t')}, {_once('d')}) AS f FROM x),
z AS (SELECT video_id, unnest(f) AS p, unnest(range(len(f))) AS pos FROM y)
SELECT video_id, p.key AS key, max(struct_pack(l := length(p.name), p := -pos, n := p.name)).n AS name FROM z WHERE p.key <> '' GROUP BY video_id, p.key""",
    "canonical": f"WITH RECURSIVE claims AS (SELECT DISTINCT video_id, name AS claimed FROM people WHERE name IS NOT NULL), {_CASCADE} SELECT video_id, claimed, name, grounded, stage FROM res",
    "violations": _ATTRIBUTED + " SELECT video_id, kind, detail, paragraphs FROM viol",
    "violation_summary": _ATTRIBUTED + ", vc AS (SELECT video_id, kind, count(*) AS c FROM viol GROUP BY ALL) SELECT video_id, string_agg(CASE WHEN c > 1 THEN kind || '×' || c ELSE kind END, ', ' ORDER BY kind) AS summary FROM vc GROUP BY video_id",
    "many_speakers": _ATTRIBUTED + " SELECT video_id, detail FROM viol WHERE kind = 'many_speakers'",
    "confirmed": _ATTRIBUTED + f" SELECT {_fold('speaker')} AS key, min(speaker) AS name FROM lab WHERE grounded AND speaker IS NOT NULL GROUP BY 1",
    "edge_verdicts": _JUDGED + " SELECT edge_id, source, target, verdict FROM verdicts",
    "fold_key": f"SELECT person_id, {_fold('name')} AS key, len(list_filter(string_split({_fold(_tidy('name'))}, ' '), lambda x: x <> '')) >= 2 AS \"full\" FROM people WHERE name IS NOT NULL",
    "tidy_names": f"SELECT person_id, {_tidy('name')} AS name FROM people WHERE name IS NOT NULL",
    "names_in": rf"""WITH r AS (SELECT DISTINCT video_id, description FROM recordings),
x AS (SELECT video_id, unnest(regexp_extract_all(description, '(?:^|[^\pL\pN_])([A-Z][\pL\pN\pM_''’-]*(?:[ \t]+[A-Z][\pL\pN\pM_''’-]*){{1,3}})', 1)) AS run FROM r)
SELECT DISTINCT video_id, {_fold('run')} AS key, trim(run, '.,;:') AS name FROM x
WHERE length({_fold('run')}) >= 5 AND NOT list_has_any(list_transform(string_split_regex(run, '[ \t]+'), lambda w: {_fold('w')}), {_STOP})
QUALIFY row_number() OVER (PARTITION BY video_id, {_fold('run')} ORDER BY 1) = 1""",
    "title_credits": r"""SELECT DISTINCT video_id, trim(regexp_extract(coalesce(title, ''), '(?i)(?:\bft\.?|\bfeat\.?|\bwith\b|\bw/|[—–|]|\s-\s)\s*(.+)$', 1), ' )') AS credits FROM recordings""",
    "known_longest": f"WITH p AS (SELECT person_id, name, {_fold('name')} AS key FROM people WHERE name IS NOT NULL) SELECT key, name FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY length(name) DESC, person_id) AS r FROM p WHERE key <> '') WHERE r = 1",
    "known_override": """WITH own AS (SELECT key, min(name) AS name FROM known WHERE origin = 'own' GROUP BY key)
SELECT key, name FROM own UNION ALL SELECT DISTINCT key, name FROM known k WHERE origin = 'corpus' AND NOT EXISTS (SELECT 1 FROM own WHERE own.key = k.key)""",
    "canonical_exact": f"WITH {_EXACT} SELECT c.video_id, claimed, kn AS name FROM c JOIN k ON k.video_id = c.video_id AND key = kk",
    "canonical_surname": f"""WITH {_EXACT}, o AS (SELECT * FROM c WHERE key <> '' AND key NOT LIKE '% %' AND NOT EXISTS (SELECT 1 FROM k WHERE k.video_id = c.video_id AND kk = key))
SELECT o.video_id, claimed, min(kn) AS name FROM o JOIN k ON k.video_id = o.video_id AND string_split(kk, ' ')[-1] = key GROUP BY o.video_id, claimed HAVING count(*) = 1""",
    "sparse_coverage": f"""WITH {_LABELS} SELECT video_id, 'only ' || count(nullif(x.s, '')) || ' of ' || count(*) || ' paragraphs attributed' AS detail FROM l GROUP BY video_id HAVING count(nullif(x.s, '')) / count(*) < 0.5""",
    "label_batches": "SELECT video_id, ((n - 1) // 40)::INTEGER AS batch, count(DISTINCT n) AS paragraphs, min(n) AS first_n FROM paragraphs GROUP BY ALL",
    "reply_labels": f"WITH {_LABELS} SELECT video_id, n, x.s AS speaker, CASE WHEN x.s IS NOT NULL THEN coalesce(x.c, 'low') END AS confidence FROM l WHERE n IS NOT NULL",
    "quote_is_real": f"""WITH {_TEXTS} SELECT edge_id, coalesce(len({_WORDS('evidence')}) >= 4 AND contains(' ' || array_to_string({_WORDS('text')}, ' ') || ' ', ' ' || array_to_string({_WORDS('evidence')}, ' ') || ' ') AND text IS NOT NULL, false) AS is_real
FROM edges LEFT JOIN t USING (video_id)""",
    "quote_supports_exact": f"""SELECT edge_id, coalesce(list_has_any({_WORDS('evidence')}, list_filter({_WORDS(_tidy('from_name'))}, lambda w: length(w) > 2)), false) OR coalesce(list_has_any({_WORDS('evidence')}, list_filter({_WORDS(_tidy('to_name'))}, lambda w: length(w) > 2)), false) AS names_an_end FROM edges""",
    "edge_urls": """WITH r AS (SELECT video_id, min(url) AS url FROM recordings GROUP BY video_id),
p AS (SELECT DISTINCT video_id, n, timestamp, string_split(url, '#')[1] || '#t=' || start_ms // 1000 AS url FROM paragraphs JOIN r USING (video_id) WHERE start_ms IS NOT NULL AND timestamp IS NOT NULL),
f AS (SELECT video_id, timestamp, arg_min(url, n) AS u FROM p GROUP BY video_id, timestamp)
SELECT edge_id, coalesce(u, r.url, '') AS url FROM edges LEFT JOIN f USING (video_id, timestamp) LEFT JOIN r USING (video_id)""",
    "graph_merge": f"WITH {_MERGE} SELECT key, name, roles, videos, appears_in, local FROM m",
    "graph_tiers": f"WITH {_MERGE} SELECT CASE WHEN local THEN 'person/local' WHEN videos >= 2 THEN 'person/recurring' ELSE 'person/named' END AS tier, count(*) AS people FROM m GROUP BY 1",
    "people_by_reach": f"WITH {_MERGE} SELECT key, name, videos FROM m ORDER BY videos DESC, name, key LIMIT 40",
    "edges_stated_implied": "SELECT kind, count(*) FILTER (confidence IS DISTINCT FROM 'low') AS stated, count(*) FILTER (confidence = 'low') AS implied FROM edges GROUP BY kind",
    "person_edges": f"""WITH e AS (SELECT {_fold('from_name')} AS a, {_fold('to_name')} AS b FROM edges), u AS (SELECT a AS x, true AS o FROM e UNION ALL SELECT b, false FROM e WHERE a <> b)
SELECT x AS "end", count(*) AS edges, count(*) FILTER (o) AS outgoing FROM u GROUP BY x""",
    "note_statistics": f"""WITH {_MERGE}, a AS (SELECT count(*) FILTER (NOT local) AS people, count(*) FILTER (NOT local AND videos >= 2) AS recurring, count(*) FILTER (local) AS local FROM m),
b AS (SELECT count(*) AS edges, count(*) FILTER (confidence IS DISTINCT FROM 'low') AS stated, count(*) FILTER (confidence = 'low') AS implied FROM edges) SELECT * FROM a, b""",
    "note_names": r"""SELECT person_id, coalesce(nullif(trim(regexp_replace(name, '[\\/:*?"<>|#^\[\]]', '-', 'g'), '. -'), ''), 'unnamed') AS file FROM people WHERE name IS NOT NULL""",
    "co_appeared": f"""WITH {_MERGE}, x AS (SELECT DISTINCT q.key, q.video_id FROM q JOIN m USING (key) WHERE NOT local AND videos > 1)
SELECT a.key AS a, b.key AS b, count(*) AS recordings FROM x a JOIN x b USING (video_id) WHERE a.key < b.key GROUP BY 1, 2 HAVING count(*) > 1""",
}
