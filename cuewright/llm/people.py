"""Variant spellings of people's names (problem 7), and what a speaker's label means among known names."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.session import cut

# Short forms of given names and what they stand for, titles before a name, and what may follow one.
NICKNAMES = dict(
    x.split("=")
    for x in (
        "abby=abigail al=albert alec=alexander alex=alexander andy=andrew angie=angela annie=anne barb=barbara bea=beatriz becky=rebecca ben=benjamin bernie=bernard bert=albert beth=elizabeth betty=elizabeth bill=william "
        "billy=william bob=robert bobby=robert cathy=catherine charlie=charles chris=christopher chuck=charles cindy=cynthia dan=daniel danny=daniel dave=david deb=deborah debbie=deborah dick=richard dima=dmitri dolly=dorothy "
        "dot=dorothy drew=andrew ed=edward eddie=edward ella=eleanor ellie=eleanor fran=francesca fred=frederick freddie=frederick gabby=gabriella gabi=gabriella ginny=virginia greg=gregory hal=harold hank=henry harry=henry "
        "hetty=henrietta iggy=ignatius izzy=isabella jack=john jake=jacob jen=jennifer jenny=jennifer jerry=gerald jim=james jimmy=james jo=josephine joe=joseph jon=jonathan josie=josephine kate=katherine kathy=katherine "
        "katie=katherine ken=kenneth larry=lawrence len=leonard lenny=leonard lil=lillian lily=lillian liz=elizabeth lizzie=elizabeth maddie=madeleine maddy=madeleine maggie=margaret marge=margaret matt=matthew meg=margaret "
        "mick=michael mike=michael mina=wilhelmina mindy=melinda mitch=mitchell molly=mary nan=nancy nat=nathaniel ned=edward nell=eleanor nick=nicholas nicky=nicholas pam=pamela pat=patricia patty=patricia peggy=margaret "
        "penny=penelope pete=peter phil=philip pip=philip polly=mary randy=randolph ray=raymond rich=richard rick=richard rob=robert robbie=robert rod=roderick ron=ronald rosie=rosalind roz=rosalind sally=sarah sam=samuel "
        "sandy=alexander steph=stephanie steve=stephen stu=stuart sue=susanna suzy=susanna tabby=tabitha tasha=natasha ted=theodore teddy=theodore terry=terence theo=theodore tim=timothy timmy=timothy toby=tobias tom=thomas "
        "tommy=thomas tony=anthony trish=patricia val=valentina vic=victor vicky=victoria vin=vincent vince=vincent viv=vivian walt=walter wally=walter wendy=gwendolyn will=william willy=william zach=zachary zack=zachary"
    ).split()
)
TITLES = set("dr doctor prof professor mr mrs ms mx miss sir dame lord lady rev fr hon herr frau sr sra dra mme mlle".split())
SUFFIXES = set("phd md jr junior senior ii iii iv esq dphil msc mba dds cpa".split())
ROLES = re.compile(r"\((?:host|guest|co-host|cohost|moderator|interviewer|narrator)\)", re.I)
_SPECIAL = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ı": "i", "þ": "th"})
_EDGES = " \t\r\n   　.,;:!?\"'“”‘’«»()[]{}<>*|"


@lru_cache(1 << 16)
def fold_words(raw: str) -> tuple[str, ...]:
    """The words of a name, folded: no case, accents or marks; titles, suffixes and roles left out; 'Last, First' put straight."""
    s = ROLES.sub(" ", unicodedata.normalize("NFKC", raw)).strip(_EDGES)
    s = re.sub(r"['’]s$", "", s).strip(_EDGES)
    if re.search(r"[a-z]", s):
        s = re.sub(r"[,\s]+(?:II|III|IV)$", "", s)
    s = "".join(c for c in unicodedata.normalize("NFKD", s.translate(_SPECIAL)) if not unicodedata.combining(c))
    parts = [re.sub(r"['’‘`]", "", p) for p in s.split(",")]
    split = []
    for p in parts:
        p = p.strip()
        spaced = " " in p or "\t" in p
        words = re.split(r"[\s._]+" if spaced else r"[\s._-]+", p)
        words = [re.sub(r"[\W_]+", "", w).lower() for w in words]
        words = [w for w in words if w]
        while len(words) > 1 and words[0] in TITLES:
            words = words[1:]
        split.append(words)
    split = [w for w in split if w and not all(x in SUFFIXES for x in w)]
    if len(split) == 2:
        split = [split[1], split[0]]
    words = [w for p in split for w in p]
    while len(words) > 2 and words[-1] in SUFFIXES:
        words = words[:-1]
    return tuple(words)


def nick(word: str) -> str:
    return NICKNAMES.get(word, word)


def deletions(word: str) -> set[str]:
    """The word, and from four letters on the word less each of its letters: two words one edit apart share one."""
    return {word} | ({word[:i] + word[i + 1 :] for i in range(len(word))} if len(word) > 3 else set())


def near(a: str, b: str) -> bool:
    """At most one letter put in, left out, changed, or two neighbours swapped."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and x[:2] == y[1::-1] and x[2:] == y[2:])


def _word(a: str, b: str) -> int:
    """How well a label's word stands for a name's: 0 for not at all."""
    if a == b:
        return 20
    if nick(a) == nick(b):
        return 18
    if len(a) == 1 and b.startswith(a):
        return 12
    return 10 if near(a, b) else 0


def match_label(label: str, name: str) -> int:
    """How well a label fits a full name; 0 for not at all."""
    a, b = fold_words(label), fold_words(name)
    if not a or not b:
        return 0
    given, last = b[0], b[-1]
    if len(a) == 1:
        w = a[0]
        if len(w) == 1:
            return 0
        of_last = _word(w, last)
        best = max(of_last + 1 if of_last else 0, _word(w, given))
        initials = w in (given[0] + last[0],) or (len(b) > 2 and w == "".join(x[0] for x in b))
        return max(best, 8 if initials else 0)
    straight, swapped = (_word(a[0], given), _word(a[-1], last)), (_word(a[-1], given), _word(a[0], last))
    return max(50 + sum(p) - k if min(p) > 0 else 0 for k, p in enumerate((straight, swapped)))


#: The radius of the join in the metric (Levenshtein): neighbours swapped are two edits of it.
RADIUS = 2
#: Two people, and no slip, if both names are met in at least so many recordings and less than this share of the lesser one's hold both:
#: who is misspelt is mostly named rightly nearby. Both grow clearer with more mentions and never turn round by more spellings.
EVIDENCE, TOGETHER = 6, 0.05
#: Where nothing tells in what a name was mentioned, a name stands by itself, however near another, if this share of its mentions is not in its commonest form and it has more than this share of the other's mentions.
OWN_VARIETY, OWN_SHARE = 0.25, 0.1


def slip_cells(keys: DataFrame) -> DataFrame:
    """Rows (cell, key): the cells of each key (key, given, last), so that any two keys one slip apart share one.

    A name is a point in the product of given and last names, whose metric is the sum of theirs. A slip leaves one part as it is; one within a last name leaves its first or
    its last half: of a length l, (l - 1) // 2 letters of an end, and as many as the next shorter length has, since a letter may be missing. Where only the blank is
    displaced the letters are the same.
    """
    size = lambda less: F.greatest(F.floor((F.length("last") - less) / 2).cast("int"), F.lit(0))
    front = lambda k: F.concat_ws("|", F.lit("<"), "given", k.cast("string"), F.substring(F.col("last"), F.lit(1), k))
    back = lambda k: F.concat_ws("|", F.lit(">"), "given", k.cast("string"), F.substring(F.col("last"), F.length("last") - k + 1, k))
    cells = F.array_distinct(F.array(F.concat(F.lit("="), "last"), F.concat(F.lit("+"), "given", "last"), front(size(1)), front(size(2)), back(size(1)), back(size(2))))
    return keys.select(F.explode(cells).alias("cell"), "key")


def radius_pairs(cells: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a <> b, both ways, of the strings `key` of one `cell` at most `radius` edits apart: an exact join in a metric space.

    Each cell has its own pivots, as many as the root of its size (keys whose hash is low enough, and the lowest), so pivots grow with the data and no list of them is held anywhere.
    Every key is at home with its nearest pivot, and is copied to each pivot of its cell that is at most 2 * radius farther than that: by the
    triangle inequality any two keys within the radius meet at the home of each. Around a pivot rings of equal
    distance that differ by more than the radius cannot hold a pair, so cell, pivot and ring are the key of an equi-join, which AQE can split
    where it is hot.
    """
    cells = cells.select(F.coalesce(F.col("cell").cast("string"), F.lit("")).alias("cell"), "key").where("key is not null").distinct()
    u = F.xxhash64("cell", "key")
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min_by("key", u).alias("lowest")).where("n > 1")
    c = cut(cells.join(sizes, "cell"))
    pivots = c.where((F.col("key") == F.col("lowest")) | (F.shiftrightunsigned(u, 11) * F.lit(2.0**-53) < 1 / F.sqrt("n"))).select("cell", F.col("key").alias("pivot"))
    d = c.select("cell", "key").join(pivots, "cell").withColumn("ring", F.levenshtein("key", "pivot"))
    d = d.groupBy("cell", "key").agg(F.min("ring").alias("least"), F.collect_list(F.struct("ring", "pivot")).alias("p"))
    copies = F.filter("p", lambda x: x["ring"] <= F.col("least") + 2 * radius)
    d = cut(d.select("cell", "key", F.array_min("p").alias("home"), copies.alias("p")))
    home = d.select("cell", F.col("key").alias("a"), "home.pivot", F.explode(F.sequence(F.col("home.ring") - radius, F.col("home.ring") + radius)).alias("ring"))
    near_ = d.select("cell", F.col("key").alias("b"), F.explode("p").alias("x")).select("cell", "b", "x.pivot", "x.ring")
    close = (F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= radius) & (F.levenshtein(F.col("a"), F.col("b"), radius) >= 0)
    return home.join(near_, ["cell", "pivot", "ring"]).where(close).select("a", "b").distinct()


def _parsed(names: DataFrame) -> DataFrame:
    """Adds w: the folded words of each name, short forms replaced, initials in the middle left out."""

    @F.pandas_udf("array<string>")
    def words(x: pd.Series) -> pd.Series:
        def of(raw):
            w = fold_words(raw or "")
            return [nick(v) for k, v in enumerate(w) if len(v) > 1 or k in (0, len(w) - 1)] if len(w) > 2 else [nick(v) for v in w]

        return x.map(of)

    return names.withColumn("w", words("name")).where(F.size("w") > 0)


def _roots(points: DataFrame) -> DataFrame:
    """(key, root) from pointers (key, to): followed to their ends, distances doubling, until none moves. Pointers never form a ring, as each leads to a key of higher rank."""
    roots = cut(points.select("key", F.coalesce("to", "key").alias("root")))
    while True:
        again = roots.select(F.col("key").alias("root"), F.col("root").alias("next"))
        step = cut(roots.join(again, "root", "left").select("key", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        roots = step.select("key", "root")
        if step.where("moved").isEmpty():
            return roots


def _together(pairs: DataFrame, met: DataFrame) -> DataFrame:
    """Adds to pairs (a, b) how many contexts hold both; met: distinct (key, context). Only the contexts of a, the key of lower rank, are looked up."""
    a = pairs.join(met.withColumnRenamed("key", "a"), "a")
    both = a.join(met.select(F.col("key").alias("b"), "context"), ["b", "context"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both"))
    return pairs.join(both, ["a", "b"], "left").withColumn("both", F.coalesce("both", F.lit(0)))


def variants(names: DataFrame, name: str = "name", context: str | None = None) -> DataFrame:
    """Rows (name, person): every spelling that is linked to a person, and the person's key, the folded spelling all others lead to.

    names: one row a mention; context: the column of what it was mentioned in. Spellings are folded to words (titles, suffixes, case, accents, marks, order after a comma, short forms); which of two words is
    the given name is settled by how often each stands first and last over all spellings. Full names are joined within the radius of the edit metric and linked where they differ by one letter or
    two swapped neighbours; each links to the neighbour of more mentions it shares most contexts with, unless both are met often and hardly ever together: then they are two people (without contexts, unless its forms vary and are no rare ones). Initials
    and bare surnames link to the one person they fit, if it is only one; run-together names to the name they spell. A bare given name is linked to nothing.

    Nulls and names without a letter give no rows; repeated mentions count as evidence only; a null context is none; further columns are ignored.
    """
    of = F.lit(None).cast("string") if context is None else F.col(f"`{context}`").cast("string")
    mentions = names.select(F.col(f"`{name}`").alias("name"), of.alias("context")).where(F.col("name").isNotNull()).groupBy("name", "context").agg(F.count(F.lit(1)).alias("rows"))
    mentions = cut(mentions)
    seen = mentions.groupBy("name").agg(F.sum("rows").alias("rows"))
    p = cut(_parsed(seen))
    two = p.where((F.size("w") > 1)).withColumn("x", F.element_at("w", 1)).withColumn("z", F.array_join(F.slice("w", 2, 99), " "))
    roles = two.where((F.length("x") > 1) & (F.length("z") > 1)).select(F.explode(F.array(F.struct(F.col("x").alias("t"), F.lit(1).alias("f"), F.lit(0).alias("l")), F.struct(F.col("z").alias("t"), F.lit(0).alias("f"), F.lit(1).alias("l")))).alias("r"))
    roles = cut(roles.groupBy(F.col("r.t").alias("t")).agg(F.sum("r.f").alias("f"), F.sum("r.l").alias("l")))
    role = lambda c: roles.select(F.col("t").alias(c), F.col("f").alias(f"f{c}"), F.col("l").alias(f"l{c}"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    two = two.join(role("x"), "x", "left").join(role("z"), "z", "left")
    turned = ((zero("fz") + zero("lx") > zero("fx") + zero("lz")) | (F.length("z") == 1)) & (F.length("x") > 1)
    two = cut(two.select("name", "rows", F.when(turned, F.col("z")).otherwise(F.col("x")).alias("given"), F.when(turned, F.col("x")).otherwise(F.col("z")).alias("last")))
    full = two.where((F.length("given") > 1) & (F.length("last") > 1)).withColumn("key", F.concat_ws(" ", "given", "last"))
    keys = cut(full.groupBy("key").agg(F.sum("rows").alias("rows"), F.max("rows").alias("top"), F.first("given").alias("given"), F.first("last").alias("last")))

    @F.pandas_udf("boolean")
    def one_slip(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y) for x, y in zip(a, b)])

    rank = F.struct("rows", "key")
    pairs = radius_pairs(slip_cells(keys)).where(one_slip("a", "b"))
    own = (F.col("rows") - F.col("top") >= OWN_VARIETY * F.col("rows")) & (F.col("rows") > OWN_SHARE * F.col("rb.rows"))
    a, b = keys.select(F.col("key").alias("a"), "rows", "top", rank.alias("ra")), keys.select(F.col("key").alias("b"), rank.alias("rb"))
    up = cut(pairs.join(a, "a").join(b, "b").where((F.col("rb") > F.col("ra")) & (~own if context is None else F.lit(True))).select("a", "b", "rb"))
    met = cut(mentions.where("context is not null").join(full.select("name", "key"), "name").select("key", "context").distinct())
    often = met.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    up = _together(up, met).join(often.select(F.col("key").alias("a"), F.col("n").alias("na")), "a", "left").join(often.select(F.col("key").alias("b"), F.col("n").alias("nb")), "b", "left")
    least = F.least(zero("na"), zero("nb"))
    up = up.where(~((least >= EVIDENCE) & (F.col("both") < TOGETHER * least)))
    best = up.groupBy(F.col("a").alias("key")).agg(F.max(F.struct("both", "rb", "b"))["b"].alias("to"))
    roots = _roots(keys.select("key").join(best, "key", "left"))
    of_full = full.select("name", "key").join(roots, "key").select("name", F.col("root").alias("person"))

    people = keys.join(roots, "key").select(F.col("root").alias("person"), "given", "last")  # every spelling of a person, slips too
    only = lambda d, by: d.groupBy(*by).agg(F.min("person").alias("person"), F.max("person").alias("other")).where("person = other").drop("other")
    short = two.where((F.length("given") == 1) & (F.length("last") > 1))
    of_short = short.join(only(people.withColumn("given", F.substring("given", 1, 1)), ["given", "last"]), ["given", "last"]).select("name", "person")
    one = p.where(F.size("w") == 1).select("name", F.element_at("w", 1).alias("t"))
    joined = keys.join(roots, "key").select(F.col("root").alias("person"), F.explode(F.array(F.concat("given", "last"), F.concat("last", "given"))).alias("t"))
    of_joined = one.join(only(joined, ["t"]), "t").select("name", "person")
    given = roles.where("f >= l").select("t")  # stands first at least as often as last
    of_last = one.join(given, "t", "left_anti").join(only(people.withColumnRenamed("last", "t"), ["t"]), "t").select("name", "person")
    return of_full.unionByName(of_short).unionByName(of_joined).unionByName(of_last).distinct()


def spelling_pairs(members: DataFrame) -> DataFrame:
    """Pairs (name_a, name_b), name_a < name_b by code point, of the different spellings of one person in members (name, person): the form some results ask for, as large as it says."""
    a, b = members.select("person", F.col("name").alias("name_a")), members.select("person", F.col("name").alias("name_b"))
    return a.join(b, "person").where("name_a < name_b").select("name_a", "name_b").distinct()
