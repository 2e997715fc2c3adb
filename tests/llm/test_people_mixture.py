"""Variant spellings of names, and mixtures of sources."""

import random

import pytest

from cuewright.llm import mixture as M
from cuewright.llm import people as P
from cuewright.session import ship


@pytest.mark.parametrize("raw,words", [
    ("Dr. Ana  Pérez, PhD", ("ana", "perez")), ("PEREZ, Ana", ("ana", "perez")), ("ana_perez", ("ana", "perez")), ("(Ana Pérez)", ("ana", "perez")), ("Ana Pérez's", ("ana", "perez")), ("Ana\xa0Pérez Jr.", ("ana", "perez")), ("A.Perez", ("a", "perez")),
    ("Søren Ødegård III", ("soren", "odegard")), ("", ()), ("...", ()), ("Ana", ("ana",)), ("Professor Ana M. Perez", ("ana", "m", "perez")),
])
def test_fold_words(raw, words):
    assert P.fold_words(raw) == words


def test_near_is_one_slip():
    assert P.near("sarobel", "sarobl") and P.near("sarobel", "saorbel") and P.near("sarobel", "sarabel") and P.near("sarobel", "saroobel")
    assert not P.near("sarobel", "sarblo") and not P.near("tim", "tom") and not P.near("sarobel", "saorble")


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("cells", [1, 3])
def test_radius_join_against_all_pairs(spark, cells):
    rng = random.Random(cells)
    keys = {"".join(rng.choice("abcd") for _ in range(rng.randrange(3, 12))) for _ in range(150)} | {"", "é"}
    for k in list(keys)[:60]:
        i = rng.randrange(len(k) + 1)
        keys.add(k[:i] + rng.choice("abcd") + k[i:])
    at = {k: rng.randrange(cells) for k in keys}
    df = spark.createDataFrame([(str(at[k]), k) for k in keys] + [("0", None)], "cell string, key string")
    got = {(r.a, r.b) for r in P.radius_pairs(df).collect()}
    assert got == {(a, b) for a in keys for b in keys if a != b and at[a] == at[b] and lev(a, b) <= 2}
    assert P.radius_pairs(df.limit(0)).collect() == []


def test_names_one_slip_apart_share_a_cell(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcde") for _ in range(n))
    keys = {(word(rng.randrange(2, 7)), word(rng.randrange(2, 9))) for _ in range(60)}
    for given, last in list(keys):
        for _ in range(6):
            parts = [given, last]
            k = rng.randrange(2)
            w, i = parts[k], rng.randrange(len(parts[k]))
            parts[k] = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcde") + w[i:], w[:i] + "x" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]])
            if all(len(x) > 1 for x in parts):
                keys.add(tuple(parts))
    df = spark.createDataFrame([(f"{g} {z}", g, z) for g, z in keys], "key string, given string, last string")
    cells = {}
    for r in P.slip_cells(df).collect():
        cells.setdefault(r.key, set()).add(r.cell)
    keys = sorted(keys)
    for i, (g, z) in enumerate(keys):
        for h, y in keys[i + 1 :]:
            if (g == h and P.near("....." + z, "....." + y)) or (z == y and P.near("....." + g, "....." + h)):
                assert cells[f"{g} {z}"] & cells[f"{h} {y}"], ((g, z), (h, y))


def test_variants(spark):
    ship(spark)
    same = ["Michael Denunodalo", "Denunodalo Michael", "Mike Denunodalo", "M. Denunodalo", "michael denunodalo", "Michael Denunotalo", "Micheal Denunodalo", "DENUNODALO, Mike", "Dr. Michael Denunodalo", "michaeldenunodalo", "Denunodalo", "Michael J. Denunodalo"]
    other = ["Petra Rolegodeli", "petra-rolegodeli", "Thomas Rolegodeli", "Michael", "Petra", "Greta Nesadodavi"]
    df = spark.createDataFrame([(n, 1) for n in same * 2 + other * 2 + ["", "..."]] + [(None, 1)], "name string, person int")
    v = {r.name: r.person for r in P.variants(df).collect()}
    assert {v.get(n) for n in same} == {"michael denunodalo"}
    assert v["Petra Rolegodeli"] == v["petra-rolegodeli"] != v["Thomas Rolegodeli"] and "Michael" not in v and "Petra" not in v and "" not in v
    pairs = {tuple(r) for r in P.spelling_pairs(P.variants(df)).collect()}
    assert pairs == {(a, b) for a in same for b in same if a < b} | {("Petra Rolegodeli", "petra-rolegodeli")}
    assert P.spelling_pairs(P.variants(df.limit(0))).collect() == []


def test_people_of_like_names_stay_apart(spark):
    ship(spark)
    a = ["Lillian Dosuratsky", "lillian dosuratsky", "Dosuratsky, Lillian", "LILLIAN DOSURATSKY"]
    b = [n.replace("su", "ru").replace("SU", "RU") for n in a]
    v = {r.name: r.person for r in P.variants(spark.createDataFrame([(n,) for n in a + b + ["Lillian Dosuratskyy"]], "name string")).collect()}
    assert {v[n] for n in a} == {v["Lillian Dosuratskyy"]} != {v[n] for n in b} and len({v[n] for n in b}) == 1


@pytest.mark.parametrize("times", [1, 5])
def test_a_slip_in_many_forms_is_still_a_slip(spark, times):
    """What decides are ratios: the same table many times over, and slips in as many forms as the name itself, give the same people."""
    ship(spark)
    slips = ["Micheal Denunodalo", "micheal denunodalo", "Denunodalo, Micheal", "MICHEAL DENUNODALO"]
    right = [n.replace("ea", "ae").replace("EA", "AE") for n in slips]
    other = [n.replace("Micheal", "Michael").replace("micheal", "michael").replace("MICHEAL", "MICHAEL").replace("nod", "rod").replace("NOD", "ROD") for n in slips]
    rows = [(n,) for n in slips + right * 15 + other * 6] * times
    v = {r.name: r.person for r in P.variants(spark.createDataFrame(rows, "name string")).collect()}
    assert {v[n] for n in slips} == {v[n] for n in right} == {"michael denunodalo"} and {v[n] for n in other} == {"michael denurodalo"}


def test_more_spellings_never_unlink(spark):
    """With the recordings of the mentions, a slip stays a slip in however many forms; only people who are met often and never together come apart."""
    ship(spark)
    right, slips = ["Katherine Hollander", "KATHERINE HOLLANDER"], ["Katherine Holander", "KATHERINE HOLANDER", "Dr. Katherine Holander", "Holander, Katherine", "Kate Holander"]
    for k in range(1, len(slips) + 1):
        rows = [(n, f"r{i}") for i in range(12) for n in right] + [(n, f"r{i}") for i in range(8) for n in slips[:k]] + [("Katherine Zollander", f"z{i}") for i in range(8)] + [(None, None), ("Katherine Hollander", None)]
        v = {r.name: r.person for r in P.variants(spark.createDataFrame(rows, "name string, video_id string"), "name", "video_id").collect()}
        assert len({v[n] for n in right + slips[:k]}) == 1 and v["Katherine Zollander"] == "katherine zollander", k


def plain_fill(sizes, shares, caps, total):
    """The rule, one round after the other."""
    most = {s: float(sizes.get(s, 0)) * caps[s] for s in shares}
    still, out, left = {s for s in shares if shares[s] > 0 and most[s] > 0}, dict.fromkeys(shares, 0.0), float(total)
    while still:
        weight = sum(shares[s] for s in still)
        over = {s for s in still if left * shares[s] / weight >= most[s]}
        if not over:
            out |= {s: left * shares[s] / weight for s in still}
            break
        out |= {s: most[s] for s in over}
        left = max(left - sum(most[s] for s in over), 0.0)
        still -= over
    return out


def filled(spark, sizes, shares, caps, total=None):
    d = spark.createDataFrame(list(sizes.items()), "source string, size long")
    t = spark.createDataFrame([(s, shares[s], caps[s]) for s in shares], "source string, target_share double, max_repeat int")
    return {r.source: r.wanted for r in M.water_fill(d, t, total).collect()}


def test_water_fill(spark):
    sizes, caps = {"a": 100, "b": 1000, "c": 10}, {"a": 2, "b": 4, "c": 3}
    got = filled(spark, sizes, {"a": 0.5, "b": 0.4, "c": 0.1}, caps)
    assert got["c"] == 30 and got["a"] == 200 and abs(sum(got.values()) - 1110) < 1e-6
    assert filled(spark, {"a": 10}, {"a": 0.5, "z": 0.5}, {"a": 2, "z": 5}, total=1000) == {"a": 20, "z": 0.0}
    assert filled(spark, {}, {"a": 1.0}, {"a": 3}) == {"a": 0.0}


@pytest.mark.parametrize("seed", range(4))
def test_water_fill_against_rounds(spark, seed):
    rng = random.Random(seed)
    names = [f"s{i}" for i in range(30)]
    sizes, caps = {s: rng.choice([0, 1, 50, 5000, 10**9]) for s in names if rng.random() < 0.9}, {s: rng.randrange(0, 5) for s in names}
    shares = {s: rng.choice([0.0, 0.01, 0.2, rng.random()]) for s in names}
    total = rng.choice([10, 10**5, 10**10, 10**11])
    assert filled(spark, sizes, shares, caps, total) == pytest.approx(plain_fill(sizes, shares, caps, total))


def test_mix(spark):
    ship(spark)
    rng = random.Random(1)
    docs = [(i, " ".join("word" for _ in range(rng.randrange(1, 60))), rng.choice(["big", "big", "big", "mid", "small"])) for i in range(600)] + [(900, None, "big"), (901, "", "mid"), (902, "text", None), (None, "text", "big"), (903, "text", "unlisted"), (5, "zz", "big")]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, source string, copies int")
    t = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.3, 4), ("small", 0.35, 2), ("absent", 0.05, 9), (None, 0.5, 1)], "source string, target_share double, max_repeat int")
    copies, shares = M.mix(d, t, seed=7)
    got, s = copies.collect(), {r.source: r for r in shares.collect()}
    assert len({r.doc_id for r in got}) == len(got) and all(r.copies <= s[r.source].max_repeat for r in got)
    for name in ("big", "mid", "small"):
        used = sum(r.tokens * r.copies for r in got if r.source == name)
        assert used == s[name].tokens and abs(used - s[name].wanted) <= 60
    assert abs(sum(r.share for r in s.values()) - 1) < 1e-9 and s["absent"].tokens == 0
    assert {r.source for r in got} == {"big", "mid", "small"}
    size = {r.source: r.size for r in s.values()}
    assert sum(r.wanted for r in s.values()) == pytest.approx(sum(size.values())) and s["mid"].wanted / s["small"].wanted == pytest.approx(0.3 / 0.35) and s["big"].wanted == pytest.approx(0.3 / 0.95 * sum(size.values()))
    again = {(r.doc_id, r.copies) for r in M.mix(d.repartition(7), t, seed=7)[0].collect()}
    assert again == {(r.doc_id, r.copies) for r in got}
    empty = M.mix(d.limit(0), t)
    assert empty[0].collect() == [] and all(r.tokens == 0 for r in empty[1].collect())
    assert M.mix(d, t.limit(0))[0].collect() == []


def test_tokens_of_a_public_tokenizer(spark):
    ship(spark)
    d = spark.createDataFrame([("hello world",), (None,), ("",)], "text string")
    assert [r.tokens for r in M.with_tokens(d, "text").collect()] == [2, 0, 0]
