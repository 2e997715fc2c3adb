"""Samples that models are fitted on, and rows that count once."""

import pyarrow as pa

from cuewright.llm.rows import first_of, gathered
from cuewright.llm.sampling import FIT_CHARS, fit_texts, least_hashes


def test_a_repeated_text_counts_once(spark):
    """Each text of a small table in turn is a hundred times as frequent; the sample stays the same different texts."""
    texts = [f"text {i}" for i in range(60)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    want = least_hashes(df, "t", 10)
    assert len(set(want)) == 10
    for hot in (want[0], want[9]):
        more = df.unionByName(spark.createDataFrame([(hot,)] * 100, "t string"))
        assert fit_texts(more, "t", 10) == want


def test_long_texts_are_fitted_on_in_pieces(spark):
    """A table of long texts only gives a sample too, of pieces from all over them."""
    long_ = [" ".join(f"w{i}x{k}" for k in range(4000)) for i in range(20)]
    got = fit_texts(spark.createDataFrame([(t,) for t in long_] + [("short",), (None,)], "t string"), "t", 30)
    assert len(got) == 21 and "short" in got and all(len(t) <= FIT_CHARS and any(t in whole for whole in [*long_, "short"]) for t in got)
    assert len({long_[i].find(t) for t in got for i in range(20) if t in long_[i]}) > 10


def test_the_first_of_equal_keys(spark):
    """Across batches of any size, nulls among the keys."""
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", None, "p"), ("b", None, "q"), ("b", 3, None), (None, 3, "r"), (None, 3, "s")]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_pylist([dict(zip("knt", r)) for r in rows[i : i + size]], pa.schema([("k", pa.string()), ("n", pa.int64()), ("t", pa.string())])) for i in range(0, len(rows), size)]
        got = [(r["k"], r["n"], r["t"]) for b in first_of([*batches[:1], batches[0].slice(0, 0), *batches[1:]], ["k", "n"]) for r in b.to_pylist()]
        assert got == [("a", 1, "x"), ("a", 2, "z"), ("b", None, "p"), ("b", 3, None), (None, 3, "r")], size
    d = gathered(spark.createDataFrame(rows[::-1] * 3, "k string, n int, t string"), ["k", "n"], ["t"])
    out = d.mapInArrow(lambda it: first_of(it, ["k", "n"]), d.schema).collect()
    assert sorted(map(tuple, out), key=repr) == sorted([("a", 1, "x"), ("a", 2, "z"), ("b", None, "p"), ("b", 3, None), (None, 3, "r")], key=repr)
