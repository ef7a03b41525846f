"""Words of texts as Arrow columns, and what is counted and merged of them."""

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from augury.functions.text import words
from augury.functions.tokens import pairs_told, words_of, worded
from augury.operators.textindex import merged

ODD = ["", "a", " a", "b ", "one,two  3", "größe KelvinK", "___", "x1-y2", "end", "İstanbul", "日本 ai", "0"]


def test_words_of_arrow_columns_are_those_of_the_expression(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "i int, x string").select("i", F.lower("x").alias("low"), words("x").alias("w")).orderBy("i").collect()
    want, low = [r["w"] for r in rows], pa.array([r["low"] for r in rows])
    for given in (low, low.cast(pa.large_string())):
        assert words_of(given).to_pylist() == want and words_of(given.slice(2, 5)).to_pylist() == want[2:7]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), low], ["id", "text"])
    for size in (1, 7, 1 << 20):
        assert [r for b in worded([batch.slice(0, 0), batch.slice(1), batch], size) for r in b.to_pylist()] == [{"id": i, "words": w} for i, w in [*enumerate(want)][1:] + [*enumerate(want)]]
    assert words_of(pa.array([], pa.string())).to_pylist() == [] and words_of(pa.array(["", "-"])).to_pylist() == [[], []]


def test_posting_rows_of_a_word_and_block_are_merged_across_batches():
    at = lambda doc, pos: (doc << 32) + pos
    rows = [("a", 0, [at(5, 1), at(5, 2)]), ("a", 0, [at(1, 0), at(5, 2)]), ("a", 0, [at(2, 9)]), ("a", 1, [at(1, 1)]), ("b", 1, [at(1, 3), at(1, 2)])]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 5, pa.int32()), pa.array([r[0] for r in rows]), *(pa.array([r[i] for r in rows], k) for i, k in ((0, pa.string()), (1, pa.int64()), (2, pa.list_(pa.int64()))))], ["part", "stem", "term", "block", "places"])
    want = [("a", 0, 3, [at(1, 0), at(2, 9), at(5, 1), at(5, 2), at(5, 2)]), ("a", 1, 1, [at(1, 1)]), ("b", 1, 1, [at(1, 2), at(1, 3)])]
    for cut in range(6):
        got = [r for b in merged([batch.slice(0, cut), batch.slice(cut)]) for r in b.to_pylist()]
        assert [(r["term"], r["block"], r["n_docs"], r["places"]) for r in got] == want
    assert [*merged([])] == []


def test_pairs_of_words_are_counted_once_a_text():
    texts = [("en", "a b a b c"), (None, "a b"), ("en", "a b"), ("de", "b"), ("en", ""), (None, "a b b b"), ("de", "c a")]
    batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in texts]), pa.array([x[1] for x in texts])], ["lang", "text"])
    want = Counter((lang, g) for lang, x in texts for g in {" ".join(p) for p in zip(x.split(), x.split()[1:])})
    for size in (1, 1 << 20):
        told = [r for b in pairs_told(worded([batch, batch.slice(3, 2)], size)) for r in b.to_pylist()]
        got = Counter()
        for r in told:
            got[r["lang"], r["gram"]] += r["n"]
        assert got == want and (size == 1 or len(told) == len(want))
