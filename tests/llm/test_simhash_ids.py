"""SimHash dedup on null ids and on ids of several texts."""

from collections import Counter

from lumenfield.llm import simhash

A, B, C, D = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return Counter(map(tuple, simhash.simhash_dedup(df).collect()))


def test_texts_of_null_ids_are_groups_of_their_own(spark):
    assert kept(spark, [(None, A), (None, B), (None, C), (None, C), (None, D), (4, D)]) == Counter([(None, A), (None, B), (None, C), (4, D)])


def test_two_texts_of_one_id_both_stay(spark):
    assert kept(spark, [(1, A), (1, B), (1, B), (2, A), (3, C)]) == Counter([(1, A), (1, B), (3, C)])
