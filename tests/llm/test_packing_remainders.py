"""Sources that are small in each partition are mixed like any other."""

import collections

from snapwarden.llm import packing


def test_sources_of_few_tokens_in_each_partition_are_mixed(spark):
    data = [(k, " ".join(["word"] * 60), "a" if k < 300 else "b") for k in range(450)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(data, 75), "doc_id long, text string, source string")
    got = packing.pack(df, window=2048).collect()
    total = sum(r.length for r in got)
    share = {s: sum(r.length for r in got if r.source == s) / total for s in "ab"}
    assert total // 2048 >= 8
    so_far = collections.Counter()
    for k in range(total // 2048):
        for r in got:
            if r.sequence_id == k:
                so_far[r.source] += r.length
        assert all(abs(so_far[s] - share[s] * 2048 * (k + 1)) <= 2 * (128 + 64) for s in "ab")
