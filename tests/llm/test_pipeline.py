"""The stages one after another on small tables, each against what it is to do with its own input."""

import corpus_pipeline
from snapwarden.llm import exact_dedup, quality, queries
from snapwarden.llm.storage import materialise
from test_near_copies import brute_groups


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "SimHash near-dedup" in names
    given = docs
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        given = materialise(stage(spark, given, sf), "test-stage")
        outs.append(given)
        if name != names[-1]:
            assert given.columns == docs.columns
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in outs]
    assert ids[0] == {r.doc_id for r in quality.classify(docs).where("kept").collect()}
    groups = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(outs[0]).collect()}
    assert sorted(groups[i] for i in ids[1]) == sorted(set(groups.values()))
    given = [(r.doc_id, r.text) for r in outs[1].collect()]
    near = dict(zip([i for i, _ in given], brute_groups(given), strict=True))
    assert sorted(near[i] for i in ids[2]) == sorted(set(near.values()))
    assert ids[3] <= ids[2] and ids[4] == ids[3]
    assert corpus_pipeline.run(spark, sf).count() == outs[4].count()


def test_stages_take_empty_tables(spark, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        given = materialise(stage(spark, given, sf), "test-empty")
    assert given.count() == 0


CLASHING = ["kept", "score", "posterior", "n_words", "row", "doc", "mix_shard", "mix_place", "shard", "place", "size", "hash", "source_size", "slice", "block", "copy", "digest", "group", "same", "near_row", "key", "queue", "lane", "at"]


def test_stages_take_any_column_names_nulls_and_repeated_rows(spark, sf):
    some = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").limit(60).collect()
    data = [tuple(r) for r in some] + [tuple(r) for r in some[:5]] + [(None, some[7].text, None), (None, None, None), (3, "", "x"), (3, " \n\t", None), (4, "word " * 30_000 + "end.", "x")]
    given = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", *[f"'v' as `{c}`" for c in CLASHING], "1 as `a.b`")
    for name, stage in corpus_pipeline.STAGES:
        before, columns = given, given.columns
        given = materialise(stage(spark, given, sf), "test-clash")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert given.columns == columns
        if "dedup" in name:
            assert given.select("doc_id", "text").distinct().count() == given.count() and (given.count() < before.count() or "near" in name.lower())
    assert given.count() > 0


def test_mixing_splits_what_one_row_given_many_times_fills(spark):
    from snapwarden.llm import mixing

    data = [(None, "a b c d", "s")] * 900 + [(i, f"x{i} y z", "s") for i in range(50)] + [(i, "t u", "r") for i in range(20)]
    got = mixing.mix_counts(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3), block_words=40).collect()
    assert len(got) == 970
    by = {s: [r for r in got if (r.source_size > 100) == (s == "s")] for s in "sr"}
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 2 * r.size for r in own)


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == [*range(1, 11)]
