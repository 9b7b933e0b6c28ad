"""Near copies against brute-force Jaccard over all pairs."""

import random

import corpus_pipeline
import numpy as np
from snapwarden.llm import near_copies


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)}


def brute_groups(docs):
    """For each row a number of its group."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(docs))]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"edit{rng.randrange(10**6)}"
    return out


def test_near_stage_equals_brute_force_jaccard(spark, sf):
    rng = random.Random(3)
    docs = []
    for _ in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 300))]
        docs += [" ".join(x) for x in [words, edited(rng, words, max(1, len(words) // 60)), edited(rng, words, max(1, len(words) // 45)), edited(rng, words, len(words) // 20)]]
    docs = [*zip(rng.sample(range(1000), len(docs)), docs, strict=True), (2000, ""), (None, None), (2001, " \n"), (2002, "one two"), (2003, "One  Two")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [r.doc_id for r in corpus_pipeline.near(spark, df, sf).collect()]
    group = dict(zip([k for k, _ in docs], brute_groups(docs), strict=True))
    assert sorted(group[k] for k in got) == sorted(set(group.values()))  # one of each
    assert len(got) < 75  # edited copies did go


def test_groups_equal_brute_force_where_the_reference_is_far(spark):
    """Chains of edits: many texts share buckets with a first one that they aren't near to."""
    rng = random.Random(5)
    docs = []
    for _ in range(8):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.randint(40, 200))]
        for _ in range(12):
            docs.append(" ".join(base))
            base = edited(rng, base, max(1, len(base) // rng.choice([25, 40, 60])))
    rows = spark.createDataFrame([*enumerate(docs)], "row long, text string")
    got = {r["row"]: r["group"] for r in near_copies.near_groups(rows).collect()}
    want = brute_groups([*enumerate(docs)])
    smallest = {}
    for i, g in enumerate(want):
        smallest.setdefault(g, i)
    assert got == {i: smallest[g] for i, g in enumerate(want)}


def test_parity_bound_never_exceeds_the_differing_hashes():
    rng = np.random.default_rng(11)
    for n in (1, 5, 80, 700, 5000):
        base = rng.integers(0, 2**64, n, dtype=np.uint64)
        sets = [np.unique(base), np.unique(np.concatenate([base[: n - n // 9], rng.integers(0, 2**64, n // 7, dtype=np.uint64)]))]
        x, y = near_copies.parities(sets)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(*sets))


def test_edits_of_one_text_do_not_become_all_pairs(spark, monkeypatch):
    """Edits that are near their text, but not near each other: the same groups as by brute force, from few verified pairs."""
    rng = random.Random(13)
    base = [f"w{rng.randrange(300)}" for _ in range(150)]
    docs = [" ".join(edited(rng, base, rng.randint(2, 8))) for _ in range(150)]
    seen, measure = [], near_copies._similarities
    monkeypatch.setattr(near_copies, "_similarities", lambda pairs, sets: seen.append(pairs.count()) or measure(pairs, sets))
    got = {r["row"]: r["group"] for r in near_copies.near_groups(spark.createDataFrame([*enumerate(docs)], "row long, text string")).collect()}
    want, smallest = brute_groups([*enumerate(docs)]), {}
    for i, g in enumerate(want):
        smallest.setdefault(g, i)
    assert got == {i: smallest[g] for i, g in enumerate(want)}
    assert seen[1] < 150 * 149 / 2 / 4


def test_texts_in_many_pairs_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "SALT_PAIRS", 3)
    rng = random.Random(7)
    base = [f"w{rng.randrange(300)}" for _ in range(120)]
    docs = [" ".join(edited(rng, base, 1)) for _ in range(60)]
    got = {r["group"] for r in near_copies.near_groups(spark.createDataFrame([*enumerate(docs)], "row long, text string")).collect()}
    assert len(got) == len(set(brute_groups([*enumerate(docs)])))


def test_near_stage_keeps_one_row_of_a_group(spark, sf):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "quite another text of some words here"), (None, "null id text number one is this"), (None, "null id text number one is this"), (None, "and a second text that has no id")]
    got = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert sorted(r.text for r in got) == sorted({t for _, t in rows})
    assert corpus_pipeline.exact(spark, spark.createDataFrame([*rows, (2, "A b c d e f g")], "doc_id long, text string"), sf).count() == 4


def test_near_stage_searches_by_simhash_and_verifies(spark, monkeypatch):
    """The pairs that are verified include SimHash's: what chains of at most 3 differing bits connect, with no band's help."""
    rng = random.Random(19)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(200)]
        docs += [" ".join(x) for x in [base, edited(rng, base, 1), edited(rng, base, 2), edited(rng, base, 30)]]
    sets = [np.sort(s) for s in near_copies.shingle_sets(near_copies.pa.array(docs), 5)]
    prints = near_copies.simhashes(sets)
    for s, fp in zip(sets, prints, strict=True):
        assert int(fp) == sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s))
    links = {(i, j) for i in range(len(docs)) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= near_copies.BITS}
    assert len(links) > 5
    seen, measure = [], near_copies._similarities
    monkeypatch.setattr(near_copies, "_similarities", lambda pairs, sets: seen.append({(r.a, r.b) for r in pairs.collect()}) or measure(pairs, sets))
    rows = spark.createDataFrame([*enumerate(docs)], "row long, text string")
    found = {(r.a, r.b) for r in near_copies.simhash_pairs(spark.createDataFrame([*enumerate(prints.view(np.int64).tolist())], "node long, fp long")).collect()}
    got = {r["row"]: r["group"] for r in near_copies.near_groups(rows).collect()}

    def joined(pairs):
        root = list(range(len(docs)))
        for i, j in sorted(pairs):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    assert found <= links and joined(found) == joined(links)
    assert found <= seen[0]
    want, smallest = brute_groups([*enumerate(docs)]), {}
    for i, g in enumerate(want):
        smallest.setdefault(g, i)
    assert got == {i: smallest[g] for i, g in enumerate(want)}
