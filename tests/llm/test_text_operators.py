"""Each operator against a plain restatement of its contract, on awkward rows and on the small tables."""

import base64
import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from snapwarden.llm import chat_tree, exact_dedup, license_scan, line_rules, mixing, packing, quality, simhash, token_counts, tokens, warc, words
from snapwarden.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 4000
AWKWARD = [
    (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, "  \n\t ", "de", "a", 0), (4, "One two", "en", "b", 0), (5, "one TWO", "en", "b", 0), (6, "ONE two", "en", "c", 0),
    (7, "É à ß Ünï", "fr", "a", 0), (8, "é à ß Ünï", "fr", "a", 0), (9, LONG, "en", "a", 0), (10, LONG.upper(), "en", None, 0), (11, "one two three four five six", "en", "a", 0),
    (11, "one two three four five six", "en", "a", 0), (None, "one two", None, "b", None), (12, "x<|endoftext|>y don't 3.14 ½ 中文 \x1c", "en", "b", 0), (13, "a" * 5000, "en", "d", 0),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).selectExpr("*", "1 as id", "'z' as digest", "2 as size", "'q' as row", "'r' as key", "'p' as part")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows(df):
    return [tuple(r) for r in df.collect()]


def both(awkward, docs):
    return [awkward, docs]


# --- exact dedup
def expect_exact(data, keep):
    groups = collections.defaultdict(list)
    for i, t in data:
        groups[lower(t)].append(i)
    out = []
    for i, t in data:
        own = groups[lower(t)]
        best = keep((x for x in own if x is not None), default=None)
        out.append((i, best, len(own), i == best, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(awkward, docs, keep):
    for df in both(awkward, docs):
        data = [(r.doc_id, r.text) for r in df.collect()]
        got = exact_dedup.exact_dedup(df, keep=keep)
        assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert sorted(rows(got), key=str) == expect_exact(data, {"min": min, "max": max}[keep])


def test_exact_dedup_empty(empty):
    assert rows(exact_dedup.exact_dedup(empty)) == []


def test_index_takes_several_runs_and_levels(spark):
    index = exact_dedup.DigestIndex(spark)
    flush = lambda *part: index.flush(spark.createDataFrame(part, "digest binary, id long"))
    level = lambda: sorted((bytes(r.digest), r.keep_id, r.n) for r in index.compact().collect())
    flush((b"a", 2), (b"b", 3), (b"c", None))
    flush((b"a", 1))
    assert level() == [(b"a", 1, 2), (b"b", 3, 1), (b"c", None, 1)]
    flush((b"b", 9), (b"c", 5))
    assert level() == [(b"a", 1, 2), (b"b", 3, 2), (b"c", 5, 2)] == level()
    assert [(bytes(r.digest), r.n) for r in index.find([b"b", b"x"]).collect()] == [(b"b", 2)]


def test_exact_dedup_takes_string_ids_and_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_BUCKETS", 1)
    monkeypatch.setattr(exact_dedup, "BITS_PER_DIGEST", 0)
    data = [(f"k{i}", f"text {i % 40}") for i in range(300)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(data, "doc_id string, text string"), keep="max")
    assert sorted(rows(got), key=str) == expect_exact(data, max)


def test_exact_dedup_survives_digest_collisions(spark, monkeypatch):
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: real(exact_dedup.F.substring(c, 1, 0), n))  # all digests equal
    got = exact_dedup.exact_dedup(spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")], "doc_id long, text string"))
    assert sorted(rows(got.select("doc_id", "keep_id", "group_size", "kept"))) == [(1, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 2, 2, False), (5, 5, 1, True)]


# --- tokens
@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAzZ éÉßÅµªİΣς.,'!<|>1٣̈\n\t\x1c\x85\xa0中ﬁ😀\\"), max_size=30) | st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|> a", "a'LL b", "..,, x."]), max_size=6))
def test_encoder_equals_library(texts):
    import pyarrow as pa

    own = tokens.encoder(tokens.default_path())
    want = own.whole(texts)
    ids, ends = own.ids(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == want
    assert own.counts(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]


def test_encoder_of_other_files():
    import pyarrow as pa

    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        own = tokens.Encoder(tokens.default_path(name))
        assert not own.by_word
        assert own.counts(pa.array(["Hello there", ""])).tolist() == [len(x) for x in own.whole(["Hello there", ""])]


def test_safe_pieces():
    text = "aa bb\n" * 50
    assert "".join(words.safe_pieces(text, 40)) == text and all(len(p) < 60 for p in words.safe_pieces(text, 40))


def test_token_counts(awkward, docs, empty, library):
    for df in both(awkward, docs):
        data = [(r.doc_id, r.text or "") for r in df.collect()]
        want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in data]
        assert sorted(rows(token_counts.count_tokens(df)), key=str) == sorted(want, key=str)
        assert sorted(rows(token_counts.count_tokens(df, piece_chars=300, batch_bytes=1000)), key=str) == sorted(want, key=str)
    assert rows(token_counts.count_tokens(empty)) == []


# --- packing
def check_packing(got, data, library, window=4096):
    ids = {}
    for i, t, _ in data:
        ids.setdefault(i, []).append([*library.encode(t or "", add_special_tokens=False).ids, 2])
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        one = ids[r.doc_id][0]
        assert all(x == one for x in ids[r.doc_id])
        assert r.doc_tokens == len(one)
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in one[r.start : r.start + r.length]))
    for i, own in ids.items():
        seen = collections.Counter(k for r in by_doc[i] for k in range(r.start, r.start + r.length))
        assert seen == {k: len(own) for k in range(len(own[0]))}
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        n = sum(r.length for r in own)
        assert n <= window
        padding += 0 if n & (n - 1) == 0 else window - n
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence, padding


def test_packing(awkward, docs, empty, library):
    for df in both(awkward, docs.repartition(3)):
        data = [(r.doc_id, r.text, r.source) for r in df.collect()]
        _, padding = check_packing(packing.pack(df).collect(), data, library)
        assert padding == 0
    assert rows(packing.pack(empty)) == []


def shares_by_window(by_sequence, window):
    for k in sorted(by_sequence):
        if sum(r.length for r in by_sequence[k]) == window:
            yield collections.Counter({s: sum(r.length for r in by_sequence[k] if r.source == s) for s in {r.source for r in by_sequence[k]}})


@pytest.mark.parametrize("lane_windows", [4, 64])
def test_packing_fills_every_window_to_proportion(spark, library, lane_windows):
    data = [(i, " ".join(["word"] * n), s) for i, (n, s) in enumerate([(700, "a")] * 60 + [(300, "b")] * 70 + [(100, "c")] * 60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3, "doc_id")
    got = packing.pack(df, window=1024, lane_windows=lane_windows).collect()
    by_sequence, padding = check_packing(got, data, library, 1024)
    total = sum(r.length for r in got)
    share = {s: sum(r.length for r in got if r.source == s) / total for s in "abc"}
    windows = [*shares_by_window(by_sequence, 1024)]
    assert padding == 0 and len(windows) == total // 1024
    in_lanes = total // (1024 * lane_windows) * lane_windows * 3 // 4 or len(windows) - 1  # the last windows hold what the lanes left
    so_far = collections.Counter()
    for k, w in enumerate(windows[:in_lanes]):
        so_far.update(w)
        for s in "abc":
            assert abs(w[s] - share[s] * 1024) <= 3 * (64 + 32)
            assert abs(so_far[s] - share[s] * 1024 * (k + 1)) <= 3 * (64 + 32) + 2 * (k // lane_windows + 1) * 64


def test_packing_by_weights(spark, library):
    data = [(i, " ".join(["word"] * 500), "ab"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    for weights in ({"a": 3.0, "b": 1.0}, (3, 1)):
        got = packing.pack(df, window=1024, weights=weights, lane_windows=8).collect()
        by_sequence, _ = check_packing(got, data, library, 1024)
        for k in range(16):
            assert abs(sum(r.length for r in by_sequence[k] if r.source == "a") / 1024 - 0.75) < 0.15
        early = [r for k in range(16) for r in by_sequence[k]]
        assert abs(sum(r.length for r in early if r.source == "a") / sum(r.length for r in early) - 0.75) < 0.03
    with pytest.raises(ValueError):
        packing.pack(df, weights={"a": 0.0})


def test_packing_gives_ids_and_pools_many_sources(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "MAX_QUEUES", 3)
    data = [(i, " ".join(["some words here"] * (i % 9)), f"s{i % 7}" if i % 11 else None) for i in range(120)]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4), window=256, with_ids=True, weights=(5, 2, 1)).collect()
    check_packing(got, data, library, 256)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)


@given(st.lists(st.tuples(st.integers(1, 5000), st.sampled_from([5.0, 2.0, 1.0])), min_size=1, max_size=12), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_schedule_deals_each_token_to_one_lane(queues, lanes):
    plan = packing.Schedule(np.array([n for n, _ in queues]), np.array([w for _, w in queues]), lanes)
    for q, (n, _) in enumerate(queues):
        place = np.full(lanes + 1, q)
        borders = plan.border(np.arange(lanes + 1), place)
        assert borders[0] == 0 and borders[-1] == n and (np.diff(borders) >= 0).all()
        at = np.arange(n)
        lane = plan.lane(np.full(n, q), at)
        assert (borders[lane] <= at).all() and (at < borders[lane + 1]).all()
    sizes = sum(np.diff(plan.border(np.arange(lanes + 1), np.full(lanes + 1, q))) for q in range(len(queues)))
    assert (abs(sizes - sum(n for n, _ in queues) / lanes) <= len(queues) + 1).all()


# --- mixing
def test_targets_by_hand():
    assert mixing.targets({"b": 100, "a": 100, None: 10}, (5, 2, 1), 315, 2) == pytest.approx({"a": 200, "b": 115 * 2 / 3, None: 20} | {"b": 95.0})
    assert mixing.targets({}, (5, 2, 1), 0, 2) == {}


def test_split_is_exact():
    import numpy as np

    quotas = np.array([17, 0, 5, 100])
    out = mixing.split(quotas, 8, 1)
    assert out.sum(axis=0).tolist() == quotas.tolist() and (out >= 0).all() and np.ptp(out.sum(axis=1)) <= 3


def test_mixing(awkward, docs, empty):
    for df in both(awkward, docs):
        data = [(r.doc_id, len(split(r.text)), r.source) for r in df.collect()]
        got = mixing.mix_counts(df, block_words=500).collect()
        sums = collections.Counter()
        for _, n, s in data:
            sums[s] += n
        goal = mixing.targets(sums, (5, 2, 1), 1.5 * sum(sums.values()), 2)
        assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == sorted(((i, n) for i, n, _ in data), key=str)
        taken = collections.Counter()
        for r in got:
            assert 0 <= r.taken <= 2 * r["size"]
            source = next(s for i, n, s in data if (i, n) == (r.doc_id, r["size"]) and sums[s] == r.source_size)
            assert r.target == pytest.approx(goal[source])
            taken[source] += r.taken
        assert all(abs(taken[s] - goal[s]) <= 1 for s in sums)
        again = mixing.mix_counts(df.repartition(5), block_words=500).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))
    assert rows(mixing.mix_counts(empty)) == []


def test_mix_gives_texts(docs):
    size = {r.doc_id: r.text for r in docs.collect()}
    got = mixing.mix(docs, block_words=500, shards=4).collect()
    want = {r.doc_id: r.taken for r in mixing.mix_counts(docs, block_words=500, shards=4).collect()}
    have = collections.Counter()
    cut = 0
    for r in got:
        have[r.doc_id] += len(split(r.text))
        cut += r.text != size[r.doc_id]
    assert have == {k: v for k, v in want.items() if v} and cut <= 20
    assert {r.mix_shard for r in got} == {0, 1, 2, 3}


# --- WARC
PAGES = [(1, "http://a/ü?x= y\r\n", "<p>é</p>"), (2, None, None), (3, "http://b", ""), (4, "u", "<p>é</p>"), (5, "u", "x" * 300_000), (6, "u", "WARC/1.1\r\n\r\n\x1f"), (None, "u", "<p>é</p>"), (None, "u", "alone")]


def expect_pages(data, least=0):
    groups = collections.defaultdict(list)
    for i, _, h in data:
        groups[h or ""].append(i)
    out = []
    for i, _, h in data:
        body = (h or "").encode()
        best = max((x for x in groups[h or ""] if x is not None), default=None)
        visit = len(groups[h or ""]) > 1 and i != best and len(body) >= least
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if visit else "response", best if visit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, sf, least):
    small = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as key", "3 as n")
    for df in (small, spark.read.parquet(f"{sf}/pages.parquet")):
        data = [(r.page_id, r.url, r.html) for r in df.collect()]
        assert sorted(rows(warc.round_trip(df, min_bytes=least, archive_bytes=20_000)), key=str) == expect_pages(data, least)
    assert rows(warc.round_trip(small.where("1 = 0"))) == []


def test_warc_payloads_come_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = warc.write_archives(df)
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, folder).where("record_type = 'response' and page_id is not null").collect()}
    assert got[5] == b"x" * 300_000 and got[6] == b"WARC/1.1\r\n\r\n\x1f" and got[4] == "<p>é</p>".encode()
    assert warc.read_gaps(spark, folder).count() == 0


def test_salvage():
    one, two, three = (warc.record(i, "u", b"payload %d" % i * 50, None, False) for i in range(3))
    a, b, c = map(warc.member, (one, two, three))
    ids = lambda s: [h["warc-record-id"][-2] for h, _ in s.records]
    assert ids(warc.salvage(a + b + c)) == ["0", "1", "2"] and warc.salvage(a + b + c).gaps == []
    broken = bytearray(a + b + c)
    broken[len(a) + len(b) // 2] ^= 0xFF
    got = warc.salvage(bytes(broken))
    assert ids(got)[0] == "0" and ids(got)[-1] == "2" and [g[:2] for g in got.gaps] == [(len(a), len(a) + len(b))]
    got = warc.salvage(b"junk" + one + b"more junk" + two[:-30] + c)
    assert ids(got) == ["0", "2"] and got.gaps[0][:2] == (0, 4) and got.gaps[1][0] == 4 + len(one) and got.gaps[-1][1] == 4 + len(one) + 9 + len(two) - 30
    assert ids(warc.salvage(a + b[:40])) == ["0"] and warc.salvage(a + b[:40]).gaps[0][0] == len(a)
    bad = two.replace(b"payload 1", b"payload X", 1)
    mixed = warc.salvage(warc.member(one + bad + three))
    assert ids(mixed) == ["0", "2"] and len(mixed.gaps) == 1
    assert warc.salvage(b"").records == [] and warc.salvage(b"\x1f\x8b\x08").gaps == [(0, 3, "member is cut off")]


# --- SimHash
def print_of(text):
    w = split(lower(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expect_groups(prints, k=3):
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= k:
                up[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_simhash(awkward, docs, empty):
    for df in both(awkward, docs):
        data = [(r.doc_id, r.text) for r in df.collect()]
        prints = [print_of(t) for _, t in data]
        roots = expect_groups(prints)
        first = {g: min((i for (i, _), x in zip(data, roots, strict=True) if x == g and i is not None), default=None) for g in set(roots)}
        want = [(i, f"{p:016x}", first[g]) for (i, _), p, g in zip(data, prints, roots, strict=True)]
        assert sorted(rows(simhash.simhash_groups(df)), key=str) == sorted(want, key=str)
    assert rows(simhash.simhash_groups(empty)) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=5), st.lists(st.lists(st.integers(0, 63), max_size=3), max_size=25))
def test_spanning_links_keep_all_chains(seeds, flips):
    import numpy as np

    prints = set(seeds)
    for f in flips:
        prints.add(sorted(prints)[len(f) % len(prints)] ^ sum({1 << b for b in f}))
    prints = sorted(prints)
    a, b = simhash.spanning_links(np.array(prints, np.uint64), simhash.references(16), 3)
    assert all((int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(a, b, strict=True))
    want = expect_groups(prints)
    assert len(a) == len(prints) - len(set(want))


def test_some_bucket_holds_every_linked_pair():
    masks = simhash.bucket_masks(3)
    assert len(masks) == 20
    for flips in ([0, 20, 40], [63, 62, 1], [10, 11, 12], [0], []):
        assert any(all(not m >> b & 1 for b in flips) for m in masks)


@pytest.mark.parametrize("large", [1, 4, 10**9])
def test_split_buckets_lose_no_pair(spark, large):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 12)
    prints = {int(x) for b in base for x in [b, *(b ^ np.bitwise_or.reduce([np.int64(1) << np.int64(k) for k in rng.choice(63, n, replace=False)]) for n in (1, 2, 3, 3, 5))]}
    keyed = simhash.bucketed(spark.createDataFrame([(x,) for x in prints], "fp long"), 3, large).collect()
    buckets = collections.defaultdict(set)
    for r in keyed:
        buckets[r.choice, r.bits, r.part, r.more].add(r.fp)
    for x in prints:
        for y in prints:
            if x < y and (x ^ y).bit_count() <= 3:
                assert any(x in own and y in own for own in buckets.values())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = dict(rows(components(spark.createDataFrame(links, "a long, b long"))))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# --- chat
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "he\\-llo </s> [INST]"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (2, 2, "user", None), (2, 3, None, "x|>y"), (3, 0, "system", "<<SYS>>"), (3, 1, "assistant", "a"),
    (3, 2, "assistant", "b"), (4, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "he\\-llo </s> [INST]"), (None, 0, "tool |> \\", "t"), (6, None, "assistant", "first"), (6, 1, "user", "[[INST]INST]"), (6, 1, "assistant", "tie"),
]


def expect_chats(data):
    chats = collections.defaultdict(list)
    for c, n, role, text in data:
        chats[c].append((n if n is not None else -(2**60), role or "", text or ""))
    out = []
    for c, own in chats.items():
        own.sort()
        said = "".join(t for _, r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for _, r, t in own)
        n = sum(sum(map(len, chat_tree.parts(r, t))) for _, r, t in own)
        out.append((c, len(own), hashlib.sha256(whole.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), n))
    return sorted(out, key=str)


def test_chat(spark, sf):
    small = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as path", "2 as line")
    for df in (small, spark.read.parquet(f"{sf}/conversations.parquet")):
        data = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
        assert sorted(rows(chat_tree.read_conversations(*chat_tree.format_conversations(df))), key=str) == expect_chats(data)
    assert rows(chat_tree.read_conversations(*chat_tree.format_conversations(small.where("1 = 0")))) == []


def test_chat_tree_shares_turns_and_intervals_add_up(spark):
    nodes, _ = chat_tree.format_conversations(spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1))
    found = [r.asDict() for r in nodes.collect()]
    for shard in {r["shard"] for r in found}:
        own = {r["node"]: r for r in found if r["shard"] == shard}
        assert len({(r["parent"], r["piece"]) for r in own.values()}) == len(own)
        for r in own.values():
            up, spans = r, []
            while up["parent"] is not None:
                up = own[up["parent"]]
                spans.append((up["emit_start"], up["emit_end"]))
            assert sum(b - a for a, b in r["attends"]) == sum(b - a for a, b in spans) == r["first_position"]
            assert {k for a, b in r["attends"] for k in range(a, b)} == {k for a, b in spans for k in range(a, b)}
            assert len(r["ids"]) == r["emit_end"] - r["emit_start"]


@settings(max_examples=200, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]x", "a\\b"]), st.lists(st.sampled_from([*chat_tree.CONTROL, "\\", "+", "-", "a", "[", "<", "s>", " "]), max_size=8).map("".join))
def test_template_is_reversible(role, text):
    piece = "".join(chat_tree.parts(role, text))
    assert chat_tree.parse(piece) == (role, text)
    assert not any(c in chat_tree.escape(text) for c in chat_tree.CONTROL)


# --- line rules
def test_line_rules(awkward, docs, empty):
    for df in both(awkward, docs):
        got = sorted(rows(line_rules.clean_lines(df, with_text=False)), key=str)
        want = []
        for r in df.collect():
            text, w = r.text or "", split(r.text)
            seen, dup = [], 0
            for line in text.split("\n"):
                if split(line):
                    dup += line in seen
                    seen.append(line)
            windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
            often = collections.Counter(windows)
            repeat = len({i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(3)})
            want.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, repeat, len(w) < 50 or 100 * repeat > 50 * len(w)))
        assert [x[:7] for x in got] == sorted(want, key=str) or sorted(x[:7] for x in got if x[0] is not None) == sorted(x for x in want if x[0] is not None)
        assert not any(x[6] and x[7] for x in got)
    assert rows(line_rules.clean_lines(empty)) == []


def test_line_faults():
    rules = line_rules.LineRules()
    judge = lambda line, seen=False: line_rules.line_fault(line, split(line), seen, rules)
    assert judge("Home | About | Contact | Help") == "navigation"
    assert judge("buy*** now### cheap$$$ best%%%") == "punctuation"
    assert judge("THIS IS ALL IN CAPITALS") == "punctuation"
    assert judge("go go go go go go go go go") == "boilerplate"
    assert judge("Please read our privacy policy.") == "boilerplate"
    assert judge("A plain line.", True) == "boilerplate"
    assert judge("A plain line with, well, some commas; it stays.") == ""


def test_rejected_texts_are_the_bad_ones(docs, spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in line_rules.clean_lines(docs, with_text=False).collect()}
    assert not any(got[i].kept for i, q in labels.items() if q == 0)
    assert all(got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed)


# --- quality classifier
def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    clean = [got[r.doc_id].kept for r in labels if r.quality == 1]
    junk = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.05 * len(junk)


def test_quality_edges(awkward, empty):
    got = quality.classify(awkward).collect()
    assert len(got) == len(AWKWARD) and all(not r.kept and r.score == 0 for r in got if r.n_words == 0)
    assert rows(quality.classify(empty)) == []
    clashing = awkward.selectExpr("*", "'k' as kept", "1 as score", "2 as n_words")
    assert quality.kept_documents(clashing).columns == clashing.columns
    assert quality.kept_documents(clashing).count() == quality.classify(awkward).where("kept").count()


def brute_quality(texts, dims):
    """Posterior and score of each text: expectation-maximisation document by document, and a dense logistic regression."""
    limits, votes, bins = quality.LIMITS, [], []
    for text in texts:
        w = split(text)
        n = max(len(w), 1)
        parts = max(1, len(w) // 200)
        pieces = [w[len(w) * i // parts : len(w) * (i + 1) // parts] for i in range(parts)]
        values = {
            "symbols": sum(c in "#*$%&<>" for c in text or "") / n, "separators": (text or "").count("|") / n, "capitals": sum(x.isupper() for x in w) / n, "repeats": sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
            "stop_words": sum(x.lower() in quality.STOP_WORDS for x in w) / n, "variety": sum(len({*p}) / max(len(p), 1) for p in pieces) / parts, "exclamations": (text or "").count("!!") / n, "word_length": sum(map(len, w)) / n,
        }
        row = []
        for name in quality.LABELLERS:
            sign, bad, good = limits[name]
            v = sign * values[name]
            row.append(None if len(w) < quality.LEAST.get(name, 1) else 0 if v >= sign * bad else 1 if v <= sign * good else None)
        votes.append(row)
        bins.append([f"\x00{name}={min(int(values[name] * (1 if name == 'word_length' else 20)), 30)}" for name in quality.LABELLERS])
    belief = []
    for row in votes:
        good, bad = row.count(1), row.count(0)
        belief.append((good + 0.5) / (good + 3 * bad + 1) if good + bad else 0.5)
    for _ in range(100):
        prior = (sum(belief) + 1) / (len(belief) + 2)
        right = []
        for k in range(len(quality.LABELLERS)):
            cast = [(b, r[k]) for b, r in zip(belief, votes, strict=True) if r[k] is not None]
            right.append([[(sum((b if c else 1 - b) for b, v in cast if v == x) + 1) / (sum((b if c else 1 - b) for b, _ in cast) + 2) for x in (0, 1)] for c in (0, 1)])
        belief = []
        for row in votes:
            gap = math.log(prior / (1 - prior)) + sum(math.log(right[k][1][v] / right[k][0][v]) for k, v in enumerate(row) if v is not None)
            belief.append(1 / (1 + math.exp(-min(max(gap, -60), 60))))
    x, full = np.zeros((len(texts), dims)), [i for i, t in enumerate(texts) if split(t)]
    for i in full:
        w = split(texts[i])
        for word in w:
            x[i, xxhash.xxh32_intdigest(word) % dims] += 1 / len(w)
        for b in bins[i]:
            x[i, xxhash.xxh32_intdigest(b) % dims] += 1
    weights, bias, seen, seen_b = np.zeros(dims), 0.0, np.full(dims, 1e-8), 1e-8
    want = np.array(belief)
    for _ in range(150):
        err = (1 / (1 + np.exp(-np.clip(x[full] @ weights + bias, -30, 30))) - want[full]) / len(full)
        slope, slope_b = x[full].T @ err + 1e-4 * weights, err.sum()
        seen, seen_b = seen + slope**2, seen_b + slope_b**2
        weights, bias = weights - 0.3 * slope / np.sqrt(seen), bias - 0.3 * slope_b / np.sqrt(seen_b)
    score = 1 / (1 + np.exp(-(x @ weights + bias)))
    return {i: (belief[i] if split(t) else 0.0, float(score[i]) if split(t) else 0.0) for i, t in enumerate(texts)}


def test_quality_equals_brute_force(spark, docs):
    texts = [r.text for r in docs.orderBy("doc_id").limit(150).collect()] + [None, "", "!!! $$$ ### " * 30, "the same the same the same " * 20, "A B C D E"]
    want = brute_quality(texts, 1 << 10)
    got = quality.classify(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3), dims=1 << 10).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.posterior == pytest.approx(want[r.doc_id][0], abs=1e-6)
        assert r.score == pytest.approx(want[r.doc_id][1], abs=1e-3)
        assert r.kept == (bool(split(texts[r.doc_id])) and r.score >= 0.5)


def test_labellers_accuracies_are_found():
    import random

    rng, counts = random.Random(3), collections.Counter()
    true = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.9, 0.6]
    for _ in range(20_000):
        good = rng.random() < 0.7
        p = 0
        for a in true:
            p = 3 * p + (quality.NONE if rng.random() < 0.2 else int(good) if rng.random() < a else 1 - int(good))
        counts[p] += 1
    model = quality.fit_labels(counts)
    assert abs(model.prior - 0.7) < 0.03
    assert all(abs(model.accuracies()[n] - a) < 0.04 for n, a in zip(quality.LABELLERS, true, strict=True))


# --- licences
def brute_licenses(text):
    """Families, paragraphs, and those with a family, by plain loops over every window of every paragraph."""
    names, weights, bias, heat = license_scan.model()
    marks = collections.defaultdict(set)
    for k, family, g, _ in license_scan.templates():
        marks[k, family].add(g)
    families, licensed, total = set(), 0, 0
    paragraph, paragraphs = [], []
    for n, line in enumerate([*(text or "").split("\n"), ""]):
        if n and not line.strip(" \t\r/*#;%<>!\"'=_|-"):
            paragraphs.append("\n".join(paragraph))
            paragraph = []
        else:
            paragraph.append(line)
    for body in paragraphs:
        w = re.sub("[^a-z0-9]+", " ", body.lower().replace("licence", "license")).split()
        total += bool(w)
        hit = False
        for start in range(0, max(len(w) - license_scan.WINDOW, 0) + license_scan.STRIDE, license_scan.STRIDE):
            found = license_scan.grams(w[start : start + license_scan.WINDOW])
            z = [(sum(weights[g][i] for g in found if g in weights) + b) / heat for i, b in enumerate(bias)]
            e = [math.exp(x - max(z)) for x in z]
            family = names[z.index(max(z))]
            part = max((len(found & m) / len(m) for (_, f), m in marks.items() if f == family), default=0)
            if family != license_scan.UNKNOWN and max(e) / sum(e) >= 0.5 and part >= 0.4:
                families.add(family)
                hit = True
        licensed += hit
    return ",".join(sorted(families - {"Proprietary"} or families)), total, licensed, total - licensed


def test_licenses(awkward, docs, empty, spark):
    texts = ["Released under the MIT License.\nbody", "x\nThis work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "The driver must show a license.", "You need permission.", "word " * 300 + "Licensed under the Apache License, Version 2.0. " + "tail " * 100, "a\n\n# ---\nb c\n \n\nAll rights reserved.\n"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.document_licenses(made).collect()}
    assert [got[i].families for i in range(8)] == ["MIT", "GPL", "CC-BY-NC", "Apache-2.0", "", "", "Apache-2.0", "Proprietary"]
    for df in (awkward, docs, made, docs.repartition(7), docs.dropDuplicates(["doc_id"])):
        want = sorted(((r.doc_id, *brute_licenses(r.text)) for r in df.collect()), key=str)
        assert sorted(rows(license_scan.document_licenses(df).drop("probability")), key=str) == want
    assert rows(license_scan.document_licenses(empty)) == []
