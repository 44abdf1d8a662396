"""Operators that join or count over the whole table, against brute force."""

import itertools
import math
import random
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from gondola.functions.lineage import checkpoint_dir, cut_lineage
from gondola.llm import attention_lm, links, simhash, substring_dedup, warc
from gondola.llm.byte_bpe import BytePairs, Encoder
from gondola.llm.texts import Shared

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def roots(n, pairs):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(n)]


def near_bits(bits, budget=2):
    bits = np.array(bits, np.uint64)
    return [(i, i + 1 + int(j)) for i in range(len(bits))
            for j in np.flatnonzero(np.bitwise_count(bits[i + 1:] ^ bits[i]) <= budget)]


# Components and fingerprints

def test_components(spark):
    draw = random.Random(4)
    pairs = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 430)]
    table = spark.createDataFrame(pairs + [(5, 5), (None, 3)], "a long, b long")
    got = {r.u: r.v for r in links.components(table).collect()}
    want = roots(500, pairs)
    assert got == {k: w for k, w in enumerate(want) if k != w}
    assert links.components(table.where("a > 999")).count() == 0


@pytest.mark.parametrize("most", [20_000, 40])
def test_trie_join_finds_all_components(spark, most):
    draw = random.Random(3)
    values = {draw.getrandbits(64) for _ in range(60)} | {0, 1, 3, 7, (1 << 64) - 1}
    for value in sorted(values)[:20]:
        for _ in range(30):
            value ^= (1 << draw.randrange(64)) ^ (1 << draw.randrange(64))
            values.add(value)
    values |= {(0xABCD1234 << 32) | draw.getrandbits(12) for _ in range(400)}
    values = sorted(values)
    place = {v: k for k, v in enumerate(values)}
    signed = [(int(np.uint64(v).view(np.int64)),) for v in values]
    rows = simhash.fingerprint_links(spark.createDataFrame(signed, "bits long"), most).collect()
    got = [(place[r.u % (1 << 64)], place[r.v % (1 << 64)]) for r in rows]
    assert len(rows) < 8 * len(values)
    assert roots(len(values), got) == roots(len(values), near_bits(values))


@pytest.mark.parametrize("low_bits", [32, 14])
def test_links_across_nodes_of_a_cut_prefix(spark, low_bits):
    draw = random.Random(8)
    values = {draw.getrandbits(low_bits) for _ in range(600)}
    # Partners two bits away, one in each block of the remainder: they meet in one trie only.
    values |= {v ^ 1 << draw.randrange(16, 32) ^ 1 << draw.randrange(12) for v in sorted(values)[::2]}
    values = sorted(0x5EED << 48 | 0xF00D << 32 | v for v in values)
    place = {v: k for k, v in enumerate(values)}
    table = spark.createDataFrame([(v,) for v in values], "bits long")
    got = [(place[r.u], place[r.v]) for r in simhash.fingerprint_links(table, 40).collect()]
    assert roots(len(values), got) == roots(len(values), near_bits(values))
    rows = simhash._tries(table)
    levels = simhash._cut_levels(rows, rows.groupBy("trie", "prefix").count().where("count > 40"), 40)
    mine = [r.levels for r in levels.where("trie = 0").collect()]
    nodes = [Counter((v & 0xFFFFFFFF) >> 32 - k for v in values) for k in (mine[0] - 1, mine[0])]
    assert len(mine) == 1 and max(nodes[0].values()) > 40 >= max(nodes[1].values())


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    spans = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_components(docs):
    given = [(r.doc_id, r.text) for r in docs.collect()]
    bits = [plain_fingerprint(t) for _, t in given]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(docs).collect()}
    least = {}
    for (key, _), root in zip(given, roots(len(bits), near_bits(bits))):
        least.setdefault(root, []).append(key)
    want = {k: min(v) for v in least.values() for k in v}
    assert got == {key: (f"{b:016x}", want[key]) for (key, _), b in zip(given, bits)}
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_simhash_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, 1), (5, "", 2), (5, "", 3), (7, "A b c d e", 1), (7, "a b c d e", 1)],
                                 "doc_id long, text string, bits int")
    got = [tuple(r) for r in simhash.simhash_components(rows).collect()]
    assert len(got) == 5 and {g[2] for g in got if g[1] == "0" * 16} == {5} and got.count(got[-1]) >= 2
    assert sorted(r.doc_id for r in simhash.keep_one_of_each(rows).collect()) == [5, 7]
    assert simhash.simhash_components(rows.where("bits > 9")).count() == 0
    assert simhash.keep_one_of_each(rows.where("bits > 9")).count() == 0


# Language model

def test_gradients():
    net = attention_lm.Network(50, np.zeros(attention_lm.CLASSES))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.mask, net.direct = net.mask.astype(np.float64), net.direct.astype(np.float64)
    draw = np.random.default_rng(0)
    x, target = draw.integers(0, 50, (3, 32)), draw.integers(0, attention_lm.CLASSES, (3, 32))
    used = draw.random((3, 32)) < 0.8

    def loss():
        logs = net.log_classes(x, net.forward(x)["z"])
        return -(np.take_along_axis(logs, target[..., None], 2)[..., 0] * used).sum() / used.sum()

    for name, g in net.gradients(x, target, used).items():
        at = (x[0, 3], 2) if name == "embed" else tuple(draw.integers(0, s) for s in g.shape)
        net.p[name][at] += 1e-5
        up = loss()
        net.p[name][at] -= 2e-5
        down = loss()
        net.p[name][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1e-2, abs(g[at]))


def test_each_subword_is_scored_once_and_probabilities_add_up():
    draw = np.random.default_rng(1)
    counts = draw.integers(0, 50, 3000)
    model = attention_lm.Model(counts)
    sizes = [1, 31, 32, 33, 60, 61, 200]
    ends = np.cumsum([0, *sizes])
    text, first, scored, size = attention_lm.windows(ends)
    met = np.zeros(ends[-1], int)
    for f, s, n in zip(first, scored, size):
        met[f + s:f + n] += 1
    assert (met == 1).all()
    ids = draw.integers(0, 3000, int(ends[-1]))
    both = model.score(ids, ends)
    alone = [model.score(ids[a:b], np.array([0, b - a])) for a, b in zip(ends, ends[1:])]
    assert np.allclose(both, np.concatenate(alone), atol=1e-4)
    # What may follow has probability one in all: classes, and subwords inside a class.
    z = model.network.forward(np.zeros((1, 32), int))["z"]
    assert np.allclose(np.exp(model.network.log_classes(np.zeros((1, 32), int), z)).sum(-1), 1, atol=1e-4)
    inside = np.bincount(model.class_of, weights=np.exp(model.inside))
    assert np.allclose(inside[inside > 0], 1)


def test_scores(spark, docs):
    more = docs.select("doc_id", "text").union(spark.createDataFrame(
        [(None, None), (900, ""), (901, "the  \x85 <|endoftext|>"), (901, "the  \x85 <|endoftext|>")],
        "doc_id long, text string"))
    rows = attention_lm.score_texts(more, PATH, steps=40).collect()
    given = [(r.doc_id, r.text or "") for r in more.collect()]
    crc = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5
    counts = Counter()
    for key, text in given:
        if crc(key) != 1:
            counts.update([*text.encode().lower().split(), "end"])
    total, distinct = sum(counts.values()), len(counts)
    want = []
    for key, text in given:
        words = [*text.encode().lower().split(), "end"]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        want.append((key, crc(key) == 1, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert attention_lm.score_texts(more.where("doc_id > 9999"), PATH, steps=1).count() == 0


def test_large_blocks_are_split_and_weights_averaged_over_parts(spark, docs, monkeypatch):
    few = docs.where("doc_id < 40").select("doc_id", "text", F.lit(1).alias("word"), F.lit("x").alias("block"),
                                           F.lit(True).alias("held_out"), F.lit(9).alias("part"))
    hot = few.union(few.where("doc_id = 3").select(
        *few.columns, F.explode(F.sequence(F.lit(1), F.lit(60)))).drop("col"))
    whole = sorted(tuple(r)[:-1] for r in attention_lm.score_texts(hot, PATH, steps=5).collect())
    monkeypatch.setattr(attention_lm, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(attention_lm, "PART_BYTES", 20_000)
    monkeypatch.setattr(attention_lm, "PART_SHARE", 0.5)
    assert attention_lm._dealt(hot, 5, 1)[1] is not None
    rows = attention_lm.score_texts(hot, PATH, steps=5).collect()
    assert [r[:5] for r in whole] == [r[:5] for r in sorted(tuple(r)[:-1] for r in rows)]
    assert np.allclose([r[5] for r in whole], [r[5] for r in sorted(tuple(r)[:-1] for r in rows)])
    assert all(math.isfinite(r.score) and r.score < 0 for r in rows)
    same = [r.score for r in rows if r.doc_id == 3]
    assert len(same) == 61 and np.ptp(same) < 1e-4  # products of single precision


def test_the_network_learns_from_every_window(spark, docs, monkeypatch):
    """All windows of all training rows are dealt out, however many a text has, and each is used once."""
    pairs = Shared(spark, BytePairs(PATH))
    rows, _ = attention_lm._dealt(docs.where("doc_id < 30").select("doc_id", "text"), 5, 1)
    model = attention_lm.Model(np.arange(len(pairs.value.token_bytes), 0, -1))
    monkeypatch.setattr(attention_lm, "WINDOWS_PER_TEXT", 1)
    encoder, want = Encoder(pairs.value, special=False), 0
    for r in rows.where("NOT held_out").collect():
        ids, _ = attention_lm.encoded(encoder, r.text.encode().lower().split())
        want += len(attention_lm.windows(np.array([0, len(ids) + 1]))[0])
    assert attention_lm.PART_SHARE == 1
    got = attention_lm.drawn_windows(rows, model, pairs, attention_lm.PART_SHARE).toArrow()
    assert got.num_rows == want > rows.count()
    seen = []
    monkeypatch.setattr(attention_lm.Network, "gradients", lambda self, x, target, used: seen.extend(x[:, 0]) or {})
    model.network.fit(np.arange(300 * 32).reshape(300, 32), np.zeros((300, 32), int), np.ones((300, 32), bool), None)
    assert sorted(seen) == list(range(0, 300 * 32, 32))


def test_fast_scores_equal_the_plain_network():
    draw = np.random.default_rng(2)
    model = attention_lm.Model(draw.integers(0, 50, 3000))
    net = model.network
    net.set_direct(draw.integers(0, 9, net.direct.shape))
    ids, ends = draw.integers(0, 3000, 300), np.array([0, 7, 39, 300])
    got = model.score(ids, ends)
    x, want = model.inputs(ids, ends), np.empty(300)
    for text, first, scored, size in zip(*attention_lm.windows(ends)):
        window = np.zeros(attention_lm.WIDTH, int)
        window[:size] = x[first:first + size]
        logs = net.log_classes(window[None], net.forward(window[None])["z"])[0]
        for k in range(scored, size):
            want[first + k] = logs[k, model.class_of[ids[first + k]]] + model.inside[ids[first + k]]
    assert np.allclose(got, want, atol=1e-3)


def test_pair_counts_against_brute_force(spark):
    model = attention_lm.Model(np.arange(40, 0, -1))
    words = [([3, 4, 4], 2), ([7], 5), ([3, 4], 1)]
    rows = spark.createDataFrame([(b"".join(i.to_bytes(4, "little") for i in ids), c, True) for ids, c in words],
                                 "ids binary, c long, first boolean")
    want = np.zeros((attention_lm.KNOWN_INPUTS + attention_lm.HASHED_INPUTS, attention_lm.CLASSES))
    firsts = Counter({39: 6})  # six ends
    for ids, c in words:
        firsts[ids[0]] += c
        for a, b in zip(ids, ids[1:]):
            want[model.input_of[a], model.class_of[b]] += c
    ends = Counter({39: 6})
    for ids, c in words:
        ends[ids[-1]] += c
    for a, n in ends.items():
        for b, m in firsts.items():
            want[model.input_of[a], model.class_of[b]] += n * m / sum(firsts.values())
    assert np.allclose(attention_lm.pair_counts(rows, model, 6), want)


# Shared passages

def test_compact_windows_cover_each_stretch_once():
    draw = np.random.default_rng(2)
    values = draw.integers(0, 1 << 62, 90).astype(np.uint64)
    values[40:60] = values[10:30]
    ends = np.array([0, 35, 35, 90])
    low, place, high = substring_dedup.compact_windows(values, ends, 8)
    assert (high - low >= 8).all()
    for a, b in zip(ends, ends[1:]):
        for i in range(a, b):
            for j in range(i + 7, b):
                holds = (low <= i) & (i <= place) & (place <= j) & (j < high)
                assert holds.sum() == 1
                assert values[place[holds]][0] == values[i:j + 1].min()


def test_shared_passages(spark):
    draw = random.Random(2)
    stock = ["".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    some = lambda n: [draw.choice(stock) for _ in range(n)]
    whole, edited, short = some(60), some(120), some(40)
    rows = []
    for k in range(120):
        words = some(draw.randint(5, 300))
        at = draw.randrange(len(words))
        put = {0: whole, 5: short[:45]}.get(k % 10, [])
        if k % 10 == 3:
            put = list(edited)
            put[draw.randrange(120)] = "zzz"
        rows.append((k, " ".join([*words[:at], *put, *words[at:]]), k))
    rows += [(1000, rows[7][1], 1), (1001, None, 1), (1002, "", 1), (None, rows[7][1], 1), (1000, rows[7][1], 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string, key int")
    got = {r.doc_id: r for r in substring_dedup.passage_classes(table).collect()}
    groups = [set(range(0, 120, 10)), set(range(3, 120, 10))]
    if len(rows[7][1].split()) >= 50:
        groups.append({7, 1000})
    assert set(got) == set.union(*groups)
    for group in groups:
        assert {got[k].class_id for k in group} == {min(group)}
    for k in sorted(groups[0])[1:]:
        text = rows[k][1].split()
        assert any(text[p.start:p.end] == whole for p in got[k].passages)
    assert substring_dedup.passage_classes(table.where("doc_id > 5000")).count() == 0


@pytest.mark.parametrize("groups, size, length, edits", [(12, 20, 60, 1), (2, 100, 60, 1), (1, 1000, 100, 2)])
def test_recall_in_groups_of_edited_copies(spark, groups, size, length, edits):
    """Truth is the exact similarity of every pair of copies."""
    draw = random.Random(size)
    word = lambda: f"w{draw.randrange(20000)}"
    some = lambda n: [word() for _ in range(n)]
    rows, true = [], []
    for _ in range(groups):
        passage, copies = some(length), []
        for _ in range(size):
            copy = list(passage)
            for place in draw.sample(range(length), edits):
                copy[place] = word()
            shingles = {tuple(copy[i:i + 5]) for i in range(length - 4)}
            copies.append((len(rows), shingles))
            rows.append((len(rows), " ".join([*some(draw.randint(30, 120)), *copy, *some(draw.randint(30, 120))])))
        true += [(a, b) for (a, x), (b, y) in itertools.combinations(copies, 2)
                 if len(x & y) >= 0.8 * len(x | y)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.passage_classes(table).collect()}
    wanted = {d for pair in true for d in pair}
    assert len(wanted & set(got)) >= 0.95 * len(wanted)
    together = sum(a in got and b in got and got[a].class_id == got[b].class_id for a, b in true)
    assert together >= 0.95 * len(true)
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())
    for r in got.values():  # classes do not reach beyond the planted groups
        assert r.class_id // size == r.doc_id // size


def test_long_copies_meet_their_neighbours_too(spark):
    """Equal words about a window and the first of its group do not keep it from meeting the others."""
    draw = random.Random(12)
    some = lambda n: [f"w{draw.randrange(50000)}" for _ in range(n)]
    passage, more = some(300), some(200)
    rows = [(1, " ".join(passage)), (2, " ".join([*passage, *more])), (3, " ".join([*passage, *more]))]
    links = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.match_id, r.start, r.end) for r in links} == {
        (2, 1, 0, 300), (3, 1, 0, 300), (3, 2, 0, 500)}
    windows = substring_dedup.window_rows(spark.createDataFrame(
        [(k, " ".join(passage)) for k in range(4)], "doc_id long, text string"))
    # Of a group of four equal windows each but the first meets the first and the one before it.
    met = substring_dedup.joined_windows(windows).groupBy("doc_id", "other_id").count().collect()
    assert {(r.doc_id, r.other_id) for r in met} == {(1, 0), (2, 0), (3, 0), (2, 1), (3, 2)}


def test_long_texts_and_one_stretch_for_overlapping_ones(spark):
    draw = random.Random(8)
    some = lambda n: [f"w{draw.randrange(50000)}" for _ in range(n)]
    long = some(200_000)
    moved = [*long[:90_000], *some(40), *long[90_000:]]
    rows = [(1, " ".join(long)), (2, " ".join(moved)), (3, " ".join([*some(30), *long[150_000:150_080]])),
            (4, " ".join(some(1000)))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    links = substring_dedup.repeated_passages(table).collect()
    by_pair = defaultdict(list)
    for r in links:
        by_pair[r.doc_id, r.match_id].append((r.start, r.end))
    assert set(by_pair) >= {(2, 1)} and {d for pair in by_pair for d in pair} == {1, 2, 3}
    for found in by_pair.values():
        found.sort()
        assert all(a[1] <= b[0] for a, b in zip(found, found[1:]))
    assert sum(end - start for start, end in by_pair[2, 1]) >= 199_000
    text = rows[2][1].split()
    assert any(text[r.start:r.end] == long[150_000:150_080] for r in links if r.doc_id == 3)


def test_pairs_at_once_tell_what_single_pairs_tell():
    """Most pairs are settled by one sort of all, with the same stretches as one by one."""
    draw = np.random.default_rng(3)
    mine, theirs = [], []
    for k in range(600):
        a = draw.integers(0, draw.choice([3, 40, 1 << 31]), draw.integers(1, 160)).astype("<u4")
        a = np.tile(a, 2) if k % 5 == 0 else a
        b = a.copy() if k % 3 else draw.integers(0, 1 << 31, 90).astype("<u4")
        b[draw.integers(0, len(b), k % 4)] += 1
        mine.append(a)
        theirs.append(np.roll(b, k % 7))
    told = substring_dedup._plain_pairs(mine, theirs, 20, 0.8)
    single = [substring_dedup._stretches(a, b, 20, 0.8) for a, b in zip(mine, theirs)]
    assert all(t is None or t == s for t, s in zip(told, single))
    assert sum(t is not None for t in told) > 200 and any(told) and [] in told
    assert substring_dedup._plain_pairs([], [], 20, 0.8) == []


def test_a_cut_may_drop_the_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    assert sorted(r.id for r in cut_lineage(spark.range(9).repartition("id"), drop_shuffles=True).collect()) == [*range(9)]
    assert spark.conf.get(name) == before


def test_exact_copies_with_returning_phrases():
    passage = np.arange(76, dtype=np.uint32) + 7
    passage[40:42] = passage[2:4]
    apart = np.arange(30, dtype=np.uint32) + 1000
    assert substring_dedup._stretches(passage, passage, 46, 0.8) == [(0, 76, 0, 76, 1.0)]
    # In the other text the phrase is also there before the passage.
    other = np.concatenate([passage[2:4], apart, passage])
    assert substring_dedup._stretches(passage, other, 46, 0.8) == [(0, 76, 32, 108, 1.0)]
    for period in (12, 20, 30, 40):
        lines = np.arange(600, dtype=np.uint32) % period
        assert substring_dedup._stretches(lines, lines, 46, 0.8) == [(0, 600, 0, 600, 1.0)]


def test_copies_of_repetitive_texts(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(5))
    texts = [" ".join([word() for _ in range(n)] * (604 // n)) for n in (12, 20, 30, 40)]
    texts.append(" ".join(word() for _ in range(200)))
    rows = [(10 * k + c, t) for k, t in enumerate(texts) for c in range(2)] + [(99, texts[4][:90])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in substring_dedup.passage_classes(table).collect()}
    assert got == {10 * k + c: 10 * k for k in range(5) for c in range(2)}


def test_both_parts_of_a_run_that_is_not_alike():
    one, two = np.arange(56, dtype=np.uint32) + 1000, np.arange(51, dtype=np.uint32) + 2000
    a, b = (np.concatenate([one, np.arange(24, dtype=np.uint32) + k, two]) for k in (0, 100))
    assert substring_dedup._stretches(a, b, 46, 0.8) == [(0, 56, 0, 56, 1.0), (80, 131, 80, 131, 1.0)]
    # The larger part is scattered and fails; the smaller holds.
    b = np.concatenate([two, np.arange(24, dtype=np.uint32), np.arange(160, dtype=np.uint32) + 4000])
    a = b.copy()
    a[51:75] += 100
    a[75:][np.arange(160) % 3 == 0] += 5000
    assert substring_dedup._stretches(a, b, 46, 0.8)[0][:4] == (0, 51, 0, 51)


# Archives

def test_loser_tree():
    draw = random.Random(6)
    for n in (0, 1, 2, 3, 7, 8, 9):
        runs = [sorted(draw.randrange(20) for _ in range(draw.randint(0, 9))) for _ in range(n)]
        got = list(warc.LoserTree([iter(r) for r in runs], lambda x: x))
        assert got == sorted(x for r in runs for x in r)


def test_archives_of_odd_pages(spark):
    tricky = "z" * 1500 + "WARC/1.1\r\nWARC-Type: x\r\n\r\n\r\n"
    rows = [(1, None, None, 0), (2, "http://x.y/a b\r\nc", tricky, 0), (3, "http://x.y:8080/", tricky, 0),
            (None, "http://x.y:8080/", tricky, 0), (4, "http://[bad", "WARC/1.1\r\n", 0), (4, "http://[bad", "WARC/1.1\r\n", 0),
            (5, "https://www.x.y/é?q=1#f", "é" * 600, 0), (5, "https://www.x.y/é?q=1#f", "é" * 600, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int").repartition(3)
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    got = warc.archived_pages(pages, folder).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in got), key=str) == sorted([
        (1, "response", None), (2, "revisit", 3), (3, "response", None), (None, "revisit", 3),
        (4, "response", None), (4, "response", None), (5, "response", None), (5, "response", None)], key=str)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    payloads = sorted(bytes(r.payload).decode() for r in warc.read_records(spark, folder).collect()
                      if r.record_type == "response")
    assert payloads == sorted(["", tricky, "WARC/1.1\r\n", "WARC/1.1\r\n", "é" * 600, "é" * 600])
    empty = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    assert warc.archived_pages(pages.where("page_id > 99"), empty).count() == 0


def test_history_is_one_order_over_many_merges(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").repartition(4)
    folder = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write_archives(pages, folder)
    rows = warc.capture_history(warc.capture_runs(spark, folder), rows_per_merge=9).collect()
    keys = [(r.url_key, r.captured) for r in rows]
    assert len(keys) == pages.count() and keys == sorted(keys) and len({r.run for r in rows}) > 1
