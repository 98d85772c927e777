"""Conversation trie, hard negatives and best-fit packing on awkward rows and on no rows, against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest

from ledgerlens.llm import bestfit, hard_negatives, trie
from tests.conftest import SF01
from tests.llm import brute


def key(row):
    return tuple((x is None, x) for x in row)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


# conversation trie ---------------------------------------------------------------------
def conversation_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, copies, absent heads, negative and huge ids, long conversations."""
    rnd = random.Random(3)
    out = []
    for c in [*range(-150, 500), 10**12 + 5]:
        if c % 100 == 0 and c % 200:
            continue
        for t in range(rnd.randint(1, 9) if c % 77 else 60):
            text = "copy" if c % 5 == 0 else rnd.choice(("hé", "b", None, "", "x" * 3000, "z\u0000z"))
            out.append((c, t if rnd.random() < 0.97 else None, rnd.choice(("u", "a", None)) if rnd.random() < 0.2 else "u", text, t, "k", None))
    return out + out[:3] + [(None, 1, "u", "x", 1, "k", 0)]


TURNS = "conv_id long, turn long, role string, text string, depth int, key string, shard int"


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_trie(spark, shards):
    """The same nodes however many shards their boundaries cut."""
    given = conversation_rows()
    df, before = spark.createDataFrame(given, TURNS), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(shards))
    try:
        got = rows(trie.trie_nodes(trie.rebuilt(trie.conversations(df))))
        assert trie.trie_nodes(trie.rebuilt(trie.conversations(df.limit(0)))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(brute.trie([r[:4] for r in given]), key=key)


def test_trie_of_turnless_conversations(spark):
    """A conversation that is rebuilt to nothing ends at the root."""
    ids = [c for c in range(1, 400) if c % 100]
    given = [(c, 0, "u", "t") for c in ids]
    got = rows(trie.trie_nodes(trie.rebuilt(trie.conversations(spark.createDataFrame(given, "conv_id long, turn long, role string, text string")))))
    assert got == sorted(brute.trie(given), key=key) and got[0][3] == len(ids) and got[0][4] == 1


def test_first_change():
    """Order and first own depth of each row, long rows over several bands of columns included."""
    rnd = random.Random(1)
    seqs = [[rnd.randint(0, 1) for _ in range(rnd.choice((0, 1, 2, 5, 30)))] for _ in range(200)]
    seqs += [seqs[0], seqs[7], [1] * 40, [1] * 40 + [0], [1] * 39]
    size = np.array([len(s) for s in seqs])
    order, change = trie.first_change(np.array(sum(seqs, [])), np.cumsum(size) - size, size)
    assert order.tolist() == sorted(range(len(seqs)), key=lambda i: (seqs[i], i))
    for a, b, c in zip(order, order[1:], change[1:]):
        same = next((k for k, (x, y) in enumerate(zip(seqs[a], seqs[b])) if x != y), min(len(seqs[a]), len(seqs[b])))
        assert c == same + 1
    assert change[0] == 1


def test_ends_of_a_node_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(trie, "_ENDS", 3)
    given = [(c * 100, t, "u", "same") for c in range(-30, 60) for t in range(2)]
    got = rows(trie.trie_nodes(trie.conversations(spark.createDataFrame(given, "conv_id long, turn long, role string, text string"))))
    assert [r[-1] for r in got if r[1] == 2] == [brute.hashlib.sha256(",".join(str(c * 100) for c in range(-30, 60)).encode()).hexdigest()]


# hard negatives ------------------------------------------------------------------------
@pytest.mark.parametrize("most, width", [(300, 64), (10**6, 70), (10**8, 3), (2, 5000)])
def test_residue_products_are_exact(most, width):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-most, most, (7, width)), rng.integers(-most, most, (9, width))
    a[0], b[0], b[1] = -most, most, -most
    primes = hard_negatives.primes_for(width * most * most)
    got = hard_negatives.scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
    assert got.tolist() == [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]


def test_one_prime_less_would_not_do():
    """The residues decide: with fewer primes than the bound asks for, scores wrap around."""
    a = np.full((1, 64), 255)
    primes = hard_negatives.primes_for(64 * 255 * 255)
    few = primes[:-1]
    assert len(primes) == 3 and hard_negatives.scores(hard_negatives.residues(a, few), hard_negatives.residues(a, few), few)[0, 0] != 64 * 255 * 255
    with pytest.raises(ValueError):
        hard_negatives.primes_for(1 << 62)


def vector_rows():
    """Null ids, labels, vectors and components, not finite ones, other lengths, repeated rows, ties and zero vectors."""
    rnd = random.Random(2)
    out = []
    for i in range(400):
        v = [rnd.gauss(0, 0.2) + (0.3 if i % 3 else 0) for _ in range(rnd.choice((6, 6, 6, 5)))]
        out.append((i, [float(np.float32(x)) for x in v], rnd.randrange(4), 7, 1))
    return out + [out[50], out[50], out[3], (None, out[1][1], 1, 0, 0), (500, None, 1, 0, 0), (501, [], 2, 0, 0), (502, [None, 1.0], 2, 0, 0), (503, [float("nan")], 1, 0, 0),
                  (505, [float("-inf")], 1, 0, 0), (504, out[9][1], None, 0, 0), (550, [0.0] * 6, 2, 0, 0), (600, out[1][1], 1, None, None)]


@pytest.mark.parametrize("blocks", [{}, {"row_block": 37, "anchor_block": 5}])
def test_hard_negatives(spark, blocks):
    given = vector_rows()
    df = spark.createDataFrame(given, "vec_id long, embedding array<float>, label int, uid int, score long")
    assert rows(hard_negatives.hard_negatives(hard_negatives.relabelled(df), **blocks)) == sorted(brute.hard_negatives([r[:3] for r in given]), key=key)
    assert hard_negatives.hard_negatives(df.limit(0), **blocks).count() == 0
    assert hard_negatives.hard_negatives(df.where("vec_id = 51"), **blocks).count() == 0


def test_scores_beyond_64_bits_are_an_error(spark):
    df = spark.createDataFrame([(50, [1e30, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError):
        hard_negatives.hard_negatives(df)


# best-fit packing ----------------------------------------------------------------------
def test_dominance_keeps_a_best_packing():
    """What the reduction fixes is in some best packing, found by search; sets of one, two and three pieces occur."""
    rnd, kinds = random.Random(1), Counter()
    for _ in range(1500):
        capacity = rnd.choice((10, 20, 30, 50))
        least = rnd.choice((1, capacity // 6 + 1, capacity // 4 + 1))
        items = Counter(rnd.randint(least, capacity) for _ in range(rnd.randint(1, 9)))
        fixed, left = bestfit.dominating_sets(dict(items), capacity)
        used, n = Counter(), sum(times for _, times in fixed)
        for content, times in fixed:
            assert sum(s * k for s, k in content) <= capacity
            kinds[sum(k for _, k in content)] += times
            for s, k in content:
                used[s] += k * times
        assert used + Counter(left) == items
        assert brute.best_bins(items.elements(), capacity) == n + brute.best_bins(Counter(left).elements(), capacity)
    assert set(kinds) == {1, 2, 3}


def test_best_fit_is_that_of_single_pieces():
    rnd = random.Random(4)
    for _ in range(300):
        capacity = rnd.choice((10, 37, 100))
        items, rooms = Counter(rnd.randint(1, capacity) for _ in range(rnd.randint(0, 60))), []
        for x in sorted(items.elements(), reverse=True):
            fit = min((r for r in rooms if r >= x), default=None)
            if fit is None:
                rooms.append(capacity - x)
            else:
                rooms[rooms.index(fit)] -= x
        got = bestfit.best_fit(dict(items), capacity)
        assert sorted(rooms) == sorted(capacity - sum(s * k for s, k in c) for c, times in got for _ in range(times))


def test_plan_does_not_grow_with_the_corpus():
    rnd = random.Random(5)
    few = {s: rnd.randint(1, 3) for s in range(1, 1025)}
    many = {s: rnd.randint(1, 10**9) for s in range(1, 1025)}
    plans = [bestfit.patterns(c, 1024) for c in (few, many)]
    assert all(len(p) < 3 * 1024 for p in plans)
    for counts, plan in zip((few, many), plans):
        n = sum(times for _, times in plan)
        assert n <= 1.01 * sum(s * k for s, k in counts.items()) / 1024 + 2


def test_whole_packing(awkward, awkward_pairs, no_docs):
    for capacity in (4096, 64):
        brute.check_whole_packing(awkward_pairs, bestfit.pack_whole(awkward, capacity).collect(), capacity)
    assert bestfit.pack_whole(no_docs).count() == 0


def test_pieces_of_one_length_share_sequences(spark):
    """A third of all documents of one length: numbered over all tasks, none twice in a place."""
    docs = [(i, "one two three") for i in range(3000)] + [(i, " ".join(["word"] * (i % 50))) for i in range(3000, 6000)]
    n, lengths = brute.check_whole_packing(docs, bestfit.pack_whole(spark.createDataFrame(docs, "doc_id long, text string").repartition(13, "doc_id"), 100).collect(), 100)
    assert n <= -(-sum(lengths) // 100) + 1


def test_trie_on_long_conversations(spark):
    """The sf0.01 conversations without rebuilding: every depth of the longest."""
    df = spark.read.parquet(f"{SF01}/conversations.parquet")
    got = {(r["conv_id"], r["depth"]) for r in trie.trie_nodes(trie.conversations(df)).collect()}
    assert (df.groupBy("conv_id").count().agg({"count": "max"}).first()[0]) == max(d for _, d in got)
