"""The registered queries: against DuckDB where SQL can say it, else against a plain version, on the sf0.01 tables."""

import hashlib
import math
from collections import Counter

from ledgerlens.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF01
from tests.llm import brute


def test_every_query_is_held_against_something():
    """test_oracles.py runs those with SQL; the others are below, the pipeline in test_edges.py."""
    assert set(ORACLE_SQL) == {"op1_url_filters", "op6_quality_rules", "op10_exact_dedup", "op11_conversation_trie", "op12_hard_negatives"}
    assert len(QUERIES) == 13


def test_packing(spark, pairs):
    brute.check_packing(pairs, QUERIES["op2_packing"](spark, SF01).collect())


def test_substrings(spark, pairs):
    want = brute.substring_dedup(pairs)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op3_substring_dedup"](spark, SF01).collect()}
    assert got == {doc: v for (doc, _), v in want.items()}


def test_simhash(spark, pairs):
    got = [tuple(r) for r in QUERIES["op4_simhash_near_dedup"](spark, SF01).collect()]
    assert sorted(got) == sorted(brute.simhash(pairs))


def test_token_counts(spark, pairs):
    tok = brute.tokenizer()
    want = [(d, len(t.encode()), n := len(tok.encode(t, add_special_tokens=False).ids), n > 2048) for d, t in pairs]
    assert sorted(map(tuple, QUERIES["op5_token_counts"](spark, SF01).collect())) == sorted(want)


def test_token_shards(spark, pairs):
    tok = brute.tokenizer()
    ids = {d: tok.encode(t, add_special_tokens=False).ids + [1] for d, t in pairs}
    got = QUERIES["op7_token_shards"](spark, SF01).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    cover = Counter()
    for r in got:
        assert (r["shard"], r["byte_offset"]) == (r["slot"] // 2048, r["slot"] % 2048 * 4098)
        x = [i for d in r["docs"] for i in ids[d["doc_id"]][d["start"]:d["start"] + d["length"]]]
        assert brute.crc(x + [1] * (2048 - len(x))) == r["ids_crc32"]
        for d in r["docs"]:
            cover[d["doc_id"]] += d["length"]
    assert cover == {d: len(x) for d, x in ids.items()}


def test_lines(spark, pairs):
    want = {d: (n, k, hashlib.sha256(t.encode()).hexdigest()) for (d, _), (n, k, t) in brute.line_dedup(pairs).items()}
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op8_line_dedup"](spark, SF01).collect()} == want


def test_mixing(spark, pairs, documents):
    """The exponent at which the most repeated source is repeated 1.3 times; every document once or twice, every source within one document of its budget."""
    size = {d: len(brute.words(t)) for d, t in pairs}
    totals = Counter()
    for r in documents.select("doc_id", "source").collect():
        totals[r["source"]] += size[r["doc_id"]]
    # repeats at full coverage are (largest share / smallest share) ** (1 - exponent)
    exponent = 1 - math.log(1.3) / math.log(max(totals.values()) / min(totals.values()))
    assert 0 < exponent < 1  # neither end of the bisection
    powers = {s: n ** exponent for s, n in totals.items()}
    weight = {s: p / sum(powers.values()) for s, p in powers.items()}
    whole = max(n / weight[s] for s, n in totals.items())
    times, used, longest = Counter(), Counter(), Counter()
    for r in QUERIES["op9_source_mixing"](spark, SF01).collect():
        times[r["doc_id"]] += 1
        used[r["source"]] += size[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], size[r["doc_id"]])
        assert abs(r["exponent"] - exponent) < 1e-6 and abs(r["weight"] - weight[r["source"]]) < 1e-6
    assert set(times) == set(size) and set(times.values()) <= {1, 2}
    for s, n in used.items():
        assert weight[s] * whole - longest[s] - 1 <= n <= weight[s] * whole + 1, s


def test_best_fit_packing(spark, pairs):
    n, lengths = brute.check_whole_packing(pairs, QUERIES["op13_best_fit_packing"](spark, SF01).collect())
    bins = []  # never more than first fit decreasing
    for x in sorted(lengths, reverse=True):
        at = next((i for i, b in enumerate(bins) if b + x <= 4096), None)
        if at is None:
            bins.append(x)
        else:
            bins[at] += x
    assert -(-sum(lengths) // 4096) <= n <= len(bins)
