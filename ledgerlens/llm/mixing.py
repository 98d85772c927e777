"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations.

1. Tokens (words) per source, counted map-side.
2. Weights are the token shares to the power of an exponent (0: equal weights,
   1: as they are), normalised. The exponent is bisected until
   the mix has the target entropy (as a share of the largest possible), or
   until the most repeated source is repeated ``max_repeat`` times: the
   flattest mix within both limits. One Spark job evaluates the 63 inner
   points of six bisection steps at once, over the table of sources.
3. Budgets. By default the smallest total that uses every document at least
   once: no source is cut short, those below their weight are repeated. An
   explicit ``budget_tokens`` may also cut sources short.
4. A source's documents are dealt into blocks by hash. Each pass over a source
   is a permutation of its blocks, and of the documents within; a budget is
   some whole passes and the first blocks of one more, up to a hash threshold
   inside one block. So what a document needs to know is its block's number of
   whole passes and the threshold of the last pass: a table of at most
   ``blocks`` rows a source, joined to the documents. No window or group
   holds more than the ``blocks`` rows of a source, or one block's documents.

All of it is DataFrame expressions. Text is read twice (to count its words, to
return it) and never shuffled while the block table is small.

Defined results: null source is a source of its own. Null or blank text has no
words; such documents are in every whole pass. A source without any words is
passed over once. Rows that repeat doc_id and text have the same hash and are
taken or left together. Budgets are met to within one document (or its
repeats) a source. No rows: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, discard, small, text_of, written

#: Points that one job evaluates: six halvings.
_STEPS = 6


def n_words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def source_totals(docs: DataFrame) -> DataFrame:
    """source, docs, tokens, share of all tokens (of sources that have any); written."""
    t = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    t = written(t, "source-totals")
    whole = t.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("s"))
    return t.withColumn("share", F.try_divide(F.col("tokens").cast("double"), whole.scalar().cast("double")))


def _mixes(totals: DataFrame, points: list[float]) -> dict[float, tuple[float, float]]:
    """exponent -> (entropy as a share of the largest, repeats of the most repeated source at full coverage)."""
    t = totals.where("tokens > 0").select("share", F.explode(F.array(*[F.lit(p) for p in points])).alias("e"))
    w = F.pow("share", F.col("e"))
    # with z the sum of w: entropy = log z - sum(w log w) / z; repeats of a source at full coverage: share ** (e - 1), by the least of them
    agg = t.groupBy("e").agg(F.sum(w).alias("z"), F.sum(w * F.col("e") * F.ln("share")).alias("wl"), F.count(F.lit(1)).alias("k"),
                             F.max(F.pow("share", F.col("e") - 1)).alias("most"), F.min(F.pow("share", F.col("e") - 1)).alias("least"))
    out = {}
    for r in agg.collect():  # a row a point
        entropy = (math.log(r["z"]) - r["wl"] / r["z"]) / math.log(r["k"]) if r["k"] > 1 else 1.0
        out[r["e"]] = (entropy, r["most"] / r["least"] if r["least"] else math.inf)
    return out


def _bisect(totals: DataFrame, holds, lo: float, hi: float, rounds: int) -> tuple[float, float]:
    """(a, b) close together in [lo, hi]: ``holds`` not at a, at b. It must hold from some exponent on, at hi at the latest."""
    for _ in range(rounds):
        points = [lo + (hi - lo) * i / (1 << _STEPS) for i in range(1, 1 << _STEPS)]
        found = _mixes(totals, points)
        for p in points:
            if holds(found[p]):
                hi = p
                break
            lo = p
    return lo, hi


#: The sharpest mix: all but the largest source are next to nothing.
_MOST = 16.0


def bisect_exponent(totals: DataFrame, target_entropy: float | None, max_repeat: float | None, rounds: int = 5) -> float:
    """The least exponent whose mix has at most the target entropy and repeats no source more than max_repeat times.

    Entropy falls as the exponent rises, and repeats fall to one at the
    exponent one, so up to there both are one condition to bisect. An entropy
    below that of the shares themselves needs an exponent above one, where
    repeats rise again; the repetition limit wins.
    """
    def fits(m: tuple[float, float]) -> bool:
        return (target_entropy is None or m[0] <= target_entropy) and (max_repeat is None or m[1] <= max_repeat)

    ends = _mixes(totals, [0.0, 1.0, _MOST])
    if not ends or fits(ends[0.0]):
        return 0.0
    if target_entropy is None or ends[1.0][0] <= target_entropy:
        return _bisect(totals, fits, 0.0, 1.0, rounds)[1]
    e = _bisect(totals, lambda m: m[0] <= target_entropy, 1.0, _MOST, rounds)[1]
    if max_repeat is not None and ends[_MOST][1] > max_repeat:
        e = min(e, _bisect(totals, lambda m: m[1] > max_repeat, 1.0, _MOST, rounds)[0])
    return e


def weights(totals: DataFrame, exponent: float, budget_tokens: int | None) -> DataFrame:
    """source, docs, tokens, share, weight, budget, passes (whole ones), rest (tokens of the last, partial pass)."""
    w = totals.withColumn("w", F.when(F.col("tokens") > 0, F.pow("share", F.lit(exponent))))
    z = w.agg(F.sum("w").alias("z"))
    w = w.withColumn("weight", F.col("w") / z.scalar())
    if budget_tokens is None:
        total = w.agg(F.max(F.col("tokens") / F.col("weight")).alias("t")).scalar()
    else:
        total = F.lit(float(budget_tokens))
    budget = F.when(F.col("tokens") > 0, F.greatest(F.round(F.col("weight") * total).cast("long"), F.lit(0)))
    if budget_tokens is None:  # rounding must not cut the source that sets the total
        budget = F.greatest(budget, F.col("tokens"))
    w = w.withColumn("budget", budget)
    passes = F.coalesce(F.try_divide(F.col("budget").cast("double"), F.col("tokens").cast("double")), F.lit(1.0))
    return w.select("source", "docs", "tokens", "share", "weight", "budget", F.floor(passes).alias("passes"),
                    F.coalesce(F.col("budget") - F.floor(passes) * F.col("tokens"), F.lit(0)).alias("rest"))


def _hash(seed: int, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _block(hash_: str, blocks: int) -> Column:
    return F.pmod(F.col(hash_), F.lit(blocks)).cast("int")


def block_plan(docs: DataFrame, per_source: DataFrame, blocks: int, seed: int) -> DataFrame:
    """source, block, passes, until, exponent, weight: whole passes and the largest order value that the partial pass takes (null: none); written.

    ``docs`` has source, tokens, hash. The partial pass goes through a source's blocks in the order of
    a hash of (source, block), and through a block's documents in the order of ``_order``.
    """
    at = docs.select("source", "tokens", _block("hash", blocks).alias("block"), _order(seed).alias("order"))
    sums = written(at.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "blocks")
    turn = Window.partitionBy("source").orderBy(_hash(seed + 1, "source", "block"), "block")
    s = per_source.select(F.col("source").alias("s"), "passes", "rest", "exponent", "weight")
    b = sums.join(small(written(s, "passes")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    b = b.withColumn("before", F.sum("tokens").over(turn) - F.col("tokens"))
    b = written(b.withColumn("left", F.col("rest") - F.col("before")), "block-budgets")
    # the one block of each source in which its budget ends
    last = b.where((F.col("left") > 0) & (F.col("left") < F.col("tokens"))).select(
        F.col("source").alias("s"), F.col("block").alias("b"), "left")
    inside = at.join(F.broadcast(last) if last.count() <= 65_536 else last, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    walk = Window.partitionBy("s", "b").orderBy("order").rangeBetween(Window.unboundedPreceding, 0)
    ends = (inside.withColumn("sum", F.sum("tokens").over(walk)).where(F.col("sum") <= F.col("left"))
            .groupBy("s", "b").agg(F.max("order").alias("end")))
    plan = b.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left")
    until = F.when(F.col("left") >= F.col("tokens"), F.when(F.col("rest") > 0, F.lit(2**63 - 1))).when(F.col("left") > 0, F.col("end"))
    return written(plan.select("source", "block", F.col("passes").cast("int").alias("passes"), until.alias("until"), "exponent", "weight"), "plan")


def _order(seed: int) -> Column:
    """Order of a document in its block's passes."""
    return _hash(seed + 2, "hash")


def mix_plan(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 2.0, budget_tokens: int | None = None,
             blocks: int = 1024, seed: int = 29) -> tuple[DataFrame, DataFrame]:
    """(weights by source, plan by source and block) for ``docs`` (doc_id, text, source)."""
    d = docs.select("source", n_words().alias("tokens"), _hash(seed, "doc_id", "text").alias("hash"))
    d = written(d, "words")
    totals = source_totals(d)
    exponent = bisect_exponent(totals, target_entropy, max_repeat)
    per_source = written(weights(totals, exponent, budget_tokens).withColumn("exponent", F.lit(exponent)), "weights")
    plan = block_plan(d, per_source, blocks, seed)
    discard(d)
    return per_source, plan


def _taken(docs: DataFrame, plan: DataFrame, blocks: int, seed: int) -> DataFrame:
    """row, id, source, exponent, weight, block, hash, pass: one row for each time that a document is taken."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("from"),
                       _hash(seed, "doc_id", "text").alias("hash")).withColumn("at", _block("hash", blocks))
    j = rows.join(small(plan), F.col("from").eqNullSafe(F.col("source")) & (F.col("at") == F.col("block")))
    times = F.col("passes") + F.coalesce((_order(seed) <= F.col("until")).cast("int"), F.lit(0))
    return (j.withColumn("times", times).where("times > 0")
            .select("row", "id", "source", "exponent", "weight", "block", "hash", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass")))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 2.0, budget_tokens: int | None = None,
        blocks: int = 1024, seed: int = 29) -> DataFrame:
    """doc_id, source, exponent, weight, pass, block, block_turn, doc_turn: each use of a document.

    ``exponent`` is the one that was bisected, ``weight`` the source's share of
    the mix (null: a source without words).

    Training order within a source: pass, block_turn (a permutation of the
    blocks, another in each pass), block, doc_turn.
    """
    _, plan = mix_plan(docs, target_entropy, max_repeat, budget_tokens, blocks, seed)
    t = _taken(docs.select("doc_id", "text", "source"), plan, blocks, seed)
    return t.select(F.col("id").alias("doc_id"), "source", "exponent", "weight", "pass", "block",
                    _hash(seed + 1, "source", "block", "pass").alias("block_turn"), _hash(seed + 2, "hash", "pass").alias("doc_turn"))


def mixed_documents(docs: DataFrame, target_entropy: float | None = None, max_repeat: float | None = 2.0, budget_tokens: int | None = None,
                    blocks: int = 1024, seed: int = 29) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix uses it."""
    _, plan = mix_plan(docs, target_entropy, max_repeat, budget_tokens, blocks, seed)
    return _taken(docs, plan, blocks, seed).select("row.*")
