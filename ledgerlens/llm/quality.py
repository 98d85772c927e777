"""Quality rules as a short-circuit cascade.

Each rule reads one or two measures of a text. On a bounded sample Spark tasks
time every measure and count every rule's rejections; the driver gets one row
a rule and orders the rules by rejections per second. Over all documents each
rule is tried in that order, its measures are computed only when it is
reached, and the first rule that rejects ends the document's cascade. The
order changes the cost, never a verdict: a document is kept when no rule
rejects it.

Measures named in ``report`` are result columns and so are computed for every
document; the cascade saves the others.

Defined results: null text has no words and is rejected by the word count.
Texts of any length are measured whole. Repeated rows get a result each. No
rows: no rows. Columns beside doc_id and text are ignored by ``judge`` and
kept by ``kept_documents``.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (splitmix64's finaliser)."""
    x = (x + np.uint64(1)) * _ODD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    value = _mix(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words)))
    h = value[:n].copy()
    for j in range(1, width):
        h = h * _ODD + value[j:j + n]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(np.isin(h, twice))
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


class Measures:
    """Lazily computed measures of one text."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._known: dict[str, int] = {}

    def __getitem__(self, name: str) -> int:
        if name not in self._known:
            self._known[name] = MEASURES[name](self)
        return self._known[name]

    @property
    def words(self) -> list[bytes]:
        if "_words" not in self._known:
            self._known["_words"] = self.text.encode("utf-8", "surrogatepass").split()
        return self._known["_words"]

    @property
    def lines(self) -> list[str]:
        if "_lines" not in self._known:
            self._known["_lines"] = [x for x in self.text.split("\n") if x.strip(SPACES)]
        return self._known["_lines"]


MEASURES: dict[str, Callable[[Measures], int]] = {
    "n_words": lambda m: len(m.words),
    "word_chars": lambda m: len(m.text) - sum(map(m.text.count, SPACES)),
    "n_symbols": lambda m: sum(map(m.text.count, SYMBOLS)),
    "n_lines": lambda m: len(m.lines),
    "n_dup_lines": lambda m: len(m.lines) - len(set(m.lines)),
    "n_repeat_words": lambda m: repeated_words(m.words),
    "n_bangs": lambda m: m.text.count("!"),
    "n_upper": lambda m: sum(map(str.isupper, m.text)),
}


@dataclass(frozen=True)
class Rule:
    name: str
    reads: tuple[str, ...]
    rejects: Callable[[Measures], bool]


#: The two base rules of the query's contract.
BASE = (
    Rule("few_words", ("n_words",), lambda m: m["n_words"] < 20),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
)
#: The method's own rules beside them. Their limits are far from what prose has.
EXTRA = (
    Rule("symbols", ("n_words", "n_symbols"), lambda m: 4 * m["n_symbols"] > m["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda m: not 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]),
    Rule("bangs", ("n_words", "n_bangs"), lambda m: 2 * m["n_bangs"] > m["n_words"]),
    Rule("dup_lines", ("n_lines", "n_dup_lines"), lambda m: m["n_lines"] >= 4 and 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("capitals", ("word_chars", "n_upper"), lambda m: 10 * m["n_upper"] > 6 * max(m["word_chars"], 1)),
)
RULES = BASE + EXTRA


def sample_costs(docs: DataFrame, rules: Sequence[Rule], sample_rows: int, seed: int) -> list[tuple[str, float, int, int]]:
    """(rule, seconds, rejections, rows) over a sample of at most ``sample_rows`` documents, measured in Spark tasks."""
    names = [r.name for r in rules]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for b in batches:
            for text in b.column(0).to_pylist():
                n += 1
                for i, r in enumerate(rules):
                    m = Measures(text)  # anew: a rule's cost is what it costs alone
                    t = time.perf_counter()
                    hits[i] += r.rejects(m)
                    spent[i] += time.perf_counter() - t
        yield pa.RecordBatch.from_pydict({"rule": names, "s": spent, "hits": hits, "n": [n] * len(rules)}, schema=schema)

    schema = pa.schema([("rule", pa.string()), ("s", pa.float64()), ("hits", pa.int64()), ("n", pa.int64())])
    total = docs.count()
    share = min(1.0, 4 * sample_rows / max(total, 1))
    picked = docs.select(text_of().alias("text")).sample(share, seed).limit(sample_rows)
    rows = (picked.mapInArrow(measure, "rule string, s double, hits long, n long")
            .groupBy("rule").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect())
    return [(r["rule"], r["s"], r["hits"], r["n"]) for r in rows]


def cascade_order(rules: Sequence[Rule], costs: list[tuple[str, float, int, int]]) -> list[Rule]:
    """Rules by rejections per second, the best first; rules that the sample never saw reject come last, cheap ones first."""
    by = {c[0]: c for c in costs}

    def key(r: Rule):
        _, s, hits, _ = by.get(r.name, (r.name, 0.0, 0, 0))
        return (-(hits / max(s, 1e-9)), s, r.name)

    return sorted(rules, key=key)


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE,
          report: Sequence[str] = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
          sample_rows: int = 512, seed: int = 17) -> DataFrame:
    """doc_id, the ``report`` measures, base_failed, kept: one row for each row of ``docs`` (doc_id, text)."""
    order = cascade_order(rules, sample_costs(docs, rules, sample_rows, seed))
    base_names = {r.name for r in base}
    later = [r for r in order if r.name not in base_names]
    first = [r for r in order if r.name in base_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in report]
            failed, kept = [], []
            for text in b.column(1).to_pylist():
                m = Measures(text)
                f = any(r.rejects(m) for r in first)
                failed.append(f)
                kept.append(not f and not any(r.rejects(m) for r in later))
                for c, name in zip(cols, report, strict=True):
                    c.append(m[name])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())],
                names=["doc_id", *report, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in report) + ", base_failed boolean, kept boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 512, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    order = cascade_order(rules, sample_costs(docs, rules, sample_rows, seed))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for text in b.column(at).to_pylist():
                m = Measures(text)
                keep.append(not any(r.rejects(m) for r in order))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
