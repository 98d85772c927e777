"""Token counts without token ids: pieces counted once for each distinct pre-token.

1. Every task counts its pre-tokens; Spark sums the counts. Each distinct
   pre-token is encoded once, and the table (unit, n, pieces) is written.
2. Its head - the ``head`` most frequent pre-tokens of at most ``head_bytes``
   bytes, a bound that does not grow with the corpus - goes to the workers as
   a broadcast map. A second pass takes each document's pre-token frequencies,
   sums the head's pieces on the spot, and leaves (unit, frequency) of the rest.
3. The rest joins the table by pre-token and is summed per document.

The rest's pre-tokens are the rare ones, so no join key is hot; where one is
(a frequent pre-token longer than head_bytes), it occurs once a document and
AQE splits it, both sides of the join being exchanges.

Defined results: null text counts as empty, with no bytes and no tokens.
Special strings inside texts are what the library makes of them by default.
Texts of any length are counted whole. Every row gets a result of its own,
repeated rows and null ids too. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_shuffles, text_of, written
from .tokenizer import VOCABULARY, pieces, pre_tokens

#: A task hands its counts on when it holds this many distinct pre-tokens.
FLUSH = 400_000


def pre_token_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """unit, n, pieces: every distinct pre-token of ``docs`` with its occurrences and its number of tokens; written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update(pre_tokens(text))
                if len(seen) > FLUSH:
                    yield out()
                    seen.clear()
        yield out()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one = pieces(vocabulary).encode
        for b in batches:
            found = [len(encode_one(u)) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], names=["unit", "n", "pieces"])

    units = docs.select(text_of().alias("text")).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return written(units.mapInArrow(encode, "unit string, n long, pieces long"), "units")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 2048,
                 head: int = 1 << 18, head_bytes: int = 32) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``): one row for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    table = pre_token_table(docs, vocabulary)
    release_shuffles(spark)
    top = (table.where(F.octet_length("unit") <= head_bytes).orderBy(F.desc("n"), "unit").limit(head)
           .select("unit", "pieces").toArrow())  # at most head * (head_bytes + 8) bytes
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))
    del top

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, schema = TaskContext.get().partitionId() << 40, pa.schema(
            [("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_head", pa.int64()),
             ("units", pa.list_(pa.string())), ("freqs", pa.list_(pa.int64()))])
        get = known.value.get
        for b in batches:
            rows, heads, sizes, units, freqs = [], [], [], [], []
            for text in b.column(1).to_pylist():
                total, rest, times = 0, [], []
                for u, f in Counter(pre_tokens(text)).items():
                    k = get(u)
                    if k is None:
                        rest.append(u)
                        times.append(f)
                    else:
                        total += k * f
                rows.append(row)
                row += 1
                heads.append(total)
                sizes.append(len(text.encode("utf-8", "surrogatepass")))
                units.append(rest)
                freqs.append(times)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), b.column(0), pa.array(sizes, pa.int64()), pa.array(heads, pa.int64()),
                 pa.array(units, schema.field("units").type), pa.array(freqs, schema.field("freqs").type)], schema=schema)

    per_doc = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
        .mapInArrow(spread, "row long, doc_id long, n_bytes long, n_head long, units array<string>, freqs array<long>"), "per-doc")
    rest = (per_doc.select("row", F.explode(F.arrays_zip("units", "freqs")).alias("p"))
            .select("row", F.col("p.units").alias("unit"), F.col("p.freqs").alias("freq"))
            .join(table.select("unit", "pieces"), "unit")
            .groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("n_rest")))
    n = F.col("n_head") + F.coalesce("n_rest", F.lit(0))
    return (per_doc.select("row", "doc_id", "n_bytes", "n_head").join(rest, "row", "left")
            .select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")))
