"""Plan shape of every oracle-checked query: JVM-only expressions, no pair explosion, no join shuffled on a topic.

Plans that are cut by a checkpoint or a written table are looked at too. Only
explicit broadcast hints count here: at this size Spark would broadcast
nearly every side by itself and hide the joins that it shuffles at scale.
"""

import re

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter

from ledgerlens.plans import catalog
from tests.conftest import SF001

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin")
TOPIC_JOIN = re.compile(r"(?:SortMergeJoin|ShuffledHashJoin) \[(?:topic|dominant_topic|topic_id|t1|t2|_t)#\d+\]")
# the k x k tables of topic words and pairs (bounded by k * top_n ** 2), and one row a topic against one row a topic
SMALL_ON_BOTH_SIDES = ("coherence_cv", "topic_info", "lda_grid", "topic_dump_files", "cluster_topic_check")


@pytest.fixture
def seen(spark, monkeypatch):
    """The plans of everything that is checkpointed or written while a query is built."""
    plans = []

    def plan(df):
        plans.append(df._jdf.queryExecution().toString())

    checkpoint, parquet = DataFrame.checkpoint, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: (plan(self), checkpoint(self, *a, **k))[1])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plan(self._df), parquet(self, *a, **k))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield plans
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_plan_shape(name, spark, seen):
    df = catalog.queries()[name](spark, SF001)
    for plan in [*seen, df._jdf.queryExecution().toString()]:
        for op in FORBIDDEN:
            assert op not in plan, f"{name}: {op} in plan"
        if name not in SMALL_ON_BOTH_SIDES:
            found = TOPIC_JOIN.search(plan)
            assert not found, f"{name}: {found[0]}"


def test_phrases_are_planned_once(spark, seen):
    """The windows over phrase hits stand below one written table, not in each of its readers."""
    df = catalog.queries()["bag_of_words"](spark, SF001)
    assert "lag(pos" not in df._jdf.queryExecution().toString()
    assert sum("lag(pos" in p for p in seen) == 1
