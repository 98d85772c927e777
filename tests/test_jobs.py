"""End-to-end jobs on files derived from the driver tables."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens.plans import jobs
from ledgerlens.sources import derived
from tests.conftest import SF001

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def test_clean_filings_job(spark):
    root = tempfile.mkdtemp(prefix="job-", dir="/tmp")
    os.makedirs(f"{root}/archive")
    for r in derived.filings(spark, SF001).collect():
        with open(f"{root}/archive/{r.f}.txt", "w") as fh:
            fh.write(r.raw)
    man = derived.manifest(spark, SF001).collect()
    with open(f"{root}/manifest.csv", "w", newline="") as fh:
        fh.write("fname\r\n" + "".join(f"{r.fname}\r\n" for r in man))
    counts = jobs.clean_filings_job(spark, f"{root}/manifest.csv", derived.mapping(spark, SF001),
                                    root, f"{root}/out", batch=7)
    got = {r.outcome: (r.rows, r.files) for r in counts.collect()}
    paths = [r.fname for r in man]
    target = {r.fname: r.archive_path for r in derived.mapping(spark, SF001).collect()}
    there = {f"archive/{r.f}.txt" for r in derived.filings(spark, SF001).collect()}
    outcome = ["NO MATCH" if p not in target else "OK" if target[p] in there else "MISSING" for p in paths]
    want = {o: (outcome.count(o), len({p for p, x in zip(paths, outcome) if x == o}) if o == "OK" else 0) for o in set(outcome)}
    assert got == want
    assert spark.read.parquet(f"{root}/out").count() == want["OK"][1]


def test_clean_filings_job_opens_exact_paths(spark):
    """Two files of one name, a repeated row, a file that can't be read, one that is not there, one without a mapping."""
    root = tempfile.mkdtemp(prefix="job-", dir="/tmp")
    for d, text in (("x", "text of x \ufffd"), ("y", "text of y")):
        os.makedirs(f"{root}/in/{d}")
        with open(f"{root}/in/{d}/a.txt", "wb") as fh:
            fh.write(f"<DOCUMENT>\n<TYPE>EX-99.1\n<TEXT>\n{text}\n</TEXT>\n</DOCUMENT>".encode() + b"\xff\n")
    with open(f"{root}/in/x/bad.gz", "wb") as fh:
        fh.write(b"this is no gzip file")
    with open(f"{root}/manifest.csv", "w") as fh:
        fh.write("path,note\nm1,\"a, \"\"b\"\"\"\nm1,\nm2,\nm3,\nm4,\n")
    mapping = spark.createDataFrame([("m1", "x/a.txt"), ("m2", "x/bad.gz"), ("m3", "x/none.txt"), ("other", "y/a.txt")],
                                    "fname string, archive_path string")
    counts = jobs.clean_filings_job(spark, f"{root}/manifest.csv", mapping, f"{root}/in", f"{root}/out")
    assert {r.outcome: (r.rows, r.files) for r in counts.collect()} == {
        "OK": (2, 1), "FAILED": (1, 0), "MISSING": (1, 0), "NO MATCH": (1, 0)}
    rows = spark.read.parquet(f"{root}/out").collect()
    assert [(r.out_name, r.source) for r in rows] == [("a_clean.txt", "x/a.txt")]
    assert "text of x \ufffd" in rows[0].text and "text of y" not in rows[0].text


def test_topic_summary_job(spark):
    out = tempfile.mkdtemp(prefix="sumjob-", dir="/tmp")
    res = jobs.topic_summary_job(spark, FIX, out)
    assert res["categorized"].count() == 2
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(
        f"{out}/categorized_documents")
    want = sorted(res["categorized"].collect(), key=lambda r: r.Document)
    got = sorted(back.collect(), key=lambda r: int(r.Document))
    assert [(r.FileName, r.TopicSummary, r.Category, r.Rationale or "") for r in got] == [
        (r.FileName, r.TopicSummary, r.Category, r.Rationale) for r in want]


def test_topic_analysis_job(spark):
    root = tempfile.mkdtemp(prefix="ldajob-", dir="/tmp")
    sp = derived.speeches(spark, SF001).select("file_name", "text", F.col("year").cast("string"))
    sp.coalesce(1).write.option("header", True).option("escape", '"').csv(f"{root}/corpus")
    pre, post = derived.meta_parts(spark, SF001)
    for name, part in (("pre", pre), ("post", post)):
        part.orderBy("pos").select("file_name", F.date_format("date", "yyyy-MM-dd").alias("date"),
                                   "speaker").coalesce(1).write.option("header", True).csv(f"{root}/{name}")
    res = jobs.topic_analysis_job(spark, f"{root}/corpus", [f"{root}/pre", f"{root}/post"], f"{root}/out", k=3)
    assert res["dominant"].columns == ["Document_No", "File Name", "Dominant_Topic", "Topic_Perc_Contrib", "Keywords", "Text"]
    assert res["proportions"].columns == ["Document", "FileName", "Date", "Topic", "Proportion"]
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{root}/out/dominant_topic")
    texts = {r.file_name: r.text for r in sp.collect()}
    rows = back.collect()
    assert [int(r["Document_No"]) for r in rows] == list(range(len(rows))) and len(rows) == res["dominant"].count() > 0
    assert all(r["Text"] == texts[r["File Name"]] for r in rows)
    assert {r.topic for r in res["topics"].select("topic").distinct().collect()} == {0, 1, 2}
    assert len(spark.read.text(f"{root}/out/topics_text").collect()) == 3
