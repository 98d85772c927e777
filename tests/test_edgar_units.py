"""Edge cases of the EDGAR operators on hand-made submissions."""

from pyspark.sql import functions as F

from ledgerlens.functions import edgar as E
from ledgerlens.operators import filings as FL


def _raw(form, blocks, header=True):
    hdr = f"<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: {form}\n</SEC-HEADER>\n" if header else ""
    return hdr + "\n".join(blocks)


def _block(t, body, text=True):
    inner = f"<TEXT>\n{body}\n</TEXT>" if text else body
    return f"<DOCUMENT>\n<TYPE>{t}\n<FILENAME>x.htm\n{inner}\n</DOCUMENT>"


def _clean(spark, raw):
    df = spark.createDataFrame([(1, raw)], "f int, raw string")
    return FL.clean_filings(df).collect()[0]["clean_text"]


def test_amended_form_loses_primary(spark):
    raw = _raw("10-K/A", [_block("10-K/A", "Primary body"), _block("EX-99.1", "Exhibit body")])
    out = _clean(spark, raw)
    assert "Primary body" not in out and "Exhibit body" in out
    assert "----- DOCUMENT TYPE: EX-99.1 -----" in out


def test_two_word_form_and_junk_types(spark):
    df = spark.createDataFrame([("<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: DEF 14A\n</SEC-HEADER>",)], "raw string")
    assert df.select(E.primary_form(F.col("raw"))).collect()[0][0] == "DEF"
    raw = _raw("DEF 14A", [_block("DEF 14A", "Proxy"), _block("GRAPHIC", "xx"), _block("EX-101.INS", "x"),
                           _block("EX-104", "Cover")])
    out = _clean(spark, raw)
    assert "Proxy" not in out and "EX-104" in out and "GRAPHIC" not in out


def test_no_header_and_header_end_before_start(spark):
    raw = _raw("8-K", [_block("EX-10.1", "Loan")], header=False)
    assert _clean(spark, raw).startswith("----- DOCUMENT TYPE: EX-10.1 -----")
    bad = "</SEC-HEADER>\n<SEC-HEADER>\nCONFORMED SUBMISSION TYPE: 8-K\n</SEC-HEADER>\n" + _block("8-K", "Body")
    df = spark.createDataFrame([(bad,)], "raw string")
    r = df.select(E.sec_header(F.col("raw")).alias("h"), E.primary_form(F.col("raw")).alias("p")).collect()[0]
    assert r.h is None and r.p == ""


def test_unclosed_block_and_lower_case_tags(spark):
    raw = _raw("8-K", ["<document>\n<type>8-k\n<text>\nLower body\n</text>\n</document>",
                       "<DOCUMENT>\n<TYPE>EX-99.1\n<TEXT>\nNever closed"])
    out = _clean(spark, raw)
    assert "Lower body" in out and "Never closed" not in out
    assert "----- DOCUMENT TYPE: 8-K -----" in out


def test_empty_type_no_text_and_two_text_ends(spark):
    raw = _raw("8-K", ["<DOCUMENT>\n<TYPE>\n<TEXT>\nNo type\n</TEXT>\n</DOCUMENT>",
                       "<DOCUMENT>\n<TYPE>EX-99.2\nPlain body without text tags\n</DOCUMENT>",
                       "<DOCUMENT>\n<TYPE>EX-10.2\n<TEXT>\nA\n</TEXT>\nmiddle\n</TEXT>\n</DOCUMENT>"])
    out = _clean(spark, raw)
    assert "No type" not in out
    assert "Plain body without text tags" in out          # whole block when no <TEXT>
    # greedy to the last </TEXT>; the inner "</TEXT>" makes the body HTML, so the tag is stripped
    assert "----- DOCUMENT TYPE: EX-10.2 -----\nA\n\nmiddle" in out


def test_gunk_cut_only_after_junk(spark):
    df = spark.createDataFrame([("FORM 10-K\nbody",), ("junk <x>\nFORM 10-K\nbody",), ("\nFORM 10-K\nb",)],
                               "t string")
    out = [r[0] for r in df.select(E.drop_leading_gunk(F.col("t"))).collect()]
    assert out == ["FORM 10-K\nbody", "FORM 10-K\nbody", "\nFORM 10-K\nb"]


def test_html_body_structure(spark):
    body = ("<html><body><script>var t='</p>';</script><p>First &amp; second</p>"
            "<div>12.5\n%\nrate</div><br>tail&lt;b&gt;x&lt;/b&gt;</body></html>")
    out = _clean(spark, _raw("8-K", [_block("8-K", body)]))
    assert "var t" not in out and "First & second" in out
    assert "12.5% rate" in out
    assert "tail x" in out                                 # escaped markup decoded first, then stripped


def test_lenient_parser_and_preferred_fallback(spark):
    raw = _raw("8-K", [_block("SC 13D", "Schedule"), _block("EX-99.1", "Ex", text=False)])
    fl = spark.createDataFrame([("a.txt", raw)], "source_file string, raw string")
    b = FL.submission_blocks(fl)
    rows = b.collect()
    assert [r.doc_type for r in rows] == ["SC 13D"]       # block without <TEXT> skipped, case/space kept
    kept = FL.preferred_blocks(b).collect()
    assert len(kept) == 1                                  # no preferred type anywhere -> keep all


def test_output_name_rule(spark):
    df = spark.createDataFrame([("a/b/x.txt",), ("a/y.TXT",), ("z.txt.txt",), ("w",)], "p string")
    out = [r[0] for r in df.select(E.clean_output_name(F.col("p"))).collect()]
    assert out == ["x_clean.txt", "y.TXT", "z_clean.txt_clean.txt", "w_clean.txt"]
