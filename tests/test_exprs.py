"""Column expressions on fixed vectors."""

import datetime

from pyspark.sql import functions as F

from tallyweave.functions import exprs


def apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_name_key(spark):
    vectors = {
        "Dixon Technologies (India) Limited": "dixon technologies (india)", "Amber Enterprises India Ltd.": "amber enterprises", "BL W Precision Ltd": "blw precision", "State Bank of India": "state bank of india",
        "Tata & Sons Pvt. Ltd.": "tata  sons".replace("  ", " "), "  A B C  Corp ": "abc", "Limited": "", "India Private Limited": "", 'Smith\'s "Best", Inc.': "smiths best", "Ltd Motors": "ltd motors",
    }
    assert apply(spark, exprs.name_key, list(vectors)) == list(vectors.values())


def test_quote_form(spark):
    assert apply(spark, exprs.quote_form, ["The “Ofﬁce” – A­B [[PAGE 3]] x’s", "ﬄ﻿ Z", None]) == ["the\"office\"-abx's", "fflz", None]


def test_report_dates(spark):
    good = {"2025-12-15": (2025, 12, 15), "March 09, 2026": (2026, 3, 9), "March 9 2026": (2026, 3, 9), "9th March 2026": (2026, 3, 9), "1st Jan. 2025": (2025, 1, 1), "22nd feb, 2024": (2024, 2, 22), "11th May 2024": (2024, 5, 11), "30-12-2025": (2025, 12, 30), "Dec 30, 2025": (2025, 12, 30)}
    assert apply(spark, exprs.report_date, list(good)) == [datetime.date(*d) for d in good.values()]
    assert apply(spark, exprs.report_date, ["2025-02-30", "11st May 2024", "2/3/2024", "Marchy 9, 2026", "", "31-31-2024"]) == [None] * 6


def test_similarity_is_highest_of_three(spark):
    rows = spark.createDataFrame([("acme works", "acme works"), ("", "x"), ("acme", "acme works"), ("a b c d", "a b c e"), ("kitten", "sitting")], "a string, b string")
    got = [r.x for r in rows.select(exprs.similarity(F.col("a"), F.col("b")).alias("x")).collect()]
    assert [round(x, 3) for x in got] == [1.0, 0.0, 0.88, 0.857, 0.571]


def test_issuer_name_keeps_meaningful_marks(spark):
    assert apply(spark, exprs.issuer_name, ["Modison Ltd-$", "Modison Ltd - #", "Acme-$", "X-Ray Limited"]) == ["Modison Ltd", "Modison Ltd", "Acme-$", "X-Ray Limited"]


def test_attachments(spark):
    site = "https://www.bseindia.com"
    assert apply(spark, exprs.attachment_url, ["http://x/y", "/a/b", "AttachHis/c.pdf", "xml-data/corpfiling/AttachLive/d.pdf", "e.pdf", None]) == ["http://x/y", f"{site}/a/b", f"{site}/xml-data/corpfiling/AttachHis/c.pdf", f"{site}/xml-data/corpfiling/AttachLive/d.pdf", f"{site}/xml-data/corpfiling/AttachLive/e.pdf", None]
    assert apply(spark, exprs.alternate_attachment_url, [f"{site}/xml-data/corpfiling/AttachLive/e.pdf", "https://other.com/xml-data/corpfiling/AttachLive/e.pdf"]) == [f"{site}/xml-data/corpfiling/AttachHis/e.pdf", None]


def test_errors_and_retries(spark):
    rows = spark.createDataFrame([("ECONNRESET", None, None), (None, 503, None), (None, None, "Socket hang up"), (None, 404, None), ("OTHER", 403, "no")], "c string, s int, m string")
    assert [r.x for r in rows.select(exprs.retryable_error(F.col("c"), F.col("s"), F.col("m")).alias("x")).collect()] == [True, True, True, False, False]
    waits = spark.range(0, 12).select(exprs.retry_delay_seconds(F.col("id").cast("int")).alias("x")).collect()
    assert [r.x for r in waits] == [300, 300, 600, 1200, 2400, 4800, 9600, 19200, 38400, 76800, 86400, 86400]


def test_fold_and_percent(spark):
    assert apply(spark, exprs.reference_form, ["Éclair & Sons, Ltd.", "ﬁne  Ⅳ", ""]) == ["eclair and sons ltd", "fine iv", ""]
    rows = spark.createDataFrame([(12.0,), (12.34,), (0.05,)], "v double")
    assert [r.x for r in rows.select(exprs.percent_text(F.col("v")).alias("x")).collect()] == ["12", "12.3", "0.1"]
