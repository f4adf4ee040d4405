"""Entities of HTML against the decoder of Python's library, and texts that have none."""

import html
import random

from pyspark.sql import functions as F

from corpusflow.functions import text as X


def test_entities_are_decoded_as_python_does(spark):
    r = random.Random(3)
    parts = ["a", "&", ";", " ", "&amp;", "&lt;", "&eacute;", "&#8217;", "&#x2019;", "&#X1F600;", "&hellip;", "&#146;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&nosuchname;", "&#;", "&Alpha;", "&apos;", "&amp;lt;", "é", "&#x0000041;", "\n"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.randrange(14)))) for i in range(300)] + [(300, None), (301, "&"), (302, "&nbsp;x&nbsp;"), (303, "x" * 5000 + "&quot;"), (304, "")]
    got = {x.i: x.o for x in spark.createDataFrame(rows, "i int, t string").select("i", X.unescape(F.col("t")).alias("o")).collect()}
    for i, t in rows:
        assert got[i] == (None if t is None else html.unescape(t).replace("\xa0", " ")), t


def test_pages(spark):
    df = spark.createDataFrame([("<title>Caf&eacute; &#8211; eyes | Site</title><body><p>Don&#8217;t&nbsp;rub &amp; rinse</p></body>",)], "h string")
    got = df.select(X.strip_html(F.col("h")).alias("t"), X.extract_title(F.col("h"), F.lit("x")).alias("n")).first()
    assert got.t.endswith("Don’t rub & rinse") and got.n == "Café – eyes"
