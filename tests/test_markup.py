"""Entities and markup runs by hand."""

from __future__ import annotations

import html

from pyspark.sql import functions as F

from rostrum.functions import markup as M


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("v"))).collect()]


def test_entities(spark):
    texts = ["a &#8211; b", "caf&eacute; &amp;lt; &lt;b&gt;", "&#x1F600;&#128512;", "AT&T &; &#; &#xZZ; &nosuch; &amp", "&#55296; &#1114112; &#0;", "no entity", "", None, "&Eacute;&eacute;&hellip;&apos;"]
    got = one(spark, M.decoded, *texts)
    assert got[:4] == ["a – b", "café &lt; <b>", "😀😀", "AT&T &; &#; &#xZZ; &nosuch; &amp"]
    assert got[4:] == ["&#55296; &#1114112; &#0;", "no entity", "", None, "Éé…'"]
    named = [f"x&{n};y" for n in M._NAMED]
    assert one(spark, M.decoded, *named) == [html.unescape(n) for n in named]


def _runs(spark, *texts):
    return [r and [(x.role, x.text, x.block) for x in r] for r in one(spark, lambda c: M.runs(c, {"b": "name", "strong": "name", "i": "title"}, breaks=["br"]), *texts)]


def test_runs(spark):
    got = _runs(
        spark,
        "<p><b>Ann <i>Lee</i> Wu</b>, Univ&eacute; X<br><i>A title</i></p>",
        "<div><b>open<p>next</b> still</div>tail",
        "</b>x<b><b>y</b>z</b>w",
        "<b>a</b><b>b</b><!-- <b> --> c<script>var x = '<b>';</script>d<unknown e",
        "",
        None,
        "plain < text",
        "<B>Up</B>&nbsp;<br/>  <i> </i>",
    )
    assert got[0] == [("name", "Ann", 1), ("title", "Lee", 1), ("name", "Wu", 1), (None, ", Univé X", 1), ("title", "A title", 1)]
    assert got[1] == [("name", "open", 1), (None, "next still", 2), (None, "tail", 3)]
    assert got[2] == [(None, "x", 0), ("name", "yz", 0), (None, "w", 0)]
    assert got[3] == [("name", "ab", 0), (None, "cd", 0)]
    assert got[4:6] == [[], None] and got[6] == [(None, "plain", 0)] and got[7] == [("name", "Up", 0)]


def test_records(spark):
    text = "<p>Intro</p><p><b>Ann Lee</b>, X <i>On A</i></p><p><b>Bo</b><i>On B</i> late</p><p><b>Cy</b></p>"
    got = one(spark, lambda c: M.records(M.runs(c, {"b": "name", "i": "title"})), text, "", "<i>no name</i>")
    assert [tuple(r) for r in got[0]] == [("Ann Lee", ", X", "On A"), ("Bo", "late", "On B"), ("Cy", None, None)] and got[1:] == [[], []]
