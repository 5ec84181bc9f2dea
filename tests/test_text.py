"""Text operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T


def values(spark, column, inputs, kind="string"):
    rows = spark.createDataFrame(list(enumerate(inputs)), f"i long, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x")).alias("y")).collect()]


def test_tokens(spark):
    got = values(spark, T.tokens, ["Coded as ICD-10 in the registry", "glucose 126 mg/dL threshold", "vitamin A", "7.0%", "café", None, "the of and"])
    assert {"icd-10", "icd", "10"} <= set(got[0]) and "the" not in got[0]
    assert {"mg/dl", "mg", "dl"} <= set(got[1])
    assert got[2:5] == [["vitamin", "a"], ["7", "0"], ["caf"]]
    assert got[5] is None and got[6] == []
    assert values(spark, lambda c: T.tokens(c, use_stopwords=False), ["the-end of"]) == [["the-end", "the", "end", "of"]]
    assert len(T.STOPWORDS) == len(set(T.STOPWORDS)) == 108 and not [w for w in T.STOPWORDS if len(w) == 1]


def test_sentences(spark):
    got = values(spark, T.sentences, ["The dose was 5.5 mg daily. HbA1c fell to 7.0% overall.", "1. Start therapy now.", "See Fig. 2 for J. Doe et al. (2001). Next!", "  ", "(2) Stop. Go? Yes"])
    assert got == [["The dose was 5.5 mg daily.", "HbA1c fell to 7.0% overall."], ["1. Start therapy now."], ["See Fig. 2 for J. Doe et al. (2001).", "Next!"], [], ["(2) Stop.", "Go?", "Yes"]]


def test_sections(spark):
    rows = ["plain  text\n\n\n\nmore", "intro\n# One\nbody\n## Empty\n\n### Two  \n a \t b", "", "# Only"]
    got = [[(s["heading"], s["text"]) for s in r] for r in values(spark, T.markdown_sections, rows)]
    assert got == [[(None, "plain text\n\nmore")], [(None, "intro"), ("One", "body"), ("Two", "a b")], [(None, "")], []]
    html = "<html><STYLE>p{}</style><h1 class=x>A<b>b</b></h1><p>one &amp; two</p><script>var x='<p>';</script><h2>C</h2>&lt;3"
    assert [(s["heading"], s["text"]) for s in values(spark, T.html_sections, [html])[0]] == [("Ab", "one & two"), ("C", "<3")]


@pytest.mark.parametrize(
    ("text", "yes"),
    [("INSUFFICIENT_CONTEXT", True), ("insufficient context: nothing", True), ("Insufficient - context", True), ("x INSUFFICIENTCONTEXT", True), ("insufficient evidence", False), ("context insufficient", False), (None, False)],
)
def test_abstention(spark, text, yes):
    assert values(spark, T.is_abstention, [text]) == [yes]


def test_degenerate(spark):
    assert values(spark, T.is_degenerate, ["@" * 12, "a" + "b" * 20, "@" * 11, "ab" * 40, "\n" * 30, None, "-" * 12 + "|"]) == [True, True, False, False, False, False, True]


def test_citations(spark):
    valid = F.array(F.lit("PMID:1 §Results"), F.lit("local:a"))
    text = ["x [PMID:1 §Results] y [made up] [ local:a ] [PMID:1 §Results]", "none"]
    assert values(spark, lambda c: T.citations(c, valid), text) == [["PMID:1 §Results", "local:a"], []]


def test_json_text(spark):
    rows = ['{"a": 1}', 'Sure:\n```json\n{"a": 2}\n```\nbye {', 'so {"a": 3} it is', "list [1, 2] here", "no {json", "", None]
    assert values(spark, T.json_text, rows) == ['{"a": 1}', '{"a": 2}', '{"a": 3}', "[1, 2]", None, None, None]


def test_year_and_truncation(spark):
    rows = spark.createDataFrame([("2020", None), ("", "2023 Jan-Feb"), (None, "2019-2020"), (None, "2019Jan"), (None, "Spring")], "y string, m string")
    assert [r[0] for r in rows.select(T.leading_year(F.col("y"), F.col("m"))).collect()] == ["2020", "2023", "2019", None, None]
    body = "One sentence here. Second sentence goes on and on"
    assert values(spark, lambda c: T.truncate_tokens(c, 7), [body, "short"]) == ["One sentence here.", "short"]
    assert values(spark, lambda c: T.truncate_tokens(c, 4), ["abcdefghijklmnopqrstuvwxyz"]) == ["abcdefghijklmnop"]


def test_rendering(spark):
    row = spark.createDataFrame([("pmid:7", "pubmed", "Results", "T", "2020", "body"), ("local:x", "local", None, "T", None, "body")], "d string, s string, sec string, t string, y string, b string")
    tag = T.citation_tag(F.col("d"), F.col("s"), F.col("sec"))
    assert [r[0] for r in row.select(T.render_chunk(tag, F.col("t"), F.col("y"), F.col("b"))).collect()] == ["[PMID:7 §Results] T (2020)\nbody", "[local:x] T\nbody"]


def test_entities_as_the_standard_library_reads_them(spark):
    from html import unescape

    texts = ["a &lt;b&gt; &amp;lt; &quot;&#39;&apos;", "&eacute;&#233;&#xE9;&#128512; &nbsp;|", "R&D; AT&T &unknown; & &;", "no entity", "&#0;&#55296;", "&&amp;&amp;amp;", "a &amp b &copy, &am"]
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string").orderBy("i").select(T.unescape_entities(F.col("x")).alias("t")).collect()]
    assert got == [unescape(t) for t in texts]
