"""Readers on small files, and the streaming extension."""

import json

from lodestar import schemas
from lodestar.sources import files
from lodestar.sources.literature import Client
from lodestar.streaming import latency

XML = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>11</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>2019-2020</MedlineDate></PubDate></JournalIssue></Journal>
<ArticleTitle>Effect of <i>E. coli</i></ArticleTitle><Abstract><AbstractText Label="NON-SMALL cell">We <b>did</b> it.</AbstractText><AbstractText> </AbstractText></Abstract>
<AuthorList>{authors}</AuthorList></Article><MeshHeadingList><MeshHeading><DescriptorName>Heart</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pii">p</ArticleId><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>12</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>""".format(
    authors="".join(f"<Author><LastName>L{i}</LastName><Initials>I</Initials></Author>" for i in range(15))
)


def test_literature_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text(XML)
    (tmp_path / "b.xml").write_text("not xml")
    rows = files.read_literature_xml(spark, f"file://{tmp_path}").collect()
    assert [r["doc_id"] for r in rows] == ["pmid:11"]
    r = rows[0]
    assert (r["title"], r["date"], r["meta"]["doi"], r["meta"]["mesh_terms"]) == ("Effect of E. coli", "2019", "10.1/x", ["Heart"])
    assert [(s["heading"], s["text"]) for s in r["sections"]] == [("Non-Small Cell", "We did it.")] and len(r["meta"]["authors"]) == 12


def test_literature_client():
    calls, pages = [], [["1", "2"], []]

    def get(url):
        calls.append(url)
        if len(calls) == 1:
            raise OSError("try again")
        return XML if "efetch" in url else json.dumps({"esearchresult": {"idlist": pages.pop(0)}})

    client = Client(get=get, sleep=lambda s: None)
    assert client.search("heart", 5) == ["1", "2"] and len(calls) == 2
    assert [d["doc_id"] for d in client.fetch(["11"])] == ["pmid:11"]


def test_local_documents(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "my_file.md").write_text("intro text\n# Head\nbody")
    (tmp_path / "plain_name.txt").write_bytes(b"bytes \xff here")
    (tmp_path / "page.html").write_text("<h1>Page</h1><p>hello</p>")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "skip.csv").write_text("a,b")
    rows = {r["doc_id"]: r for r in files.read_local(spark, str(tmp_path)).collect()}
    assert set(rows) == {"local:deep/my_file.md", "local:plain_name.txt", "local:page.html"}
    assert rows["local:deep/my_file.md"]["title"] == "Head" and rows["local:plain_name.txt"]["title"] == "plain name"
    assert "�" in rows["local:plain_name.txt"]["sections"][0]["text"] and rows["local:page.html"]["meta"]["bytes"] == 25


def test_json_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"qid": "1", "score": 0.5}\n\n{"qid": "2", "metric": "m", "score": 1}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "l.jsonl"), schemas.HUMAN_LABELS).orderBy("qid").collect()
    assert [(r["qid"], r["metric"], r["score"]) for r in rows] == [("1", None, 0.5), ("2", "m", 1.0)]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), schemas.HUMAN_LABELS).count() == 0
    assert files.write_jsonl(spark.createDataFrame(rows, schemas.HUMAN_LABELS), str(tmp_path / "out")) == 2


def test_distinct_documents(spark):
    rows = spark.createDataFrame([("a", 1, "late"), ("a", 0, "first"), ("b", 1, "x")], "doc_id string, query_ordinal int, t string")
    assert {r["doc_id"]: r["t"] for r in files.distinct_documents(rows).collect()} == {"a": "first", "b": "x"}


def test_stream(spark, tmp_path):
    from datetime import datetime

    rows = [(i, datetime(2024, 1, 1, i // 60, i % 60), i % 3, "view", float(i), "") for i in range(240)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/in/events.parquet")
    stream = latency.read_events(spark, f"{tmp_path}/in/events.parquet", "*.parquet").selectExpr("ts", "event_type AS stage", "value AS ms")
    latency.run_to_table(latency.windowed(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    out = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert len(out) >= 3 and out[0]["n"] == 60
