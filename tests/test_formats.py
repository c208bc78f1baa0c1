"""Writers and readers: fixed texts and round trips."""

import gzip
import xml.dom.minidom

from pyspark.sql import functions as F

from tessellex.sources import readers as R
from tessellex.sources import writers as W
from tessellex.sources.conll import CONLLU, read_conllu


def test_xml_and_inline_xml(spark):
    rows = spark.createDataFrame([("Ann & Bo met.", [(0, 3, "PER"), (2, 5, "X"), (6, 8, "PER")])], "text string, spans array<struct<begin:int,end:int,label:string>>")
    got = rows.select(W.inline_xml(F.col("text"), F.col("spans")).alias("x"), W.element("doc", F.lit("a"), id=F.lit('q"<'), none=F.lit(None)).alias("e")).collect()[0]
    assert got.x == "<PER>Ann</PER> &amp; <PER>Bo</PER> met." and got.e == '<doc id="q&quot;&lt;">a</doc>'
    tokens = spark.createDataFrame([([("a<", None), ("b", "N")],)], "t array<struct<word:string,tag:string>>").select(W.xml_tokens(F.col("t"), "word", "tag").alias("x")).collect()[0].x
    assert tokens == '<tokens><token id="1"><word>a&lt;</word></token><token id="2"><word>b</word><tag>N</tag></token></tokens>'
    xml.dom.minidom.parseString(tokens)


def test_conllu_round_trip(spark, tmp_path):
    cells = "doc_id int, sent_id string, id string, form string, lemma string, upos string, xpos string, feats map<string,string>, head int, deprel string, deps string, misc string"
    rows = [(1, "s1", i, w, w, "X", None, f, h, "dep", None, "") for i, w, f, h in [("2", "gonna", {"b": "2", "A": "1"}, 0), ("1-2", "du", None, None), ("1", "de", {}, 2), ("2.1", "(e)", None, None)]]
    frame = spark.createDataFrame(rows + [(1, "s2", "1", "Hi", "hi", None, None, None, 0, "root", None, None)], cells)
    blocks = W.conllu_sentences(frame, ["doc_id", "sent_id"])
    text = {r.sent_id: r.block for r in blocks.collect()}
    assert [line.split("\t")[0] for line in text["s1"].splitlines()[1:]] == ["1-2", "1", "2", "2.1"] and "A=1|b=2" in text["s1"]
    blocks.select("block").coalesce(1).write.text(str(tmp_path / "c"))
    back = read_conllu(spark, str(tmp_path / "c")).select("sent_id", *CONLLU).collect()
    want = {(r.sent_id, r.id): (r.form, r.head, r.feats or None) for r in frame.collect()}
    assert {(r.sent_id, r.id): (r.form, r["head"], r.feats) for r in back} == want


def test_readers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one;two;;three")
    with gzip.open(tmp_path / "in" / "b.txt.gz", "wt") as out:
        out.write("x\ny")
    assert sorted(r.text for r in R.read_texts(spark, str(tmp_path / "in")).collect()) == ["one;two;;three", "x\ny"]
    assert [r.text for r in R.read_texts(spark, str(tmp_path / "in"), "a.*").collect()] == ["one;two;;three"]
    assert [r.piece for r in R.read_delimited(spark, str(tmp_path / "in" / "a.txt"), ";").collect()] == ["one", "two", "three"]
    (tmp_path / "list").write_text(f"{tmp_path}/in/a.txt\n\n")
    assert R.read_file_list(spark, str(tmp_path / "list")).count() == 1
    (tmp_path / "x.xml").write_text("<d><p id='1' k=\"a=b\">one\n<b>two</b></p><p/></d>")
    assert [(r.attributes, r.body) for r in R.read_elements(spark, str(tmp_path / "x.xml"), "p").collect()] == [({"id": "1", "k": "a=b"}, "one\n<b>two</b>"), ({}, "")]
    (tmp_path / "c.conll").write_text("-DOCSTART- -X- O O\n\nEU NNP I-NP I-ORG\nsays VBZ I-VP O\n\nBonn NNP I-NP I-LOC\n")
    got = R.read_columns(spark, str(tmp_path / "c.conll"), R.CONLL_2003).orderBy("block_id", "idx").collect()
    assert [(r.word, r.ner) for r in got] == [("EU", "I-ORG"), ("says", "O"), ("Bonn", "I-LOC")]
    (tmp_path / "v").write_text("+1 3:0.5 7:2 # note\n\n-1\n")
    assert [(r.label, r.features) for r in R.read_svmlight(spark, str(tmp_path / "v")).collect()] == [("+1", {3: 0.5, 7: 2.0}), ("-1", {})]
    (tmp_path / "t.csv").write_text('a,b\n1,"x ""y"",\nz"\n')
    assert [tuple(r) for r in R.read_table(spark, str(tmp_path / "t.csv")).collect()] == [("1", 'x "y",\nz')]
    arrays = spark.createDataFrame([('{a,"b,c","say ""hi"""}',), ("{}",)], "t string").select(R.parse_array(F.col("t")).alias("a")).collect()
    assert [r.a for r in arrays] == [["a", "b,c", 'say "hi"'], []]


def test_json_and_tables(spark, tmp_path):
    frame = spark.createDataFrame([(1, "a<b", [1, 2]), (2, None, [])], "id int, t string, l array<int>")
    frame.select(W.json_line(frame, "id", "t", "l").alias("value")).write.text(str(tmp_path / "j"))
    assert sorted((r.id, r.t, r.l) for r in R.read_json_annotations(spark, str(tmp_path / "j")).collect()) == [(1, "a<b", [1, 2]), (2, None, [])]
    html = W.html_table(frame.withColumn("g", F.lit(0)), ["g"], "id", "id", "t").collect()[0].html
    assert html == "<table><tr><th>id</th><th>t</th></tr><tr><td>1</td><td>a&lt;b</td></tr><tr><td>2</td><td></td></tr></table>"
    edges = spark.createDataFrame([("s", 2, 1, "nsubj")], "graph string, gov int, dep int, reln string")
    assert W.graph_dot(edges, ["graph"]).collect()[0].dot == 'digraph {\n  N_2 -> N_1 [label="nsubj"];\n}'
