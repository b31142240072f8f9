import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from daysieve.operators import extras
from daysieve.sources import assistants, outlines


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), body)
    return out.getvalue()


def space(name, body):
    """A part's XML with the namespace prefixes that it uses."""
    own = {"w": outlines.WORD, "s": outlines.SHEET, "p": outlines.SLIDE, "a": outlines.DRAWING, "r": outlines.RELATION, "k": outlines.PACKAGE}
    return f"<{name} " + " ".join(f'xmlns:{k}="{v[1:-1]}"' for k, v in own.items()) + f">{body}</{name}>"


def test_document_outlines(spark):
    style = '<w:style w:styleId="h9"><w:name w:val="heading 1"/></w:style><w:style w:styleId="mine"><w:name w:val="My Head"/><w:basedOn w:val="h9"/></w:style><w:style w:styleId="a"><w:basedOn w:val="b"/></w:style><w:style w:styleId="b"><w:basedOn w:val="a"/></w:style>'
    para = lambda s, t: f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t[:2]}</w:t></w:r><w:r><w:t>{t[2:]}</w:t></w:r></w:p>'
    title = lambda kind, t: space("p:sld", f'<p:sp><p:nvSpPr><p:nvPr><p:ph type="body"/></p:nvPr></p:nvSpPr><a:t>no</a:t></p:sp><p:sp><p:nvSpPr><p:nvPr><p:ph type="{kind}"/></p:nvPr></p:nvSpPr><a:t>{t}</a:t></p:sp>')
    slides = space("p:presentation", '<p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst>')
    rels = space("k:Relationships", '<k:Relationship Id="r1" Target="slides/slide1.xml"/><k:Relationship Id="r2" Target="/ppt/slides/slide7.xml"/>')
    xmp = b'%PDF <x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="r"><dc:title xmlns:dc="http://purl.org/dc/elements/1.1/"><rdf:Alt><rdf:li>From &amp; XMP</rdf:li></rdf:Alt></dc:title></rdf:RDF></x:xmpmeta>'
    files = {
        "/d/a.docx": archive(word__styles_xml=space("w:styles", style), word__document_xml=space("w:document", para("a", "plain") + para("h9", "One &amp; two") + para("Heading2", "Three") + para("mine", "Four") + para("Heading5", "too deep"))),
        "/d/b.xlsx": archive(xl__workbook_xml=space("s:workbook", '<s:sheets><s:sheet name="Plan" sheetId="1"/><s:sheet name="&lt;Data&gt;" sheetId="2"/></s:sheets>')),
        "/d/c.pptx": archive(**{"ppt/_rels/presentation.xml.rels": rels}, ppt__presentation_xml=slides, ppt__slides__slide1_xml=title("title", "Second"), ppt__slides__slide7_xml=title("ctrTitle", "First")),
        "/d/d.pdf": b"%PDF /Title (A (b) \\) \\101\\\n)",
        "/d/e.pdf": b"%PDF /Title <FEFF6F225B57>",
        "/d/f.docx": b"broken",
        "/d/g.txt": b"x",
        "/d/h.pdf": xmp,
        "/d/i.docx": archive(word__document_xml=space("w:document", para("x", "only text") + para("y", "more"))),
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "path string, content binary")
    got = {r.path: (r.outline_kind, r.outline) for r in outlines.document_outlines(df).collect()}
    assert got == {"/d/a.docx": ("headings", ["One & two", "Three", "Four"]), "/d/b.xlsx": ("sheets", ["Plan", "<Data>"]), "/d/c.pptx": ("slides", ["First", "Second"]), "/d/d.pdf": ("title", ["A (b) ) A"]), "/d/e.pdf": ("title", ["漢字"]), "/d/f.docx": (None, None), "/d/h.pdf": ("title", ["From & XMP"]), "/d/i.docx": ("title", ["only text"])}


def said(rows):
    return [(r.role, r.text) for r in sorted(rows.collect(), key=lambda r: (r.session_id, r.seq))]


def test_history_with_chat(spark):
    h = spark.createDataFrame([("/w", "# 2024-01-09 10:00:00.123\n+fix\n+more\n\n# 2024-01-09 11:00:00\n+next\n")], "dir string, text string")
    c = spark.createDataFrame([("/w", "# aider chat started at x\n\n#### fix\n> tokens\ndone\n\n#### next\n\n#### fix\nlater")], "dir string, text string")
    assert said(assistants.history_and_chat(h, c)) == [("user", "fix\nmore"), ("assistant", "done"), ("user", "next")]


def test_model_io(spark, tmp_path):
    line = '{"sessionId":"s","turnId":"%s","startedAt":"2024-01-09T10:00:0%dZ","request":{"messages":[%s]},"response":{"text":"%s"}}\n'
    user = '{"role":"user","content":"%s"}'
    (tmp_path / "io.jsonl").write_text(line % ("t1", 1, user % "ask" + "," + user % "<noise>", "part") + line % ("t1", 2, user % "ask", "whole") + line % ("t0", 0, '{"role":"system","content":"Generate a concise title"},' + user % "x", "title") + "bad\n")
    assert said(assistants.model_io_lines(spark, str(tmp_path / "io.jsonl"))) == [("user", "ask"), ("assistant", "whole")]


def test_bubbles(spark):
    kv = [("composerData:c", '{"createdAt":1704794400000,"fullConversationHeadersOnly":[{"bubbleId":"b"},{"bubbleId":"a"},{"bubbleId":"gone"}]}'), ("bubbleId:c:a", '{"type":2,"text":"yes"}'), ("bubbleId:c:b", '{"type":1,"text":"ok?"}'), ("composerData:x", "bad")]
    rows = assistants.bubble_table(spark.createDataFrame(kv, "key string, value string"), spark.createDataFrame([("c", "/w")], "session_id string, cwd string"))
    assert said(rows) == [("user", "ok?"), ("assistant", "yes")]
    assert {(r.ts, r.cwd) for r in rows.collect()} == {(datetime(2024, 1, 9, 10), "/w")}


def test_messages_anywhere(spark):
    files = [("a", '{"data": {"items": [{"role": "user", "content": "q", "timestamp": "1704794400"}, {"deep": {"sender": "bot", "text": "r"}}]}}'), ("b", '{"role": "human", "text": "one"}\nbad\n{"role": "assistant", "message": {"content": "two"}}\n'), ("c", "nothing")]
    df = spark.createDataFrame([(*f, datetime(2024, 1, 1)) for f in files], "file string, text string, mtime timestamp")
    rows = assistants.any_messages(df)
    assert said(rows) == [("user", "q"), ("assistant", "r"), ("user", "one"), ("assistant", "two")]
    assert {r.text: r.ts for r in rows.collect()}["r"] == datetime(2024, 1, 9, 10)


def test_small_operators(spark):
    m = spark.createDataFrame([("k", ["a"], 0), ("l", ["b"], 0)], "key string, source_ids array<string>, images int")
    i = spark.createDataFrame([("1", "k"), ("2", None), ("3", "gone")], "id string, for_key string")
    assert {r.key: (r.source_ids, r.images) for r in extras.attach_images(m, i).collect()} == {"k": (["a", "image:1"], 1), "l": (["b"], 0)}
    blocks = spark.createDataFrame([("p", datetime(2024, 1, 9, 9, 40), datetime(2024, 1, 9, 10, 0)), ("p", datetime(2024, 1, 9, 14, 10), datetime(2024, 1, 9, 14, 10))], "project string, start_ts timestamp, end_ts timestamp")
    hours = extras.board_hours(blocks)
    assert sorted(r.hour.hour for r in hours.collect()) == [9, 10, 13, 14]
    assert [(r.from_hour.hour, r.to_hour.hour) for r in extras.idle_spans(hours).collect()] == [(11, 13)]
    one = spark.createDataFrame([("sk-abcdefghij", 'Sure: {"a": 1} ok')], "k string, j string").select(extras.mask_key(F.col("k")).alias("k"), F.try_variant_get(extras.model_json(F.col("j")), "$.a", "int").alias("a")).first()
    assert (one.k, one.a) == ("*********ghij", 1)
