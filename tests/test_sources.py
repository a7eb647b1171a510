import gzip
import json
import zipfile

from pyspark.sql import functions as F

from lexiloom.sources import cues as U
from lexiloom.sources import files, html, ocr, package

RAW = """WEBVTT
before the first clock

1
00:01.000 --> 00:03.120
>> <c>Hello</c> {\\an8}there
12
[music]

00:00:03,500 --> 00:00:05,000
Hello there
- And on.

01:00:00.5 --> 01:00:02.25
NOTE spoken
"""


def lines(spark, raw):
    return spark.createDataFrame([(1, i, x) for i, x in enumerate(raw.splitlines())], "file_id long, line_no long, line string")


def test_cue_parsing(spark):
    rows = lines(spark, RAW)
    got = {r.cue: (r.start, r["end"], r.text) for r in U.cues_of(rows).collect()}
    # The repeated line goes to the first cue, the number and the note are lost, the last cue is empty.
    assert got == {1: (1.0, 3.12, "Hello there"), 2: (3.5, 5.0, "And on.")}
    assert U.looks_like_cues(rows).first().is_cues


def test_folding(spark):
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, "a b"), (1, 2, 1.8, 2.0, "c"), (1, 3, 2.1, 3.0, " ".join("x" * 40)), (1, 4, 3.1, 4.0, "d")], "file_id long, cue long, start double, end double, text string")
    assert [r.joined for r in U.greedy_breaks(cues).orderBy("cue").collect()] == ["start", "break", "space", "break"]
    # A blank line stands before the second and the last cue.
    assert [r.starts_at for r in U.offsets(cues).orderBy("cue").collect()] == [0, 5, 7, 88]
    assert U.folded(cues).first().text == "a b\n\nc " + " ".join("x" * 40) + "\n\nd"
    assert not U.punctuated(cues).first().punctuated


def test_tolerant_html(spark):
    pages = spark.createDataFrame([(1, "<h2>A<b>c</h2><p>x</div><ol><li>one<ul><li>e.g.</ul><li>two &amp; <b>three</ol><script>'</p>'</script>"), (2, None), (3, "<<<")], "page_id long, html string")
    got = {r.page_id: r for r in html.parsed_pages(pages).collect()}
    assert [x.definition for x in got[1].senses][-1] == "two & three" and got[1].headings[0].name == "Ac" and "</p>" not in got[1].text
    assert got[2].text == "" and got[3].senses == []


def test_ocr_archive(spark, tmp_path):
    path = str(tmp_path / "volume.zip")
    page = lambda *blocks: json.dumps({"blocks": [{"lines": list(b)} for b in blocks]})
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("root/metadata.json", json.dumps({"pages": [[0, "img/b.jpg"], [1, "img/a.jpg"]]}))
        z.writestr("root/a.json", page(["タオさん", "いんなら"], ["...", "!"]))
        z.writestr("root/b.json", page(["Hello", "", "world"], ["日本", "text"]))
    spark.dataSource.register(ocr.OcrArchive)
    rows = spark.read.format("ocr_archive").option("path", path).load()
    assert [r.member for r in rows.orderBy("page_id").collect()] == ["root/b.json", "root/a.json"]
    assert [r.text for r in ocr.speech(rows).orderBy("page_id", "block").collect()] == ["Hello world", "日本text", "タオさんいんなら"]


def test_package_round_trip(spark, tmp_path):
    cards = spark.createDataFrame([(1, "recognition", "k1", "f", "b"), (2, "production", None, "g", "c")], "place int, kind string, gloss_key string, front string, back string")
    assert package.write_package(cards, str(tmp_path / "deck.apkg"), "deck") == 2
    got = package.read_packages(spark, str(tmp_path / "*.apkg")).orderBy("due").select("gloss_key", "kind", "due", F.length("guid").alias("n")).collect()
    assert [tuple(r) for r in got] == [("k1", "recognition", 1, 16), (None, "production", 2, 16)]
    assert 1 << 30 <= package.package_id("deck") < 1 << 31


def test_cues_of_many_lines(spark):
    text = "\n".join(f"line {i}" for i in range(100))
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, text), (1, 2, 2.0, 3.0, "after")], "file_id long, cue_ord int, start_s double, end_s double, text string")
    files = spark.createDataFrame([(1, "srt")], "file_id long, dialect string")
    for lines in (U.as_lines(cues, files), U.as_ordered_lines(cues, files)):
        got = {r.cue: r.text for r in U.cues_of(lines, block=1 << 50).collect()}
        assert got[2] == "after" and got[1].startswith("line 0 line 1 ") and got[1].endswith("line 99")


def test_files_and_dispatch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.srt").write_text("\ufeff1\r\n00:00:01,000 --> 00:00:02,000\r\nHi.\r\n", "utf-8")
    (tmp_path / "in" / "b").write_text("WEBVTT\n\n00:01.000 --> 00:02.000\nYo", "utf-8")
    (tmp_path / "in" / "c.txt").write_text("  Plain text.\n", "utf-8")
    rows = files.sources(files.read_texts(spark, str(tmp_path / "in"))).cache()
    assert {r.name.rsplit("/", 1)[1]: (r.kind, r.text[:5]) for r in rows.collect()} == {"a.srt": ("cues", "1\r\n00"), "b": ("cues", "WEBVT"), "c.txt": ("text", "Plain")}
    named = files.cue_lines(rows).withColumn("file_id", F.when(F.col("name").endswith("a.srt"), 1).otherwise(2).cast("long"))
    assert {(r.file_id, r.text) for r in U.cues_of(named.select("file_id", "line_no", "line")).collect()} == {(1, "Hi."), (2, "Yo")}
    (tmp_path / "dump.xml").write_text("<mediawiki><page><title>a</title><revision><model>wikitext</model><text>x</text></revision></page><page><title>b</title><revision><model>flow-board</model><text>y</text></revision></page></mediawiki>")
    assert [r.title for r in files.read_dump_pages(spark, str(tmp_path / "dump.xml")).collect()] == ["a"]
    with gzip.open(tmp_path / "titles.gz", "wt") as f:
        f.write("give_up\n\n  lamp \n")
    assert {r.title for r in files.read_titles(spark, str(tmp_path / "titles.gz")).collect()} == {"give up", "lamp"}
