"""Columns of any name in the pipeline, page parts of any length, damaged archives."""

import pytest

from millrace.llm import extract, warc


def paragraphs(n, word):
    return "".join(f"<p>{word} number {k} tells a longer story about the weather and the sea that goes on for a while.</p>" for k in range(n))


ARTICLE = "<article><h1>Title</h1>" + paragraphs(2, "Article") + "</article>"
WANT = "\n\n".join(["Title", *(f"Article number {k} tells a longer story about the weather and the sea that goes on for a while." for k in range(2))])
PARTS = [
    "<aside class=sidebar>{}</aside>", "<footer>{}</footer>", "<form>{}</form>", '<div class="comments"><h3>Comments</h3>{}</div>', '<section id=comments><ol class="comment-list">{}</ol></section>',
    '<div class="cookie-notice">{}</div>', '<div class="site-footer">{}</div>', "<nav>{}</nav>", '<div class="left-sidebar widget-area">{}</div>',
]


@pytest.mark.parametrize("part", PARTS)
@pytest.mark.parametrize("n", [2, 4, 12, 50])
@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_parts_longer_than_the_article_go(part, n, wrap):
    page = f"<body><header>Site name</header>{ARTICLE.replace('article>', wrap + '>')}{part.format(paragraphs(n, 'Other'))}</body>"
    assert extract.main_text(page) == WANT


@pytest.mark.parametrize("part", PARTS)
def test_parts_within_the_article_go(part):
    assert extract.main_text(f"<body>{ARTICLE.replace('</article>', part.format(paragraphs(12, 'Other')) + '</article>')}</body>") == WANT


def test_words_in_names_cut_nothing():
    page = """<body><article><h1>Head</h1><div class=legal><p>What the law says on this matter of the sea and the weather.</p></div>
    <p class="market-share">The share of the market has grown by a lot in this year and the next.</p>
    <p>Text with a <label>labelled word</label> in the middle of a sentence here.</p>
    <ul><li><a href=x>First linked item of text</a></li><li><a href=y>Second linked item</a></li></ul>
    <blockquote><a href=z>A quote that is linked as a whole to its source</a></blockquote></article></body>"""
    assert extract.main_text(page).split("\n\n") == [
        "Head", "What the law says on this matter of the sea and the weather.", "The share of the market has grown by a lot in this year and the next.",
        "Text with a labelled word in the middle of a sentence here.", "First linked item of text", "Second linked item", "A quote that is linked as a whole to its source",
    ]


def test_a_form_around_the_whole_page_is_taken_back():
    page = f"<body><form id=all><div><h1>Title</h1>{paragraphs(2, 'Article')}</div></form><div>A company</div></body>"
    assert extract.main_text(page) == WANT


def test_archives_with_damaged_payloads_are_an_error(spark):
    record = warc.build_record(7, "http://a.example/", b"some payload", None)
    assert warc.parse_record(record)["payload_bytes"] == 12
    with pytest.raises(ValueError, match="damaged"):
        warc.parse_record(record.replace(b"some", b"sore"))
    pages = spark.createDataFrame([(k, f"http://a.example/{k}", "same page" if k % 3 else f"page {k}") for k in range(9)], "page_id long, url string, html string")
    rows = {r.page_id: r for r in warc.read_archives(spark, warc.write_archives(pages)).collect()}
    assert [k for k, r in rows.items() if r.record_type == "revisit"] and all(r.refers_to == 1 and r.payload_bytes == 9 and r.payload_digest == rows[1].payload_digest for r in rows.values() if r.record_type == "revisit")


def test_revisits_without_their_response_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(warc, "_frames", lambda dictionary: _one_frame)
    path = warc.write_archives(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))
    with pytest.raises(Exception, match="no such response"):
        warc.read_archives(spark, path).collect()


def _one_frame(batches):
    import pyarrow as pa
    import zstandard

    for batch in batches:
        frames = [warc.skippable(warc.DICTIONARY, b""), zstandard.ZstdCompressor().compress(warc.build_record(9, "u", b"payload", 5))]
        yield pa.RecordBatch.from_pydict({"frame": pa.array(frames, pa.binary())})


def test_pipeline_keeps_columns_of_any_name(spark, sf):
    import corpus_pipeline as p

    text = "The weather at the sea was good and all of the people went out to look at the ships {} and came home late in the evening of day {}."
    rows = [(k, text.format(k % 10, k % 10), "en", f"s{k % 2}", 5, f"mine {k}", "k", k, "g", "c", "dot", "row") for k in range(30)]
    rows += [(None, None, None, None, None, "none", None, None, None, None, None, None)]
    extra = ["language", "_key", "_copies", "_group", "copies", "a.b", "_row"]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, language string, _key string, _copies long, _group string, copies string, `a.b` string, _row string")
    columns = now.columns
    for name, stage in p.STAGES[:4]:
        now = p.written(stage(spark, now, sf))
        assert now.columns == columns, name
        got = now.collect()
        assert all(r["language"] == f"mine {r['doc_id']}" and r["_copies"] == r["doc_id"] and r["a.b"] == "dot" and r["_row"] == "row" for r in got if r["doc_id"] is not None), name
    assert got and set(extra) <= set(columns)
    assert p.token_output(spark, now, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
