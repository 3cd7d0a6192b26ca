from datetime import datetime

from pyspark.sql import functions as F

from eventengine.plans.queries import QUERIES
from eventengine.sources import documents, markup, payloads
from eventengine.sources.registry import SourceRegistry


def docs(spark, *bodies):
    return spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "doc_id long, body string")


def test_table_rows(spark):
    body = "<table><tr><th>x</th></tr><tr><td>Fri 9pm</td><td><a href='/e/1'>Deep <b>Night</b></a> @ The Cave</td><td>$10</td></tr><tr><td></td><td>none</td></tr></table>"
    (r,) = markup.table_rows(docs(spark, body), "https://x.example").collect()
    assert (r["title"], r["venue_name"], r["when_text"], r["price_text"], r["url"]) == ("Deep Night", "The Cave", "Fri 9pm", "$10", "https://x.example/e/1")


def test_cards(spark):
    card = '<div class="card"><a href="/c/{0}"><h3>Card {0}</h3></a><span class="v">Place {0}</span> {1}</div>'
    body = "<main>" + card.format(1, "12 votes") + card.format(2, "room 7") + card.format(1, "again") + "</main>"
    got = markup.cards(docs(spark, body), '<div class="card"', {"title": "(?is)<h3>(.*?)</h3>", "venue_name": '(?is)class="v">(.*?)<'}, "https://x.example").orderBy("pos").collect()
    assert [(r["title"], r["venue_name"], r["votes"], r["url"]) for r in got] == [("Card 1", "Place 1", 12, "https://x.example/c/1"), ("Card 2", "Place 2", None, "https://x.example/c/2")]


def test_schema_org_needs_a_start(spark):
    body = '<div itemtype="https://schema.org/MusicEvent"><a href="/a"><span itemprop="name">A</span></a><meta itemprop="startDate" content="2026-01-02"></div><div itemtype="http://schema.org/Event"><span itemprop="name">B</span></div>'
    (r,) = markup.schema_org(docs(spark, body)).collect()
    assert (r["title"], r["start_text"]) == ("A", "2026-01-02")


def test_json_ld(spark):
    body = """<script type="application/ld+json">{"@graph":[{"@type":"ItemList","itemListElement":[{"item":{"@type":"MusicEvent","name":"N","startDate":"2026-02-03","url":"https://x.example/e/n?aff=1","location":{"name":"V","geo":{"latitude":"1.5","longitude":2}}}},
    {"item":{"@type":"Event","name":"Online","url":"https://x.example/e/o","location":{"@type":"VirtualLocation","name":"web"}}}]}]}</script><script type="application/ld+json">{bad</script>"""
    (r,) = markup.json_ld(docs(spark, body, None)).collect()
    assert (r["name"], r["url"], r["venue"], r["lat"], r["lon"]) == ("N", "https://x.example/e/n", "V", 1.5, 2.0)


def test_embedded_state_and_fallback(spark):
    state = '<script id="__NEXT_DATA__">{"a":{"b":[{"name":"One","start_at":"2026-01-01T00:00:00Z","url":"one"},{"title":"Two","start":"x","slug":"one"}]}}</script>'
    plain = '<a href="https://x.example/z">A long label</a> Mar 3, 2026 @ The Den, +12 going'
    df = docs(spark, state, plain)
    hits = markup.embedded_state(df, "https://x.example")
    assert [(r["title"], r["url"]) for r in hits.collect()] == [("One", "https://x.example/one")]
    more = markup.with_fallback(hits.select("doc_id", "pos", "title", "url"), markup.anchors(df, []).select("doc_id", "pos", "title", "url", "when_text", "attendees"))
    got = {r["doc_id"]: r for r in more.collect()}
    assert got[1]["title"] == "A long label" and got[1]["when_text"] == "Mar 3, 2026" and got[1]["attendees"] == 12


def test_sections_blocks_and_lines(spark):
    html_doc = "<h2><a href='https://x.example/1'>First</a></h2><p>blurb &amp; more</p><h2>No link</h2><p>text</p>"
    (r,) = markup.heading_sections(docs(spark, html_doc)).collect()
    assert r["title"] == "First" and r["url"] == "https://x.example/1"
    (r,) = markup.text_blocks(docs(spark, "Title one\nhttps://x.example/a\nWords\n\nalone\n\n")).collect()
    assert (r["title"], r["url"], r["blurb"]) == ("Title one", "https://x.example/a", "Words")
    got = markup.visible_lines(docs(spark, "<script>x</script><p>A &amp; B</p>\n<style>p{}</style><div>C<br>D</div>")).orderBy("pos").collect()
    assert [x["line"] for x in got] == ["A & B", "C", "D"]


def test_dated_segments(spark):
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(["intro", "Sunday June 7", "Band", "2pm", "Sunday June 14", "Lottery open", "Other"])], "doc_id long, pos int, line string")
    got = markup.dated_segments(lines, r"^\w+day \w+ \d+$", "(?i)lottery").orderBy("pos").collect()
    assert [(r["date_text"], r["body"]) for r in got] == [("Sunday June 7", ["Band", "2pm"]), ("Sunday June 14", ["Other"])]


def test_headings_cells_and_ranges(spark):
    assert [r["title"] for r in markup.headings(docs(spark, "<h2>About us page</h2><h3>A fine evening</h3><h3>a fine evening</h3><h4>x</h4>"), ["About us page"]).collect()] == ["A fine evening"]
    (r,) = markup.br_cells(docs(spark, "<li class='r'><a href='https://x.example/q'>t</a><td>5pm<br/>Room 2<br>Gallery</td></li>"), "<li class='r'", "(?is)<td>(.*?)</td>").collect()
    assert r["parts"] == ["5pm", "Room 2", "Gallery"]
    (r,) = markup.title_range_scan(docs(spark, "Blue Period\nFeb 14–Mar 28, 2026\nGallery Nine")).collect()
    assert (r["title"], r["when_text"], r["venue_name"]) == ("Blue Period", "Feb 14–Mar 28, 2026", "Gallery Nine")


def test_event_urls(spark):
    df = spark.createDataFrame([("https://x.example/fine-show/",), ("https://x.example/2024",), ("https://x.example/wp-admin",), ("https://x.example/about",), ("https://x.example/a/b",)], "u string")
    assert [r["ok"] for r in df.select(markup.is_event_url(F.col("u"), ["about"]).alias("ok")).collect()] == [True, False, False, False, False]


def test_listings(spark):
    body = """{"_embedded":{"events":[{"id":"1","name":" Show ","dates":{"start":{"dateTime":"2026-06-01T03:00:00Z"},"status":{"code":"offsale"}},"priceRanges":[{"min":10.5,"currency":"USD"}],
    "images":[{"url":"s","width":10,"height":10},{"url":"l","width":100,"height":10}],"classifications":[{"segment":{"name":"Music"},"genre":{"name":"Jazz"}}],
    "_embedded":{"venues":[{"name":"V","city":{"name":"C"},"location":{"latitude":"37.5","longitude":"-122.5"}}],"attractions":[{"name":"Band"}]}},{"id":"2","name":"Nowhere"}]}}"""
    items = documents.json_items(docs(spark, body, "not json", "{}"), "_embedded.events", payloads.LISTING)
    (r,) = payloads.listings(items).collect()
    assert (r["title"], r["status"], float(r["price"]), r["image_url"], r["categories"], r["tags"], r["start_at"]) == ("Show", "cancelled", 10.5, "l", ["Music", "Jazz"], ["Band"], datetime(2026, 6, 1, 3))


def test_post_hints(spark):
    at = datetime(2026, 3, 4, 20)
    df = spark.createDataFrame([(0, "Playing at The Blue Room this Saturday 8pm. Come by", at), (1, "Anyone know a good bar?", at), (2, "nothing here", at)], "doc_id long, text string, posted_at timestamp")
    (r,) = payloads.post_hints(df).collect()
    assert r["venue_name"] == "The Blue Room" and r["start_at"] == datetime(2026, 3, 8, 4)


def test_mail_and_senders(spark):
    raw = b"From: Ed <ed@news.list.example>\r\nDate: Mon, 02 Mar 2026 10:00:00 +0100\r\nSubject: Hi\r\nMIME-Version: 1.0\r\nContent-Type: multipart/alternative; boundary=b\r\n\r\n--b\r\nContent-Type: text/plain\r\n\r\nplain\r\n--b\r\nContent-Type: text/html\r\n\r\n<p>html</p>\r\n--b--\r\n"
    m = documents.mail(spark.createDataFrame([("p", bytearray(raw))], "path string, content binary"))
    r = m.first()
    assert (r["sender"], r["subject"], r["html"].strip(), r["plain"].strip(), r["sent_at"]) == ("ed@news.list.example", "Hi", "<p>html</p>", "plain", datetime(2026, 3, 2, 9))
    allow = lambda e: documents.allowed_senders(m, spark.createDataFrame([(e,)], "entry string")).count()
    assert (allow("list.example"), allow("ed@news.list.example"), allow("st.example")) == (1, 1, 0)


def test_registry(spark):
    reg = SourceRegistry()
    reg.register(" B ", lambda d: d.select("doc_id"))
    reg.register("a", lambda d: d.select("doc_id", F.lit(1).alias("extra")))
    assert reg.names() == ["a", "b"]
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, source_name string")
    assert sorted((r["doc_id"], r["source_name"], r["extra"]) for r in reg.collect(df).collect()) == [(1, "a", 1), (2, "b", None)]
    try:
        reg.register("A", lambda d: d)
        raise AssertionError("a second source of that name")
    except ValueError:
        pass


def test_incremental(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 3))], "id int, modified_at timestamp")
    assert documents.since(df, "modified_at", None).count() == 2
    assert documents.since(df, "modified_at", datetime(2026, 1, 2)).count() == 1
    assert [r["url"] for r in documents.crawl_days(spark, F.lit("2026-02-27").cast("date"), 3).collect()] == ["/2026/02/27/", "/2026/02/28/", "/2026/03/01/"]


def test_links_of_many_pages_go_a_few_at_a_time():
    import pyarrow as pa

    page = "".join(f'<p>{"x" * 300}<a href="/e/{k}">Show number {k}</a>' for k in range(1500))
    kind = pa.schema([("doc_id", pa.int64()), ("pos", pa.int32()), ("url", pa.string()), ("label", pa.string()), ("context", pa.string())])
    taken = []

    def pages():
        for k in range(3):
            taken.append(k)
            yield pa.RecordBatch.from_pydict({"doc_id": [10 * k, 10 * k + 1, 10 * k + 2], "body": [page, None, page]})

    got, first = [], None
    for batch in markup.link_batches(pages(), kind):
        first = first or list(taken)
        assert batch.num_rows <= markup.LINKS
        got += batch.to_pylist()
    assert first == [0], "the second batch of pages waits for the links of the first"
    assert [(r["doc_id"], r["pos"], r["url"]) for r in got] == [(d, k, f"/e/{k}") for d in (0, 2, 10, 12, 20, 22) for k in range(1500)]
    at = page.index('<a href="/e/7"')
    assert got[7]["context"] == page[at - 200 : page.index("</a>", at) + 304]


def test_page_anchors_has_every_link_of_a_page(spark, tmp_path):
    links = [f'<a href="/e/{k}">Show number {k}</a>' for k in range(300)]
    pages = {1: links + links[::-1] + ['<a href="/home">Home</a>', '<a href="/s">Show</a>'], 2: links[:50], 3: ["no link"], 4: []}
    spark.createDataFrame([(k, "u", " ".join(x)) for k, x in pages.items()], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r["doc_id"], r["pos"], r["url"], r["title"]) for r in QUERIES["page_anchors"](spark, str(tmp_path)).collect())
    assert got == [(d, k, f"/e/{k}", f"Show number {k}") for d, n in ((1, 300), (2, 50)) for k in range(n)]


def test_visible_lines_unescapes_lines_not_pages(spark):
    import html

    bodies = ["A&#10;B &amp; C&#0010D\n&#x0a;&#Xa;E&NewLine;F&NewLine G&#100;H&#10", "&amp;#10;x\n&am\np;&amp\n;&#xAB;\n\xa0\n \n&nbsp;\n&#13;y&lt;b&gt;", "&", "&#10;", "no reference", ""]
    found = markup.visible_lines(docs(spark, *bodies))
    want = [(k, pos, " ".join(line.split())) for k, b in enumerate(bodies) for pos, line in enumerate(html.unescape(b).split("\n")) if line.split()]
    first = min(r["doc_id"] for r in docs(spark, *bodies).collect())
    assert sorted((r["doc_id"] - first, r["pos"], r["line"]) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Generate"), "lines are made before Python sees them"
