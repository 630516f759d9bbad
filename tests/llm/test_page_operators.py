import re

from tidewire.llm import html_text as H
from tidewire.llm import warc as A
from tidewire.llm.url_filter import RULES, filter_urls

PAGES = "page_id long, url string, html string"


def test_url_verdicts(spark):
    hop = "<link rel='canonical' href='http://q.example.net/es/1'>"
    rows = [(1, "http://a.example.org/x", hop), (2, "http://b.example.org/", '<META HTTP-EQUIV="refresh" content="0; url=http://a.example.org/x#z">'), (3, "http://www.example.com/en/9", hop), (4, None, None), (5, "nourl", "<link rel=canonical href=/x>"), (6, "HTTP://NEWS.EXAMPLE.COM/en/?b#c", None), (7, "http://r.example.org/d/e", '<link rel="canonical" href="/z?a=1&amp;b=2">'), (8, "http://com", None), (1, "http://a.example.org/x", hop), (None, "http://x.net/fr/", "")]
    df = spark.createDataFrame([(*r, "dup") for r in rows], PAGES + ", verdict string")
    want = sorted([(1, None, "block", "alias"), (2, None, "block", "alias"), (3, "www.example.com/en/", "allow", "rule"), (4, None, "allow", "default"), (5, None, "allow", "default"), (6, "example.com/en/", "block", "rule"), (7, None, "allow", "default"), (8, None, "allow", "default"), (1, None, "block", "alias"), (None, "net/fr/", "block", "rule")], key=str)
    for rules in (RULES, [*RULES, *(("block", f"h{i}.org", "/") for i in range(1001))]):
        assert sorted(((x.page_id, x.rule, x.verdict, x.by) for x in filter_urls(df, rules).collect()), key=str) == want
    assert filter_urls(df.limit(0)).count() == 0


def test_redirect_log_and_hub(spark):
    rows = [(i, f"http://s{i}.example.org/p", None) for i in range(50)]
    log = spark.createDataFrame([(f"http://s{i}.example.org/p", "http://hub.example.net/es/x") for i in range(49)], "src string, dst string")
    got = {x.page_id: x.verdict for x in filter_urls(spark.createDataFrame(rows, PAGES), redirects=log).collect()}
    assert got == {i: "block" if i < 49 else "allow" for i in range(50)}


def archives(spark, rows):
    return A.write_archives(A.decide(spark.createDataFrame(rows, PAGES).coalesce(1)))


def test_round_trip(spark):
    big = "y" * 2000
    rows = [(1, "u", big), (2, "u\r\nv", big), (3, None, None), (4, "u", big + "z"), (5, "s", "short"), (6, "s", "short"), (7, "u", big)]
    out = {x.record_id: x for x in A.read_archives(archives(spark, rows), with_payload=True).collect()}
    assert {k: (x.warc_type, x.refers_to) for k, x in out.items()} == {"1": ("revisit", "7"), "2": ("revisit", "7"), "3": ("response", None), "4": ("response", None), "5": ("response", None), "6": ("response", None), "7": ("response", None)}
    assert bytes(out["7"].payload).decode() == big and out["1"].payload_bytes == 2000 and out["1"].payload_digest == out["7"].payload_digest
    assert A.read_archives(A.write_archives(A.decide(spark.createDataFrame([], PAGES)))).count() == 0


def test_damage_is_quarantined(spark):
    rows = [(i, f"http://x/{i}", f"page {i} " * 50) for i in range(20)]
    data = bytearray(archives(spark, rows).first().data)
    whole = [r for r in A.salvage(bytes(data)) if r[3] and r[3]["warc-type"] == "response"]
    start, stop = whole[7][0], whole[7][1]
    data[start + 40] ^= 255
    data[stop:stop] = b"\x00garbage\x1f\x8b\x08"
    found = list(A.salvage(bytes(data)))
    assert len([r for r in found if r[3] and r[3]["warc-type"] == "response"]) == 19
    gaps = [r[:3] for r in found if r[2]]
    assert gaps[0][0] == start and gaps[-1][1] == stop + 11
    cut = bytes(data[: len(data) - 30])
    assert [r for r in A.salvage(cut)][-1][2]
    assert list(A.salvage(b"")) == []


def test_plain_records_and_version_lines():
    one = A.record([("WARC-Type", "resource"), ("WARC-Record-ID", "<a>")], b"body")
    found = list(A.salvage(b"junk" + one + b"WARC/1.1\r\nContent-Length: 99\r\n\r\nx" + one))
    assert [(r[2] is None) for r in found] == [False, True, False, True]


def test_members_of_many_records():
    import hashlib
    import random

    r = random.Random(1)
    blocks = [bytes(r.choices(b"abcdefgh <>/", k=3000)) for _ in range(12)]
    one = [A.record([("WARC-Record-ID", f"<{i}>"), ("WARC-Block-Digest", A._b32(hashlib.sha1(b).hexdigest()))], b) for i, b in enumerate(blocks)]
    other = A.member(A.record([("WARC-Record-ID", "<z>")], b"z"))

    def read(data):
        found = list(A.salvage(data))
        return [f["warc-record-id"].strip("<>") for *_, f, _ in found if f], [x[:3] for x in found if x[2]]

    names = [str(i) for i in range(12)]
    whole = A.member(b"".join(one))
    assert read(whole + other) == ([*names, "z"], [])
    bad = A.member(b"".join([*one[:4], one[4].replace(blocks[4][:50], b"?" * 50), b"junk", *one[5:]]))
    got, gaps = read(bad + other)
    assert got == [*names[:4], *names[5:], "z"] and gaps == [(0, len(bad), "wrong digest")]
    got, gaps = read(whole[: len(whole) // 2])
    assert len(got) >= 5 and got == names[: len(got)] and gaps == [(0, len(whole) // 2, "cut off")]
    half = len(whole) // 2
    got, gaps = read(whole[:half] + b"\x00" * 400 + whole[half + 400 :] + other)
    assert got[:5] == names[:5] and got[-1] == "z" and len(gaps) == 1 and gaps[0][:2] == (0, len(whole))
    got, gaps = read(whole[:-8] + b"\x00" * 8 + other)
    assert got == [*names, "z"] and gaps[0][:2] == (0, len(whole))
    single = A.member(one[0])
    assert read(single[:-8] + b"\x00" * 8 + other)[0] == ["z"]


PAGE = '<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div class="box">Fixed words here</div><div id="cookie-notice">We use cookies</div><div class="text"><h1>Title {0}</h1><p>Body &amp; soul of {0}<br>goes on <b>and on</b><p>Second {0}</div><form>Ask</form><section class="comments"><p>Nice {0}</section><footer>&copy; {0}</footer>'


def test_template_is_found_across_pages(spark):
    rows = [(i, f"http://h.org/{i}", PAGE.format(i)) for i in range(8)] + [(20, "http://other.org/", PAGE.format(20)), (21, None, None), (22, "x", "plain  text"), (None, "http://h.org/n", "")]
    got = {x.page_id: x.text for x in H.extract(spark.createDataFrame([(*r, "q") for r in rows], PAGES + ", text string")).collect()}
    for i in range(8):
        assert got[i] == f"Title {i}\nBody & soul of {i} goes on and on\nSecond {i}"
    assert got[20].startswith("Fixed words here\nTitle 20")
    assert got[21] == "" and got[22] == "plain text" and got[None] == ""
    assert H.extract(spark.createDataFrame([], PAGES)).count() == 0


def texts(spark, rows):
    return {x.page_id: x.text for x in H.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_copies_keep_their_text(spark):
    page = "<div class='top'>Fixed words</div><div class='text'><h1>Title {0}</h1><p>Body of {0}</p></div>"
    rows = [(i, f"http://copy.org/{i}", page.format("one" if i < 6 else i)) for i in range(10)]
    rows += [(20 + i, f"http://small.org/{i}", page.format("same")) for i in range(4)]
    got = texts(spark, rows)
    for i in range(10):
        assert got[i] == "Title {0}\nBody of {0}".format("one" if i < 6 else i)
    for i in range(4):
        assert got[20 + i] == "Fixed words\nTitle same\nBody of same"


def test_template_of_each_layout(spark):
    story = "<div class='text'><h1>Story {0}</h1><p>Words of {0}</p></div><div class='box'>Read this every day</div>"
    listing = "<table class='grid'><tr><td>Price {0}</td></tr></table><div class='terms'><ul><li>Prices without tax</li></ul></div>"
    deep = "<div>" * 200 + "<p>Deep words</p><p>Told {0}</p>"
    rows = [(i, f"http://h.org/{i}", x.format(i)) for i, x in enumerate([story] * 9 + [listing] * 5 + [deep] * 5)]
    got = texts(spark, rows)
    for i in range(19):
        assert got[i] == (f"Story {i}\nWords of {i}" if i < 9 else f"Price {i}" if i < 14 else f"Told {i}")


def kept(page):
    return [text for _, keep, text in H.parse(page)[1] if keep]


def test_hint_words_do_not_drop_the_main_text():
    body = "<h1>Title</h1><p>" + "Many words of the story. " * 8 + "</p>"
    want = ["Title", ("Many words of the story. " * 8).strip()]
    for wrapper in ("<div class='content has-sidebar'>", "<div class='ad-free'>", "<div id='widget'>", "<div class='sidebar'><article>", "<article class='post category-legal comments-open'>", "<article class='post'><div class='share-story'>", "<div class='notice'><main>"):
        assert kept(wrapper + body) == want, wrapper
    page = "<div class='ad-free layout'>" + body + "{}</div>"
    for part in ("<div class='sidebar'>Left out</div>", "<p id='cookie-notice'>Left out</p>", "<div class='story ad-slot'>Left out</div>", "<div class='siteFooter'>Left out</div>", "<section class='comments'><article>Left out</article></section>"):
        assert kept(page.format(part)) == want, part
    assert kept("<article>" + body + "</article><div class='related'><article>Left out</article></div>") == want
    assert kept(body + "<div class='legal-matters'>" + "All of this stays. " * 9 + "</div>")[2:] == [("All of this stays. " * 9).strip()]


def test_given_pages(spark):
    import html

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for x in df.collect():
        body = re.sub("</?b>", "", x.html[x.html.index("<article>") : x.html.index("</article>")]).replace("<br>", " ")
        blocks = [" ".join(html.unescape(b).split()) for b in re.split("</?(?:article|h1|p)>", body)]
        want[x.page_id] = "\n".join(b for b in blocks if b)
    assert {x.page_id: x.text for x in H.extract(df).collect()} == want


def test_trees_align():
    assert H.align("a ( b c ( d ) e )", "a ( c ( d ) e f )") == [0, -1, 1, 2, 3]
    assert H.parse("<div>" * 3000 + "x")[1] == [(-1, True, "x")]
    assert H.parse("<a title='x>y")[1]


def test_runs_of_false_marks_take_linear_time():
    import time

    import tidewire.llm.warc as A

    one = A.record([("WARC-Type", "response")], b"body")
    for junk in (b"WARC/1.", b"WARC/1.1\r\n", b"WARC/1.1\r\nx: WARC/1.0\r\n", b"\x1f\x8b\x08", b"WARC/1.1\r\nContent-Length: x\r\n\r\n"):
        for wrap in (lambda d: d, A.member):
            data = wrap(junk * (320_000 // len(junk)) + one)
            began = time.perf_counter()
            found = [r for r in A.salvage(data) if r[3]]
            assert [r[4] for r in found] == [b"body"], junk
            assert time.perf_counter() - began < 8, junk


def test_lines_that_articles_repeat_stay(spark):
    page = "<div class='top'>Fixed words</div><article><h1>Title {0}</h1><p>By our staff</p><p>Body of {0}</p><p>Sources agree on this point.</p></article>"
    rows = [(i, f"http://h.org/{i}", page.format(i)) for i in range(7)] + [(9, "http://h.org/9", page.format(3)), (9, "http://h.org/9", page.format(3))]
    rows.append((10, "http://h.org/10", page.format("long " * 50_000)))
    got = texts(spark, rows)
    for i in range(7):
        assert got[i] == f"Title {i}\nBy our staff\nBody of {i}\nSources agree on this point."
    assert got[9] == got[3] and len(got[10]) > 500_000


def test_marked_pages_are_aligned(spark):
    """Blocks of marked pages stand at nodes of their trees; the slots that marked articles fill are content, others still judged."""
    page = lambda k, tag: f"<html><body><{tag} class='story'><h1>Title {k}</h1><div>By our staff</div><p>Body {k} of it</p></{tag}></body></html>"
    nodes = [n for n, _, _ in H.parse(page(1, "article"))[1]]
    assert min(nodes) >= 0 and len(set(nodes)) == 3
    marked = [(k, "http://h.example/x", page(k, "article")) for k in range(6)]
    plain = [(k, "http://g.example/x", page(k, "div")) for k in range(10, 16)]
    got = texts(spark, [*marked, *plain])
    assert all(got[k] == f"Title {k}\nBy our staff\nBody {k} of it" for k in range(6))
    assert all(got[k] == f"Title {k}\nBody {k} of it" for k in range(10, 16))
