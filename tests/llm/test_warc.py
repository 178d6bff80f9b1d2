"""WARC derivatives: links, round trips, codings, odd and hostile records."""

import gzip
import json
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest

from lectern.llm import markup, queries, warc
from tests.llm.tables import clashing
from tests.llm.test_pages import PAGE

as_dict = lambda headers: {h["name"]: h["value"] for h in headers}


def test_records_are_linked_and_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/x", PAGE), (2, None, None), (3, "http://b.example/", "")], "page_id int, url string, html string")
    responses = warc.responses_of_pages(clashing(pages))
    made = warc.build_derivatives(responses, ["page_id"]).collect()
    assert Counter((r.key.page_id, r.type) for r in made) == Counter((i, t) for i in (1, 2, 3) for t in ("metadata", "conversion"))
    source = {r.page_id: ([(h["name"], h["value"]) for h in r.headers], bytes(r.block)) for r in responses.collect()}
    for r in made:
        headers = dict(source[r.key.page_id][0])
        assert r.refers_to == headers["WARC-Record-ID"] and r.payload_digest == headers["WARC-Payload-Digest"] and r.date == headers["WARC-Date"]
        assert r.block_digest == warc.digest(bytes(r.block)) and r.target_uri == headers.get("WARC-Target-URI")
        if r.type == "metadata":
            facts = json.loads(bytes(r.block))["Envelope"]
            assert as_dict(facts["WARC-Header-Metadata"]) == headers and facts["Payload-Metadata"]["HTTP-Response-Metadata"]["Status"] == "200"
    text = next(bytes(r.block).decode() for r in made if r.key.page_id == 1 and r.type == "conversion")
    assert text.startswith("Site\nA\nbuy things now\nA & title\n") and "var a" not in text and text.endswith("© all")
    # written out and read again, gzipped and not
    whole = b"".join(warc.serialize([(h["name"], h["value"]) for h in r.headers], bytes(r.block)) for r in made)
    (tmp_path / "a.warc").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(warc.serialize(h, b)) for h, b in source.values()))
    back = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted((as_dict(r.headers)["WARC-Record-ID"], bytes(r.block)) for r in back if r.path.endswith("a.warc")) == sorted((r.record_id, bytes(r.block)) for r in made)
    again = warc.build_derivatives(warc.read_warc(spark, str(tmp_path / "b.warc.gz"))).collect()
    assert {r.record_id for r in again} == {r.record_id for r in made} and all(r.key is None for r in again)


def test_empty_tables_repeats_and_clashing_names(spark):
    rows = spark.createDataFrame([(1, "http://a/", "<p>x"), (1, "http://a/", "<p>x"), (None, None, None)], "type int, url string, html string").selectExpr("*", "type AS date")
    responses = warc.responses_of_pages(rows, "type").withColumnRenamed("type", "date")
    made = warc.build_derivatives(responses, ["date"]).collect()
    assert Counter(r.key["date"] for r in made) == {1: 4, None: 2} and {r.type for r in made} == {"metadata", "conversion"}
    assert warc.build_derivatives(responses.limit(0), ["date"]).count() == 0
    bare = spark.createDataFrame([(None, None), ([("WARC-Type", "response")], None)], f"headers {warc.HEADERS}, block binary")
    assert [r.type for r in warc.build_derivatives(bare).collect()] == ["metadata"]


def test_other_records_and_contents():
    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/plain; charset=latin-1\r\n\r\ncaf\xe9"
    made = warc.derived([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], http)
    assert [dict(h)["WARC-Type"] for h, _ in made] == ["metadata", "conversion"] and made[1][1] == "café".encode()
    assert [dict(h)["WARC-Type"] for h, _ in warc.derived([("WARC-Type", "response")], b"HTTP/1.1 200\r\nContent-Type: image/png\r\n\r\n\x00")] == ["metadata"]
    assert warc.derived([("WARC-Type", "request")], b"") == [] and warc.derived([], b"") == []
    assert list(warc.parse(b"nothing")) == [] and list(warc.parse(b"WARC/1.0\r\ncut")) == []


def test_repeated_and_folded_headers_stay():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Protocol: h2\r\nWARC-Protocol: tls/1.3\r\nX: a\r\n  b\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    [(headers, block)] = warc.parse(b"noise\n" + record + record[:-6])
    assert headers == [("WARC-Type", "response"), ("WARC-Protocol", "h2"), ("WARC-Protocol", "tls/1.3"), ("X", "a b"), ("Content-Length", "3")] and block == b"abc"
    metadata = warc.derived(headers, block)[0][1]
    assert json.loads(metadata)["Envelope"]["WARC-Header-Metadata"] == [{"name": k, "value": v} for k, v in headers]
    assert list(warc.parse(gzip.compress(record)[:-12])) == []


@pytest.mark.parametrize("coding,pack", [("gzip", gzip.compress), ("deflate", zlib.compress), ("deflate", lambda b: zlib.compress(b)[2:-4]), ("identity", bytes)])
@pytest.mark.parametrize("chunked", [False, True])
def test_codings_are_undone(coding, pack, chunked):
    body = pack("<p>héllo<p>wörld".encode())
    if chunked:
        body = b"".join(b"%x;q=1\r\n%s\r\n" % (len(body[i : i + 7]), body[i : i + 7]) for i in range(0, len(body), 7)) + b"0\r\n\r\n"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: {coding}\r\n{'Transfer-Encoding: chunked' if chunked else 'X: y'}\r\n\r\n".encode() + body
    made = warc.derived([("WARC-Type", "response")], http)
    assert made[1][1].decode() == "héllo\nwörld" and dict(made[1][0])["WARC-Source-Payload-Digest"] == warc.digest(body)


def test_what_cannot_be_opened_has_metadata_only():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: %s\r\n\r\nnot so"
    for coding in (b"br", b"gzip", b"deflate"):
        [(_, facts)] = warc.derived([("WARC-Type", "response")], http % coding)
        assert json.loads(facts)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]["Entity-Not-Opened"]
    assert warc.opened(gzip.compress(b"a" * 5000), [("Content-Encoding", "gzip")], 4999) == (None, True)
    assert warc.unchunked(b"plain text") == b"plain text"


def test_page_facts():
    facts = warc.page_facts("<title>a  &amp;\nb</title><meta content='x > y' name=\"k\"><META NAME=q><a class=z href=/u?a&amp;b>t</a><img alt='>' src=\"i.png\"><a name=n><script src=s.js>'<a href=no>'</script>")
    assert facts["Head"] == {"Title": "a & b", "Metas": [{"name": "k", "content": "x > y"}]}
    assert [(x["path"], x["url"]) for x in facts["Links"]] == [("A@/href", "/u?a&b"), ("IMG@/src", "i.png"), ("SCRIPT@/src", "s.js")]


@pytest.mark.parametrize("page,want", [("<head><title>t</title><p>no head end", "no head end"), ("a<svg><text>b</text></svg>c", "a c"), ("x<script>y", "x"), ("1 < 2 <b>b</b>", "1 < 2 b"), ("a<!-- b", "a"), ("<p title='>'>a\rb\n c<br>d", "a b c\nd"), ("&lt;p&gt;", "<p>")])
def test_plain_text(page, want):
    assert warc.plain_text(page) == want


def http_response(body, *headers):
    return b"HTTP/1.1 200 OK\r\n" + b"".join(h.encode() + b"\r\n" for h in headers) + b"\r\n" + body


def made_of(body, *headers):
    """(facts, text) of a response's derived records."""
    made = warc.derived([("WARC-Type", "response"), ("WARC-Record-ID", "<x>")], http_response(body, *headers))
    facts = json.loads(made[0][1])["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
    return facts, made[1][1].decode() if len(made) > 1 else None


def test_gzip_members_and_cut_payloads():
    packed = lambda *parts: b"".join(gzip.compress(p) for p in parts)
    plain = "Content-Type: text/plain"
    coded = (plain, "Content-Encoding: gzip")
    facts, text = made_of(packed(b"aaa", b"", b"bbb") + b"\0\0\0", *coded)
    assert text == "aaabbb" and "Entity-Cut-Off" not in facts
    long = packed(bytes(range(256)) * 3000)
    facts, text = made_of(long[: len(long) // 2], *coded)
    assert facts["Entity-Cut-Off"] and text
    damaged = packed(b"aaa") + packed(b"b" * 3000)[:15] + b"\xff" * 40
    assert made_of(damaged, *coded)[0]["Entity-Cut-Off"] and made_of(damaged, *coded)[1].startswith("aaa")
    assert made_of(b"no gzip at all", *coded)[0]["Entity-Not-Opened"]
    many = packed(b"x") * 60_000
    began = time.time()
    assert warc.opened(many, [("Content-Encoding", "gzip")])[0] == b"x" * 60_000 and time.time() - began < 8
    assert warc.opened(many, [("Content-Encoding", "gzip")], 59_999)[0] is None and warc.opened(many, [("Content-Encoding", "gzip")], 60_000)[1]
    raw = zlib.compressobj(wbits=-15)
    assert made_of(raw.compress(b"raw") + raw.flush(), plain, "Content-Encoding: deflate")[1] == "raw"


@pytest.mark.parametrize("charset", ["undefined", "idna", "punycode", "unicode_escape", "hex", "rot13", "nothing", "utf-99", "é", "mbcs"])
def test_odd_charsets_count_as_utf_8(charset):
    assert made_of("é\\ud800".encode(), f"Content-Type: text/plain; charset={charset}")[1] == "é\\ud800"


@pytest.mark.parametrize("charset", ["latin-1", "windows-1252", "utf-16", "shift_jis", "utf-7"])
def test_charsets_of_texts(charset):
    assert made_of("abc".encode(charset), f"Content-Type: text/plain; charset={charset}")[1] == "abc"


@pytest.mark.parametrize("length", ["9" * 14, "9" * 20, "9" * 5000, "٣", "-3", "1e3"])
def test_lengths_beyond_what_is_there_end_a_file(length):
    whole = warc.serialize([("WARC-Type", "response"), ("Content-Length", "3")], b"abc")
    odd = f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {length}\r\n\r\nabc\r\n\r\n".encode()
    found = [b for _, b in warc.parse(whole + odd)]
    assert found[0] == b"abc" and found[1:] in ([], [b""])  # a length that is no number is none
    assert [b for _, b in warc.parse(warc.serialize([("Content-Length", "0003")], b"abc"))] == [b"abc"]


HOSTILE_PAGES = ["<p>a &#" + "9" * 5000 + "; b", "<title>&#" + "0" * 5000 + "65;</title><p>&#" + "0" * 5000 + "66", "<p>&#x" + "f" * 9000 + ";", "<meta name=a content='&#" + "8" * 6000 + "'>", "<a href='/?&#" + "7" * 6000 + "'>x</a>"]


def test_pages_with_endless_references_stop_no_job(spark):
    from lectern.llm import maintext

    pages = spark.createDataFrame([*enumerate([f"http://a.example/{i}" for i in range(len(HOSTILE_PAGES))])], "page_id int, url string")
    pages = pages.join(spark.createDataFrame([*enumerate(HOSTILE_PAGES)], "page_id int, html string"), "page_id")
    made = warc.build_derivatives(warc.responses_of_pages(pages), ["page_id"]).where("type = 'conversion'").collect()
    said = {r.key.page_id: bytes(r.block).decode() for r in made}
    assert said[0] == "a � b" and said[1] == "B" and said[2] == "�" and len(said) == len(HOSTILE_PAGES)
    assert maintext.extract(pages).count() == len(HOSTILE_PAGES)


HOSTILE = ['<meta name=a "', "<title>", "<a ", '<a ">" ', "<a '\">", "<script>x</script", "<head>", "<svg>", "<!--", "</", "<a href=", "&#", "a=\"'", "<meta " + "\t" * 9, "<p " + "x=" * 9]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_end(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.time()
    warc.plain_text(page)
    warc.page_facts(page)
    assert time.time() - began < 5


def test_tokens_hold_the_whole_page_and_find_ends_as_a_plain_scan_does():
    import random

    rng = random.Random(5)

    def plain_end(page, at):
        quote = None
        for i in range(at, len(page)):
            c = page[i]
            if quote:
                quote = None if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c == ">":
                return i
        i = page.find(">", at)
        return len(page) if i < 0 else i

    for _ in range(3000):
        page = "".join(rng.choice(["<a", " ", '"', "'", ">", "x", "</a", "<!--", "-->", "<"]) for _ in range(rng.randrange(30)))
        ends = markup._Ends(page)
        at = 0
        while (at := page.find("<a", at)) >= 0:
            at += 2
            assert ends.find(at) == plain_end(page, at), page
        list(markup.tokens(page))
        assert len(ends.lost) <= 3


class Plain(HTMLParser):
    """Text and title of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.title = [], None, None

    def handle_starttag(self, tag, attrs):
        if self.hidden == "head" and tag not in warc.IN_HEAD:
            self.hidden = None
        if tag == "title" and self.title is None:
            self.title = ""
        if self.hidden:
            self.inside = tag
            return
        if tag in warc.UNSEEN:
            self.hidden = self.inside = tag
        elif tag in warc.LINES:
            self.parts.append("\0")

    def handle_endtag(self, tag):
        self.inside = None
        if self.hidden:
            if tag == self.hidden:
                self.hidden = None
                self.parts.append(" ")
        elif tag in warc.LINES:
            self.parts.append("\0")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data.replace("\0", " "))
        elif self.inside == "title":
            self.title += data


def test_query_equals_a_plain_builder(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op10_warc_derivatives(spark, sf).collect()
    assert Counter((r.page_id, r.type) for r in got) == Counter((i, t) for i in pages for t in ("metadata", "conversion"))
    refers: dict = {}
    for r in got:
        page = pages[r.page_id]
        plain = Plain()
        plain.feed(page.html or "")
        plain.close()
        payload = (page.html or "").encode()
        assert refers.setdefault(r.page_id, r.refers_to) == r.refers_to and r.record_id != r.refers_to and r.target_uri == page.url
        assert r.payload_digest == warc.digest(payload) and r.block_digest == warc.digest(r.content.encode()) and r.content_length == len(r.content.encode()) and r.date == warc.PAGE_DATE
        if r.type == "conversion":
            lines = (" ".join(x.split()) for x in "".join(plain.parts).split("\0"))
            assert r.content_type == "text/plain" and r.content == "\n".join(x for x in lines if x)
        else:
            facts = json.loads(r.content)["Envelope"]["Payload-Metadata"]["HTTP-Response-Metadata"]
            assert facts["Entity-Length"] == len(payload) and facts["HTML-Metadata"]["Head"]["Title"] == (None if plain.title is None else " ".join(plain.title.split()))
    assert len(set(refers.values())) == len(pages) and len({r.record_id for r in got}) == 2 * len(pages)
