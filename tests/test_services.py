"""Clients, connectors, parsers, settings and the server, over made-up transports."""

import io
import json
import sys
import types

import pytest

from lectern import server, services
from lectern.engine import TOOLS, Engine
from lectern.errors import ConfigError, ServiceUnavailable, StageFailed
from lectern.sources import parsers
from lectern.sources.settings import Settings


class Said:
    """A transport that gives answers in turn and remembers what it was asked."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, method, url, headers, body, seconds):
        self.asked.append((method, url, headers, body, seconds))
        got = self.answers.pop(0)
        if isinstance(got, Exception):
            raise got
        status, value = got if isinstance(got, tuple) else (200, got)
        return status, value if isinstance(value, bytes) else json.dumps(value).encode()


def test_failures_that_may_pass_are_tried_again():
    waits = []
    said = Said(OSError("lost"), (503, {}), (200, {"data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}))
    model = services.HttpEmbedder("http://m/v1/", "e", "key", transport=said, wait=waits.append)
    assert model.embed(["a", "b"]) == [[1.0], [2.0]] and waits == [0.5, 1.0]
    assert said.asked[0][1] == "http://m/v1/embeddings" and said.asked[0][2]["Authorization"] == "Bearer key" and said.asked[0][4] == 120
    with pytest.raises(ServiceUnavailable):
        services.HttpEmbedder("http://m", "e", transport=Said(*[(500, {})] * 4), wait=waits.append).embed(["a"])
    with pytest.raises(ServiceUnavailable):  # comes back at once
        services.HttpEmbedder("http://m", "e", transport=Said((404, {}))).embed(["a"])


@pytest.mark.parametrize("data", [[], [{"index": 0}], [{"index": 1, "embedding": [1]}], [{"index": 0, "embedding": [1]}] * 2, "x"])
def test_answers_that_do_not_fit_are_refused(data):
    with pytest.raises(ServiceUnavailable):
        services.HttpEmbedder("http://m", "e", transport=Said({"data": data})).embed(["a"])


def test_reranking_by_batches_and_chat():
    said = Said({"results": [{"index": 1, "relevance_score": 3}, {"index": 0, "relevance_score": 1.5}]}, {"results": [{"index": 0, "relevance_score": 2}]})
    assert services.HttpReranker("http://m", "r", transport=said, batch=2).score("q", ["a", "b", "c"]) == [1.5, 3.0, 2.0]
    chat = services.HttpChat("http://m", "c", transport=Said(*[{"choices": [{"message": {"content": x}}]} for x in ("no", '{"a": 1}')]))
    assert chat.complete_json("p", {}) == {"a": 1}
    with pytest.raises(ServiceUnavailable):
        services.HttpChat("http://m", "c", transport=Said({"choices": []})).complete("p", {})
    with pytest.raises(ValueError):
        services.HttpChat("", "c")


def test_shared_clients_are_made_once():
    services.reset()
    first = services.shared("x", object)
    assert services.shared("x", object) is first
    services.reset()
    assert services.shared("x", object) is not first


def test_bibliographic_connectors():
    assert services.work_of_doi("10.1/a b", said := Said({"message": {"title": ["T"]}}))["title"] == "T" and said.asked[0][1].endswith("10.1%2Fa%20b") and said.asked[0][4] == 10
    assert [services.work_of_doi("10.1/a", Said(x)) for x in ((404, {}), OSError("no"), b"no json", {"message": 3})] == [None] * 4 and services.work_of_doi(None) is None
    tei = b'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>H</title></titleStmt></fileDesc></teiHeader></TEI>'
    assert services.header_of_pdf(b"%PDF", "http://g/", Said(tei))["title"] == "H" and services.header_of_pdf(b"", "http://g", Said((500, {}))) is None


def test_abstracts_come_from_the_first_service_that_has_one():
    europe = {"resultList": {"result": [{"title": "Other words", "pubYear": "2001", "abstractText": "not it"}, {"title": "A title", "pubYear": "2001", "abstractText": "<b>From</b> one"}]}}
    assert services.find_abstract("10.1/x", "A title", 2001, Said(europe)) == "From one"
    pubmed = [{"esearchresult": {"idlist": ["7"]}}, b"<A><AbstractText Label='AIM'>from two</AbstractText></A>"]
    assert services.find_abstract("10.1/x", "A title", 2001, Said((500, {}), *pubmed)) == "AIM: from two"
    works = {"title": "A title", "publication_year": 2002, "abstract_inverted_index": {"three": [1], "from": [0]}}
    assert services.find_abstract("10.1/x", "A title", 2001, Said(OSError("x"), {}, works)) == "from three"
    assert services.find_abstract(None, "A title", 2001, Said({}, {"results": [works]})) == "from three"
    assert services.find_abstract(None, None, None, Said()) is None


def test_tables_of_answers(spark):
    def transport(method, url, headers, body, seconds):
        return (200, b'{"message": {"title": ["T"]}}') if url.endswith("10.1%2Fa") else (404, b"")

    df = spark.createDataFrame([("10.1/a",), ("10.1/b",), (None,)], "doi string")
    assert [(r.doi, json.loads(r.message)) for r in services.works_table(df, transport).collect()] == [("10.1/a", {"title": ["T"]})]
    europe = lambda *a: (200, b'{"resultList": {"result": [{"abstractText": "text"}]}}')
    found = spark.createDataFrame([("10.1/a", "t", None, None, "crossref"), ("10.1/b", "t", 3, "own", "crossref"), ("10.1/c", "t", 3, None, "unresolved")], "doi string, title string, year int, abstract string, source string")
    assert [tuple(r) for r in services.abstracts_table(found, europe).collect()] == [("10.1/a", "text")]


def test_parsers_of_all_kinds(tmp_path):
    def library(pdf_file, output_dir, lang="x"):
        with open(f"{output_dir}/b.md", "w") as f:
            f.write(f"lib {lang} {open(pdf_file).read()}")

    assert parsers.library_parser(library, lang="en", other=3)(b"c") == "lib en c"
    assert parsers.library_parser(lambda **all: f"{sorted(all)}", z=1)(b"") == "['output_dir', 'pdf_bytes', 'pdf_file', 'z']"
    script = tmp_path / "p.py"
    script.write_text("import sys, os\na = sys.argv\nos.makedirs(a[4] + '/a/auto')\nopen(a[4] + '/a/auto/a.md', 'w').write('cmd ' + open(a[2]).read())\nopen(a[4] + '/0.md', 'w').write('no')")
    assert parsers.command_parser([sys.executable, str(script)])(b"c") == "cmd c"
    assert parsers.service_parser("http://p", transport=Said({"results": {"z": {"md_content": "", "md": "svc"}}}))(b"c") == "svc"
    for parse in (parsers.library_parser(lambda pdf_file: None), parsers.command_parser([sys.executable, "-c", "import sys; sys.exit('bad')"]), parsers.service_parser("http://p", transport=Said((500, {}))), parsers.service_parser("http://p", transport=Said({"results": {}}))):
        with pytest.raises(StageFailed, match="parser (library|command|service): "):
            parse(b"c")


def test_optional_libraries():
    assert parsers.optional("json") is json and parsers.optional("no_such_library") is None
    assert parsers.local_doi(b"x", lambda name: None) is None

    class Pdf(list):
        __enter__, __exit__ = (lambda self: self), (lambda self, *a: None)

    pages = Pdf(types.SimpleNamespace(get_text=lambda t=t: t) for t in ("no", "doi:10.1234/abc.def", "10.9999/late"))
    fitz = types.SimpleNamespace(open=lambda stream, filetype: pages)
    assert parsers.local_doi(b"x", lambda name: fitz) == "10.1234/abc.def"
    assert parsers.local_doi(b"x", lambda name: types.SimpleNamespace(open=lambda **of: 1 / 0)) is None


@pytest.mark.parametrize("wrong", [{"parser_backend": "magic"}, {"parser_backend": "service"}, {"parser_backend": "command"}, {"embed_backend": "api"}, {"rerank_backend": "local"}, {"chat_backend": "api", "chat_base_url": ""}, {"header_url": "ftp://x"}, {"embed_batch": "0"}])
def test_settings_that_cannot_be_are_refused(wrong):
    with pytest.raises(ConfigError):
        Settings.load(environ={f"LECTERN_{k.upper()}": v for k, v in wrong.items()})


def test_settings_that_can():
    s = Settings.load(environ={"LECTERN_EMBED_BACKEND": "api", "LECTERN_EMBED_BASE_URL": "http://m/v1", "LECTERN_PARSER_BACKEND": "service", "LECTERN_PARSER_URL": "http://p"})
    assert s.embed_base_url == "http://m/v1" and s.parser_backend == "service"


class Tools(Engine):
    def __post_init__(self):
        pass

    def list_kbs(self):
        return {"kbs": []}


def test_the_server_answers_line_by_line():
    sent = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "list_kbs", "arguments": {}}}, {"id": 4, "method": "tools/call", "params": {"name": "none"}}, {"id": 5, "method": "else"}, {"id": 6, "method": "ping"}, 7]
    sink = io.StringIO()
    server.serve(Tools(None, ""), io.StringIO("\n".join(map(json.dumps, sent)) + "\n\nno json\n"), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, 2, 3, 4, 5, 6, None, None]
    tools = {t["name"]: t for t in got[1]["result"]["tools"]}
    assert set(tools) == set(TOOLS) == set(server.DESCRIPTIONS)
    search = tools["search_chunks"]["inputSchema"]
    assert search["required"] == ["kb", "query"] and search["properties"]["min_score"] == {"type": ["number", "null"]}
    assert json.loads(got[2]["result"]["content"][0]["text"]) == {"kbs": []} and not got[2]["result"]["isError"]
    assert got[3]["result"]["isError"] and got[4]["error"]["code"] == server.NO_METHOD and got[7]["error"]["code"] == server.NO_JSON
