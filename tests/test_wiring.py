"""Engines from settings: everything that settings name, over one made-up transport."""

import io
import json
import sys

import pytest

from lectern import server, wiring
from lectern.engine import Engine
from lectern.errors import ConfigError
from lectern.services import HttpEmbedder
from lectern.sources import works_source
from lectern.sources.settings import Settings
from tests.papers import ARTICLE, pdf

BARE = "see doi: 10.1234/found.one for this text without a heading\n\nIt goes on for a while and says nothing of note.\n"
HEADED = "no number here, only words that a header service knows\n\nMore of them follow here.\n"
DOUBTFUL = ARTICLE.split("Anna Berg")[0] + "## Gedanken\n\nWe fold paper and read it. The effect is small but it is real, and folding goes on.\n\n## Weiteres\n\nMore words on folding follow here, which say little of note, and it goes on.\n"


class World:
    """Parser, embedder, re-ranker, chat, works, headers and abstracts; each call is written to a folder, as workers are processes of their own."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, method, url, headers, body, seconds):
        name = url.split("//")[1].split("/")[0]
        import uuid

        with open(f"{self.folder}/{name}.{uuid.uuid4().hex}", "w") as f:
            f.write(url)
        body = body or b""
        said = json.loads(body) if body[:1] == b"{" else {}
        if "file_parse" in url:
            text = body[body.index(b"%PDF-1.4\n") + 9 :].split(b"\r\n--")[0].decode()
            return 200, json.dumps({"results": {"a": {"md": text}}}).encode()
        if url.endswith("/embeddings"):
            return 200, json.dumps({"data": [{"index": i, "embedding": [len(t), 1.0, t.count("e")]} for i, t in enumerate(said["input"])]}).encode()
        if url.endswith("/rerank"):
            return 200, json.dumps({"results": [{"index": i, "relevance_score": len(t)} for i, t in enumerate(said["documents"])]}).encode()
        if url.endswith("/chat/completions"):
            prompt = said["messages"][0]["content"]
            if "keywords" in prompt:
                got = {"keywords": ["folding", "lamps"]}
            else:
                got = {"items": [{"block_index": int(line.split(": ")[1]), "decision": "override", "section_type": "Introduction", "confidence": 0.95, "rationale": "asked"} for line in prompt.splitlines() if line.startswith("block_index")]}
            return 200, json.dumps({"choices": [{"message": {"content": json.dumps(got)}}]}).encode()
        if "crossref" in url:
            return (200, b'{"message": {"title": ["The Found One"], "DOI": "10.1234/found.one", "issued": {"date-parts": [[2011]]}}}') if "found.one" in url else (404, b"")
        if "processHeaderDocument" in url:
            tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>From a header</title></titleStmt></fileDesc></teiHeader></TEI>'
            return (200, tei.encode()) if b"header service knows" in body else (500, b"")
        if "europepmc" in url:
            return 200, b'{"resultList": {"result": [{"abstractText": "An abstract that was asked for."}]}}'
        return 404, b""

    def calls(self):
        import os

        names = [n.split(".")[0] for n in os.listdir(self.folder)]
        return {n: names.count(n) for n in set(names)}


@pytest.fixture
def settings(tmp_path):
    urls = {"embed_base_url": "http://embed/v1", "rerank_base_url": "http://rerank/v1", "chat_base_url": "http://chat/v1", "parser_url": "http://parser", "header_url": "http://header"}
    return Settings(data_dir=str(tmp_path / "data"), parser_backend="service", embed_backend="api", rerank_backend="api", chat_backend="api", annotation_resolver_enabled=True, **urls)


def test_a_folder_goes_in_through_everything_once(spark, tmp_path, settings):
    folder, calls = tmp_path / "in", tmp_path / "calls"
    folder.mkdir()
    calls.mkdir()
    for name, text in (("bare", BARE), ("headed", HEADED), ("doubtful", DOUBTFUL)):
        (folder / f"{name}.pdf").write_bytes(pdf(text))
    world = World(str(calls))
    e = Engine.from_settings(spark, settings, world)
    job = e.jobs.wait(e.create_kb("papers", str(folder), chunk_min=20, chunk_max=200, chunk_overlap=20)["job_id"])
    assert job.status == "succeeded" and job.result["succeeded"] == 3, (job.error, job.result)
    docs = {r.title: r for r in e.store.read("papers", "documents").collect()}
    assert set(docs) == {"The Found One", "From a header", "A Study of Paper Folding and Its Effect on Reading"}
    found = docs["The Found One"]
    assert (found.doi, found.year, found.abstract, found.keywords) == ("10.1234/found.one", 2011, "An abstract that was asked for.", ["folding", "lamps"])
    sections = {r.section for r in e.store.read("papers", "doc_sections").collect()}
    assert "Introduction" in sections and e.store.read("papers", "decisions").count() >= 1
    first = world.calls()
    assert first["parser"] == 3 and first["header"] == 1 and first["chat"] >= 2
    assert e.search_chunks("papers", "folding", top_k=2)["warning"] is None and world.calls()["rerank"] == 1
    # the same text again: its parse and the model's decisions are held
    e.remove_document("papers", docs["A Study of Paper Folding and Its Effect on Reading"].doc_id)
    before = world.calls()
    again = e.jobs.wait(e.add_document("papers", str(folder / "doubtful.pdf"))["job_id"])
    assert again.status == "succeeded", again.error
    after = world.calls()
    assert all(after.get(n) == before.get(n) for n in ("parser", "chat", "header")), (before, after)
    e.jobs.close()


def test_one_document_that_a_tier_fails_on_goes_to_the_next(spark, monkeypatch):
    from lectern.operators import metadata as M

    assert M.guarded(lambda v: 1 / v, lambda: "missed")(0) == "missed"
    df = spark.createDataFrame([("a", '{"title": ["T"]}'), ("b", "[no json"), ("c", None), ("d", '{"title": {"x": 1}, "author": 7, "issued": {"date-parts": [[99999999999999]]}}')], "k string, body string")
    got = {r.key: r.title for r in M.parse_works(df.where("k <> 'd'"), "k", "body", "work").collect()}
    assert got == {"a": "T", "b": "", "c": ""}


def test_what_settings_stand_for(tmp_path):
    s = Settings(data_dir=str(tmp_path), embed_model="hashing-128")
    assert wiring.embedder(s).dim == 128 and wiring.chat(s) is None and wiring.parser(s)(b"%PDF-1\nx") == "x"
    r = wiring.recipe(None, Settings(crossref_enabled=False))
    assert r.works is None and r.headers is None and r.abstracts == [] and r.resolver is None and r.keywords is None
    assert isinstance(wiring.embedder(Settings(embed_backend="api", embed_base_url="http://m")), HttpEmbedder)
    assert wiring.parser(Settings(parser_backend="command", parser_command=f"{sys.executable} -c 'pass'")) is not None
    with pytest.raises(ConfigError):
        wiring.parser(Settings(parser_backend="library", parser_library="no_such_module:parse"))
    with pytest.raises(ConfigError):
        Settings(parser_backend="library")


def test_the_server_starts_from_settings(spark, tmp_path, monkeypatch):
    config = tmp_path / "settings.json"
    config.write_text(json.dumps({"data_dir": str(tmp_path / "kbs")}))
    out = io.StringIO()
    monkeypatch.setattr(server, "serve", lambda engine: out.write(json.dumps([engine.list_kbs(), engine.root])))
    server.main([str(config)])
    assert json.loads(out.getvalue()) == [{"kbs": []}, str(tmp_path / "kbs")]


def test_works_are_a_format_read_by_ranges_of_keys(spark, tmp_path, monkeypatch):
    seen = tmp_path / "seen"
    seen.mkdir()

    class Service:
        def __call__(self, method, url, headers, body, seconds):
            import time as clock
            import uuid

            doi = url.rsplit("/", 1)[1].replace("%2F", "/")
            (seen / uuid.uuid4().hex).write_text(f"{doi} {clock.time()}")
            n = int(doi.split("/d")[1])
            if n % 5 == 1:
                return 404, b""
            if n % 5 == 2:
                return 200, b"no json"
            if n % 5 == 3 and sum(p.read_text().startswith(doi + " ") for p in seen.iterdir()) < 2:
                raise OSError("lost")  # the first time
            return 200, json.dumps({"message": {"title": [f"T{n}"]}}).encode()

    monkeypatch.setattr(works_source, "KEYS_OF_A_PARTITION", 10)
    dois = spark.createDataFrame([(f"10.1/d{i}",) for i in range(30)] * 2 + [(None,)], "doi string")
    found = works_source.works(spark, dois, Service(), per_second=30)
    assert found.rdd.getNumPartitions() == 3
    got = {r.doi: json.loads(r.message)["title"][0] for r in found.collect()}
    assert got == {f"10.1/d{i}": f"T{i}" for i in range(30) if i % 5 not in (1, 2)}
    asked = sorted(float(p.read_text().split()[1]) for p in seen.iterdir())
    assert len(asked) == 36 and asked[-1] - asked[0] >= 0.8 * 9 / 10  # ten keys a partition at ten a second
    assert works_source.works(spark, dois.limit(0), Service()).count() == 0
