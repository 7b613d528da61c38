import base64
import collections
import gzip
import hashlib
import itertools
import json
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from varloom.llm import warc

corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = Path("/root/testdata/sf0.001")


def test_derivatives_round_trip(spark, tmp_path):
    html = '<html lang="en"><head><title>A &amp; B</title><meta name="author" content="me"><script>var x="<p>no</p>";</script></head><body><p>One <b>two</b><br>three</p><a href="/x">link</a><p></p></body></html>'
    rows = [(1, "http://a.example/", html), (2, None, None), (3, "http://b.example/", ""), (3, "http://b.example/", ""), (4, "http://c.example/é", "plain \r\n\r\n text"), (None, "http://d.example/", "<p>x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("block", F.lit(1))
    out = warc.derivatives(warc.responses(pages))
    got = out.collect()
    assert len(got) == 2 * len(rows)
    sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    by = {(r["source_id"], r["warc_type"]): r for r in got}
    text, meta = by[1, "conversion"], by[1, "metadata"]
    assert text["block"] == "One two\nthree\nlink" and text["refers_to"] == meta["refers_to"]
    assert text["block_digest"] == sha(text["block"].encode()) and text["refers_to_payload_digest"] == sha(html.encode())
    head = json.loads(meta["block"])
    assert head["Conversion"] == text["record_id"] and head["WARC-Header"]["WARC-Record-ID"] == text["refers_to"]
    assert head["HTML"]["Title"] == "A & B" and head["HTML"]["Links"] == [{"path": "A@/href", "url": "/x"}] and head["HTML"]["Lang"] == "en"
    assert by[2, "conversion"]["block"] == "" and by[2, "conversion"]["target_uri"] is None
    warc.write_warc(out.repartition(3), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert collections.Counter((r["record_id"], r["refers_to"], bytes(r["payload"]).decode(), r["block_digest"]) for r in back) == collections.Counter((r["record_id"], r["refers_to"], r["block"], r["block_digest"]) for r in got)
    files = list((tmp_path / "w").iterdir())
    assert files and all(f.name.startswith("part-") for f in files)
    members = sum(gzip_members(f.read_bytes()) for f in files)
    assert members == len(got)  # one for each record
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def gzip_members(data):
    n = 0
    while data:
        d = zlib.decompressobj(31)
        assert d.decompress(data).startswith(b"WARC/1.1\r\n")
        data, n = d.unused_data, n + 1
    return n


def record(kind, block, **head):
    lines = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", ["plain", "members", "whole"])
def test_responses_of_crawls_keep_their_heads(spark, tmp_path, packed):
    page = "<html><head><title>caf\u00e9</title></head><body>pr\u00e8s\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nthere</body></html>".encode("latin-1")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-Note: a: b\r\nSet-Cookie: x=1\r\nSet-Cookie: y=2\r\n folded\r\n\r\n"
    moved = b"HTTP/1.1 301 Moved Permanently\r\nLocation: http://b.example/\r\nContent-Length: 0\r\n\r\n"
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\x00\xff"
    text = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\n<b>not</b> markup\n"
    common = dict(Content_Type="application/http; msgtype=response")
    all_records = [
        record("warcinfo", b"software: none\r\n", WARC_Record_ID="<urn:uuid:0>", Content_Type="application/warc-fields"),
        record("response", http + page, WARC_Record_ID="<urn:uuid:1>", WARC_Target_URI="http://a.example/", WARC_Date="2021-03-04T05:06:07Z", WARC_Payload_Digest="sha1:GIVEN", WARC_IP_Address="192.0.2.7", **common),
        record("response", moved, WARC_Record_ID="<urn:uuid:2>", WARC_Target_URI="http://c.example/", WARC_Date="2022-01-01T00:00:00Z", **common),
        record("response", image, WARC_Record_ID="<urn:uuid:3>", WARC_Date="2022-01-02T00:00:00Z", **common),
        record("response", text, WARC_Record_ID="<urn:uuid:4>", WARC_Date="2022-01-03T00:00:00Z", **common),
    ]
    cut = record("response", http + page, WARC_Record_ID="<urn:uuid:5>", **common)[:-30]
    raw = {"plain": b"".join(all_records) + cut, "members": b"".join(map(gzip.compress, [*all_records, cut])), "whole": gzip.compress(b"".join(all_records) + cut)}[packed]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "crawl.warc.gz").write_bytes(raw)
    read = warc.read_warc(spark, str(tmp_path / "in"))
    kinds = read.select("record_id", "warc_type", "truncated").collect()
    assert [(r["record_id"][10:-1], r["truncated"]) for r in kinds] == [(str(i), i == 5) for i in range(6)]
    got = {(r["source_id"], r["warc_type"]): r for r in warc.derivatives(read.filter("warc_type = 'response'").withColumn("source_id", F.col("record_id"))).collect()}
    assert len(got) == 10
    meta = json.loads(got["<urn:uuid:1>", "metadata"]["block"])
    assert meta["HTTP-Headers"] == {"Content-Type": "text/html; charset=ISO-8859-1", "X-Note": "a: b", "Set-Cookie": "x=1, y=2 folded"}
    assert meta["WARC-Header"]["WARC-IP-Address"] == "192.0.2.7" and meta["HTTP-Status"] == "HTTP/1.1 200 OK" and meta["HTML"]["Title"] == "caf\u00e9"
    conversion = got["<urn:uuid:1>", "conversion"]
    assert conversion["block"] == "caf\u00e9\npr\u00e8s WARC/1.1 WARC-Type: response there".split("\n", 1)[1]
    assert (conversion["refers_to"], conversion["date"], conversion["refers_to_payload_digest"], conversion["target_uri"]) == ("<urn:uuid:1>", "2021-03-04T05:06:07Z", "sha1:GIVEN", "http://a.example/")
    assert [got[f"<urn:uuid:{i}>", "conversion"]["block"] for i in (2, 3, 4)] == ["", "", "<b>not</b> markup\n"]
    assert json.loads(got["<urn:uuid:2>", "metadata"]["block"])["HTTP-Status"].endswith("301 Moved Permanently")


@pytest.mark.parametrize("html,text", [("<p>a</p><![foo[bar]]>x", "a\nx"), ("a<![ x", "a<![ x"), ("<![if !IE]>y<![endif]>", "y"), ("<!doctype <a>b", None), ("<", None), ("&#xfffffff; &#0; t", None), ("<!--[if IE]>z<![endif]-->w", "w"),
                                       ("</" * 50, None), ("<a " * 300 + "b", None), ("<script>never closed", ""), ("\ud800 lone", None)])
def test_malformed_pages(spark, html, text):
    page = warc.Page(html)
    assert text is None or page.text == text
    if "\ud800" not in html:
        pages = spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
        assert warc.derivatives(warc.responses(pages)).count() == 2


@pytest.mark.parametrize("html,text", [
    ("<p>a</p><iframe src=x><p>rest of page</p>", "a\nrest of page"), ("<div><svg><title>t</title></div><p>b<svg>no</svg>", "b"), ("a<object>in<object>deep</object><p>b", "a in b"),
    ("<noscript>x</noscript>y<noscript>z", "y\nz"), ("<p>a</p></svg><p>b</p>", "a\nb"), ("<svg><br><path></svg>a<svg/>b", "ab"), ("a<template><p>x</p></template>b<style>p{}", "ab"), ("<iframe>x<iframe>y</iframe>", "x"),
])
def test_hidden_elements_that_are_not_closed_do_not_hide_the_rest(html, text):
    assert " ".join(warc.Page(html).text.split()) == " ".join(text.split())


def test_text_of_pages_against_a_second_way():
    """Random nests of elements: the visible text is that of the words outside of closed hidden elements."""
    rng = __import__("random").Random(3)

    def nest(depth, hidden):
        html, seen = "", []
        for _ in range(rng.randrange(1, 5)):
            if depth and rng.random() < 0.6:
                tag = rng.choice(["p", "div", "b", "svg", "object", "noscript", "iframe", "td", "a"])
                inner, words = nest(depth - 1, hidden or tag in warc.HIDDEN)
                html, seen = html + f"<{tag} x=1>{inner}</{tag}>", seen + words
            else:
                word = f"w{rng.randrange(10**6)} "
                html, seen = html + word, seen + ([] if hidden else [word.strip()])
        return html, seen

    for _ in range(300):
        html, words = nest(4, False)
        assert warc.Page(html).text.split() == words
    assert warc.Page("<div>" * 100_000 + "deep").text == "deep"


def test_charsets_named_late_and_in_comments():
    head = b"<!-- <meta charset=utf-16> " + b"x" * 50_000 + b" --><meta name='d' content='" + b"y" * 5000 + b"'><META http-equiv=Content-Type " + b" " * 900 + b" content='text/html; charset=iso-8859-1'>"
    assert warc.decoded(head + "<body>é".encode("latin-1"), "text/html").endswith("é")
    assert warc.decoded("é<body><meta charset=iso-8859-1>".encode(), "text/html").startswith("é")
    assert warc.decoded(b"<!--" * 100_000, "text/html") == "<!--" * 100_000


def test_line_breaks_in_fields_make_no_fields(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/\r\nWARC-Type: response\r\n\r\nx", "<p>t", "HTTP/1.1 200 OK\r\n\r\nX: y\r\n \r\n")], "page_id int, url string, html string, head string")
    made = warc.responses(pages, http_col="head")
    assert made.first()["http_headers"] == "HTTP/1.1 200 OK\r\nX: y\r\n"
    warc.write_warc(warc.derivatives(made), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted(r["warc_type"] for r in back) == ["conversion", "metadata"]
    assert {r["target_uri"] for r in back} == {"http://a.example/%0D%0AWARC-Type: response%0D%0A%0D%0Ax"}
    meta = json.loads(next(bytes(r["payload"]) for r in back if r["warc_type"] == "metadata"))
    assert meta["WARC-Header"]["WARC-Type"] == "response" and meta["HTTP-Headers"] == {"X": "y"}


def test_long_files_are_streamed_and_empty_folders_are_empty(spark, tmp_path):
    blocks = [bytes([65 + i % 26]) * (i * 997 % 5000) for i in range(200)]
    for k, pack in enumerate((lambda x: x, gzip.compress)):
        (tmp_path / str(k)).mkdir()
        for name in ("a", "b c"):
            (tmp_path / str(k) / name).write_bytes(b"".join(pack(record("resource", b, WARC_Record_ID=f"<urn:uuid:{i}>")) for i, b in enumerate(blocks)))
        (tmp_path / str(k) / "empty").write_bytes(b"")
        want = collections.Counter((f"<urn:uuid:{i}>", b) for i, b in enumerate(blocks) for _ in "ab")
        for whole in (0, 10**9):
            assert collections.Counter((r["record_id"], bytes(r["payload"])) for r in warc.read_warc(spark, str(tmp_path / str(k)), whole_bytes=whole).collect()) == want
    (tmp_path / "none").mkdir()
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_pages_with_heads_of_their_own(spark):
    pages = spark.createDataFrame([(1, "u", "<p>x", "2020-02-02T00:00:00Z", "HTTP/1.1 404 Not Found\r\nServer: s"), (2, "v", "y" * 3_000_000, None, None)], "page_id int, url string, html string, at string, head string")
    got = {(r["source_id"], r["warc_type"]): r for r in warc.derivatives(warc.responses(pages, date_col="at", http_col="head")).collect()}
    meta = json.loads(got[1, "metadata"]["block"])
    assert got[1, "conversion"]["date"] == "2020-02-02T00:00:00Z" and meta["HTTP-Status"] == "HTTP/1.1 404 Not Found" and meta["HTTP-Headers"] == {"Server": "s"}
    assert got[2, "conversion"]["block"] == "y" * 3_000_000 and got[2, "conversion"]["date"] == "2024-01-01T00:00:00Z"


def kept_by_plain_rules(docs):
    """Exact and near duplicates of rows by pairs."""
    last = {}
    for i, text in docs:
        last[text or ""] = max(i, last.get(text or "", -1))
    left = {i: t or "" for t, i in ((t, i) for t, i in last.items())}
    sets = {}
    for i, t in left.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return set(left), {i for i in left if top(i) == i}


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    docs, stages = spark.read.parquet(str(DATA / "documents.parquet")), dict(corpus_pipeline.STAGES)
    docs = docs.unionByName(docs.filter("doc_id < 5")).unionByName(docs.filter("doc_id = 7").withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(10**6)))
    out = {}
    for k, (name, stage) in enumerate(stages.items()):
        stage(spark, docs, str(DATA)).write.parquet(path := str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(path)
        out[name] = docs
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "exact dedup":
            expected, _ = kept_by_plain_rules([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(expected)
        if name == "near dedup":
            _, expected = kept_by_plain_rules([(r["doc_id"], r["text"]) for r in before.collect()])
            assert sorted(r["doc_id"] for r in docs.collect()) == sorted(expected)
    mixed = collections.Counter(r["doc_id"] for r in out["mixing"].collect())
    assert max(mixed.values()) <= 3
    pieces = out["packing"].collect()
    assert sum(r["length"] for r in pieces if r["start"] == 0) > 0
    assert sum(r["doc_tokens"] for r in pieces if r["start"] == 0) == sum(r["length"] for r in pieces)
    assert sum(r["start"] == 0 for r in pieces) == sum(mixed.values())


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
