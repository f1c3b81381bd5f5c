"""Derived records read by another reader, records that are none, and pages of unclosed tags."""

import io
import time
from email.parser import BytesHeaderParser

import pytest

from townhall.llm import warc


def read(data):
    """Fields and block of every record of a file, by the header parser of the standard library."""
    stream, out = io.BytesIO(data), []
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        raw = b""
        while (row := stream.readline()) != b"\r\n":
            raw += row
        fields = BytesHeaderParser().parsebytes(raw)
        out.append((fields, stream.read(int(fields["Content-Length"]))))
        assert stream.read(4) == b"\r\n\r\n"
    return out


def test_another_reader_finds_the_linked_records(spark):
    pages = [(k, f"https://x.example.org/{k}", f"<html lang=en><head><title>T {k}</title></head><body><p>Text {k}</p><a href='/l{k}'>l</a></body></html>") for k in range(20)]
    rows = warc.responses(spark.createDataFrame(pages, "page_id long, url string, html string"))
    responses = {r["page_id"]: read(bytes(r["record"]))[0] for r in rows.collect()}
    made = warc.derivatives(rows).collect()
    found = read(b"".join(bytes(r["record"]) for r in sorted(made, key=lambda r: (r["page_id"], r["kind"]))))
    assert len(found) == 40
    for k in range(20):
        (text, words), (about, facts) = found[2 * k : 2 * k + 2]
        source = responses[k][0]["WARC-Record-ID"]
        assert (text["WARC-Type"], about["WARC-Type"]) == ("conversion", "metadata") and text["WARC-Refers-To"] == about["WARC-Refers-To"] == source
        assert text["WARC-Concurrent-To"] == about["WARC-Record-ID"] and about["WARC-Concurrent-To"] == text["WARC-Record-ID"]
        assert words.decode() == f"Text {k}\nl"
        assert f"title: T {k}\r\nlanguage: en\r\noutlink: /l{k}\r\n" in facts.decode()


def test_repeated_headers_stay_in_order():
    block = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nContent-Type: text/html\r\nSet-Cookie: b=2\r\n folded\r\n\r\n<p>x</p>"
    made = warc.derive(warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], block))
    about = warc.parse(made[0]["record"])[1].decode()
    assert "source-set-cookie: a=1\r\nsource-content-type: text/html\r\nsource-set-cookie: b=2 folded\r\n" in about


def test_bytes_that_are_no_record_give_none_and_are_listed(spark):
    good = warc.response(1, "https://x.example.org/", "<p>x</p>")
    rows = [(1, good), (2, b"junk"), (3, b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx"), (4, b""), (5, None), (6, warc.record([("WARC-Type", "request")], b"GET /")), (None, b"\xff\x00")]
    df = spark.createDataFrame(rows, "page_id long, record binary")
    assert sorted((r["page_id"], r["kind"]) for r in warc.derivatives(df).collect()) == [(1, "conversion"), (1, "metadata")]
    assert {(r["page_id"], r["reason"]) for r in warc.unreadable(df).collect()} == {
        (2, "not a WARC record"), (3, "length is no number"), (4, "not a WARC record"), (None, "not a WARC record")}


@pytest.mark.parametrize("piece", ["<script>", "<!--", "<script", "<head>", "<a ", "<a href=\"", "<title>", "<html ", "</script ", "<p ", "< ", "<style></style", "<a <a>"])
def test_a_megabyte_of_unclosed_tags(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    warc.plain_text(page)
    warc.page_facts(page)
    assert time.process_time() - start < 3


def test_hidden_parts_go_and_unclosed_ones_stay():
    page = "a<script x='1'>no</SCRIPT >b<!-- no --><style>no</style>c<script>d<HEAD>no</head>e<!-- f <br>g &lt;"
    assert warc.plain_text(page) == "abcde<!-- f \ng <".replace(" \n", "\n")
    assert warc.page_facts("<a href=1><A HREF='2&amp;3'><a nohref><title> x\n y </title><html lang=de>") == ("x y", "de", ["1", "2&3"])
