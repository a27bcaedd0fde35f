import gzip
import time
import zlib
from html.parser import HTMLParser

import pytest
import zstandard

from lodestone.llm import op07_warc as op

HTML = (
    "<!DOCTYPE html><html lang='EN'><head><title>A &amp; b</title><style>p{}</style></head><body><!-- no --><p>One <b>two</b> &lt;3<br>four"
    "<script>x='<p>never</p>'</script><a href=\"/u?a=1&amp;b=2\">five</a></p><div>  six\t seven </div></body></html>"
)


def pages(spark):
    rows = [(1, "http://a.example/x", HTML), (2, None, "<p>é"), (None, "http://b.example", None), (1, "http://a.example/x", HTML), (3, "http://c.example\r\nX: forged", "")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_page_text():
    assert op.page_text(HTML) == "One two <3\nfour five\nsix seven"
    assert op.page_text("") == "" and op.page_text("a < b and c > d") == "a < b and c > d"


class SlowText(HTMLParser):
    """Text by the library's parser, event by event."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.inside = [], []

    def handle_starttag(self, tag, attrs):
        if tag in op._NO_TEXT and not self.inside:
            self.inside.append(tag)
        elif not self.inside and tag in op._BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if self.inside and tag == self.inside[-1]:
            self.inside.pop()
            self.out.append(" ")
        elif not self.inside and tag in op._BLOCKS:
            self.out.append("\n")

    def handle_comment(self, data):
        if not self.inside:
            self.out.append(" ")

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)


def slow_text(markup):
    parser = SlowText()
    parser.feed(markup)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).replace("\xa0", " ").split("\n"))
    return [x for x in lines if x]


def test_text_of_pages_is_that_of_a_slow_parser(spark):
    pages = [HTML] + [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    for page in pages:
        assert [" ".join(x.split()) for x in op.page_text(page).split("\n") if x.split()] == slow_text(page), page[:500]


@pytest.mark.parametrize("unit", ["<script>", "<!--", "<script", "<a ", "<a href='", "<title>", "</script  ", "&#1", "<html lang", "<", "<style></style", "<p>x", "-->"])
def test_hostile_pages_take_linear_time(unit):
    page = (unit * (1_000_000 // len(unit))).encode()
    start = time.process_time()
    assert len(op.derive_one("r", "u", "d", "", b"HTTP/1.1 200 OK\r\n\r\n" + page)) == 2
    assert time.process_time() - start < 4


def test_numbers_of_entities():
    assert op.page_text("&#" + "1" * 10_000 + ";&#" + "0" * 10_000 + "65;&#66;&#x43;&amp;&#;") == "\ufffdABC&&#;"


def chunked(data, size=7):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x;ext=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def test_encodings_are_undone():
    page = "<title>t</title><p>é one</p><a href=x>two</a>".encode()
    raw = zlib.compressobj(wbits=-15)
    encoded = {
        "identity": page, "gzip": gzip.compress(page[:20]) + gzip.compress(page[20:]), "x-gzip": gzip.compress(page), "deflate": zlib.compress(page), "zstd": zstandard.compress(page), "br": page,
    }
    for coding, body in [*encoded.items(), ("deflate", raw.compress(page) + raw.flush())]:
        for transfer in (False, True):
            sent = chunked(body) if transfer else body
            block = f"HTTP/1.1 200 OK\r\nContent-Encoding: {coding}\r\n{'Transfer-Encoding: chunked' if transfer else 'X: y'}\r\n\r\n".encode() + sent
            metadata, conversion = op.derive_one("r", "u", "d", "", block)
            assert conversion["block"].decode() == "t\né one\ntwo" and b"outlink: x\r\n" in metadata["block"] and metadata["source_payload_digest"] == op.digest(sent)
    broken = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(page)[:-4]
    assert op.derive_one("r", "u", "d", "", broken)[1]["block"].decode() == "t\né one\ntwo"
    for odd in (b"\x1f\x8bnot gzip", b"", b"zz\r\n", b"ffffffffff\r\nabc"):
        op.derive_one("r", "u", "d", "", b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + odd)
    assert "WARC-Source-Payload-Digest: sha1:OWN\r\n" in op.derive_one("r", "u", "d", "WARC-Type: response\nWARC-Payload-Digest: sha1:OWN", broken)[1]["header"]


def test_malformed_records_do_not_crash(tmp_path, spark):
    (tmp_path / "a.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc")
    assert op.derive(op.read_responses(spark, f"file://{tmp_path}")).count() == 4


def test_records_are_linked(spark):
    rows = op.derive(op.page_responses(pages(spark))).collect()
    assert len(rows) == 10
    responses = {(r.source_id, r.target_uri): r for r in op.page_responses(pages(spark)).collect()}
    for r in rows:
        source = responses[r.source_id, r.target_uri]
        assert r.refers_to == source.record_id and r.content_length == len(r.block) and r.block_digest == op.digest(bytes(r.block))
        assert r.source_payload_digest == op.digest(bytes(source.block).partition(b"\r\n\r\n")[2])
    one = {r.record_type: r for r in rows if r.source_id == 1}
    fields = [x.split(": ", 1) for x in bytes(one["metadata"].block).decode().split("\r\n") if x]
    named = dict(fields)
    assert named["title"] == "A & b" and named["language"] == "en" and named["outlink"] == "/u?a=1&b=2" and named["status"] == "HTTP/1.1 200 OK"
    assert named["conversion"] == one["conversion"].record_id and any(v.startswith("WARC-Payload-Digest") for k, v in fields if k == "source-header")
    assert {bytes(r.block) for r in rows if r.source_id is None and r.record_type == "conversion"} == {b""}


def test_files_round_trip(spark, tmp):
    derived = op.derive(op.page_responses(pages(spark)))
    made = op.save(derived, f"{tmp}/warc").collect()
    assert sum(r.records for r in made) == 10
    found = []
    for r in made:
        with open(r.path, "rb") as f:
            found += list(op.parse(f.read()))
    want = sorted((r.record_id, bytes(r.block)) for r in derived.collect())
    assert sorted((h["WARC-Record-ID"], b) for h, b in found) == want
    assert all("X" not in h for h, _ in found)


def test_reads_responses(spark, tmp_path):
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<p>caf\xe9</p>"
    header = op.warc_header([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://x"), ("WARC-Date", "2020"), ("Content-Length", str(len(block)))])
    other = op.warc_header([("WARC-Type", "warcinfo"), ("Content-Length", "2")])
    (tmp_path / "a.warc.gz").write_bytes(op.member(other, b"hi") + op.member(header, block))
    (tmp_path / "b.warc").write_bytes(gzip.decompress(op.member(header, block)))
    rows = op.derive(op.read_responses(spark, f"file://{tmp_path}")).collect()
    assert len(rows) == 4 and {bytes(r.block).decode() for r in rows if r.record_type == "conversion"} == {"café"}


def test_empty(spark):
    assert op.derive(op.page_responses(pages(spark).where("false"))).count() == 0
