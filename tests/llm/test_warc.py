import gzip
import hashlib
import io

import pytest
from pyspark.sql import Row

from tessera.llm import warc


def arc(version, records, packed):
    text = f"{version} 0 org\n{' '.join(warc.ARC_FIELDS[version])}\n\n"
    more = {1: "", 2: "200 - - 0 f.arc "}[version]
    parts = [f"filedesc://f.arc 0.0.0.0 19990101 text/plain {more}{len(text)}\n{text}\n".encode()]
    parts += [f"{u} 1.2.3.4 {d} text/html {more}{len(c)}\n".encode() + c + b"\n" for u, d, c in records]
    return io.BytesIO(b"".join(map(gzip.compress, parts)) if packed else b"".join(parts))


RECORDS = [("http://a/b c", "19990203040506", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nmore"), ("dns:a", "199902", b"1.2.3.4"), ("http://e/", "19990203040507", b"")]


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [True, False])
def test_arc_to_warc(version, packed):
    got = list(warc.arc_records(arc(version, RECORDS, packed)))
    assert [(r.fields["URL"], r.fields["Archive-date"], r.content) for r in got] == RECORDS
    out = io.BytesIO(b"".join(warc.member(warc.to_warc(r, "x/f.arc")) for r in got))
    back = list(warc.warc_records(out))
    assert [b for _, b in back] == [c for *_, c in RECORDS]
    assert [f["warc-type"] for f, _ in back] == ["response", "resource", "response"]
    assert [f["warc-date"] for f, _ in back] == ["1999-02-03T04:05:06Z", "1999-02-01T00:00:00Z", "1999-02-03T04:05:07Z"]
    assert back[0][0]["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"body\n\nmore").hexdigest()
    assert len({f["warc-record-id"] for f, _ in back}) == 3


@pytest.mark.parametrize("piece", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("version", [1, 2])
def test_streams_of_any_piece(monkeypatch, version, piece):
    """One member a record, one member for all, and no gzip give the same records, however few bytes are read at a time."""
    monkeypatch.setattr(warc, "PIECE", piece)
    plain = arc(version, RECORDS, False).getvalue()
    for data in (arc(version, RECORDS, True).getvalue(), plain, gzip.compress(plain)):
        got = list(warc.arc_records(io.BytesIO(data)))
        assert [(r.fields["URL"], r.content) for r in got] == [(u, c) for u, _, c in RECORDS]
        assert len({r.offset for r in got}) == 3 and [r.offset for r in got] == sorted(r.offset for r in got)
    assert list(warc.arc_records(io.BytesIO(b""))) == []


def test_a_large_plain_archive_is_streamed(monkeypatch):
    """Of a file of many records little more than one record is held."""
    data = arc(1, [(f"http://e/{k}", "1999", b"x" * 50_000) for k in range(200)], False)
    held = []
    monkeypatch.setattr(warc, "PIECE", 1 << 16)
    fill = warc.Stream.fill
    monkeypatch.setattr(warc.Stream, "fill", lambda self, n: (fill(self, n), held.append(len(self.held) + len(self.raw)))[0])
    assert len(list(warc.arc_records(data))) == 200 and max(held) < 300_000


def test_each_file_has_its_task(spark):
    df = spark.createDataFrame([(k, f"http://e/{k}", "p" * 120 + str(k % 3)) for k in range(40)], "page_id long, url string, html string").repartition(6)
    arcs = warc.write_arc(df)
    records = warc.read_arc(arcs)
    files = warc.convert(warc.first_of_equals(records), arcs)
    assert arcs.count() == files.count() == 6 and files.agg({"n_records": "sum"}).first()[0] == 40
    got = warc.read_warc(files).collect()
    assert sorted(r.page_id for r in got) == list(range(40)) and {r.refers_to for r in got} == {None, 0, 1, 2}


@pytest.mark.parametrize("data", [b"http://a 1 2 3 4\n", b"filedesc://x 0 1 t 9\n9 0 o\nURL\n", arc(1, [("http://a", "1999", b"abc")], False).getvalue()[:-3], arc(1, [("http://a", "1999", b"abc")], True).getvalue()[:-9], b"filedesc://x 0 1 t nine\n1 0 o\nURL\n", b"filedesc://f.arc"])
def test_malformed(data):
    with pytest.raises(ValueError):
        list(warc.arc_records(io.BytesIO(data)))


def test_query_rows(spark):
    long, short = "x" * 100 + "é", "y" * 99
    data = [(1, long), (0, long), (7, long), (7, long), (2, short), (3, short), (4, None), (5, ""), (None, long), (None, "z" * 200), (None, "z" * 200), (9, "w" * 300_000)]
    df = spark.createDataFrame([Row(page_id=p, url=None if p == 9 else "http://e/ %s" % p, html=h, path="clash") for p, h in data], "page_id long, url string, html string, path string")
    got = sorted((tuple(r) for r in warc.archive_digest(df).collect()), key=str)
    want = []
    seen = set()
    for p, h in data:
        raw = (h or "").encode()
        kind, ref = "response", None
        if raw == long.encode() and p != 0:
            kind, ref = "revisit", 0
        if h and h[0] == "z":
            kind = "revisit" if h in seen else "response"
            seen.add(h)
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), kind, ref))
    assert got == sorted(want, key=str)
    assert warc.archive_digest(df.limit(0)).collect() == []
