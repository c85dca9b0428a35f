"""The archive against a plain computation, and the salvage reader against planted damage."""

import base64
import hashlib

from kindred.llm import warc
from kindred.llm.common import scratch

PAGES = [(3, "http://a/ b\n", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://c", None), (5, "u", ""), (None, "n", "<p>é</p>"), (None, "n", "only null"), (7, "u", "WARC/1.0\r\n\r\n" * 3), (8, "u", "x" * 300_000), (3, "again", "<p>é</p>")]


def expected(rows, least=0):
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "").encode() == body and i is not None]
        first = min(ids, default=None)
        again = len(body) >= least and page_id != first
        out.append((page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def run(spark, rows, **options):
    path = scratch(spark, "warc")
    warc.write_archive(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, body int"), path, **options)
    return path, warc.read_archives(spark, path)


def test_every_page_is_read_back(spark):
    for least in (0, 8):
        _, archive = run(spark, PAGES, least_bytes=least)
        assert sorted(map(tuple, warc.digests(archive).collect()), key=repr) == expected(PAGES, least)
        assert archive.where("kind = 'gap'").count() == 0
    assert run(spark, PAGES[:0])[1].count() == 0


def built(packed):
    records = [warc.record("response", k, "u", warc.payload_digest(b"x%d" % k * 50), 100, warc.HTTP % 100 + b"x%d" % k * 50) for k in range(6)]
    return [warc.member(r) for r in records] if packed else records


def read(data):
    got = list(warc.read_archive(data))
    return [x.fields["WARC-Record-ID"] for x in got if isinstance(x, warc.Record)], [(x.start, x.end) for x in got if isinstance(x, warc.Gap)]


def test_salvage_skips_only_what_is_damaged():
    for packed in (True, False):
        parts = built(packed)
        starts = [sum(map(len, parts[:k])) for k in range(7)]
        whole = b"".join(parts)
        for place in range(starts[2] + (12 if packed else 0), starts[3] - (0 if packed else 4), 7):
            bad = bytearray(whole)
            bad[place] ^= 0x55
            ids, gaps = read(bytes(bad))
            if len(ids) == 6:  # the name of the header's digest, whose loss leaves the rest as it was
                assert not gaps and not packed
                continue
            assert ids == [warc.PAGE % k for k in (0, 1, 3, 4, 5)] and gaps == [(starts[2], starts[3])]
        ids, gaps = read(b"junk" + whole[: starts[1]] + b"\x1f\x8b\x08 WARC/1.0\r\n" + whole[starts[1] : -3])
        assert ids == [warc.PAGE % k for k in range(5)] and len(gaps) == 3 and gaps[0] == (0, 4)
    assert read(b"") == ([], []) and read(b"nothing") == ([], [(0, 7)])
    assert read(warc.EMPTY_MEMBER * 2) == ([], [])


def test_salvage_inside_members_of_many_records():
    records = built(False)
    one = warc.member(b"".join(records))
    ids = lambda *ks: [warc.PAGE % k for k in ks]
    assert read(one) == (ids(*range(6)), [])
    bad = warc.member(b"".join([*records[:2], records[2].replace(b"x2x2", b"x2y2", 1), *records[3:]]))
    assert read(bad) == (ids(0, 1, 3, 4, 5), [(0, len(bad))])
    assert read(warc.member(b"junk" + records[0] + b"tail"))[0] == ids(0)
    packer = warc.zlib.compressobj(0, warc.zlib.DEFLATED, 31)
    stored = packer.compress(b"".join(records)) + packer.flush()
    cut = stored[: stored.index(b"x4x4")]
    for data, behind in ((cut, b""), (cut, one), (cut, b"junk")):
        got, gaps = read(data + behind)
        assert got == ids(0, 1, 2, 3) + (ids(*range(6)) if behind == one else []) and gaps == [(0, len(cut) + (len(behind) if behind == b"junk" else 0))]
    wrong = one[:-8] + bytes(4) + one[-4:]
    assert read(wrong) == (ids(0, 1, 2, 3, 4), [(0, len(wrong))])


def test_headers_without_blanks_and_folded():
    plain = built(False)[1]
    signed, _, rest = plain.partition(b"\r\n\r\n")
    head = signed.partition(warc.HEADER_DIGEST)[0]
    assert read(head.lower().replace(b"warc/1.1", b"WARC/1.1") + b"\r\n\r\n" + rest)[0] == [warc.PAGE % 1]
    assert read(head.replace(b": ", b":") + b"\r\n\r\n" + rest)[0] == [warc.PAGE % 1]
    assert read(head.replace(b"application/http; ", b"application/http;\r\n\t") + b"\r\n\r\n" + rest)[0] == [warc.PAGE % 1]
    for damage in (b"1e0", b"-5", b"99999999999999999999999", b"", "\u0663".encode(), b"101", b"1_0"):
        bad = plain.replace(b"X-Payload-Length: 100", b"X-Payload-Length: " + damage)
        assert read(bad + plain) == ([warc.PAGE % 1], [(0, len(bad))])
    other = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:x>\r\ncontent-length:%d\r\nContent-Type: %s\r\nWARC-Payload-Digest: %s\r\n\r\n%s\r\n\r\n"
    body = b"H: 1\r\n\r\npage"
    for kind, payload in ((b"application/http", b"page"), (b"text/html", body)):
        for name, good in (("sha256", True), ("md5", True), ("sha1", True), ("crc9", True)):
            for text in (hashlib.new(name, payload).hexdigest(), base64.b32encode(hashlib.new(name, payload).digest()).decode()) if name != "crc9" else ("zz",):
                (x,) = warc.read_archive(other % (len(body), kind, f"{name}:{text}".encode(), body))
                assert warc.described(x) == (x.start, x.end, "record", "response", None, None, None, len(payload), warc.payload_digest(payload))
    (x,) = warc.read_archive(other % (len(body), b"text/html", b"sha256:" + b"0" * 64, body))
    assert isinstance(x, warc.Gap)


def test_no_damaged_byte_gives_a_wrong_row(spark, tmp_path):
    """Every byte of an archive damaged in turn, in both layouts: whatever is read is what was written."""
    records = [warc.record("response", 1, "http://a/?b=1", warc.payload_digest(b"x" * 40), 40, warc.HTTP % 40 + b"x" * 40), warc.record("revisit", 2, "u", warc.payload_digest(b"x" * 40), 40, b"", 1), warc.record("response", 3, None, warc.payload_digest(b""), 0, warc.HTTP % 0)]
    for parts in (records, [warc.member(r) for r in records]):
        whole = b"".join(parts)
        good = {warc.described(x)[3:] for x in warc.read_archive(whole)}
        assert len(good) == 3
        for place in range(len(whole)):
            for change in (0x01, 0x20, 0x55):
                bad = bytearray(whole)
                bad[place] ^= change
                got = [x for x in warc.read_archive(bytes(bad)) if isinstance(x, warc.Record)]
                assert {warc.described(x)[3:] for x in got} <= good and len(got) >= 2, (place, change)
    bad = whole[:200] + b"!" + whole[201:]
    (tmp_path / "a").write_bytes(bad)
    (tmp_path / "b").write_bytes(b"".join(records).replace(b"X-Payload-Length: 40", b"X-Payload-Length: 1e"))
    rows = warc.read_archives(spark, str(tmp_path), payloads=True).collect()
    assert {r.kind for r in rows} == {"record", "gap"} and all(tuple(r)[4:10] in good for r in rows if r.kind == "record")
