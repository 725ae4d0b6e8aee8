import base64
import hashlib
import io
import struct

import pytest
import zstandard

from cleanloom.llm import warc

PAGES = "page_id long, url string, html string, payload string"


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(4, "http://a/ü", "<p>x</p>"), (2, "http://b\r\nHost: evil", "<p>x</p>"), (9, None, None), (7, "http://c", ""), (None, "http://d", "<p>x</p>"),
            (None, "n", "only nulls"), (None, "n", "only nulls"), (3, "u", "WARC/1.1\r\n\r\nin the payload\r\n\r\n"), (5, "u", "y" * 3_000_000), (6, "u", "é😀"), (6, "u", "é😀")]
    rows += [(100 + i, f"http://e/{i}", f"page {i} " * (i % 50)) for i in range(400)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def expected(rows):
    firsts = {}
    for r in rows:
        if r["page_id"] is not None:
            firsts[r["html"] or ""] = min(firsts.get(r["html"] or "", r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        html = r["html"] or ""
        revisit = html in firsts and firsts[html] != r["page_id"]
        out.append((r["page_id"], len(html.encode()), b32(html), "revisit" if revisit else "response", firsts[html] if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, pages, tmp_path, monkeypatch):
    manifest = warc.write_bundles(pages, str(tmp_path / "archive"))
    records = warc.read_bundles(manifest).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records), key=repr) == expected(pages.collect())
    html = {r["page_id"]: r["html"] for r in pages.collect() if r["page_id"] is not None}
    for r in records:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() == (html[r["page_id"]] or "")
    assert {r["url"] for r in records if r["page_id"] == 2} == {"http://b%0D%0AHost: evil"}
    assert manifest.agg(warc.F.sum("records")).first()[0] == pages.count()


def test_records_are_found_by_identifier(spark, pages, tmp_path):
    manifest = warc.write_bundles(pages, str(tmp_path / "archive"))
    index = warc.record_index(manifest)
    assert index.count() == pages.count()
    wanted = index.filter(warc.F.col("record_id").isin("<urn:page:149>", "<urn:page:5>"))
    found = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.fetch(wanted).collect()}
    assert found == {149: "page 49 " * 49, 5: "y" * 3_000_000}


def test_bundle_is_plain_zstandard_with_a_seek_table(tmp_path):
    stream = io.BytesIO()
    writer = warc.BundleWriter(stream)
    records = [warc.encode_record(i, "u", f"text {i}".encode() * 9000, False, None) for i in range(20)]
    for i, r in enumerate(records):
        writer.add(warc.record_id(i), r)
    writer.finish()
    data = stream.getvalue()
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True) as reader:
        assert reader.read() == b"".join(records)  # any decoder reads it and skips the tables
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    assert (count, flags, magic) == (len(writer.frames), 0, 0x8F92EAB1) and count > 3
    path = tmp_path / "b.warc.zst"
    path.write_bytes(data)
    reader = warc.BundleReader(str(path))
    for name, frame, offset, length in reader.places():
        assert reader.frame(frame)[offset:offset + length] == records[int(name[10:-1])]


def test_damage_is_noticed():
    record = bytearray(warc.encode_record(1, "u", b"payload", False, None))
    record[-6] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.decode_record(bytes(record))


def test_short_payloads_can_stay_responses(spark, pages, tmp_path):
    records = warc.read_bundles(warc.write_bundles(pages, str(tmp_path / "archive"), revisit_from=5)).collect()
    assert {r["record_type"] for r in records if r["payload_bytes"] < 5} == {"response"}
    assert "revisit" in {r["record_type"] for r in records}


def test_empty_table(spark, pages, tmp_path):
    manifest = warc.write_bundles(pages.limit(0), str(tmp_path / "archive"))
    assert manifest.count() == 0 and warc.read_bundles(manifest).count() == 0
