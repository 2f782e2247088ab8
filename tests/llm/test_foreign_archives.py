"""Archives of other writers: their digests, ids, record types, and damage."""

import base64
import gzip
import hashlib
import io

import pytest
from propensia.llm import warc

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"


def member(block, length=None, **fields):
    head = {"WARC-Type": "response", "WARC-Record-ID": "<urn:uuid:0c0f>", "Content-Type": "application/http; msgtype=response"}
    head |= {k.replace("_", "-"): v for k, v in fields.items()} | {"Content-Length": len(block) if length is None else length}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return gzip.compress(f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n")


def read(data, **how):
    return list(warc.read_records(io.BytesIO(data), **how))


def labelled(name, data, base32=False):
    raw = hashlib.new(name, data).digest()
    return f"{name}:{base64.b32encode(raw).decode().rstrip('=') if base32 else raw.hex()}"


@pytest.mark.parametrize("name", sorted(warc.DIGESTS))
@pytest.mark.parametrize("base32", [False, True])
def test_digests_are_verified_by_their_algorithm(name, base32):
    good = dict(WARC_Block_Digest=labelled(name, HTTP + b"body", base32), WARC_Payload_Digest=labelled(name, b"body", base32))
    (r,) = read(member(HTTP + b"body", **good), keep_payload=True)
    assert (r.payload, r.payload_bytes, r.payload_digest) == (b"body", 4, hashlib.sha256(b"body").hexdigest())
    for field, data in (("WARC_Block_Digest", b"other"), ("WARC_Payload_Digest", b"other")):
        with pytest.raises(warc.DamagedArchive):
            read(member(HTTP + b"body", **good | {field: labelled(name, data, base32)}))


def test_digests_by_unknown_algorithms_are_passed_over():
    assert read(member(HTTP + b"x", WARC_Payload_Digest="blake9:00", WARC_Block_Digest="crc:1"))[0].payload_bytes == 1


@pytest.mark.parametrize("fields", [{"WARC_Payload_Digest": "sha1:not!base32"}, {"length": "x"}, {"length": "-4"}, {"length": "9999"}, {"length": "3"}, {"WARC_Type": None}, {"length": ""}])
def test_damage_is_named_so(fields):
    with pytest.raises(warc.DamagedArchive):
        read(member(HTTP + b"body", **fields))


def test_revisits_that_state_nothing():
    rows = read(member(b"", WARC_Type="revisit") + member(HTTP, WARC_Type="revisit", WARC_Payload_Digest="sha1:" + "A" * 32)
                + member(HTTP.replace(b"\r\n\r\n", b"\r\nContent-Length: 7\r\n\r\n"), WARC_Type="revisit", WARC_Payload_Digest=labelled("sha256", b"payload", True)))
    assert [(r.payload_bytes, r.payload_digest) for r in rows] == [(None, None), (None, None), (7, hashlib.sha256(b"payload").hexdigest())]


def test_other_records_are_payload_as_a_whole():
    info = b"software: x\r\n\r\nmore"
    long = b"n" * (3 << 20)
    rows = read(member(info, WARC_Type="warcinfo", Content_Type="application/warc-fields") + member(long, WARC_Type="resource", Content_Type="text/plain") + member(long), keep_payload=True)
    assert [r.payload for r in rows] == [info, long, long]
    assert read(member(b"no header"), keep_payload=True)[0].payload == b"no header"


def test_foreign_ids_are_kept_as_text(spark, tmp_path):
    path = tmp_path / "other.warc.gz"
    path.write_bytes(member(HTTP + b"a") + member(HTTP, WARC_Type="revisit", WARC_Refers_To="<urn:uuid:0c0f>", WARC_Record_ID="<urn:page:x>") + warc.record(-3, "u", b"p"))
    rows = warc.read_archives(spark.createDataFrame([(str(path),)], "path string")).collect()
    assert sorted((r.page_id is None, r.record_id, r.refers_to, r.refers_to_id) for r in rows) == [
        (False, "<urn:page:-3>", None, None), (True, "<urn:page:x>", None, "<urn:uuid:0c0f>"), (True, "<urn:uuid:0c0f>", None, None)]


def test_folders_lie_in_the_default_file_system(spark):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    assert warc._qualified(spark, "/a/b") == "/a/b"
    try:
        conf.set("fs.defaultFS", "hdfs://name:8020/")
        assert warc._qualified(spark, "/a/b") == "hdfs://name:8020/a/b" and warc._qualified(spark, "s3a://c/d") == "s3a://c/d"
    finally:
        conf.set("fs.defaultFS", before)
