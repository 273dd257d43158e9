import base64
import glob
import hashlib
import random

import duckdb
import pytest
import zstandard

from phonolith.llm import warc as W


def test_archive_round_trip():
    rng = random.Random(1)
    for n in (1, 15, 16, 400):
        records = [W.record(i, f"http://h/{i}", bytes(rng.choice(b"<p>hello world</p>") for _ in range(rng.randint(0, 900))), None if i % 3 else 0, "2024-01-01T00:00:00Z") for i in range(n)]
        data = W.archive(records)
        assert list(W.records_of(data)) == records
        assert int.from_bytes(data[4:8], "little") > 0
        if n == 400:
            # An ordinary Zstandard reader skips the dictionary frame; frames hold one record each.
            end = W.frame_end(memoryview(data), 8 + int.from_bytes(data[4:8], "little"))
            with pytest.raises(zstandard.ZstdError):
                zstandard.ZstdDecompressor().decompress(data[8 + int.from_bytes(data[4:8], "little") : end])


def test_few_or_equal_records_have_a_dictionary_too():
    one = W.record(1, "http://h/1", b"<p>some page</p>" * 60, None, "2024-01-01T00:00:00Z")
    for records in ([one], [one[:400]], [one] * 3, [b"x" * 50] * 100):
        data = W.archive(records)
        assert list(W.records_of(data)) == records and int.from_bytes(data[4:8], "little") >= 100
    assert len(W.archive([one] * 16)) < 16 * len(W.archive([one]))


def test_a_store_unknown_to_pyarrow_is_named():
    with pytest.raises(ValueError, match="nowhere"):
        W.opened("nowhere://bucket/a")


def test_the_query_and_its_sql(spark):
    pages = "/root/testdata/sf0.001/pages.parquet"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{pages}'")
    want = con.sql(W.ORACLE["op9_warc_dictionary"])
    got = W.op9_warc_dictionary(spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_a_damaged_payload_is_an_error():
    raw = W.record(1, "http://h/", b"payload", None, "2024-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        W.parsed(raw.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"))


def rows():
    rng = random.Random(2)
    out = [(i, f"http://h/{i}", "<html>" + " ".join(rng.choice(["é", "a", "b\r\n\r\n", "WARC/1.1"]) for _ in range(rng.randint(0, 300)))) for i in range(200)]
    out += [(300 + i, "http://same/", "equal payload") for i in range(40)]
    return [*out, (400, None, None), (401, "with\r\nbreak %", ""), (402, "", "big" * 400_000), (None, "http://n/", "equal payload"), (None, "http://n/", "only null ids"), (500, "u", "twice"), (500, "u", "twice")]


@pytest.mark.parametrize("least", [0, 1, 100_000_000])
def test_pages_come_back(spark, tmp_path, least):
    pages = spark.createDataFrame([(*r, "x") for r in rows()], "page_id long, url string, html string, refers_to string").repartition(3)
    got = sorted(map(tuple, W.archived(pages, f"file://{tmp_path}/a", least).collect()), key=str)
    groups: dict[bytes, list] = {}
    for i, _, html in rows():
        groups.setdefault((html or "").encode(), []).append(i)
    want = []
    for payload, ids in groups.items():
        named = [i for i in ids if i is not None]
        first = max(named, default=None)
        for i in ids:
            again = len(payload) >= least and i != first
            want.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(want, key=str)
    files = glob.glob(f"{tmp_path}/a/archives/*.warc.zst")
    assert files and all(open(f, "rb").read(4) == b"\x5d\x2a\x4d\x18" for f in files)


def test_small_archives_and_empty_table(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id long, url string, html string")
    manifest = W.write_archives(W.with_originals(pages, 0, "page_id", "url", "html"), f"file://{tmp_path}/b", 20_000)
    assert manifest.count() > 5
    found = W.read_archives(manifest, f"file://{tmp_path}/b")
    assert found.count() == len(rows())
    assert W.archived(pages.limit(0), f"file://{tmp_path}/c").count() == 0
