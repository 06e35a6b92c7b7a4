import io
import zipfile

import pyarrow as pa
import pytest

from tidemark.llm import warc_zip as w


def rows_of(df):
    return sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    pages = [(5, "http://a/é x", "same"), (3, "http://b", "same"), (9, None, "same"), (4, "http://c", None), (6, "u", ""), (8, "http://d", "ß" * 300_000), (None, "n", "same"), (None, "n", "only"), (3, "http://b", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first int").repartition(3)
    archives = w.write_archives(df, str(tmp_path / "a"), archive_bytes=1000)
    records = w.read_records(w.read_index(archives, range_bytes=700))
    least = {"same": 3, "": 4, "ß" * 300_000: 8, "only": None}
    want = []
    for i, url, html in pages:
        first = least[html or ""]
        late = first is not None and first != i
        want.append((i, url, "revisit" if late else "response", len((html or "").encode()), w.digest((html or "").encode()), first if late else None))
    assert rows_of(records) == sorted(want, key=str)
    assert {r.page_id: bytes(r.payload) for r in records.where("record_type = 'response' and page_id = 8").collect()} == {8: ("ß" * 300_000).encode()}
    all_ = w.read_records(w.read_index(w.write_archives(df, str(tmp_path / "b"), least_bytes=5)))
    assert all_.where("record_type = 'revisit'").count() == 0
    assert w.read_records(w.read_index(w.write_archives(df.limit(0), str(tmp_path / "c")))).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_directories(zip64, monkeypatch):
    """The reader finds what zipfile wrote, with 32-bit or ZIP64 directories."""
    if zip64:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(3):
            with z.open(f"m{i}", "w", force_zip64=zip64) as f:
                f.write(b"x" * i * 1000 + b"end")
        z.comment = b"a comment"
    file = pa.BufferReader(out.getvalue())
    found = w.members(file)
    assert [m.name for m in found] == ["m0", "m1", "m2"]
    assert [file.read_at(m.size, w.data_start(file, m)) for m in found] == [b"x" * i * 1000 + b"end" for i in range(3)]


def test_bad_archives_and_records():
    with pytest.raises(ValueError, match="not a ZIP"):
        w.members(pa.BufferReader(b"no archive"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", "x" * 100)
    file = pa.BufferReader(out.getvalue())
    with pytest.raises(ValueError, match="compressed"):
        w.data_start(file, w.members(file)[0])
    with pytest.raises(ValueError, match="no WARC record"):
        w.parse_record(b"HTTP/1.1 200")
