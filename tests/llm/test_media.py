import hashlib
import struct
import zlib

import pytest

from pagewright.llm import media


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


ROWS = [("a.png", png(640, 480)), ("b.gif", b"GIF89a" + struct.pack("<HH", 3, 4)), ("c.html", "<p>é</p>".encode()), ("c.html", b"again"), ("d.bin", b""), ("e.bin", bytes(range(256)) * 5000), (None, b"x"), ("f", None), ("g.wav", b"RIFF\0\0\0\0WAVEfmt ")]
WAV = b"RIFF" + struct.pack("<I", 36 + 8000) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", 8000) + b"\0" * 8000
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF" + b"\0" * 10 + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 90, 120) + b"\0" * 12


@pytest.mark.parametrize("range_bytes, archive_bytes", [(1 << 30, 1 << 30), (64, 1000), (1, 1)])
def test_round_trip(spark, tmp_path, range_bytes, archive_bytes):
    frame = spark.createDataFrame([(*r, "x") for r in ROWS], "member string, payload binary, md5 string").repartition(3)
    assert media.write(frame, str(tmp_path / "a"), archive_bytes) == 7
    found = media.columns(media.scan(spark, f"file://{tmp_path}/a", range_bytes)).collect()
    assert sorted((r.member, bytes(r.payload)) for r in found) == sorted(r for r in ROWS if None not in r)
    assert all(r.error is None and r.attempts == 1 and r.md5 == hashlib.md5(bytes(r.payload)).hexdigest() and r.n_bytes == len(r.payload) for r in found)
    kinds = {r.member: (r.media_type, r.width, r.height) for r in found}
    assert kinds["a.png"] == ("image/png", 640, 480) and kinds["b.gif"] == ("image/gif", 3, 4) and kinds["c.html"][0] == "text/html" and kinds["g.wav"][0] == "audio/wav" and kinds["d.bin"][0] == "application/octet-stream"
    assert not list((tmp_path / "a").glob("*.tmp"))


def test_broken_members_and_archives(spark, tmp_path):
    frame = spark.createDataFrame([("one", b"first payload" * 9), ("two", b"second payload" * 9)], "member string, payload binary").coalesce(1)
    media.write(frame, str(tmp_path / "a"))
    path = next((tmp_path / "a").glob("*.zip"))
    data = bytearray(path.read_bytes())
    data[40] ^= 255
    path.write_bytes(data)
    (tmp_path / "a/bad.zip").write_bytes(b"no archive")
    (tmp_path / "a/empty.zip").write_bytes(b"")
    (tmp_path / "a/other.txt").write_bytes(b"not read")
    rows = {r.member or r.archive[-9:]: r for r in media.scan(spark, str(tmp_path / "a"), retries=2).collect()}
    assert rows["one"].payload is None and rows["one"].attempts == 2 and rows["one"].error
    assert bytes(rows["two"].payload) == b"second payload" * 9 and rows["two"].attempts == 1
    assert rows["a/bad.zip"].error and rows["empty.zip"].error and len(rows) == 4


def test_nothing(spark, tmp_path):
    assert media.scan(spark, str(tmp_path / "missing")).count() == 0
    empty = spark.createDataFrame([], "member string, payload binary")
    assert media.write(empty, str(tmp_path / "b")) == 0
    assert media.columns(media.scan(spark, str(tmp_path / "b"))).count() == 0


def test_retry_reads_only_the_member_again(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        for k in range(5):
            z.writestr(f"m{k}", b"payload" * k)
    calls = []
    real = media.read_member

    def flaky(file, info, most):
        calls.append(info.filename)
        if info.filename == "m2" and calls.count("m2") == 1:
            raise OSError("connection lost")
        return real(file, info, most)

    monkeypatch.setattr(media, "read_member", flaky)
    reader = media.Members({"path": str(tmp_path)})
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert [r["attempts"] for r in rows] == [1, 1, 2, 1, 1] and all(r["error"] is None for r in rows)
    assert calls == ["m0", "m1", "m2", "m2", "m3", "m4"]


def test_jpeg_and_wav_columns(spark, tmp_path):
    frame = spark.createDataFrame([("a.jpg", JPEG), ("b.jpg", b"\xff\xd8\xff"), ("c.wav", WAV), ("d.wav", b"RIFF\0\0\0\0WAVEfmt "), ("e.png", png(5, 6))], "member string, payload binary")
    media.write(frame, str(tmp_path / "a"))
    found = {r.member: (r.width, r.height, r.channels, r.sample_rate, r.seconds) for r in media.columns(media.scan(spark, str(tmp_path / "a"))).collect()}
    assert found == {"a.jpg": (120, 90, None, None, None), "b.jpg": (None, None, None, None, None), "c.wav": (None, None, 2, 8000, 0.25), "d.wav": (None, None, None, None, None), "e.png": (5, 6, None, None, None)}


def test_unreadable_and_oversized_members(spark, tmp_path):
    import zipfile

    for name, change in (("version", (b"PK\x01\x02\x14\x03\x14", b"PK\x01\x02\x14\x03\xff")), ("method", None), ("big", None), ("lies", None)):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_BZIP2 if name == "method" else zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, b"0" * (300_000 if name in ("big", "lies") else 50))
            z.writestr(f"{name}-too", b"fine", zipfile.ZIP_STORED)
        data = (tmp_path / f"{name}.zip").read_bytes()
        if name == "lies":  # the directory tells of a smaller size
            at = data.index(b"PK\x01\x02") + 24
            data = data[:at] + struct.pack("<I", 10) + data[at + 4 :]
        (tmp_path / f"{name}.zip").write_bytes(data.replace(*change) if change else data)
    rows = media.scan(spark, str(tmp_path), member_bytes=100_000).collect()
    told = {r.member: r for r in rows}
    assert told["method"].attempts == 1 and "compression" in told["method"].error and "at most" in told["big"].error and "as long" in told["lies"].error
    assert all(bytes(told[f"{k}-too"].payload) == b"fine" for k in ("method", "big", "lies"))
    assert any("version" in r.archive and r.error and "NotImplementedError" in r.error for r in rows)
