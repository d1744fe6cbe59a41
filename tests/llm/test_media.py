import hashlib
import zipfile
import zlib

import numpy as np
import pytest

from echofold.llm import media

SCHEMA = "doc_id long, text string, media int, offset string"


def test_png_round_trip():
    for n in (64, 128, 6400):
        raw = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        assert media.decode_png(media.encode_png(raw)).tobytes() == raw
    image = bytearray(media.encode_png(bytes(64)))
    image[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(image))


def rows():
    texts = ["", None, "a", "x" * 64, "é" * 33, "ends with zeros\0\0", "z" * 300_000, "a"]
    return [(i, t, 1, "x") for i, t in enumerate(texts)] + [(0, "", 1, "x"), (None, "no id", 1, "x")]


def test_every_text_comes_back(spark):
    got = media.media_columns(spark.createDataFrame(rows(), SCHEMA).repartition(3)).collect()
    want = []
    for d, t, *_ in rows():
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((str(d), len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    same = [r for r in got if r.doc_id in (2, 7)]
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in same}) == 1


def test_ranges_cover_each_member_once(spark, tmp_path):
    df = spark.createDataFrame([(i, "text %d " % i * 50) for i in range(200)], "doc_id long, text string").repartition(2)
    media.write_archives(df, str(tmp_path / "a"), archive_bytes=5_000)
    assert len(list((tmp_path / "a").glob("part-*.zip"))) > 2
    found = media.read_archives(spark, str(tmp_path / "a"), range_bytes=1_000)
    assert found.rdd.getNumPartitions() > 10
    assert sorted(r.doc_id for r in found.select("doc_id").collect()) == list(range(200))


def test_members_are_retried_by_offset(tmp_path):
    path = tmp_path / "part-000000-0000.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(3):
            z.writestr(zipfile.ZipInfo(f"{i:08d}_{i}_64.png"), media.encode_png(bytes([i]) * 64))
    fs, root = media.file_system(str(path))

    class Flaky:
        """Fails whenever the second member is read for the first two times."""

        def __init__(self):
            self.opened, self.failed = 0, 0

        def open_input_file(self, p):
            self.opened += 1
            stream = fs.open_input_file(p)
            outer = self

            class Stream:
                def __enter__(self):
                    return self

                def __exit__(self, *x):
                    stream.close()

                def seek(self, n):
                    stream.seek(n)

                def read(self, n):
                    if stream.tell() == second and outer.failed < 2:
                        outer.failed += 1
                        raise OSError("lost")
                    return stream.read(n)

            return Stream()

    with zipfile.ZipFile(path) as z:
        members = z.infolist()
    second = members[1].header_offset
    flaky, reader = Flaky(), media.ArchiveReader(str(tmp_path), 1 << 20, 3)
    images = [reader.member(flaky, str(path), m) for m in members]
    assert [int(media.decode_png(x)[0, 0]) for x in images] == [0, 1, 2]
    assert (flaky.failed, flaky.opened) == (2, 5)
    flaky.failed = -5
    with pytest.raises(OSError, match=f"member at {second}"):
        reader.member(flaky, str(path), members[1])


def test_empty_table(spark):
    assert media.media_columns(spark.createDataFrame([], SCHEMA)).collect() == []
