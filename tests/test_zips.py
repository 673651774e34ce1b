"""Members of archives by byte ranges."""

import random
import zipfile

import pytest

from panolith.sources import zips


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        z.writestr("folder/", "")
        for name, data in members.items():
            z.writestr(name, data)
    return str(path)


def test_wanted_members_alone_are_fetched(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    one = {f"images/{i}.jpg": rng.randbytes(5000 + i) for i in range(40)} | {"empty": b"", "é ü.txt": "é".encode()}
    two = {"labels/0.json": b"{}" * 100}
    paths = [archive(tmp_path / "one.zip", one), archive(tmp_path / "two.zip", two, zipfile.ZIP_STORED)]
    rows = zips.members(spark, paths, partition_bytes=20_000)
    assert {r.name: bytes(r.content) for r in rows.collect()} == one | two and rows.rdd.getNumPartitions() > 8
    names = ["images/3.jpg", "images/30.jpg", "labels/0.json", "absent"]
    some = zips.members(spark, paths, names)
    assert {r.name: (r.size, bytes(r.content)) for r in some.collect()} == {n: (len(x), x) for n, x in (one | two).items() if n in names}
    left = zips.members(spark, paths, names, done=some.where("name LIKE 'images/%'"))
    assert [r.name for r in left.collect()] == ["labels/0.json"]
    assert zips.members(spark, paths, []).count() == 0

    asked = []
    fetch = zips.fetch
    monkeypatch.setattr(zips, "fetch", lambda p, at, n: asked.append(n) or fetch(p, at, n))
    found = {m.name: m for m in zips.directory(paths[0])}
    assert zips.content(found["images/3.jpg"]) == one["images/3.jpg"] and sum(asked) < 80_000 < 200_000 < sum(map(len, one.values()))


def test_damaged_members_are_told(tmp_path):
    path = archive(tmp_path / "x.zip", {"a": b"abc" * 50}, zipfile.ZIP_STORED)
    data = bytearray(open(path, "rb").read())
    at = data.index(b"abcabc")
    data[at] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(OSError, match="damaged"):
        zips.content(zips.directory(path)[0])
