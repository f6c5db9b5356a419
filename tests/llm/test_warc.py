import base64
import gzip
import hashlib
from pathlib import Path

import pytest
from compare import connect, same

from waveplan.llm.warc import OP9_SQL, op9_warc, parse, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, shard string, first string, tag string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def odd():
    rows = [(i, f"http://a.example/{i}", f"<p>{i % 7}</p>" * (i % 50)) for i in range(120)]
    rows += [(200, None, None), (201, "http://ü.example/ \r\n", ""), (202, "u", "é漢😀\x00" * 3000), (203, "u", "\r\n\r\n")]
    rows += [(None, "v", "only without id"), (None, "v", "<p>1</p>"), (204, "w", "twice"), (204, "w", "twice"), (205, "w", "twice")]
    return rows


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = odd()
    write_archive(pages(spark, rows), f"file://{tmp_path}/a", shard_bytes=4000, roll_bytes=1500)
    got = read_archive(spark, f"file://{tmp_path}/a").collect()
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    expected = []
    for i, _, html in rows:
        low = first.get(html or "")
        response = low is None or i == low
        payload = (html or "").encode()
        expected.append((i, len(payload), digest(html), "response" if response else "revisit", None if response else low, payload if response else None))
    ours = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["payload"] and bytes(r["payload"])) for r in got]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, (bytes, str)) else (False, str(x)) for x in r)
    ours = [(*r[:5], b"" if r[3] == "response" and not r[5] else r[5]) for r in ours]
    assert sorted(ours, key=key) == sorted(expected, key=key)


def test_files_are_the_same_again_and_roll_by_size(spark, tmp_path):
    table = pages(spark, odd())
    for name, parts in (("a", 3), ("b", 11)):
        write_archive(table.repartition(parts), f"file://{tmp_path}/{name}", shard_bytes=4000, roll_bytes=1500)
    a, b = ({p.name: p.read_bytes() for p in (tmp_path / n).glob("*.warc.gz")} for n in "ab")
    assert a == b and len(a) > 5
    assert not list(tmp_path.rglob("*.tmp"))
    ids = []
    for name in sorted(a):
        records = list(parse(a[name]))
        assert records[0][0]["WARC-Filename"] == name
        assert len(a[name]) <= 1500 or len(records) == 2
        assert gzip.decompress(a[name]).count(b"WARC/1.1\r\n") == len(records)
        ids += [int(f["X-Page-ID"]) for f, _ in records[1:] if "X-Page-ID" in f]
    assert ids == sorted(ids)


def test_damage_is_noticed(spark, tmp_path):
    write_archive(pages(spark, odd()), f"file://{tmp_path}/a")
    file = next(Path(tmp_path / "a").glob("*.warc.gz"))
    file.write_bytes(file.read_bytes()[:-1] + b"?")
    with pytest.raises(Exception, match="differs from its manifest"):
        read_archive(spark, f"file://{tmp_path}/a").collect()


def test_files_without_manifest_are_not_read(spark, tmp_path):
    write_archive(pages(spark, odd()[:20]), f"file://{tmp_path}/a")
    (tmp_path / "a" / "part-999999-000000.warc.gz").write_bytes(b"left over")
    assert read_archive(spark, f"file://{tmp_path}/a").count() == 20


def test_empty_table(spark, tmp_path):
    write_archive(pages(spark, []), f"file://{tmp_path}/a")
    assert read_archive(spark, f"file://{tmp_path}/a").collect() == []


def test_query_equals_sql(spark, small):
    same(op9_warc(spark, small), connect(small), OP9_SQL)
