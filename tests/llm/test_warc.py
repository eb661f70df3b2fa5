import gzip
import hashlib
import io
import random
from collections import defaultdict

import duckdb
import pytest

from leafmill.llm import queries, warc

from .helpers import AWKWARD_SCHEMA  # noqa: F401


def expected(rows):
    groups = defaultdict(list)
    for i, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000:
            groups[hashlib.sha1(b).hexdigest()].append(i)
    out = []
    for i, html in rows:
        b = (html or "").encode()
        h = hashlib.sha1(b).hexdigest()
        top = max((x for x in groups[h] if x is not None), default=None)
        again = len(groups[h]) > 1 and top is not None and top != i
        out.append((str(i), len(b), h, "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_query_and_oracle(spark, sf):
    got = sorted(map(tuple, queries.op4_warc(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{sf}/pages.parquet'")
    assert got == sorted(con.execute(queries.oracle_sql()["op4_warc"]).fetchall())


def test_awkward_pages_in_tiny_ranges(spark):
    rng = random.Random(4)
    page = "".join(rng.choice("abcdé <>") for _ in range(3000))
    rows = [(1, None), (2, ""), (3, page), (9, page), (4, page), (5, page), (5, page), (None, page), (6, "x" * 999), (7, "x" * 999), (8, "y" * 1000), (10, "y" * 1000), (11, "z" * 400_000), (12, page[::-1]), (None, page[::-1] + "q")]
    df = spark.createDataFrame([(i, h, f"http://a/{i} b\n", 0, "x") for i, h in rows], "page_id long, html string, url string, bytes int, path string")
    for range_mb in (8, 0.01):
        got = sorted(((str(r[0]), *tuple(r)[1:]) for r in warc.round_trip(df, range_mb=range_mb).collect()), key=str)
        assert got == expected(rows)
    assert warc.round_trip(df.limit(0)).collect() == []


@pytest.mark.parametrize("step", [1, 7, 100, 1000, 10**6])
def test_every_split_gives_every_record_once(step):
    rng = random.Random(step)
    inner = warc.record(99, "u", "d", 3, b"abc", None)
    bodies = [rng.randbytes(rng.randrange(0, 600)) for _ in range(6)] + [inner + inner[:40], warc.MAGIC * 50]
    members = [warc.record(i, "u", "d", len(b), b, None) for i, b in enumerate(bodies)]
    # a stored (uncompressed) member that holds another member's bytes
    import zlib

    stored = zlib.compressobj(0, zlib.DEFLATED, 31)
    raw = gzip.decompress(warc.record(50, "u", "d", len(inner), inner, None))
    members.insert(3, stored.compress(raw) + stored.flush())
    data = b"".join(members)
    starts = [sum(map(len, members[:k])) for k in range(len(members))]
    found = [pos for a in range(0, len(data), step) for pos, _ in warc.records(io.BytesIO(data), a, a + step)]
    assert found == starts
    assert len(gzip.decompress(data).split(b"WARC/1.1\r\n")) >= len(members)


class CountingFile(io.BytesIO):
    reads = 0

    def read(self, *args):
        self.reads += 1
        return super().read(*args)


@pytest.mark.parametrize("beyond", [0, 1, 10**6, 10**9])
def test_reads_stop_at_the_files_end(beyond):
    data = b"".join(warc.record(i, "u", "d", 3, b"abc", None) for i in range(50))
    for tail in (b"", b"\x1f", warc.MAGIC, b"garbage" * 10):
        file = CountingFile(data + tail)
        assert len(list(warc.records(file, 0, len(data) + beyond))) == 50
        assert file.reads <= 4
    assert list(warc.records(CountingFile(b""), 0, 10**9)) == []


def test_files_that_read_short():
    class Short(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 100))

    data = b"".join(warc.record(i, "u", "d", 300, bytes(300), None) for i in range(9))
    assert len(list(warc.records(Short(data), 0, len(data)))) == 9


def made(n=6, size=300):
    return [warc.record(i, "u", hashlib.sha1(bytes([i]) * size).hexdigest(), size, bytes([i]) * size, None) for i in range(n)]


def test_a_changed_byte_ends_the_read():
    members = made()
    for at in range(20, len(members[3]), 7):
        bad = bytearray(members[3])
        bad[at] ^= 0x55
        data = b"".join([*members[:3], bytes(bad), *members[4:]])
        for step in (100, 10**6):
            with pytest.raises(warc.DamagedArchive):
                found = [warc.row_of(r) for a in range(0, len(data), step) for _, r in warc.records(io.BytesIO(data), a, a + step)]
                if len(found) < 6:  # what the count of records of each archive finds
                    raise warc.DamagedArchive


def test_a_false_digest_ends_the_read():
    (_, good), = warc.records(io.BytesIO(made(1)[0]), 0, 10**6)
    assert warc.row_of(good)["payload_bytes"] == 300
    for field, value in (("warc-payload-digest", "sha1:" + "0" * 40), ("x-payload-length", "299")):
        with pytest.raises(warc.DamagedArchive):
            warc.row_of(good | {field: value})


def test_records_read_are_counted(spark):
    files = spark.createDataFrame([("a", 10, 2), ("b", 10, 1)], "path string, bytes long, records long")
    back = spark.createDataFrame([("a",), ("a",), ("b",)], "path string")
    warc.complete(files, back)
    for some in (back.where("path = 'a'"), back.limit(0), back.unionAll(back)):
        with pytest.raises(warc.DamagedArchive):
            warc.complete(files, some)
