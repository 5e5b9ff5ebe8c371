import hashlib
import random

from tessella.llm import common, warc_merkle


def test_locates_every_difference(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for _ in range(1500):
        rows.append((at, hashlib.sha256(str(at).encode()).hexdigest()))
        at += rng.randint(150, 4000)
    other = dict(rows)
    corrupt = {rows[k][0] for k in (0, 7, 700, 701, 1499)}
    missing = {rows[k][0] for k in (5, 900)}
    for o in corrupt:
        other[o] = "0" * 64
    for o in missing:
        del other[o]
    other[at + 5_000_000] = "f" * 64
    one = spark.createDataFrame(rows, "offset long, leaf string")
    two = spark.createDataFrame(list(other.items()), "offset long, leaf string")
    found = {tuple(r) for r in warc_merkle.audit(spark, one, two).collect()}
    assert found == {(o, "corrupt") for o in corrupt} | {(o, "missing") for o in missing} | {(at + 5_000_000, "extra")}
    assert warc_merkle.audit(spark, one, one).count() == 0
    assert {r.status for r in warc_merkle.audit(spark, one, one.limit(0)).collect()} == {"missing"}
    assert warc_merkle.audit(spark, one.limit(0), one.limit(0)).count() == 0


def test_root_is_the_hash_of_the_tree(spark):
    rows = [(k * 40_000, f"leaf{k}") for k in range(40)]
    scratch = common.Scratch(spark, "test-merkle")
    tree = warc_merkle.levels(scratch, spark.createDataFrame(rows, "offset long, leaf string"), "t", 2)
    now = rows
    for level, width in enumerate((warc_merkle.RANGE, warc_merkle.FAN, warc_merkle.FAN)):
        groups = {}
        for place, leaf in now:
            groups.setdefault(place // width, []).append(f"{place}@{leaf}")
        now = sorted((k, hashlib.sha256(("node" + "|".join(v)).encode()).hexdigest()) for k, v in groups.items())
        assert sorted(map(tuple, tree[level].collect())) == now
    assert len(now) == 1


def test_edge_rows(spark, tmp_path):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "é", 2), (1, "u", "é", 2), (2, "", "x" * 200_000, 3)], "page_id long, url string, html string, status int")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = warc_merkle.audit_pages(spark, str(tmp_path)).orderBy("record_offset").collect()
    assert [r.page_id for r in rows] == [None, 1, 1, 2]
    at = 0
    for r in rows:
        assert r.record_offset == at
        at += r.record_length
    body = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: u\r\nContent-Type: text/html\r\nContent-Length: 2\r\n\r\né\r\n\r\n".encode()
    assert rows[1].sha256 == hashlib.sha256(body).hexdigest() and rows[1].record_length == len(body)


def test_empty_pages(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc_merkle.audit_pages(spark, str(tmp_path)).count() == 0
