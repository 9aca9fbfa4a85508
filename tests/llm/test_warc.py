import base64
import hashlib

from strandline.llm.warc import captures, lookup, read_archive, read_records, reversed_host_key, write_archive


def pages(spark):
    rows = [(i, f"http://www.h{i % 7}.Example.com:80/p/{i}?q={i % 3}", "<p>" + "é" * (i % 11) + "</p>" if i % 5 else None, "x") for i in range(1500)]
    rows += [(5000, None, "<b>\r\n\r\nWARC/1.1</b>" * 5000, "x"), (5001, "not a url\n", "", "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, offset string").repartition(6)


def test_round_trip(spark):
    rows, df = pages(spark)
    archive = write_archive(df, shards=4)
    groups = {}
    for i, _, html, _ in rows:
        groups[html or ""] = max(groups.get(html or "", -1), i)
    want = set()
    for i, _, html, _ in rows:
        p, keep = (html or "").encode(), groups[html or ""]
        want.add((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == keep else "revisit", None if i == keep else keep))
    found = read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(found) == len(rows) and {tuple(r) for r in found} == want
    assert archive.shards.agg({"blocks": "sum", "captures": "sum"}).first()["sum(captures)"] == len(rows)
    assert captures(archive).count() == len(rows)


def test_lookup_and_payload(spark):
    rows, df = pages(spark)
    archive = write_archive(df, shards=3)
    asked = [rows[k][1] for k in (3, 700, 1499)] + ["http://nowhere.example.org/", None, rows[3][1]]
    found = lookup(archive, spark.createDataFrame([(u,) for u in asked], "url string"))
    assert {r["page_id"] for r in found.collect()} == {3, 700, 1499, 5000}
    (row,) = read_records(archive, found.where("page_id = 5000"), with_payload=True).collect()
    assert bytes(row["payload"]).decode() == rows[1500][2]


def test_keys_and_empty(spark):
    assert reversed_host_key("https://user@WWW.a.B.com:8/x?y#z") == "com,b,a)/x?y"
    assert reversed_host_key(None) == ")/"
    assert read_archive(write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_page_ids_with_several_payloads(spark):
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    for rows in ([(5, "a"), (5, "b"), (3, "a")], [(5, "a"), (3, "a"), (3, "z")], [(5, "a"), (5, "a"), (3, "a"), (3, "b"), (4, "b"), (4, "a")], [(None, "a"), (2, "a"), (2, "a")]):
        df = spark.createDataFrame([(i, f"http://h{k}/", x) for k, (i, x) in enumerate(rows)], "page_id long, url string, html string")
        most = {x: max((i for i, y in rows if y == x and i is not None), default=None) for _, x in rows}
        want = sorted((str(i), digest(x), "revisit" if i is not None and i < most[x] else "response", most[x] if i is not None and i < most[x] else None) for i, x in rows)
        archive = write_archive(df, shards=2)
        for urls in (None, df.select("url")):
            found = read_archive(archive, urls).select("page_id", "payload_digest", "record_type", "refers_to").collect()
            assert sorted((str(r[0]), *r[1:]) for r in found) == want, rows


def test_lookup_finds_all_captures_of_a_hot_url(spark):
    rows = [(i, "http://hot.example.com/" if i % 3 else f"http://h{i}.example.com/", str(i)) for i in range(2000)]
    archive = write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), shards=4)
    found = lookup(archive, spark.createDataFrame([("http://www.hot.example.com",), ("http://hot.example.com/",)], "url string"))
    assert found.where("url = 'http://hot.example.com/'").count() == sum(u == "http://hot.example.com/" for _, u, _ in rows)
    assert read_archive(archive, found.select("url")).count() == sum(u == "http://hot.example.com/" for _, u, _ in rows)
