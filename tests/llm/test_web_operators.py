import base64
import hashlib

from pyspark.sql import functions as F

from prismark.llm import url_filter, warc
from prismark.llm.common import tuned
from prismark.llm.queries import URL_RULES, host_list


def test_hosts_paths_rules(spark):
    urls = [None, "", "no scheme/x", "http://", "HTTP://A.B", "http://X.Example.ORG/es/a?q#f", "http://example.org/en/1", "http://example.org/en/2", "http://notexample.org/es/",
            "https://a.com/fr/x", "https://com/de/", "https://b.com/de", "ftp://h?x/y", "x://h#/y?z", "http://a/b://c/d", "http://spam-farm.net/x", "http://spamfarm.net/x", "http://w.ADS.net", "http://org"]
    df = tuned(spark).createDataFrame([(i, u, "z", True) for i, u in enumerate(urls)] + [(None, urls[5], None, None), (5, urls[5], None, None)], "page_id long, url string, host string, listed boolean")
    got = url_filter.judge(df, URL_RULES, host_list(df)).collect()
    got = [(None if r.page_id is None else urls[r.page_id], r.host, r.path, r.rule, r.verdict) for r in got]
    assert len(got) == len(urls) + 2 and got.count((urls[5], "x.example.org", "/es/a", "example.org/es/", "block")) == 2
    by = {x[0]: x[1:] for x in got}
    assert by[None] in [("", "", None, "allow"), ("x.example.org", "/es/a", "example.org/es/", "block")]
    assert by["no scheme/x"] == by["http://"] == by[""] == ("", "", None, "allow")
    assert by["HTTP://A.B"] == ("a.b", "", None, "allow")
    assert by["http://example.org/en/1"][2:] == ("example.org/en/1", "block") and by["http://example.org/en/2"][2:] == ("org/", "allow")
    assert by["http://notexample.org/es/"][2:] == ("org/", "allow")
    assert by["https://a.com/fr/x"][2:] == ("com/fr/", "allow") and by["https://com/de/"][2:] == ("com/de/", "block") and by["https://b.com/de"][2:] == (None, "allow")
    assert by["ftp://h?x/y"][:2] == ("h", "") and by["x://h#/y?z"][:2] == ("h", "") and by["http://a/b://c/d"][:2] == ("a", "/b://c/d")
    assert [by[u][3] for u in urls[-4:]] == ["block", "allow", "block", "allow"]
    assert url_filter.judge(df.limit(0), URL_RULES, host_list(df)).count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    keys = spark.range(20_000).select(F.concat(F.lit("host"), F.col("id").cast("string")).alias("key"), (F.col("id") % 7 == 0).alias("want"))
    listed = keys.where("want").select("key").unionByName(spark.createDataFrame([("elsewhere",), (None,), ("host7",)], "key string"))
    got = url_filter.with_listed(keys, "key", keys, listed)
    assert got.where("listed != want").count() == 0 and got.where("listed").count() == 2858
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    inside, outside = keys.where("want").select("key"), keys.where("not want").select("key")
    assert len(url_filter.build_cascade(inside, outside, 2858).levels) > 2
    monkeypatch.setattr(url_filter, "SHARD_KEYS", 1000)
    got = url_filter.with_listed(keys.unionByName(spark.createDataFrame([(None, False)], "key string, want boolean")), "key", keys, listed)
    assert got.where("listed != want").count() == 0 and got.count() == 20_001
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", None, "", "x\r\n\r\ny", "\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é汉🙂", "<p>a</p>", "z" * 200_000, "\r\n\r\n\r\n\r\n", "end\r\n"]
    rows = [(i + 10, f"http://h/{i}", t, "x") for i, t in enumerate(html)] + [(3, None, "z" * 200_000, None), (None, "http://n\r\n/", "<p>a</p>", None), (16, "http://h/6", "é汉🙂", "x"), (None, None, "only", None)]
    path = str(tmp_path / "rows")
    clashing = "page_id long, url string, html string, digest string, _metadata string, place int, bytes string"
    spark.createDataFrame([(*r, "m", 1, None) for r in rows], clashing).repartition(3).write.parquet(path)
    for least in (0, 5):
        out = str(tmp_path / f"warc{least}")
        warc.write_archives(tuned(spark).read.parquet(path), out, min_bytes=least)
        records = warc.read_archives(spark, out)
        assert records.where("record_type = 'response' and (digest != stated_digest)").count() == 0
        bare = warc.read_archives(spark, out, payloads=False)
        assert bare.where("payload is not null").count() == 0
        got = sorted((tuple(r) for r in warc.resolve_read(bare).collect()), key=str)
        assert got == sorted((tuple(r) for r in warc.resolve_read(records).collect()), key=str)
        want = []
        by = {}
        for p, _, t, _ in rows:
            by.setdefault(t or "", []).append(p)
        for t, ids in by.items():
            payload = t.encode()
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            ids = sorted(ids, key=lambda p: (p is None, p or 0))
            for k, p in enumerate(ids):
                again = k > 0 and len(payload) >= least
                want.append((p, len(payload), digest, "revisit" if again else "response", ids[0] if again else None))
        assert got == sorted(want, key=str)
    warc.write_archives(spark.read.parquet(path).limit(0), str(tmp_path / "none"))
    assert warc.resolve_read(warc.read_archives(spark, str(tmp_path / "none"))).count() == 0
