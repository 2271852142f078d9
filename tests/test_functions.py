from pyspark.sql import functions as F

from docweave.functions import records as R
from docweave.functions import text as T
from docweave.functions import urls as U


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def test_tokens_fold_and_keep_trailing_marks(spark):
    assert one(spark, T.tokens, "Straße end. end a/b:c-d Ünï") == ["strasse", "end.", "end", "a/b:c-d", "ünï"]
    assert one(spark, T.tokens, None) == []


def test_lines_split_like_text_lines(spark):
    for t in ("a\nb\n", "a\r\nb\rc", "", "\n", "x\x0by\x1cz\u2028w", "no end", "a\n\nb"):
        assert one(spark, T.lines, t) == t.splitlines()


def test_titles_do_not_cross_lines(spark):
    df = spark.createDataFrame([("#\nTitle", "a/b.x.md"), ("## two\n  #  One  \n# three", "a/c.md"), ("", ".env")], "c string, p string")
    assert [r[0] for r in df.select(T.markdown_title(F.col("c"), T.file_stem(F.col("p")))).collect()] == ["b.x", "One", ".env"]


def test_canonical_urls(spark):
    cases = {
        " HTTPS://Docs.Example.org:443/a/b/?q=1#top ": "https://docs.example.org/a/b?q=1", "http://x.org": "http://x.org/", "http://x.org:8080//": "http://x.org:8080/",
        "http://Me:pw@X.org/": "http://Me:pw@X.org/", "mailto:a@b": "mailto:a@b",
    }
    for raw, want in cases.items():
        assert one(spark, U.canonicalize_url, raw) == want


def test_destinations(spark):
    assert one(spark, U.destination_for_url, "https://x.org/") == "index.md"
    assert one(spark, U.destination_for_url, "https://x.org/a b/../c.html") == "a-b/index/c.md"
    assert one(spark, U.destination_for_url, "https://x.org/v1.2?x=1").startswith("v1--")


def test_policy_order(spark):
    cases = {
        "ftp://x.org": "invalid_url", "http://a:b@127.0.0.1/": "credentials_in_url", "http://x.org/?client-secret=1": "credentials_in_url", "http://127.0.0.1/": "ssrf_blocked", "http://[::1]/": "ssrf_blocked",
        "http://LOCALHOST/": "ssrf_blocked", "http://8.8.8.8/": "allowed", "http://172.32.0.1/": "allowed", "http://172.16.9.9/": "ssrf_blocked",
    }
    for raw, want in cases.items():
        assert one(spark, U.url_policy, raw) == want


def test_timestamps(spark):
    assert [one(spark, R.timestamp_ms, x) for x in ("01:02", "1:02:03,5", "00:00.25", "x", "99:99:99:99")] == [62_000, 3_723_500, 250, None, None]


def test_time_zone_is_required(spark):
    assert one(spark, R.to_utc, "2024-05-01T10:00:00") is None
    assert str(one(spark, R.to_utc, "2024-05-01T10:00:00+02:00")).startswith("2024-05-01 08:00:00")


def test_canonical_json_sorts_and_skips_volatile_fields(spark):
    got = spark.range(1).select(R.canonical_json({"b": F.lit(1), "a": F.lit(None).cast("string"), "updated_at": F.lit("x")})).first()[0]
    assert got == '{"a":null,"b":1}'
