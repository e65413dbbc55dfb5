from pyspark.sql import functions as F

from veilmark.functions import text as X
from veilmark.functions import urls


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("r")).first()["r"]


def test_luhn(spark):
    rows = [("4532015112830366", True), ("0000000000000000", False), ("1234567890123456", False), ("4111 1111 1111 1111", True), ("", False), (None, False), ("4" * 30, False)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(X.luhn(F.col("t")).alias("r")).collect()
    assert [r["r"] for r in got] == [b for _, b in rows]


def test_luhn_without_the_repeat_rule(spark):
    assert one(spark, "0000000000000000", lambda c: X.luhn(c, False)) is True


def test_scrub_goldens(spark):
    rows = {
        "4532 0151 1283 0366": "[REDACTED] 0366",
        "4111111111111111": "4111111111111111",
        "Contact admin@defense.gov or +1 (202) 555-0143": "Contact [REDACTED] or [REDACTED]",
        "+44.20.7946.0912 ext. 432": "[REDACTED]",
        "+33 1 42 68 55 55": "+33 1 42 68 55 55",
        "FedEx Tracking: 0123 4567 8901": "FedEx Tracking: [REDACTED]",
        "Serial: 1234-5678-9012-3456": "Serial: [REDACTED]-3456",
        "(415) 555-0199": "([REDACTED]",
        "+91 98765 43210": "[REDACTED]",
        "ü4111-1111-1111-1111": "ü[REDACTED]-1111",
        "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY----- after": "[REDACTED] after",
        "": "",
        "nothing here": "nothing here",
    }
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", X.scrub(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == rows


def test_scrub_null(spark):
    assert one(spark, None, X.scrub) is None


def test_decode_passes(spark):
    rows = {"a%2540b": "a@b", "100%": "100%", "a+b%20c": "a+b c", "%25252540": "%40", "plain": "plain"}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", X.decode3(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] for r in got} == rows


def test_cap(spark):
    assert one(spark, "abcdefghij", lambda c: X.cap(c, 5)) == "ab..."
    assert one(spark, "abcdefghij", lambda c: X.cap(c, 5, "…", False)) == "abcde…"
    assert one(spark, "abc", lambda c: X.cap(c, 5)) == "abc"


def test_sanitised_addresses(spark):
    rows = {
        "https://u:p@x.example/a?token=1&b=2#f": "https://x.example/a?b=2&token=[REDACTED]#f",
        "/search?q=mail@x.example": "/search?q=[REDACTED]",
        "https://x.example/u/4155550199/v": "https://x.example/u/[REDACTED]/v",
        "https://x.example/#access_token=z": "https://x.example/#access_token=[REDACTED]",
        "https://x.example/?token=1&token=2": "https://x.example/?token=[REDACTED]",
        "https://x.example/?a=%2540me%2540x.example%2Fa%2540b.example": "https://x.example/?a=[REDACTED]",
        "": "",
        "/plain": "/plain",
    }
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", urls.sanitize(F.col("t")).alias("r"), urls.is_sensitive(urls.sanitize(F.col("t"))).alias("s")).collect()
    assert {r["t"]: r["r"] for r in got} == rows
    assert not any(r["s"] for r in got)
    assert one(spark, None, urls.sanitize) == ""


def test_sensitive_addresses(spark):
    bad = ["https://u:p@x.example/", "/?session_id=1", "/?a=123-45-6789", "/#x@y.example", "/?page_token=a"]
    good = ["/?keyword=a", "/?token=", "/?token=[REDACTED]", "/a/b?page=2", "https://x.example/"]
    got = spark.createDataFrame([(k,) for k in bad + good], "t string").select("t", urls.is_sensitive(F.col("t")).alias("r")).collect()
    assert {r["t"] for r in got if r["r"]} == set(bad)
