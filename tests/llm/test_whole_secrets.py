"""Secrets behind an equals sign, of one case, and beside what the allow-list knows."""

import random
import string

from tidewater.llm import secrets

SECRET = "q8Zr2LmX0pVt7KdY4sBn9WcE"


def spans(spark, texts):
    got = secrets.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    return [r.spans for r in sorted(got.collect(), key=lambda r: r.doc_id)]


def test_values_behind_an_equals_sign(spark):
    texts = [f"AWS_SECRET_ACCESS_KEY={SECRET}q8Zr2LmX", f"https://h/p?sig={SECRET}&x", f"KEY: {SECRET}", f"MY_OWN_AWS_SECRET_ACCESS_KEY={SECRET}==", f"{SECRET}=1"]
    assert spans(spark, texts) == ["entropy_base64:22:54", "entropy_base64:16:40", "entropy_base64:5:29", "entropy_base64:29:55", "entropy_base64:0:24"]


def test_random_strings_of_one_case(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices(alphabet, k=32)) for alphabet in (string.ascii_lowercase + string.digits, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(20)]
    assert all("entropy_one_case:3:35" in x for x in spans(spark, [f"id {t}." for t in texts]))
    assert spans(spark, ["internationalization internationalization2internationalization2", "ABABABABABABABABABABABAB12121212", "1" * 30]) == ["", "", ""]


def test_allowed_parts_do_not_hide_the_rest(spark):
    got = spans(spark, [f"/home/{SECRET}", f"example{SECRET}", f"{SECRET}xxxxxx", "/home/me/example/placeholder1A", "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGH"])
    assert got == ["entropy_base64:0:30", "entropy_base64:0:31", "entropy_base64:0:30", "", ""]
    x = spark.createDataFrame([(1, f"export AWS_KEY={SECRET}\n")], "doc_id long, text string")
    assert secrets.redacted(x).first().text == "export AWS_KEY=[entropy_base64]\n"
