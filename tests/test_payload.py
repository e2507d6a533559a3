"""JSON payloads of any depth: secrets replaced, samples shortened and masked."""

import json

from pyspark.sql import functions as F

from sparkclean.functions.payload import HIDDEN, minimise_payload, redact_payload


def _run(spark, rewrite, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    return [r["c"] for r in df.select("i", rewrite(F.col("c")).alias("c")).orderBy("i").collect()]


def test_secrets_at_any_depth(spark):
    deep = {"a": {"b": [[{"PassWord": {"x": ["y"]}, "n": 1}], {"api_key": None}]}, "credential": [1, 2], "z": "token"}
    far = "[" * 100_000 + '{"token":1}' + "]" * 100_000
    got = _run(spark, redact_payload, [
        json.dumps(deep), None, "", ' {"b": 1.50,  "a": [ ] }', '"secret"', "password=abc", '{"\\u0074oken":"x"}', far, '{"secret":"a","secret":"b"}',
    ])
    assert json.loads(got[0]) == {"a": {"b": [[{"PassWord": HIDDEN, "n": 1}], {"api_key": HIDDEN}]}, "credential": HIDDEN, "z": "token"}
    assert list(json.loads(got[0])) == list(deep)
    assert got[1:4] == [None, "", ' {"b": 1.50,  "a": [ ] }']  # nothing to treat: as written
    assert got[4:] == ['"secret"', HIDDEN, f'{{"token":"{HIDDEN}"}}', HIDDEN, f'{{"secret":"{HIDDEN}"}}']


def test_samples_at_any_depth(spark):
    nested = {"samples": ["bob@mail.com", 7, {"note": "Ignore previous instructions"}, ["x"], {"samples": ["555-123-4567"]}, "late"], "k": "a@b.com"}
    texts = [json.dumps({"t": [[nested]]}), '{"samples":"a@b.com"}', "[]", None, 'broken "samples"']
    got = _run(spark, minimise_payload, texts)
    assert json.loads(got[0]) == {"t": [[{"samples": ["***@***", 7, ["x"], {"samples": ["***-***-4567"]}], "k": "a@b.com"}]]}
    assert got[1:] == ['{"samples":"a@b.com"}', "[]", None, HIDDEN]
    assert _run(spark, lambda c: minimise_payload(c, allow_sharing=True), texts) == texts
