"""File loaders (edge rows) and stream = batch equivalence."""

import os

import pytest

from msgscope.sources.files import union_sources


def test_loaders_and_union(spark, tmp_path):
    sms = tmp_path / "sms.csv"
    sms.write_bytes('v1,v2,x\nham,"Caf\xe9 tonight?",1\nspam,"WIN cash\nnow",2\nham,   ,3\n'.encode("latin-1"))
    email = tmp_path / "email.csv"
    email.write_text("text,spam\nhello there,0\nfree money,1\n", encoding="utf-8")
    yt = tmp_path / "yt.csv"
    yt.write_text("AUTHOR,CONTENT\nme,no class column\n", encoding="utf-8")
    rev = tmp_path / "rev.jsonl"
    rev.write_text(
        '{"text": "great product", "label": 0}\n{not json\n{"text": "no label here"}\n{"text": "null label", "label": null}\n'
        '{"text": "buy now", "label": "spam"}\n',
        encoding="utf-8",
    )
    paths = {"sms": str(sms), "email": str(email), "youtube": str(yt), "review": str(rev), "mix_email_sms": str(tmp_path / "missing.csv")}
    rows = sorted((r.source, r.text, r.label) for r in union_sources(spark, paths).collect())
    assert rows == sorted(
        [
            ("sms", "Café tonight?", 0), ("sms", "WIN cash\nnow", 1), ("email", "hello there", 0), ("email", "free money", 1),
            ("review", "great product", 0), ("review", "null label", 0), ("review", "buy now", 1),
        ]
    )


def test_no_source_at_all(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        union_sources(spark, {"sms": str(tmp_path / "nope.csv")})


def test_stream_lockout_equals_batch(spark):
    import __spark_entry__ as E

    q = E.queries()
    d = "/root/testdata/sf0.001"
    cols = ["event_id", "decision", "attempts", "lockout_until_us"]
    b = sorted(tuple(r) for r in q["lockout_fold"](spark, d).select(*cols).collect())
    s = sorted(tuple(r) for r in q["stream_lockout"](spark, d).select(*cols).collect())
    assert b == s and len(b) > 0
    assert {r[1] for r in b} <= {"ok", "failed", "locked"}


def test_entry_smoke(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and set(df.columns) == {"source", "total", "spam", "ham", "spam_rate"}
    overall = [r for r in rows if r.source is None][0]
    assert overall.total == sum(r.total for r in rows if r.source is not None)
