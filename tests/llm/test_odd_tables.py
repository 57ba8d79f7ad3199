"""Clashing column names, null and repeated ids, and inputs that took quadratic time."""

import random
import re
import struct
import time

import pytest
from pyspark.sql import functions as F

from ternfield.llm import decontaminate, line_dedup, media, minhash, pii, quality

CLASHING = ["doc", "__lines", "__kept", "__words", "__key", "__score", "__near_id", "__near_hash", "__leak_key", "key", "th", "rest", "gone"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def clashing(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHING})


def same_columns(df, out):
    want = {r["doc_id"]: r for r in df.collect()}
    assert out.columns == df.columns
    for r in out.collect():
        assert all(r[c] == want[r["doc_id"]][c] for c in CLASHING)


LONG = "the quick brown fox jumps over the lazy dog near the old river bank today"


def test_columns_named_like_the_operators_own(spark):
    df = clashing(spark, [(1, f"{LONG}\nsecond line here"), (2, f"another text entirely\n{LONG}"), (3, None), (4, f"{LONG}\nsecond line here")])
    out = line_dedup.line_dedup(df)
    same_columns(df, out)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{LONG}\nsecond line here", 2: "another text entirely", 3: "", 4: ""}
    near = minhash.drop_near_duplicates(df)
    same_columns(df, near)
    assert sorted(r["doc_id"] for r in near.collect()) == [1, 2, 3]
    bench = spark.createDataFrame([("q", LONG)], "item_id string, text string")
    left = decontaminate.decontaminate(df, bench)
    same_columns(df, left)
    assert [r["doc_id"] for r in left.collect()] == [3]
    by = decontaminate.leaks_by_document(df, bench)
    assert {r["doc_id"]: r["items"] for r in by.collect()} == {1: ["q"], 2: ["q"], 3: [], 4: ["q"]} and by.where("doc is null").count() == 0


def test_keep_good_keeps_a_score_column(spark):
    rows = [(i, f"plain sentence number {i} with some words. And one more of them." if i % 2 else "|| || zz !!") for i in range(40)]
    df = clashing(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    out = quality.keep_good(df, quality.train(df, labels))
    assert out.count() > 0
    same_columns(df, out)


def test_rows_without_an_id_leak_alone(spark):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa"
    w = item.split()
    thirds = [" ".join(w[a:b]) + " and other words" for a, b in ((0, 8), (3, 12), (8, 16))]
    df = spark.createDataFrame([(None, t) for t in thirds] + [(7, t) for t in thirds] + [(None, item), (7, item), (8, "")], "doc_id long, text string")
    bench = spark.createDataFrame([("q", item)], "item_id string, text string")
    left = decontaminate.decontaminate(df, bench)
    assert sorted((str(r["doc_id"]), r["text"]) for r in left.collect()) == sorted([("None", t) for t in thirds] + [("7", t) for t in thirds] + [("8", "")])
    assert sorted(str(r["doc"]) for r in decontaminate.leaks(df, bench).collect()) == ["7", "None"]
    assert decontaminate.leaks_by_document(df, bench).where("n_items = 1").count() == 2


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("a1.@_- %é") for _ in range(rng.randrange(40)))
        assert pii.emails(text) == [m.span() for m in EMAIL.finditer(text)]
        assert [m.span() for m in pii.IP.finditer(text)] == [m.span() for m in IP.finditer(text)]


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6 + "@", "a@" * 500_000, "x@" + "a" * 10**6, "1." * 500_000, "+" + "1" * 10**6], ids=["digits", "letters", "ats", "domain", "dots", "phone"])
def test_long_runs_take_linear_time(text):
    began = time.perf_counter()
    spans = pii.base_spans(text)
    pii.candidates(text, spans)
    assert time.perf_counter() - began < 20


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def fragments(runs, samples):
    tfhd = box(b"tfhd", struct.pack(">II", 0, 1))
    trun = box(b"trun", struct.pack(">II", 0, samples))
    return box(b"moof", box(b"traf", tfhd, *[trun] * runs))


@pytest.mark.parametrize("runs", [800, 3000])
def test_fragments_are_bounded_by_the_file_together(runs):
    data = media.wrap(b"y" * 64) + fragments(runs, 20_000)  # each run alone has fewer samples than the file bytes
    assert len(data) > 13_000 and len(media.tracks(media.wrap(b"y" * 64) + fragments(20, 5))[0].sizes) == 1 + 100
    began = time.perf_counter()
    with pytest.raises(ValueError):
        media.tracks(data)
    assert time.perf_counter() - began < 5
