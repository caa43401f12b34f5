"""Runs, as-of joins, snapshots, streams that go on from them, the merged current state, extractor versions and charsets."""

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from obspipe.operators import asof, runs, state
from obspipe.operators.extract import EXTRACTORS, extract
from obspipe.operators.versions import extract_memo, version_differences
from obspipe.plans import render
from obspipe.session import prepared
from obspipe.sources.charset import decoded
from obspipe.sources.evidence import capture_evidence
from obspipe.streaming.current import current_stream, merge_current, read_current
from obspipe.streaming.runs import run_stream
from obspipe.streaming.state import audited, state_stream, stored_state

AT = datetime(2026, 9, 5)
SF = "/root/testdata/sf0.001"
SIGHTED = "source string, identity_key string, observed_at timestamp, arrival_seq long, state_hash string, is_valid boolean, present boolean"


def observed(spark, n=600, keys=12, seed=1, present=0.85):
    """Rows of a few keys and two sources, some late, invalid or without a time."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        at = AT + timedelta(minutes=i - (rnd.randint(0, 40) if rnd.random() < 0.2 else 0))
        rows.append((rnd.choice("st"), f"k{min(int(rnd.expovariate(0.4)), keys)}", None if rnd.random() < 0.02 else at, i, rnd.choice("abc"), rnd.random() > 0.05, rnd.random() < present))
    return spark.createDataFrame(rows, SIGHTED)


def same(a, b):
    assert a.columns == b.columns
    x, y = (sorted(tuple(map(str, r)) for r in df.collect()) for df in (a, b))
    assert x == y and x


@pytest.mark.parametrize("broadcast", [20_000, 0])
def test_marks_before_and_as_of(spark, monkeypatch, broadcast):
    monkeypatch.setattr(asof, "BROADCAST", broadcast)
    rnd = random.Random(broadcast)
    # crowded marks, an outlier, a group of one and one without marks
    marks = [("a", rnd.randint(0, 50), i) for i in range(60)] + [("a", 10**12, 99), ("b", 7, 1), ("c", None, 1)]
    rows = [(g, x) for g in ("a", "b", "c", "d", None) for x in (None, -5, 0, 7, 8, 50, 51, 10**12, 10**13, *[rnd.randint(-3, 60) for _ in range(30)])]
    m, r = spark.createDataFrame(marks, "g string, m long, v int"), spark.createDataFrame(rows, "g string, x long")
    for closed in (True, False):
        got = asof.marks_before(r, "x", m, "m", ("g",), "n", closed)
        assert got.columns == ["g", "x", "n"] and "NestedLoop" not in got._jdf.queryExecution().toString()
        for g, x, n in got.collect():
            assert n == sum(x is not None and k == g and y is not None and (y <= x if closed else y < x) for k, y, _ in marks), (g, x)
    single = m.groupBy("g", "m").agg(F.max("v").alias("v"))
    best = {}
    for g, y, v in single.collect():
        best.setdefault(g, []).append((y, v))
    for g, x, v in asof.as_of(r, "x", single, "m", ("g",), ["v"]).collect():
        had = [(y, w) for y, w in best.get(g, []) if x is not None and y is not None and y <= x]
        assert v == (max(had)[1] if had else None)
    assert asof.marks_before(r, "x", m.limit(0), "m", ("g",), "n").agg(F.sum("n")).first()[0] == 0


def some_runs(spark, n=600, seed=3):
    """Runs of two sources that leave gaps; some are incomplete, one is within a moment."""
    rnd, rows = random.Random(seed), []
    for source in "st":
        at = rnd.randint(0, 20)
        while at < n:
            end = at + rnd.choice([0, 15, 30, 60])
            rows.append((source, f"{source}{at}", at, end, AT + timedelta(minutes=end), rnd.random() < 0.7))
            at = end + rnd.randint(1, 25)
    return spark.createDataFrame(rows, "source string, run_id string, started_seq long, ended_seq long, ended_at timestamp, complete boolean")


def test_runs_equal_each_run_by_itself(spark):
    """The absences of all runs at once decide as those of every run and key, one after the other, would."""
    rows, spans = observed(spark).withColumn("present", F.lit(True)), some_runs(spark)
    every = []
    for r in spans.filter("complete").collect():
        known = rows.filter("is_valid").filter((F.col("source") == r.source) & (F.col("arrival_seq") < r.started_seq)).select("source", "identity_key").distinct()
        seen = rows.filter("is_valid").filter((F.col("arrival_seq") >= r.started_seq) & (F.col("arrival_seq") <= r.ended_seq))
        gone = state.detect_disappearances(known.withColumn("state_hash", F.lit(None).cast("string")), seen, r.ended_at, r.ended_seq)
        every += [(*x[:4], None, True, False, r.run_id) for x in gone.collect()]
    whole = rows.withColumn("run_id", F.lit(None).cast("string")).union(spark.createDataFrame(every, SIGHTED + ", run_id string"))
    want = state.state_transitions(whole).filter("run_id is null or decision = 'DISAPPEARED'")
    got = runs.decided_runs(rows, spans)
    cols = ["source", "identity_key", "arrival_seq", "observed_at", "run_id", "decision", "previous_hash"]
    same(got.select(cols), want.select(cols))
    found = runs.run_absences(rows, spans)
    assert 0 < found.count() < len(every) and not found.join(spans.filter("not complete"), "run_id").count()
    assert runs.run_absences(rows, spans.filter("not complete")).count() == 0 == runs.run_absences(rows.limit(0), spans).count()


def test_runs_that_overlap_fail(spark):
    spans = spark.createDataFrame([("s", "a", 0, 10, AT, True), ("s", "b", 10, 20, AT, True)], "source string, run_id string, started_seq long, ended_seq long, ended_at timestamp, complete boolean")
    with pytest.raises(Exception, match="overlap"):
        runs.run_absences(observed(spark), spans).collect()


def fed(spark, tmp_path, parts, run):
    for part in parts:
        part.write.mode("append").parquet(str(tmp_path / "in"))
        found = run(spark.readStream.schema(part.schema).parquet(str(tmp_path / "in")))
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination(300)
    return spark.read.parquet(str(tmp_path / "out"))


def test_run_stream_equals_batch(spark, tmp_path):
    """Several run ends in one micro-batch, and a restart between micro-batches and within a run."""
    rows, spans = observed(spark, seed=5).withColumn("present", F.lit(True)), some_runs(spark, seed=6)
    ends = spans.select("source", F.col("ended_at").alias("observed_at"), F.col("ended_seq").alias("arrival_seq"), "run_id", "started_seq", "complete")
    every = rows.unionByName(ends, allowMissingColumns=True)
    got = fed(spark, tmp_path, [every.filter("arrival_seq < 211"), every.filter("arrival_seq between 211 and 400"), every.filter("arrival_seq > 400")], lambda s: run_stream(s, 3))
    want = runs.decided_runs(rows, spans.filter(F.col("ended_seq") <= 10**6))
    cols = ["source", "identity_key", "arrival_seq", "observed_at", "run_id", "decision"]
    same(got.select(cols), want.select(cols))


def test_snapshot_goes_on(spark):
    """A snapshot of later rows on an earlier snapshot is that of all, and decisions on it are those of all rows."""
    rows = observed(spark, seed=7).withColumn("state", F.struct("state_hash", F.lit(1.5).cast("decimal(38,18)").alias("price")))
    early, late = rows.filter("arrival_seq < 250"), rows.filter("arrival_seq >= 250")
    for blocks in (None, 3):
        prior = state.snapshot(early, blocks=blocks)
        same(state.snapshot(late, blocks=blocks, prior=prior), state.snapshot(rows))
        same(state.state_transitions(late, blocks=blocks, prior=prior), state.state_transitions(rows).filter("arrival_seq >= 250"))


def test_hot_key_is_split_by_itself(spark, monkeypatch):
    monkeypatch.setattr(state, "HOT", 100)
    rows = observed(spark, seed=8)
    assert state._blocks(rows, ("source", "identity_key"), None) > 1
    same(state.state_transitions(rows), state.state_transitions(rows, blocks=1))


def test_stream_from_snapshot_and_audit(spark, tmp_path):
    """States before and after come from a stream that starts from the batch; its store equals the rebuild, and a planted fault is found."""
    rows = observed(spark, seed=9).withColumn("state", F.struct(F.col("state_hash").alias("kind"), F.lit("1.50").cast("decimal(38,18)").alias("price"), F.array(F.lit("é"), F.lit(None).cast("string")).alias("tags")))
    early, mid, late = rows.filter("arrival_seq < 200"), rows.filter("arrival_seq between 200 and 399"), rows.filter("arrival_seq >= 400")
    state.snapshot(early).write.parquet(str(tmp_path / "start"))
    start = spark.read.parquet(str(tmp_path / "start"))
    got = fed(spark, tmp_path, [mid, late], lambda s: state_stream(s, start))
    want = state.state_transitions(rows).filter("arrival_seq >= 200")
    cols = ["source", "identity_key", "arrival_seq", "observed_at", "state_hash", "decision", "previous_hash", "state", "previous_state"]
    same(got.select(cols), want.select(cols))
    held, rebuilt = stored_state(spark, str(tmp_path / "at")), state.snapshot(rows)
    assert {r.finding for r in audited(held, rebuilt).collect()} == {"equal"}
    broken = rebuilt.withColumn("state_hash", F.when(F.col("identity_key") == "k1", "x").otherwise(F.col("state_hash"))).filter("identity_key <> 'k2'")
    found = {(r.identity_key, r.finding) for r in audited(held, broken).collect() if r.finding != "equal"}
    assert found == {("k1", "differs"), ("k2", "only stored")}


def test_current_state_by_merges(spark, tmp_path):
    """After each batch the table equals the rebuild; files of untouched buckets stay; a repeated batch changes nothing; late rows are STALE."""
    rows, path = observed(spark, seed=10, keys=40), str(tmp_path / "table")
    files = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    for low, high in ((0, 200), (200, 400), (400, 600)):
        merge_current(rows.filter(f"arrival_seq >= {low} and arrival_seq < {high}"), path, 16, decisions=str(tmp_path / f"d{low}"))
        same(read_current(spark, path), state.snapshot(rows.filter(f"arrival_seq < {high}")))
    decided = spark.read.parquet(*[str(tmp_path / f"d{x}") for x in (0, 200, 400)])
    same(decided.select("arrival_seq", "decision", "previous_hash"), state.state_transitions(rows).select("arrival_seq", "decision", "previous_hash"))
    merge_current(rows.filter("arrival_seq >= 400"), path, 16)
    same(read_current(spark, path), state.snapshot(rows))
    before = files()
    late = spark.createDataFrame([("s", "k0", AT - timedelta(days=300), 1000, "old", True, True)], SIGHTED)
    merge_current(late, path, 16, decisions=str(tmp_path / "late"))
    kept = before.keys() & files().keys()
    assert [r.decision for r in spark.read.parquet(str(tmp_path / "late")).collect()] == ["STALE"]
    assert kept and all(files()[p] == before[p] for p in kept) and len({p.parent for p in before.keys() - kept}) == 1
    current_stream(spark.readStream.schema(rows.schema).parquet(_put(rows, tmp_path)), str(tmp_path / "t2"), str(tmp_path / "c2"), 4).awaitTermination(300)
    same(read_current(spark, str(tmp_path / "t2")), state.snapshot(rows))


def _put(rows, tmp_path):
    rows.write.parquet(str(tmp_path / "rows"))
    return str(tmp_path / "rows")


def test_state_as_of_plain(spark):
    rows = observed(spark, seed=11)
    decided = state.state_transitions(rows)
    intervals = state.validity(decided)
    asked = rows.select("source", "identity_key").distinct().withColumn("as_of", F.explode(F.array(*[F.lit(AT + timedelta(minutes=m)) for m in (-5, 0, 100, 333, 599, 10**5)])))
    found = state.state_as_of(asked, intervals)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    changes = decided.filter("decision in ('CREATE', 'UPDATE', 'DISAPPEARED', 'REAPPEARED') and observed_at is not null").orderBy("observed_at", "arrival_seq").collect()
    for r in found.collect():
        own = [c for c in changes if (c.source, c.identity_key) == (r.source, r.identity_key) and c.observed_at <= r.as_of]
        if not own:
            assert (r.present, r.state_hash, r.valid_from) == (None, None, None)
        else:
            gone = own[-1].decision == "DISAPPEARED"
            assert (r.present, r.state_hash) == (not gone, own[-1].previous_hash if gone else own[-1].state_hash)
            assert r.valid_from <= r.as_of and (r.valid_to is None or r.as_of < r.valid_to)


def test_memo_and_versions(spark, tmp_path, monkeypatch):
    part = spark.read.parquet(f"{SF}/part.parquet")
    pages = render.books(part).unionByName(render.embedded(part)).unionByName(render.catalogs(part))
    # the same body at another address is parsed once, and keeps its own address
    moved = pages.withColumns({"evidence_id": F.concat(F.lit("x-"), "evidence_id"), "source_url": F.concat("source_url", F.lit("?again"))})
    want = extract(pages.union(moved))
    found, parsed = extract_memo(pages.union(moved), str(tmp_path / "memo"))
    same(found.select(want.columns), want)
    assert parsed == pages.select("source", "body_hash").distinct().count() < pages.count() + moved.count()
    again, parsed = extract_memo(pages.union(moved), str(tmp_path / "memo"))
    assert parsed == 0
    same(again.select(want.columns), want)
    assert extract_memo(pages.limit(0), str(tmp_path / "none"))[0].columns == want.select(again.columns).columns
    # a version is compared with itself, and with one that changes a variant's price and loses a record
    assert version_differences(extract(pages), extract(pages)).count() == 0
    old = extract(render.embedded(part))
    new = old.withColumn("variants_raw", F.transform("variants_raw", lambda v, i: v.withField("price_raw", F.when(i == 1, F.lit("9.99")).otherwise(v["price_raw"])))).filter("evidence_id <> 'scraping_sandbox-2'")
    diff = version_differences(old, new).collect()
    assert {r.field for r in diff if r.evidence_id != "scraping_sandbox-2"} == {"variants_raw"}
    one = next(r for r in diff if r.field == "variants_raw" and r.evidence_id != "scraping_sandbox-2")
    assert one.new_value.count("price_raw") == 1 and "9.99" in one.new_value
    assert {(r.field, r.new_value) for r in diff if r.evidence_id == "scraping_sandbox-2"} >= {("record", None)}
    assert set(EXTRACTORS) == set(want.select("extractor_version").distinct().toPandas().extractor_version) | {"scrapeme-live-v2"}


def test_charsets(spark):
    """Declared, marked and guessed charsets, and bad bytes, as Python decodes them."""
    prepared(spark)
    rnd = random.Random(4)
    noise = [bytes(rnd.choice([0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xFF, 0xED, 0xA0, 0xC0]) for _ in range(12)) for _ in range(200)]
    rows = [(x, "text/html; charset=UTF-8", x.decode("utf-8", "replace")) for x in noise] + [(x, None, x.decode("utf-8", "replace")) for x in noise]
    every = bytes(range(256))
    rows += [
        (every, "text/html;charset=iso-8859-1", every.decode("latin-1")), (every, 'text/html; charset="Windows-1252"', every.decode("cp1252", "replace")), (every, "x; Charset=us-ascii", every.decode("ascii", "replace")),
        ("é😀".encode("utf-16-le"), "a/b; charset=utf-16le", "é😀"), ("é😀".encode("utf-16"), "a/b; charset=utf-16", "é😀"), ("é".encode("utf-16-be"), "charset=UTF-16BE", "é"),
        (b"\xef\xbb\xbf\xc3\xa9", "text/html", "é"), (b"\xff\xfe\xe9\x00", "", "é"), (b"\xfe\xff\x00\xe9", None, "é"), (b"\xef\xbb\xbfa", "x; charset=utf-8", "﻿a"),
        (b'<META http-equiv="x" content="text/html; charset=latin1">\xe9', "text/html", '<META http-equiv="x" content="text/html; charset=latin1">é'), (b"<meta charset='cp1252'>\x80", None, "<meta charset='cp1252'>€"),
        (b"<meta charset=latin1>\xc3\xa9", "text/html; charset=nonsense", "<meta charset=latin1>Ã©"), (b"<meta charset=utf-16>\xc3\xa9", None, "<meta charset=utf-16>é"), (b"<meta charset=latin1>\xc3\xa9", "text/html; charset=utf8", "<meta charset=latin1>é"),
        (b"", None, ""), (None, None, None), (b"a" * 5000 + b"<meta charset=latin1>\xe9", None, "a" * 5000 + "<meta charset=latin1>�"),
    ]
    df = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, body binary, kind string")
    got = {r.i: r.text for r in df.select("i", decoded(F.col("body"), F.col("kind")).alias("text")).collect()}
    for i, (data, kind, want) in enumerate(rows):
        assert got[i] == want, (data, kind)
    landed = spark.createDataFrame([("u", 200, b"\xe9", "latin-1"), ("u", 200, b"\xc3\xa9", None)], "source_url string, status_code int, body binary, charset string")
    assert [r.body for r in capture_evidence(landed).collect()] == ["é", "é"]
