"""Faults that a review found, each with the smallest input that showed it."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as e
from obspipe.operators.html import select_text


def test_references_stay_as_the_sql_has_them(spark, tmp_path):
    titles = ["cut off &amp", "&quot;a&quot; &amp; b &middot; c", "&amp;middot; &#65; &lt", " & plain"]
    html = [f'<nav><a href="/1">{t}</a></nav><article><h1> {t} </h1><ul><li><a href="/2">{t}</a></ul></article><div class="ad">{t}</div>' for t in titles]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = e.queries()["html_select"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    # all_texts is left out: the SQL takes the links of nav too
    want = con.execute(f"select page_id, title_text, first_text, last_text, ad_text from ({e.oracle_sql()['html_select']}) order by 1").fetchall()
    assert [(r.page_id, r.title_text, r.first_text, r.last_text, r.ad_text) for r in found.orderBy("page_id").collect()] == want


def test_references_in_scripts_and_classes(spark):
    body = '<p class="a&amp;b">x &copy y</p><script>if (a && b) "&amp;"</script>'
    rules = {"p": {"select": ["p.a&amp;b", "p.a&b"]}, "code": {"select": ["script"]}}
    kept, read = (spark.createDataFrame([(body,)], "h string").select(select_text(F.col("h"), rules, r).alias("t")).first().t for r in (False, True))
    assert kept == {"p": ["x &copy y"], "code": ['if (a && b) "&amp;"']}
    assert read == {"p": ["x © y"], "code": ['if (a && b) "&amp;"']}


def test_no_link_between_paragraphs_that_meet_is_lost(spark, monkeypatch):
    """Few pivots among many unlike lines of one bucket, in which ten pairs are alike and stand for no pivot."""
    from obspipe.llm import components, substring

    size = 60
    sets = {i: [1000 * (i // 2 if i < 20 else i) + j for j in range(20)] + [10**6 * (i + 1)] for i in range(size)}
    nodes = spark.createDataFrame([(i, b) for i in range(size) for b in (7, 8 + i)], "node long, bucket long")
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    monkeypatch.setattr(substring, "PIVOTS", 1)
    propose = lambda asking, whole: substring.prefix_pairs(asking, table, 0.8) if whole else substring.pivoted(asking)
    found = components.verified_groups(nodes, propose, lambda pairs: components.similar_pairs(pairs, table, 0.8))
    assert sorted((r.node, r.root) for r in found.collect()) == [(i, i - i % 2) for i in range(20)]


def test_no_link_between_near_copies_that_meet_is_lost(spark, monkeypatch):
    """All fingerprints at one anchor and near each other, so that the few first proposals are refuted ones."""
    import numpy as np

    from obspipe.llm import components, similar

    size = 40
    sets = {i: [1000 * (i % 20) + j for j in range(20)] for i in range(size)}
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    nodes = spark.createDataFrame([(i, 0, 0, 0, 0) for i in range(size)], "node long, " + ", ".join(f"{p} long" for p in similar.PRINT))
    propose = lambda asking, whole: similar.proposed(asking, 3, 0, 50, whole)
    found = components.verified_groups(nodes, propose, lambda pairs: components.similar_pairs(pairs, table, 0.8))
    assert sorted((r.node, r.root) for r in found.collect()) == [(i, i % 20) for i in range(size)]
    same = np.zeros(9, np.int64)
    assert sum(len(a) for a, _ in similar.proposals(np.arange(9), same, np.zeros((9, 4), np.uint64), 9, True, 50, None)) == 0


def test_prefixes_have_all_similar_pairs(spark):
    import random

    from obspipe.llm import components, substring

    rng = random.Random(5)
    base = [[rng.randrange(10**6) for _ in range(rng.randrange(1, 40))] for _ in range(12)]
    sets = {i: sorted({x if rng.random() > 0.1 else rng.randrange(10**6) for x in base[i % 12]}) for i in range(240)}
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    asking = spark.createDataFrame([(i, i) for i in sets], "node long, root long")
    pairs = substring.prefix_pairs(asking, table, 0.8)
    found = {(r.a, r.b) for r in components.similar_pairs(pairs, table, 0.8).filter("ok").collect()}
    s = {i: set(x) for i, x in sets.items()}
    want = {(i, j) for i in s for j in s if i < j and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j])}
    assert found == want and len(want) > 100
    assert pairs.count() < 240 * 239 / 12


def test_pages_are_parsed_in_many_tasks(spark):
    for name in ("books_extract", "woo_extract", "embedded_variants"):
        assert e.queries()[name](spark, "/root/testdata/sf0.1").rdd.getNumPartitions() >= 4, name


def test_memo_sends_no_hashes_to_the_driver(spark, tmp_path):
    from obspipe.operators.versions import extract_memo
    from obspipe.plans import render

    pages = render.books(spark.read.parquet("/root/testdata/sf0.001/part.parquet"))
    for _ in range(2):
        found, _ = extract_memo(pages, f"{tmp_path}/memo")
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_stream_makes_no_table_for_a_key(monkeypatch):
    import pandas as pd

    from obspipe.streaming import state

    class Held:
        now = None
        exists = lambda self: self.now is not None
        get = lambda self: self.now
        update = lambda self, now: setattr(self, "now", now)

    monkeypatch.setattr(pd, "concat", None)
    decide = state.Decisions()
    decide.state = Held()
    at = [pd.Timestamp(2026, 1, d) for d in (2, 1, 3)]
    rows = pd.DataFrame({"arrival_seq": [2, 3, 1], "observed_at": at, "state_hash": ["a", "b", None], "is_valid": [True, True, False], "present": True, "state": None})
    found = next(decide.handleInputRows(("s", "k"), iter([rows[:2], rows[2:]]), None))
    assert list(zip(found.arrival_seq, found.decision)) == [(1, "REJECT"), (2, "CREATE"), (3, "STALE")]


def test_near_but_unlike_texts_make_no_row_for_each_pair(spark, monkeypatch):
    """One crowd at few anchors, of fifty pairs of similar texts; all others are near by their fingerprints, but not similar."""
    from obspipe.llm import components, similar

    size, seen = 400, []
    sets = {i: [*range(60), *range(1000 * (i // 2 if i < 100 else i) + 100, 1000 * (i // 2 if i < 100 else i) + 120), 10**7 + i] for i in range(size)}
    table = spark.createDataFrame(list(sets.items()), "node long, shingles array<long>")
    nodes = spark.createDataFrame([(i, 0, 0, 0, 0) for i in range(size)], "node long, " + ", ".join(f"{p} long" for p in similar.PRINT))
    monkeypatch.setattr(similar, "HELD", 5000)  # an anchor's sets are dealt to several shares
    made = components.saved
    monkeypatch.setattr(components, "saved", lambda df, name: seen.append((name, (found := made(df, name)).count())) or found)

    def rest(rooted):
        crosses = made(similar.crossing(rooted, 3, 0, 50), "crosses")
        seen.append(("crosses", crosses.count()))
        return similar.links_at_anchors(rooted, crosses, table, 50, 0.8)

    check = lambda pairs: components.similar_pairs(pairs, table, 0.8)
    found = components.verified_groups(nodes, lambda asking, whole: similar.proposed(asking, 3, 0, 50, whole), check, rest)
    assert sorted((r.node, r.root) for r in found.collect()) == [(i, i - i % 2) for i in range(100)]
    assert max(n for _, n in seen) <= 3 * size


def test_the_near_copy_stage_uses_no_pairs_in_its_second_turn(spark, monkeypatch):
    from obspipe.llm import similar

    asked = []
    pairs = similar.proposed
    monkeypatch.setattr(similar, "proposed", lambda *a: asked.append(a[-1]) or pairs(*a))
    rows = [(i, " ".join(f"w{j if j % 9 else j * 100 + i}" for j in range(60))) for i in range(30)]
    assert similar.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 30
    assert asked == [False]


def test_substring_dedup_deletes_what_it_has_used_and_broadcasts_no_large_side(spark, monkeypatch, tmp_path):
    import os

    from obspipe.llm import substring
    from obspipe.session import shared_dir

    docs = spark.createDataFrame([(i, " ".join(f"w{j if j != 5 else 10**6 + i}" for j in range(60)) + f"\n{'x' * i} a b c d") for i in range(8)], "doc_id long, text string")
    want = sorted(substring.dedup(docs).collect())
    monkeypatch.setattr(substring, "BROADCAST", 3)
    there = set(os.listdir(shared_dir(spark)))
    found = substring.repeats(docs)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {x.split("-")[1] for x in set(os.listdir(shared_dir(spark))) - there} == {"units", "repeated"}
    assert sorted(substring.dedup(docs).collect()) == want and sum(r.repeated for r in want) == 8


def test_scope_is_searched_once_for_a_page(monkeypatch):
    """Rules of one scope share its search; texts stay those of each rule."""
    from obspipe.operators.html import Tree, pick

    asked, select = [], Tree.select
    monkeypatch.setattr(Tree, "select", lambda tree, root, selector: asked.append(selector) or select(tree, root, selector))
    tree = Tree('<div class="other">x</div><div class="main"><h1>a</h1><p>b<p>c</div>')
    rules = {"main": {"of": ["div.main"]}, "title": {"of": ["div.main"], "select": ["h1"]}, "last": {"of": ["div.none", "div.main"], "select": ["p"], "pick": "last"}, "gone": {"of": ["div.none"], "select": ["p"]}}
    assert {k: pick(tree, r) for k, r in rules.items()} == {"main": [""], "title": ["a"], "last": ["c"], "gone": None}
    assert asked.count("div.main") == 1 and asked.count("div.none") == 1
