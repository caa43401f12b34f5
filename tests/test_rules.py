"""Rules of extraction, normalisation, validation and state on small hand-made rows."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from obspipe.functions.text import canonical_url, parse_availability, parse_price, py_strip, url_host
from obspipe.operators import state
from obspipe.operators.extract import extract, extraction_failures, observations
from obspipe.operators.normalize import normalize
from obspipe.operators.validate import split_valid, validate
from obspipe.schemas import EVIDENCE, NORMALIZED
from obspipe.sources.evidence import capture_evidence, read_evidence
from obspipe.sources.lookup import route_source
from obspipe.sources.outputs import TABLES, stream_outputs, write_outputs

AT = datetime(2026, 9, 4, 12)


def column(spark, values, f, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return [r[0] for r in spark.createDataFrame(rows, f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_text(spark):
    assert column(spark, ["　 a\x1c", "\x85", "", None], py_strip) == ["a", "", "", None]
    urls = ["HTTP://U@H:80/a?q#f", "http://h", "http://h?x", "ftp://h/", "//h/x", "http:///x", "", None, " https://A.b/C/../d%20 "]
    assert column(spark, urls, canonical_url) == ["http://u@h:80/a", "http://h/", "http://h/", None, None, None, None, None, "https://a.b/C/../d%20"]
    hosts = ["https://User:p@EX_ample.com:8/a", "//h/x", "mailto:a", "http://[2001:DB8::1]:80/", "http://\n h", None]
    assert column(spark, hosts, url_host)[:4] == ["ex_ample.com", "h", None, "2001:db8::1"]


@pytest.mark.parametrize("raw,currency,amount,found", [
    ("-£5", None, -5, "GBP"), ("£ 5", None, 5, "GBP"), ("£-5", None, None, None), ("£1,234.00", None, None, None), (".5", "USD", None, None),
    ("5.", "USD", None, None), ("+5", "USD", None, None), ("1e3", "USD", None, None), ("5", None, None, None), ("5", "usd ", 5, "USD"), ("£5", "USD", 5, "GBP"),
    ("5", "EUR", None, None), ("٣", "USD", 3, "USD"), ("$12345678.5", None, Decimal("12345678.5"), "USD"), (None, "USD", None, None), ("", "USD", None, None),
])
def test_price(spark, raw, currency, amount, found):
    row = spark.createDataFrame([(raw, currency)], "raw string, c string").select(parse_price(F.col("raw"), F.col("c")).alias("p")).first().p
    assert (row.amount, row.currency) == (amount, found)


@pytest.mark.parametrize("source,raw,want", [
    ("x", "OUT OF STOCK", ("OUT_OF_STOCK", 0)), ("books_to_scrape", "in stock", ("IN_STOCK", None)), ("books_to_scrape", " In stock (22 available)", ("IN_STOCK", 22)),
    ("scrapeme_live", "In stock", (None, None)), ("scrapeme_live", "0 in stock", ("IN_STOCK", 0)), ("scrapify_js", " TRUE ", ("IN_STOCK", None)),
    ("scraping_sandbox", "false", ("OUT_OF_STOCK", None)), ("web_scraping_dev", "true", (None, None)), ("books_to_scrape", None, (None, None)),
])
def test_availability(spark, source, raw, want):
    row = spark.createDataFrame([(source, raw)], "s string, r string").select(parse_availability(F.col("s"), F.col("r")).alias("a")).first().a
    assert tuple(row) == want


def page(source, url, body):
    return (f"e-{source}", url, AT, 200, "text/html", body, "", source)


def extracted(spark, *pages):
    return extract(spark.createDataFrame(list(pages), EVIDENCE + ", source string"))


def test_html_extractors(spark):
    book = '<ul class="breadcrumb"><li><a>Home</a><li><a>Books</a><li><a>Poetry</a><li class="active">A</ul><div class="product_main"><h1>Tea for a Walrus</h1><p class="price_color">£51.77<p class="instock availability">\n In stock (22 available)\n</div>'
    shop = '<div class="summary entry-summary"><h1 class="product_title">Brass Kettle</h1><p class="price"><del>£20</del> <ins>£15</ins></p><p class="stock">31 in stock</p><span class="sku">8840</span><span class="posted_in"><a>Kitchen</a><a>Metal</a></span></div>'
    rows = observations(extracted(spark, page("books_to_scrape", "https://books.toscrape.com/x", book), page("scrapeme_live", "https://scrapeme.live/y", shop)))
    got = {r.source: r for r in rows.collect()}
    b, w = got["books_to_scrape"], got["scrapeme_live"]
    assert (b.title_raw, b.price_raw, b.availability_raw, b.category_raw, b.categories_raw) == ("Tea for a Walrus", "£51.77", "In stock (22 available)", "Poetry", [])
    assert (w.price_raw, w.category_raw, w.categories_raw, w.sku_raw) == ("£20 £15", None, ["Kitchen", "Metal"], "8840")
    n = {r.source: r for r in validate(normalize(rows)).collect()}
    assert n["books_to_scrape"].is_valid and n["books_to_scrape"].identity_key == "url:https://books.toscrape.com/x" and n["books_to_scrape"].quantity == 22
    assert n["scrapeme_live"].errors == ["MISSING_PRICE", "MISSING_CURRENCY"]


def test_json_extractors(spark):
    url = "https://scrapifydatalabs.com/data/products.json"
    cases = ["{bad", "[]", '{"products":5}', '{"products":[{},2,3]}', '{"products":[]}', None,
             '{"products":[{"id":7,"title":5,"in_stock":"true","price":"12.50"},{"id":"p","price":1e2,"in_stock":false,"currency":"USD"},{"price":12345678.5}]}']
    rows = extracted(spark, *[page("scrapify_js", url, b) for b in cases])
    assert sorted(r.error_code for r in extraction_failures(rows).collect()) == ["INVALID_JSON", "INVALID_JSON", "INVALID_PRODUCT_RECORD:1", "PRODUCTS_ARRAY_NOT_FOUND", "PRODUCTS_ARRAY_NOT_FOUND"]
    got = [(r.source_record_id_raw, r.title_raw, r.availability_raw, r.price_raw) for r in observations(rows).collect()]
    assert sorted(got, key=str) == sorted([(None, None, None, "12.50"), ("p", None, "false", "100"), (None, None, None, "12345678.5")], key=str)
    box = lambda j: page("scraping_sandbox", "https://scrapingsandbox.com/product/1", f"<pre>x</pre><pre>{j}</pre>")
    rows = extracted(spark, box('{"id":true,"title":null,"variants":[]}'), box('{"id":1,"title":"a","variants":{}}'), box('{"id":1,"title":"a","variants":[1]}'), box('{"title":"a","variants":[]}'))
    assert sorted(r.error_code for r in extraction_failures(rows).collect()) == ["PRODUCT_JSON_NOT_FOUND", "VARIANTS_NOT_LIST", "VARIANT_NOT_OBJECT"]
    assert [r.source_record_id_raw for r in observations(rows).collect()] == [None]


def test_deep_and_unreadable_pages(spark):
    deep = "<div>" * 100_000 + '<div class="product_main"><h1>deep</h1>' + "<span>" * 50_000
    pages = [page("books_to_scrape", "https://books.toscrape.com/x", body) for body in (deep, "<![unknown[" + deep, "</p>" * 100_000, None)]
    rows = extracted(spark, *pages)
    assert [r.title_raw for r in observations(rows).collect()] == ["deep"]
    assert [r.error_code for r in extraction_failures(rows).collect()] == ["PRODUCT_MAIN_NOT_FOUND"] * 3


def test_nested_selection(spark):
    rules = {"inner": {"of": ["div.a"], "select": ["div.b p", "p"], "pick": "all"}, "skip": {"select": ["ul li a"], "pick": "all"}, "none": {"of": ["nav"], "select": ["p"]}}
    body = '<div class="a"><p>1<div class="b x"><div><p>2 <b>3</b><script>no</script></div><p>4</div></div><p>5</p><ul><li><a>6</a><li><b><a>7</a></b></ul><ol><li><a>8</a></ol>'
    from obspipe.operators.html import select_text

    found = spark.createDataFrame([(body,)], "h string").select(select_text(F.col("h"), rules).alias("t")).first().t
    assert found == {"inner": ["2 3", "4"], "skip": ["6", "7"], "none": None}


def test_repeated_keys_take_the_last(spark):
    """Without any setting of the session."""
    spark.conf.unset("spark.sql.variant.allowDuplicateKeys")
    url = "https://scrapifydatalabs.com/data/products.json"
    body = '{"products":[],"products":[{"id":"a","id":"b","title":"t","price":1,"price":2}]}'
    pre = page("scraping_sandbox", "https://scrapingsandbox.com/product/1", '<pre>{"id":1,"id":2,"title":"t","title":"u","variants":[]}</pre>')
    got = {r.source: r for r in observations(extracted(spark, page("scrapify_js", url, body), pre)).collect()}
    assert (got["scrapify_js"].source_record_id_raw, got["scrapify_js"].price_raw) == ("b", "2")
    assert (got["scraping_sandbox"].source_record_id_raw, got["scraping_sandbox"].title_raw) == ("2", "u")


def test_json_is_parsed_once(spark):
    """One parse of each page in the whole plan, also below the filter on failures, and one reading of prices."""
    rows = extract(spark.createDataFrame([page("scraping_sandbox", "u", "")], EVIDENCE + ", source string"), ["scraping-sandbox-json-v1"])
    plan = validate(normalize(observations(rows)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1


def test_numbers_in_json(spark):
    """Plain digits without an exponent; where numbers are binary, those that would need one are null."""
    url = "https://scrapifydatalabs.com/data/products.json"
    numbers = ["1e2", "1E-5", "12.50", "1e16", "123456789012345678", "0.00001", "-0.5", "true", "null", '"7,5"', "[1]"]
    rows = extracted(spark, page("scrapify_js", url, '{"products":[' + ",".join(f'{{"price":{n}}}' for n in numbers) + "]}"))
    assert [r.price_raw for r in observations(rows).collect()] == ["100", "0.00001", "12.5", "10000000000000000", "123456789012345678", "0.00001", "-0.5", None, None, "7,5", None]
    pages = [page("scraping_sandbox", "https://scrapingsandbox.com/product/1", f'<pre>{{"id":{i},"title":"t","price":{n},"variants":[]}}</pre>') for i, n in enumerate(numbers)]
    got = {r.source_record_id_raw: r.price_raw for r in observations(extracted(spark, *pages)).collect()}
    assert [got[str(i)] for i in range(len(numbers))] == ["100", None, "12.5", None, "123456789012345678", None, "-0.5", None, None, "7,5", None]


def valid_row(**change):
    row = dict(evidence_id="e", extractor_version="v", source="books_to_scrape", source_url="https://books.toscrape.com/x", canonical_product_url="https://books.toscrape.com/x",
               source_record_id=None, observed_at=AT, title="t", price=Decimal(10), compare_at_price=None, currency="GBP", availability="IN_STOCK", quantity=3, category=None, sku=None, categories=[], variants=[])
    return tuple((row | change).values())


def test_validation(spark):
    v = lambda key, price=1, stock="IN_STOCK": (key, None, [], None if price is None else Decimal(price), stock)
    cases = [
        (valid_row(), []), (valid_row(compare_at_price=Decimal(10)), []), (valid_row(compare_at_price=Decimal(9)), ["COMPARE_AT_BELOW_PRICE"]),
        (valid_row(price=Decimal(-1), compare_at_price=Decimal(-2), quantity=-1), ["NEGATIVE_PRICE", "NEGATIVE_COMPARE_AT_PRICE", "NEGATIVE_QUANTITY"]),
        (valid_row(availability="OUT_OF_STOCK", quantity=2), ["INCONSISTENT_AVAILABILITY_QUANTITY"]),
        (valid_row(source="other_source"), ["UNKNOWN_SOURCE", "MISSING_IDENTITY", "INVALID_CANONICAL_URL"]),
        (valid_row(title=None, price=None, currency=None, availability=None, quantity=None, source="z", canonical_product_url="x"),
         ["MISSING_TITLE", "MISSING_PRICE", "MISSING_CURRENCY", "UNKNOWN_AVAILABILITY", "UNKNOWN_SOURCE", "MISSING_IDENTITY", "INVALID_CANONICAL_URL"]),
        (valid_row(variants=[v(None), v("k1"), v("k1"), v("k2", -1), v("k3", 1, None)]), ["MISSING_VARIANT_IDENTITY", "DUPLICATE_VARIANT_IDENTITY", "INVALID_VARIANT_PRICE", "INVALID_VARIANT_AVAILABILITY"]),
    ]
    rows = [(*c[:0], f"{i:02}", *c[1:]) for i, (c, _) in enumerate(cases)]
    got = validate(spark.createDataFrame(rows, NORMALIZED))
    assert [r.errors for r in got.orderBy("evidence_id").collect()] == [w for _, w in cases]
    accepted, rejected = split_valid(got)
    assert (accepted.count(), rejected.count()) == (2, 6)


def test_capture_route_and_files(spark, tmp_path):
    rows = [("", "https://books.toscrape.com/a", 503, None, "é"), ("x", "https://example.com/b", 200, "text/html", "é")]
    got = capture_evidence(spark.createDataFrame(rows, "evidence_id string, source_url string, status_code int, content_type string, body string"))
    a, b = got.orderBy("source_url").collect()
    assert a.body_hash == b.body_hash and len(a.evidence_id) == 64 and a.content_type == "" and a.status_code == 503
    routed = route_source(got)
    assert {r.source for r in routed.collect()} == {"books_to_scrape", None}
    with pytest.raises(Exception, match="unsupported source"):
        route_source(got, on_unknown="fail").collect()
    got.write.parquet(str(tmp_path / "e"))
    assert read_evidence(spark, str(tmp_path / "e")).count() == 2
    (tmp_path / "p.html").write_text("<h1>é</h1>")
    assert read_evidence(spark, str(tmp_path / "p.html"), "text").first().body == "<h1>é</h1>"


def test_stream_equals_batch(spark, tmp_path):
    from obspipe.plans import render

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    render.books(part).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    chain = lambda df: validate(normalize(observations(extract(df, ["books-to-scrape-v1"]))))
    query = chain(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = chain(spark.read.parquet(str(tmp_path / "in")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == batch.count() and got.select("evidence_id", "errors").exceptAll(batch.select("evidence_id", "errors")).count() == 0
    found = extract(spark.read.parquet(str(tmp_path / "in")), ["books-to-scrape-v1"])
    write_outputs(found, str(tmp_path / "tables"))
    assert spark.read.parquet(str(tmp_path / "tables/accepted")).count() == batch.filter("is_valid").count()
    stream = extract(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["books-to-scrape-v1"])
    stream_outputs(stream, str(tmp_path / "streamed"), str(tmp_path / "c2")).awaitTermination(120)
    for name in TABLES:
        one, other = (spark.read.parquet(str(tmp_path / d / name)).drop("batch") for d in ("tables", "streamed"))
        assert one.count() == other.count() > 0 and one.select("evidence_id").exceptAll(other.select("evidence_id")).isEmpty()
    write_outputs(found, str(tmp_path / "streamed"), "overwrite", "batch=0")  # a batch that comes again replaces itself
    assert spark.read.parquet(str(tmp_path / "streamed/accepted")).count() == batch.filter("is_valid").count()


def sightings(spark):
    rows = [("s", "k", AT.replace(hour=h), i, x) for i, (h, x) in enumerate([(1, "a"), (2, "a"), (4, "b"), (3, "c"), (4, "b"), (5, "a")])]
    return spark.createDataFrame(rows, "source string, identity_key string, observed_at timestamp, arrival_seq long, state_hash string")


WANT = ["CREATE", "NO_CHANGE", "UPDATE", "STALE", "NO_CHANGE", "UPDATE"]


def test_state(spark):
    got = state.state_transitions(sightings(spark))
    assert [r.decision for r in got.orderBy("arrival_seq").collect()] == WANT
    now = state.current_state(got).first()
    assert (now.state_hash, now.updated_at.hour) == ("a", 5)
    gone = state.detect_disappearances(state.current_state(got), sightings(spark).limit(0), datetime(2026, 9, 5), 9)
    again = sightings(spark).limit(1).withColumn("arrival_seq", F.lit(10).cast("long")).withColumn("observed_at", F.lit(datetime(2026, 9, 6)))
    rows = sightings(spark).withColumn("present", F.lit(True)).unionByName(gone).unionByName(again.withColumn("present", F.lit(True)))
    assert [r.decision for r in state.state_transitions(rows).orderBy("arrival_seq").collect()][-2:] == ["DISAPPEARED", "REAPPEARED"]


def test_keys_split_into_blocks(spark):
    """A key that is split by arrival decides as a whole one, with absences, late and invalid rows."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = e.select(F.lit("s").alias("source"), F.when(F.col("user_id") % 3 == 0, None).when(F.col("user_id") % 2 == 0, "hot").otherwise(F.col("user_id").cast("string")).alias("identity_key"), F.col("ts").alias("observed_at"),
                    F.expr("event_id + (event_id * 37) % 500").alias("arrival_seq"), F.col("event_type").alias("state_hash"), (F.col("event_type") != "error").alias("present"), (F.col("event_id") % 29 != 0).alias("is_valid"))
    rows = rows.dropDuplicates(["arrival_seq"])
    whole, split = (sorted(map(str, state.state_transitions(rows, blocks=n).collect())) for n in (1, 7))
    assert whole == split and len(whole) > 100


def test_history_and_transitions_have_states(spark):
    price = lambda p, at, **change: valid_row(price=None if p is None else Decimal(p), observed_at=AT.replace(hour=at), **change)
    rows = [price(1, 1), price(1, 2), price(3, 4), price(2, 3), price(None, 5), price(5, 6, title="")]
    seen = validate(spark.createDataFrame(rows, NORMALIZED)).withColumn("n", F.monotonically_increasing_id()).coalesce(1)
    got = state.transition_rows(seen, F.col("n")).orderBy("arrival_seq").collect()
    told = [(r.decision, r.validation_errors, r.previous_state and r.previous_state.price, r.new_state and r.new_state.price) for r in got]
    assert told == [("CREATE", [], None, 1), ("NO_CHANGE", [], 1, 1), ("UPDATE", [], 1, 3), ("STALE", [], None, None), ("REJECT", ["MISSING_PRICE"], None, None), ("REJECT", ["MISSING_TITLE"], None, None)]
    rows = state.with_state_hash(seen).withColumnRenamed("n", "arrival_seq").filter("is_valid")
    now = state.current_state(state.state_transitions(rows))
    gone = state.detect_disappearances(now, rows.limit(0), datetime(2026, 9, 6), 1 << 50).withColumn("is_valid", F.lit(True))
    every = rows.withColumn("present", F.lit(True)).unionByName(gone, allowMissingColumns=True)
    changes = state.history(state.state_transitions(every)).orderBy("arrival_seq").collect()
    assert [(r.decision, r.previous_state and r.previous_state.price, r.new_state and r.new_state.price) for r in changes] == [("CREATE", None, 1), ("UPDATE", 1, 3), ("DISAPPEARED", 3, None)]
    assert all(r.new_hash == (None if r.decision == "DISAPPEARED" else r.state_hash) for r in changes)


def test_state_stream(spark, tmp_path):
    from obspipe.streaming.state import state_stream

    sightings(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = state_stream(spark.readStream.schema(sightings(spark).schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert [r.decision for r in spark.read.parquet(str(tmp_path / "out")).orderBy("arrival_seq").collect()] == WANT


def test_state_stream_equals_batch(spark, tmp_path):
    """Absences, invalid and late rows over two micro-batches decide as in the batch."""
    from obspipe.streaming.state import state_stream

    flags = [(1, "a", True, True), (2, "bad", False, True), (3, "a", True, False), (4, "a", True, False), (2, "z", True, True), (5, "a", True, True), (6, "b", True, True), (7, "b", True, False), (8, "c", True, True), (3, "x", False, True)]
    rows = [("s", "k", AT.replace(hour=h), i, *x) for i, (h, *x) in enumerate(flags)] + [("s", "gone", AT, 20, "q", True, False), ("s", "gone", AT, 21, "q", True, True), ("s", "bad", AT, 22, "q", False, True)]
    table = spark.createDataFrame(rows, "source string, identity_key string, observed_at timestamp, arrival_seq long, state_hash string, is_valid boolean, present boolean")
    for part in ("arrival_seq in (0, 1, 2, 3, 20)", "arrival_seq not in (0, 1, 2, 3, 20)"):
        table.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = state_stream(spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    decided = lambda df: [tuple(r) for r in df.select("identity_key", "arrival_seq", "observed_at", "state_hash", "decision").orderBy("arrival_seq").collect()]
    got = decided(spark.read.parquet(str(tmp_path / "out")))
    assert got == decided(state.state_transitions(table)) and {"DISAPPEARED", "REAPPEARED", "REJECT", "STALE"} <= {x[-1] for x in got}
