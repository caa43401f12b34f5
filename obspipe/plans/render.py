"""Evidence rendered from the part table: one template per page shape, with faults by p_partkey."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRICE = "cast(cast(p_retailprice as decimal(18,2)) as string)"


def _evidence(rows: DataFrame, url: str, body: str, source: str, ident: str = "p_partkey") -> DataFrame:
    return rows.select(
        F.expr(f"concat('{source}-', {ident})").alias("evidence_id"), F.expr(url).alias("source_url"), F.expr("timestamp'2026-09-05 00:00:00'").alias("fetched_at"),
        F.lit(200).alias("status_code"), F.lit("text/html; charset=utf-8").alias("content_type"), F.expr(body).alias("body"),
        F.expr(f"sha2({body}, 256)").alias("body_hash"), F.lit(source).alias("source"),
    )


def books(part: DataFrame) -> DataFrame:
    body = f"""concat('<html><body><ul class="breadcrumb"><li><a href="/">Home</a><li><a href="/b">', p_brand, ' </a></li><li class="active">x</ul>',
      '<div class="', if(p_partkey % 11 = 0, 'other', 'page product_main'), '"><h1> ', p_name, ' </h1><p class="price_color">£<b>', {PRICE}, '</b>',
      '<p class="', if(p_partkey % 5 = 0, 'outofstock', 'instock'), ' availability">\n  <i></i>In stock (', p_size, ' available)\n</p></div></body></html>')"""
    return _evidence(part, "concat('https://books.toscrape.com/catalogue/', p_partkey, '/index.html')", body, "books_to_scrape")


def woo(part: DataFrame) -> DataFrame:
    body = f"""concat('<html><body><div class="', if(p_partkey % 13 = 0, 'x', if(p_partkey % 2 = 0, 'summary', 'summary entry-summary')), '"><h1>', p_name, '</h1><p class="price"><span><bdi>£</bdi>', {PRICE},
      '</span></p><p class="stock">', p_size, ' in stock</p><span class="sku_wrapper">SKU: <span class="sku">', p_partkey, '</span></span>',
      '<span class="posted_in"><a>', p_type, '</a>, <a>', p_brand, '</a><a> </a></span></div></body></html>')"""
    return _evidence(part, "concat('https://scrapeme.live/shop/', p_partkey, '/')", body, "scrapeme_live")


def catalogs(part: DataFrame) -> DataFrame:
    """JSON catalogs of a brand's parts, of 1000 part keys each; Brand#1's are cut off, Brand#2's have no array, Brand#3's hold a number."""
    item = f"""concat('{{"id":', if(p_partkey % 7 = 0, cast(p_partkey as string), concat('"p-', p_partkey, '"')), ',"title":"', p_name, '","category":"', p_type,
      '","price":', if(p_partkey % 3 = 0, concat('"', {PRICE}, '"'), {PRICE}), ',"currency":"USD","in_stock":', if(p_size % 2 = 0, 'true', 'false'), '}}')"""
    rows = part.groupBy("p_brand", F.expr("p_partkey div 1000").alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.expr(item).alias("j")))), lambda x: x["j"]), ",").alias("items"))
    body = """case p_brand when 'Brand#1' then '{"products":[' when 'Brand#2' then '{"products":5}'
      when 'Brand#3' then concat('{"products":[', items, ',7]}') else concat('{"meta":{},"products":[', items, ']}') end"""
    return _evidence(rows, "'https://scrapifydatalabs.com/data/products.json'", body, "scrapify_js", "p_brand, '-', page")


def embedded(part: DataFrame) -> DataFrame:
    variant = f"""'{{"color":"Red","size":" ', p_size, '","sku":', if(p_partkey % 4 = 0, 'null', concat('"S-', p_partkey, '"')), ',"inStock":true,"price":', {PRICE}, '}},',
      '{{"color":" ","size":"L","inStock":false,"price":', if(p_partkey % 6 = 0, 'null', '12.5'), '}}'"""
    body = f"""concat('<html><body><pre>{{"id":1}}</pre><pre>{{bad "variants"</pre><pre> {{"id":', p_partkey, ',"title":"', p_name, '","category":"', p_type, '","price":', {PRICE},
      ',"compareAtPrice":', cast(cast(p_retailprice as decimal(18,2)) + 10 as string), ',"sku":"', p_partkey, '","inStock":true,"variants":',
      if(p_partkey % 10 = 0, '{{}}', if(p_partkey % 10 = 1, '[1]', concat('[', {variant}, ']'))), '}}</pre></body></html>')"""
    return _evidence(part, "concat('https://scrapingsandbox.com/product/', p_partkey)", body, "scraping_sandbox")


def observed(part: DataFrame) -> DataFrame:
    """Raw observations with faults, without any page."""
    p = PRICE
    cols = {
        "evidence_id": "cast(p_partkey as string)", "extractor_version": "'synthetic-v1'",
        "source": "case when p_partkey % 17 = 0 then 'other' when p_partkey % 3 = 0 then 'books_to_scrape' when p_partkey % 3 = 1 then 'scrapeme_live' else 'scrapify_js' end",
        "source_url": "case when p_partkey % 9 = 0 then 'https://elsewhere.example/x' when p_partkey % 3 = 0 then concat('HTTPS://books.toscrape.com/A/', p_partkey, '?q#f') when p_partkey % 3 = 1 then 'https://scrapeme.live' else 'https://scrapifydatalabs.com/p.json' end",
        "observed_at": "timestamp'2026-09-05 00:00:00'", "title_raw": "if(p_partkey % 19 = 0, '  ', concat(' ', p_name, ' '))",
        "price_raw": f"case p_partkey % 8 when 0 then concat('£', {p}) when 1 then '- £ 5' when 2 then concat(' $', {p}) when 3 then {p} when 4 then '£1,234.00' when 5 then '5' when 6 then concat('-', {p}) else null end",
        "currency_raw": "case p_partkey % 8 when 3 then 'usd ' when 5 then 'EUR' when 6 then 'GBP' else null end",
        "compare_at_price_raw": "case p_partkey % 6 when 0 then '£99999.5' when 1 then '£1' when 2 then '$9' else null end",
        "availability_raw": "case p_partkey % 5 when 0 then ' OUT of stock ' when 1 then 'In stock' when 2 then concat('In stock (', p_size, ' available)') when 3 then concat(p_size, ' in stock') else ' TRUE ' end",
        "category_raw": "concat(' ', p_type)", "source_record_id_raw": "if(p_partkey % 3 = 2, concat('r', p_partkey), ' ')", "canonical_product_url_raw": "cast(null as string)",
        "sku_raw": "if(p_partkey % 2 = 0, ' ', cast(p_size as string))", "categories_raw": "array(concat(p_brand, ' '), '', p_type, p_brand)",
        "variants_raw": "if(p_partkey % 4 = 0, array(named_struct('sku_raw', ' a ', 'price_raw', '£1', 'availability_raw', 'Out of stock', 'options_raw', array(named_struct('name', 'size', 'value', 'L'))),"
        " named_struct('sku_raw', if(p_partkey % 12 = 0, 'a', ''), 'price_raw', '£2', 'availability_raw', 'nope', 'options_raw', array(named_struct('name', 'size', 'value', 'L'), named_struct('name', 'Color', 'value', ' Pink')))), null)",
    }
    return part.select("p_partkey", *[F.expr(e).alias(c) for c, e in cols.items()])
