"""Table schemas of every step."""

OPTIONS = "array<struct<name:string,value:string>>"
MONEY = "decimal(38,18)"
EVIDENCE = "evidence_id string, source_url string, fetched_at timestamp, status_code int, content_type string, body string, body_hash string"
VARIANTS_RAW = f"array<struct<sku_raw:string,price_raw:string,availability_raw:string,options_raw:{OPTIONS}>>"
RAW_FIELDS = ("title_raw", "price_raw", "availability_raw", "category_raw", "currency_raw", "source_record_id_raw", "canonical_product_url_raw", "compare_at_price_raw", "sku_raw")
LINEAGE = ("evidence_id", "extractor_version", "source", "source_url", "observed_at")
OBSERVATION = (
    "evidence_id string, extractor_version string, source string, source_url string, observed_at timestamp, "
    + ", ".join(f"{f} string" for f in RAW_FIELDS)
    + f", categories_raw array<string>, variants_raw {VARIANTS_RAW}"
)
VARIANTS = f"array<struct<key:string,sku:string,options:{OPTIONS},price:{MONEY},availability:string>>"
NORMALIZED = (
    "evidence_id string, extractor_version string, source string, source_url string, canonical_product_url string, "
    "source_record_id string, observed_at timestamp, title string, "
    f"price {MONEY}, compare_at_price {MONEY}, currency string, availability string, quantity bigint, category string, sku string, "
    f"categories array<string>, variants {VARIANTS}"
)
FAILURE = "evidence_id string, extractor_version string, source string, source_url string, error_code string"
