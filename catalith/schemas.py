"""Logical schemas and fixed column lists of the catalog data model."""

from pyspark.sql import types as T

# Names that the data model prescribes.
ENTITY_FIELDS = (
    "asin title brand product_type manufacturer model_number part_number country_of_origin is_customized best_sellers_rank"
    " original_price current_price buybox_price buybox_shipping is_fba stock_count stock_status delivery_date delivery_time"
    " image_urls bullet_points long_description upc_list ean_list parent_asin variation_asins root_category_id category_ids"
    " category_tree first_available_date package_dimensions package_weight item_dimensions item_weight product_url site"
    " zip_code crawl_time screenshot_path content_hash title_bullets_hash"
).split()
CONTENT_FIELDS = (
    "title brand product_type manufacturer model_number part_number country_of_origin is_customized best_sellers_rank"
    " bullet_points long_description image_urls upc_list ean_list parent_asin variation_asins root_category_id category_ids"
    " category_tree first_available_date package_dimensions package_weight item_dimensions item_weight"
).split()
TITLE_FIELDS = ["title", "bullet_points"]
STATUSES = ["pending", "processing", "done", "failed"]

_TEXT = {name: T.StringType() for name in ENTITY_FIELDS}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_long, _int, _bool, _text, _ts = T.LongType(), T.IntegerType(), T.BooleanType(), T.StringType(), T.TimestampType()

BATCHES = _struct(id=_long, name=_text, needs_screenshot=_bool, is_auto=_bool, created_at=_ts, updated_at=_ts)
BATCH_MEMBERS = _struct(batch_id=_long, asin=_text, is_new=_bool)
TASKS = _struct(id=_long, batch_id=_long, asin=_text, zip_code=_text, status=_text, priority=_int, needs_screenshot=_bool,
                worker_id=_text, lease_epoch=_int, retry_count=_int, error_type=_text, error_detail=_text, created_at=_ts, updated_at=_ts)
CHANGES = _struct(asin=_text, seq=_long, batch_id=_long, change_type=_text, change_detail=_text, prev_value=_text, new_value=_text)
PRODUCT = T.StructType([T.StructField(n, _text) for n in ENTITY_FIELDS if n not in ("screenshot_path", "content_hash", "title_bullets_hash")])
OFFER = _struct(price=_text, shipping=_text, delivery=_text, seller=_text, ships_from=_text, is_fba=_text)
REQUESTS = _struct(worker_id=_text, ts=_ts, latency_s=T.DoubleType(), success=_bool, blocked=_bool, resp_bytes=_long)
SCREENSHOTS = _struct(id=_long, asin=_text, batch_id=_long, status=_text, retry_count=_int, error_detail=_text, file_path=_text, created_at=_ts, updated_at=_ts)
