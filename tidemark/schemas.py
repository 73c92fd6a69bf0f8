"""Table schemas as DDL strings, and additive evolution to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES: dict[str, str] = {
    "market_products": "product_id BIGINT, name STRING, model_number STRING, brand STRING, category STRING, image_url STRING, url STRING, created_at TIMESTAMP, updated_at TIMESTAMP, "
    "volume_7d INT, volume_30d INT, last_volume_check TIMESTAMP, refresh_tier STRING, last_price_refresh TIMESTAMP, scan_priority STRING, next_scan_at TIMESTAMP, last_batch_scan_at TIMESTAMP, "
    "refresh_fail_count INT, last_volume_attempt_at TIMESTAMP, volume_attempt_count INT, next_volume_attempt_at TIMESTAMP, last_volume_error STRING, next_volume_check_at TIMESTAMP",
    "market_prices": "id BIGINT, product_id BIGINT, size STRING, sell_now_price BIGINT, buy_now_price BIGINT, bid_count INT, last_sale_price BIGINT, fetched_at TIMESTAMP",
    "market_volume_snapshots": "id BIGINT, product_id BIGINT, volume_7d INT, volume_30d INT, snapshot_at TIMESTAMP",
    "retail_products": "id BIGINT, source STRING, product_id STRING, name STRING, model_number STRING, brand STRING, url STRING, image_url STRING, created_at TIMESTAMP, updated_at TIMESTAMP",
    "retail_prices": "id BIGINT, source STRING, product_id STRING, size STRING, price BIGINT, original_price BIGINT, in_stock BOOLEAN, discount_type STRING, discount_rate DOUBLE, fetched_at TIMESTAMP",
    "alerts": "id BIGINT, product_id BIGINT, alert_type STRING, best_profit BIGINT, signal STRING, message_id STRING, created_at TIMESTAMP, source STRING, roi DOUBLE, direction STRING, retail_price BIGINT, sell_price BIGINT, size STRING",
    "alert_sent": "id BIGINT, checkpoint_id BIGINT, product_id BIGINT, signal STRING, fired_at TIMESTAMP",
    "alert_followup": "id BIGINT, alert_id BIGINT, fired_at TIMESTAMP, product_id BIGINT, size STRING, retail_price BIGINT, sell_price_at_fire BIGINT, checked_at TIMESTAMP, actual_sold BOOLEAN, actual_price BIGINT",
    "events": "id BIGINT, event_type STRING, payload STRING, created_at TIMESTAMP, consumed_at TIMESTAMP, consumer STRING, status STRING, attempts INT, last_reason STRING",
    "decisions": "id BIGINT, ts TIMESTAMP, stage STRING, decision STRING, reason STRING, source STRING, product_id BIGINT, model_no STRING, extra STRING",
    "candidate_dedup": "product_id BIGINT, retail_price BIGINT, last_processed_at TIMESTAMP, last_outcome STRING, last_source STRING",
    "collect_queue": "model_number STRING, brand_hint STRING, name_hint STRING, source STRING, source_url STRING, status STRING, attempts INT, found_product_id STRING, added_at TIMESTAMP, last_attempt_at TIMESTAMP, "
    "canonical_model_key STRING, next_search_at TIMESTAMP, dormant BOOLEAN, last_search_at TIMESTAMP",
    "catalog_items": "source STRING, model_no STRING, name STRING, url STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, seen_count INT",
    "catalog_runs": "id BIGINT, source STRING, product_count INT, finished_at TIMESTAMP",
    "heartbeat": "source STRING, last_emit_at TIMESTAMP, emit_count INT",
    "api_calls": "id BIGINT, ts TIMESTAMP, endpoint STRING, method STRING, status INT, latency_ms INT, purpose STRING, token_id BIGINT",
    "send_tokens": "id BIGINT, reserved_at TIMESTAMP, purpose STRING, endpoint STRING, status STRING, settled_at TIMESTAMP",
    "snapshot_hash": "product_id BIGINT, hash STRING, updated_at TIMESTAMP",
    "coupon_catches": "id BIGINT, sourcing STRING, native_id STRING, color_code STRING, size_code STRING, page_type STRING, payload STRING, captured_at TIMESTAMP",
    "scan_history": "goods_no STRING, category STRING, brand STRING, goods_name STRING, model_number STRING, matched BOOLEAN, product_id STRING, price BIGINT, scanned_at TIMESTAMP",
    "scan_progress": "category STRING, last_scanned_page INT, total_items_scanned BIGINT, last_scan_at TIMESTAMP",
}

SIZE_PROFIT = "STRUCT<size: STRING, sell_price: BIGINT, net_profit: BIGINT, roi: DOUBLE>"
STOCK = "STRUCT<state: STRING, available_sizes: ARRAY<STRING>, observed_at: DOUBLE, expires_at: DOUBLE, evidence_method: STRING, reason_code: STRING>"
#: Payload of each event type.
EVENTS: dict[str, str] = {
    "CatalogDumped": "source STRING, product_count INT, dumped_at DOUBLE",
    "CandidateMatched": f"source STRING, product_id BIGINT, model_no STRING, retail_price BIGINT, size STRING, url STRING, available_sizes ARRAY<STRING>, color_name STRING, source_stock {STOCK}",
    "ProfitFound": "source STRING, product_id BIGINT, model_no STRING, size STRING, retail_price BIGINT, sell_price BIGINT, net_profit BIGINT, roi DOUBLE, signal STRING, volume_7d INT, url STRING, "
    f"size_profits ARRAY<{SIZE_PROFIT}>, color_name STRING, catch_applied BOOLEAN, original_retail BIGINT, source_stock_expires_at DOUBLE",
    "AlertSent": "alert_id BIGINT, product_id BIGINT, signal STRING, fired_at DOUBLE",
    "AlertFollowup": "alert_id BIGINT, checked_at DOUBLE",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def conform(df: DataFrame, table: str) -> DataFrame:
    """The table's columns in order: missing ones null, others cast (bad values null) and extra ones dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema(table).fields
    ])
