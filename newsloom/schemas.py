"""Explicit schemas of the event-store tables and of external inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLES = "id string, url string, title string, summary string, full_text string, published_at timestamp, collected_at timestamp, source_name string, source_icon string, source_color string, source_category string, source_tier int, image_url string, analysis string, analyzed_at timestamp, status string, importance int, ai_relevant boolean, rendered_at timestamp, canonical_event_id string"
EVENTS = "event_id string, title string, summary string, first_seen_at timestamp, last_updated_at timestamp, published_at timestamp, canonical_url string, canonical_source string, canonical_article_id string, entity_tags array<string>, event_type string, status string, importance int, cluster_size int, analysis string, rendered_at timestamp, rendered_shift string"
EVIDENCE = "event_id string, article_id string, role string, source_name string, source_tier int, reported_at timestamp, url string, title string"
RUNS = "id bigint, started_at timestamp, finished_at timestamp, items_fetched int, items_new int, items_analyzed int, events_created int, events_updated int, status string"
HEALTH = "name string, status string, last_success timestamp, last_count int, consecutive_failures int, last_error string, avg_response_time double, total_successes int, total_runs int, success_rate double, updated_at timestamp"
SIGNALS = "source string, title string, url string, points int, comments int, upvotes int, likes int, downloads int, stars int, forks int, created_at timestamp, signal_score int"
ITEM = "title string, link string, summary string, published timestamp, image string"
RUN_HEALTH = "run_id string, shift string, duration_sec int, kept int, llm_coverage double, llm_count int, multi_source_count int, important_count int, sources_healthy int, sources_failing int, dead_sources array<string>, deploy_ok boolean"


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of the schema in its order: missing ones are null, others are dropped (additive evolution)."""
    wanted = T.StructType.fromDDL(ddl) if hasattr(T.StructType, "fromDDL") else df.sparkSession.createDataFrame([], ddl).schema
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
