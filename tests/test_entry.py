import importlib


def test_every_sql_has_its_query_and_the_smoke_query_runs(spark):
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_queries_run_on_the_smallest_tables(spark):
    entry = importlib.import_module("millrace.plans.catalog")
    for name in ("word_stats", "clean_documents", "pii_scan", "categories", "rank_fusion", "stage_durations", "conversation_history", "event_sessions", "pricing_summary"):
        assert entry.queries()[name](spark, "/root/testdata/sf0.001").limit(5).collect() is not None, name
