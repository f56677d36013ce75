import importlib.util
import os

import duckdb
import pytest

from thermocline.plans.catalog import QUERIES, SQL
from thermocline.sources.binding import BASE_TABLES
from tools.compare import same

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
WITHOUT_SQL = set()
COMPARED = (
    "float_summary regional_comparison profiles_by_ids system_statistics float_card filter_named_region filter_circle "
    "filter_funnel float_profiles deepest_per_float region_coverage iqr_outliers key_audit explode_profiles "
    "virtual_measurements export_ascii trajectory_endpoints decimate_even sample_whole sample_importance thin_lines "
    "measurement_documents vector_topk_batch detect_intent failure_runs format_columns"
).split()


@pytest.fixture(scope="module")
def duck(folder):
    connection = duckdb.connect()
    for t in BASE_TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", COMPARED)
def test_same_as_sql(spark, duck, folder, name):
    assert same(QUERIES[name](spark, folder).toPandas(), duck.execute(SQL[name]).df()) is None


def test_every_query_has_its_sql():
    assert set(QUERIES) - set(SQL) == WITHOUT_SQL and set(SQL) <= set(QUERIES)


def test_every_sql_runs(duck):
    for name, text in SQL.items():
        assert duck.execute(f"SELECT count(*) FROM ({text})").fetchone()[0] >= 0, name


def test_entry(spark):
    spec = importlib.util.spec_from_file_location("entry", f"{ROOT}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    assert entry.entry(spark).count() == 50
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(SQL)
