"""Registered queries vs their DuckDB oracles on the smallest fixture tables."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from scripts.check_oracles import TABLES, digest

SF = "/root/testdata/sf0.001"
PICK = ["kv_roundtrip", "json_repair", "csv_roundtrip", "html_roundtrip", "yaml_inline", "type_merge",
        "schema_fields", "version_assign", "group_tables", "q_topk", "schema_tree", "nested_schema_diff", "registry_history",
        "duplicate_upload", "clustered_read", "table_roundtrip", "pipeline_evidence", "file_documents", "stored_result", "example_values",
        "source_schema", "coercion_hints", "field_confidence", "flatten_serialize"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="fixture tables not present")
@pytest.mark.parametrize("name", PICK)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    assert len(sp) == len(dk)
    assert digest(sp) == digest(dk[sp.columns])
