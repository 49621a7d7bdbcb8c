"""Registered queries of the subpackage against their SQL on the smallest tables."""

import os

import pytest

from checks.compare import compare, duck
from fleetlint.llm.queries import QUERIES
from fleetlint.llm.sql import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    ok, _, why = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, why


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_secrets_sql_measures_gaps(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    jwt = "eyJ" + "a1B2" * 250
    texts = [f"token={jwt}\nuser=bob host=db.example.com", "https://" + "x" * 400 + ".example.com/path pwd=abc123 login=al",
             f"user=carol {'z ' * 200} password=hunter22", f"api_key={jwt[:40]} " + "w " * 149 + "account=dave",
             "client_id=abc " + "q" * 310 + " secret=shorty1", None, ""]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}),
                   tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    ok, n, why = compare(spark, con, "op9_secrets", QUERIES["op9_secrets"], ORACLES["op9_secrets"], str(tmp_path))
    assert ok and n == len(texts), why
    spans = {r.doc_id: r.spans for r in QUERIES["op9_secrets"](spark, str(tmp_path)).collect()}
    assert "ident" in spans[0] and "endpoint" in spans[0]
