import duckdb
import pytest

import __spark_entry__ as contract
from parcelwise.llm import queries

COLUMNS = {
    "op1_line_dedup": "doc_id n_lines n_removed text",
    "op2_repeats": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op3_simhash": "doc_id fingerprint component_id",
    "op4_embedding": "vec_id n_links component_id kept",
    "op5_mixing": "doc_id source block phase release deadline slot position",
    "op6_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op7_toxicity": "doc_id held_out score predicted",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op9_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op10_quality_net": "doc_id held_out score predicted",
    "op11_collocations": "lang rank phrase a l r n score",
    "op12_lexical": "item_id rank doc_id score",
    "op13_maxent": "doc_id held_out n_tokens n_known train_tokens base_score score",
}

# Queries whose rows are phrases or pairs; their own tests compare them with SQL.
OTHER_ROWS = {"op11_collocations", "op12_lexical"}


def test_all_are_registered():
    assert set(queries.registered()) == set(COLUMNS)
    assert {*COLUMNS, "pipeline"} <= set(contract.queries())
    assert set(queries.statements()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_a_row_for_every_row(session, small, name):
    found = contract.queries()[name](session, small)
    source = {"op4_embedding": "embeddings", "op8_warc": "pages"}.get(name, "documents")
    assert found.columns == COLUMNS[name].split()
    if name in OTHER_ROWS:
        return
    assert found.count() == session.read.parquet(f"{small}/{source}.parquet").count()


def test_warc_like_sql(session, small):
    duck = duckdb.connect()
    duck.execute(f"create view pages as select * from '{small}/pages.parquet'")
    sql = queries.statements()["op8_warc"]
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    found = contract.queries()["op8_warc"](session, small)
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)
