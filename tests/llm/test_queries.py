"""The registered queries: against SQL where there is any, and by their contracts' columns."""

from __future__ import annotations

import pytest

from quernstone.llm import queries

COLUMNS = {
    1: ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    2: ["doc_id", "size", "source_size", "target", "taken"],
    3: ["query_id", "rank", "vec_id", "score"],
    4: ["doc_id", "held_out", "score", "predicted"],
    5: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    6: ["doc_id", "fingerprint", "component_id"],
    8: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    9: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
}


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_query_agrees_with_sql(spark, sf_dir, agrees, name):
    agrees(queries.queries()[name](spark, sf_dir), queries.sql()[name])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_contract_columns(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    wanted = COLUMNS.get(int(name[2:].split("_")[0]), [])
    assert df.columns[: len(wanted)] == wanted


def test_there_is_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
