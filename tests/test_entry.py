"""The driver contract: names, and that SQL exists only for queries that exist."""

import __spark_entry__ as entry


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    own = {q for q in queries if q not in entry.LLM_QUERIES and q != "pipeline"}
    assert {q for q in own if q not in oracles} == {"agent_text", "agent_docs_native", "fix_prompt", "select_questions"}
    assert entry.entry(spark).limit(3).count() == 3
