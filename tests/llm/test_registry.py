from shelfspark.llm.queries import ORACLE, QUERIES


def test_every_operator_has_one_query():
    numbers = [int(k[2:].split("_")[0]) for k in QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert set(ORACLE) <= set(QUERIES)
    assert all(isinstance(v, str) for v in ORACLE.values()) and all(callable(v) for v in QUERIES.values())
