import __spark_entry__
from vecscore.llm import registry


def test_all_operators_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in registry.queries()}
    assert "pipeline" in names and set(registry.oracle_sql()) <= set(registry.queries())
