import pytest
from empty import folder

from confab.llm import queries


@pytest.mark.parametrize("nulls", [False, True])
def test_every_query_takes_empty_tables_and_rows_of_nulls(spark, tmp_path, nulls):
    path, wrong = folder(spark, tmp_path / "t", nulls), []
    for name, query in queries.QUERIES.items():
        try:
            n = len(query(spark, path).collect())
            if not nulls and n:
                wrong.append((name, n))
        except Exception as e:
            wrong.append((name, str(e)[:300]))
    assert not wrong, wrong
