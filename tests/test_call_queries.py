"""Queries on calls against their SQL where blanks, letters and word ends are unlike ASCII's."""

import duckdb
import pytest

from tidemark.plans import catalogue

from .test_queries import rows

TEXTS = (
    "Hié was said by us all here today. Risqué may be one word of many for us",  # \b beside an accented letter, no-break spaces
    "Il mayé be one two three four five. The riſk is here for all of us", "OK we go on to the next one",  # long s, kelvin sign
    "One two three\x0bfour five six. One two three four five six", "one two three.\x0bFour five six seven eight nine ten", "one two three four five six\x1fseven eight nine ten eleven twelve",
    "  One two three four five six  ", "thank you for that one more time ", "The next question is for you all", "The firſt question is for you all", "", None,
)


@pytest.mark.parametrize("name", ["call_features", "role_section", "sentences_flags"])
def test_odd_texts_equal_sql(spark, tmp_path, name):
    roles = ("system", "user", "assistant")
    data = [(c, t, roles[(t + c) % 3] if t + c < 20 else None, TEXTS[(t + 5 * c) % len(TEXTS)]) for c in range(12) for t in range(12)]
    spark.createDataFrame(data, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = catalogue.queries()[name](spark, str(tmp_path))
    found = rows(got.columns, sorted(columns), [tuple(r) for r in got.collect()])
    assert found and found == rows(columns, sorted(columns), want.fetchall())
