"""Recurring lines most of whose words hold a digit."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry_points
from dockspan.llm.line_templates import drop_recurring_lines

EXACT = ["Page 12", "Version 2.1", "2021-03-04 12:00:01 INFO start", "tel 555-0199", "7"]


@pytest.mark.parametrize("times", [9, 12])
def test_numbered_lines_that_recur(spark, times):
    rows = []
    for i in range(times):
        stamp = f"2021-03-04 12:00:01 worker-7 ok{chr(97 + i)}"
        rows.append((i, "\n".join([f"own line {chr(97 + i)}", *EXACT, stamp, f"Page {100 + i}", f"{i}-x {i}-y"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in drop_recurring_lines(docs).collect()}
    for i, text in rows:
        lines = text.split("\n")
        # Three of the stamp's four words are the same; lines whose numbers differ stay.
        left = [lines[0], *lines[-2:]] if i and times >= 10 else lines
        assert found[i].text == "\n".join(left)
        assert (found[i].n_lines, found[i].n_dropped) == (len(lines), len(lines) - len(left))


def test_the_sql_has_the_same_rule(spark, tmp_path):
    rows = []
    for i in range(14):
        stamp = f"2021-03-04 12:00:01 worker-7 ok{chr(97 + i)}"
        rows.append((i, "\n".join([f"own {i} line", *EXACT, stamp, f"Page {100 + i // 10}", f"{i % 2}-x {i}-y w", "all the same here"])))
    docs = spark.createDataFrame([*rows, (50, None), (51, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = entry_points.queries()["op6_line_templates"](spark, str(tmp_path)).collect()
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    wanted = connection.execute(entry_points.oracle_sql()["op6_line_templates"]).fetchall()
    assert sorted(tuple(r) for r in found) == sorted(wanted)
    dropped = sum(r.n_dropped for r in found)
    assert dropped >= 13 * (len(EXACT) + 2) and hashlib.sha256(b"").hexdigest() in {r.kept_sha256 for r in found}
