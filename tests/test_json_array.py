"""JSON arrays in byte ranges: any cut gives the elements that the json module gives."""

import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.sources import jsonarray, tables

text = st.text(alphabet='ab"\\[]{},: \né\U0001f600', max_size=12)
value = st.recursive(st.none() | st.booleans() | st.integers() | text, lambda x: st.lists(x, max_size=3) | st.dictionaries(text, x, max_size=3), max_leaves=6)


def cut(path, size):
    """The two passes without Spark."""
    import pyarrow as pa

    n = os.path.getsize(path)
    ranges = pa.RecordBatch.from_pylist([{"path": path, "start": a, "size": min(size, n - a)} for a in range(0, n, size)])
    begins, depth, known = 0, 0, []
    for r in next(jsonarray._summed([ranges])).to_pylist():
        known.append({"path": r["path"], "start": r["start"], "size": r["size"], "begins": begins, "depth": depth})
        depth += r["inner"] if begins else r["outer"]
        begins = (begins + r["odd"]) % 2
    return [json.loads(v) for b in jsonarray._cut(size)([pa.RecordBatch.from_pylist(known)]) for v in b.column(0).to_pylist()]


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(value, max_size=8), st.integers(1, 40), st.booleans(), st.sampled_from([None, 1]))
def test_any_cut(tmp_path, values, size, plain, indent):
    path = tmp_path / "x.json"
    path.write_bytes((" \n" + json.dumps(values, ensure_ascii=plain, indent=indent) + "\n").encode())
    assert cut(str(path), size) == values


def test_long_runs_of_backslashes(tmp_path):
    path = tmp_path / "x.json"
    for n in (63, 64, 65, 4095, 4096, 9001):
        values = ["\\" * n, "a", '"' + "\\" * n + '"', ["]"]]
        path.write_text(json.dumps(values))
        for size in (1000, 1 << 20):
            assert cut(str(path), size) == values


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_files_as_rows(spark, tmp_path, size):
    rows = [{"session_id": f"s{i}", "user_id": None, "turn_number": i, "predicted_track_ids": ['a"]', "b\\"], "predicted_response": "x, [é] " * (i % 5)} for i in range(40)]
    for k, part in enumerate((rows[:25], [], rows[25:])):
        (tmp_path / f"{k} part.json").write_text(json.dumps(part, indent=k or None))
    (tmp_path / "none.json").write_text("")
    for read in (jsonarray.rows(spark, str(tmp_path), tables.PREDICTIONS, size), tables.json_array(spark, str(tmp_path), tables.PREDICTIONS), tables.json_array(spark, str(tmp_path), tables.PREDICTIONS, 100)):
        got = sorted((r for r in read.collect() if r["turn_number"] is not None), key=lambda r: r["turn_number"])
        assert [r.asDict() for r in got] == rows


def test_one_file_in_many_partitions(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps([{"session_id": "s" * 50} for _ in range(2000)]))
    from pyspark.sql import functions as F

    got = jsonarray.elements(spark, str(tmp_path), 4096).withColumn("p", F.spark_partition_id())
    assert got.count() == 2000 and got.select("p").distinct().count() > 1


def test_arrays_without_an_end_and_wrong_elements(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"turn_number": 1}, {"turn_number"')
    with pytest.raises(Exception, match="has no end"):
        jsonarray.rows(spark, str(tmp_path), tables.PREDICTIONS).collect()
    (tmp_path / "x.json").write_text('[{"turn_number": 1}, {"turn_number" 2}]')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        jsonarray.rows(spark, str(tmp_path), tables.PREDICTIONS).collect()
