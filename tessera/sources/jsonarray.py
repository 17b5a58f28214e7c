"""Large files that hold one JSON array each, read in byte ranges.

A range alone can't tell whether it begins inside a string, so its effect is worked out for both
cases: a first pass over the ranges gives quotes (odd or even) and brackets of each, sums over
the ranges before give every range its state, and a second pass cuts out the elements that begin
in a range. Only an element that crosses the end of its range is read further, in steps. What
Spark shuffles between the passes is three numbers for each range.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: tasks of a pass at most; beyond it a task reads several ranges, one after the other
PARTITIONS = 50_000


def _opened(path: str):
    from urllib.parse import unquote, urlparse

    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(urlparse(path).path))
    system, at = fs.FileSystem.from_uri(path)
    return system.open_input_file(at)


def _escaped(file, start: int) -> bool:
    """Whether the byte at start follows an odd run of backslashes."""
    run, at = 0, start
    while at:
        back = max(0, at - 4096)
        part = file.read_at(at - back, back)
        kept = len(part) - len(part.rstrip(b"\\"))
        run += kept
        if kept < len(part):
            break
        at = back
    return run % 2 == 1


#: the bytes that matter: quotes 1, commas 2, opening brackets 3, closing ones 4
KINDS = np.zeros(256, np.uint8)
KINDS[[0x22, 0x2C, 0x5B, 0x7B, 0x5D, 0x7D]] = [1, 2, 3, 3, 4, 4]


def _marks(data: bytes, escaped: bool):
    """(places, kinds) of quotes that open or close strings, commas and brackets, those inside strings too."""
    b = np.frombuffer(data, np.uint8)
    kinds = KINDS[b]
    at = np.flatnonzero(kinds)
    kinds = kinds[at]
    if escaped or b"\\" in data:
        quotes = np.flatnonzero(kinds == 1)
        after = np.where(at[quotes] > 0, b[at[quotes] - 1] == 0x5C, escaped)
        gone = [q for q in quotes[after].tolist() if _odd(data, int(at[q]), escaped)]
        at, kinds = np.delete(at, gone), np.delete(kinds, gone)
    return at, kinds


def _odd(data: bytes, end: int, escaped: bool) -> bool:
    """Whether an odd run of backslashes ends before end."""
    start, back = end, 64
    while start:
        part = data[max(0, end - back) : end]
        start = end - (len(part) - len(part.rstrip(b"\\")))
        if start > max(0, end - back):
            return (end - start) % 2 == 1
        back *= 16
        if start == 0:
            break
    return (end + int(escaped)) % 2 == 1


def _inside(kinds: np.ndarray, begins: bool) -> np.ndarray:
    return (np.cumsum(kinds == 1) + int(begins)) % 2 == 1


def _steps(kinds: np.ndarray) -> np.ndarray:
    return (kinds == 3).astype(np.int64) - (kinds == 4)


def _summed(batches):
    import pyarrow as pa

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            with _opened(r["path"]) as f:
                data = f.read_at(r["size"], r["start"])
                _, kinds = _marks(data, _escaped(f, r["start"]))
            inside, step = _inside(kinds, False), _steps(kinds)
            out.append((r["path"], r["start"], r["size"], int((kinds == 1).sum()) % 2, int(step[~inside].sum()), int(step[inside].sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())], names=["path", "start", "size", "odd", "outer", "inner"])


def _ends(data: bytes, escaped: bool, begins: bool, depth: int):
    """(places of the array's own bracket, commas and end; state after the data)."""
    at, kinds = _marks(data, escaped)
    inside = _inside(kinds, begins)
    step = np.where(inside, 0, _steps(kinds))
    after = depth + np.cumsum(step)
    shuts = (after == 0) & (step == -1)
    own = ((after == 1) & ((step == 1) | ((kinds == 2) & ~inside))) | shuts
    run = len(data) - len(data.rstrip(b"\\"))
    odd = (run + (int(escaped) if run == len(data) else 0)) % 2 == 1
    return at[own], at[shuts], (odd, bool(inside[-1]) if len(at) else begins, int(after[-1]) if len(at) else depth)


def _cut(step: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                out = []
                with _opened(r["path"]) as f:
                    data = f.read_at(r["size"], r["start"])
                    marks, shuts, state = _ends(data, _escaped(f, r["start"]), bool(r["begins"]), r["depth"])
                    shut = set(shuts.tolist())
                    for a, z in zip(marks.tolist(), marks[1:].tolist()):
                        if a not in shut:
                            out.append(data[a + 1 : z])
                    if len(marks) and int(marks[-1]) not in shut:  # the last element goes on
                        parts, at = [data[int(marks[-1]) + 1 :]], r["start"] + len(data)
                        while True:
                            more = f.read_at(step, at)
                            if not more:
                                raise ValueError(f"{r['path']}: the array has no end")
                            found, _, state = _ends(more, *state)
                            if len(found):
                                parts.append(more[: int(found[0])])
                                break
                            parts.append(more)
                            at += len(more)
                        out.append(b"".join(parts))
                yield pa.RecordBatch.from_arrays([pa.array([x for x in (o.strip().decode() for o in out) if x], pa.string())], names=["value"])

    return run


def elements(spark: SparkSession, path: str, size: int = 4 << 20) -> DataFrame:
    """value: each element of the JSON arrays in the files of path, as text.

    Files are listed without their content and read in ranges of ``size`` bytes, a task's memory
    is a few times that, or that of one element if it is longer. Empty arrays and empty files
    give no rows, an array without its end raises an error. Elements may be of any kind.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.lit(size).cast("long"), F.col("length") - F.col("start")).alias("size"))
    n = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 1
    tasks = min(int(n), PARTITIONS)  # a stated number: rows of ranges are small and would be put together again
    ranges = ranges.repartition(tasks, "path", "start")
    sums = ranges.mapInArrow(_summed, "path string, start long, size long, odd int, outer long, inner long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = sums.withColumn("begins", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("begins") == 1, F.col("inner")).otherwise(F.col("outer"))).over(before), F.lit(0).cast("long")))
    dealt = known.select("path", "start", "size", F.col("begins").cast("int").alias("begins"), "depth").repartition(tasks, "path", "start")
    return dealt.mapInArrow(_cut(min(size, 1 << 20)), "value string")


def rows(spark: SparkSession, path: str, schema: T.StructType, size: int = 4 << 20) -> DataFrame:
    """The elements as rows of schema; an element that isn't one raises an error."""
    got = elements(spark, path, size).select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("x"))
    return got.select("x.*")
