import pyarrow as pa
from pyspark.sql import types as T

from cartwise.llm import batches


def test_slices_cover_the_batch_in_small_parts():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 1000] * 5000), pa.array(range(5000))], names=["t", "i"])
    parts = list(batches.slices(b, 64 << 10))
    assert len(parts) > 50 and [i for p in parts for i in p.column(1).to_pylist()] == list(range(5000))
    assert [p.num_rows for p in batches.slices(b.slice(0, 3), 1)] == [1, 1, 1]
    assert list(batches.slices(b.slice(0, 0))) == []


def test_a_worker_holds_one_state(monkeypatch):
    monkeypatch.setattr(batches, "_HELD", {})
    made = []

    def make(name):
        return lambda: made.append(name) or name
    assert [batches.worker_state(k, make(k)) for k in ("a", "a", "b", "a")] == ["a", "a", "b", "a"]
    assert made == ["a", "b", "a"] and len(batches._HELD) == 1


def test_new_columns_replace_clashing_ones_and_keep_the_rest(spark):
    df = spark.createDataFrame([(1, "old", None), (2, None, [1.5])], "id long, n string, v array<double>")

    def make():
        return lambda b: [pa.array([len(b)] * b.num_rows, pa.int64())]
    out = batches.add_columns(df, [T.StructField("n", T.LongType())], make)
    assert out.dtypes == [("id", "bigint"), ("v", "array<double>"), ("n", "bigint")]
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, None), (2, [1.5])]
