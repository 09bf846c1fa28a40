import datetime as dt

from skycube.sources import store
from skycube.streaming import arrivals

T0 = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, rows, schema):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_first_arrivals(spark, tmp_path):
    rows = [(T0, "k", 1, 1, "a"), (T0, "k", 1, 1, "b"), (T0, "k", 1, 4, "c")]
    s = stream(spark, tmp_path, rows, "ts timestamp, time_key string, freq_bin long, stokes int, path string")
    arrivals.drain(arrivals.first_arrivals(s), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.stokes for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 4]


def test_merged_observations(spark, tmp_path):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(at(0), 41.0, 1), (at(50), 46.0, 1), (at(200), 41.0, 1), (at(90000), 50.0, 1)]
    s = stream(spark, tmp_path, rows, "ts timestamp, mhz double, stokes int")
    arrivals.drain(arrivals.merged_observations(s, 60), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.start, r.files) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(at(0), 2), (at(200), 1)]


def test_append_stream_is_idempotent(spark, tmp_path):
    rows = [(0, 0, 0, 0, 0, 0, 0, 1, 2, [1.0, 2.0]), (1, 0, 0, 0, 0, 0, 0, 1, 2, [3.0, 4.0])]
    schema = "time_idx long, freq_idx long, pol_idx long, tile_l long, tile_m long, l0 long, m0 long, n_l int, n_m int, data array<float>"
    s = stream(spark, tmp_path, rows, schema)
    for k in range(2):
        arrivals.append_as_they_arrive(s, str(tmp_path / "store"), str(tmp_path / f"cp{k}")).awaitTermination()
    assert store.open_tiles(spark, str(tmp_path / "store")).count() == 2


def test_running_coverage(spark, tmp_path):
    s = stream(spark, tmp_path, [(T0, 41.0), (T0, 41.0), (T0, 46.0)], "ts timestamp, mhz double")
    q = arrivals.running_coverage(s).writeStream.format("memory").queryName("cov").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.mhz, r.files) for r in spark.sql("SELECT * FROM cov").collect()) == [(41.0, 2), (46.0, 1)]


def test_a_time_step_over_two_batches(spark, tmp_path):
    """Channels of one time step that arrive in different batches are all stored."""
    schema = "time_idx long, freq_idx long, pol_idx long, tile_l long, tile_m long, l0 long, m0 long, n_l int, n_m int, data array<float>"
    path = str(tmp_path / "in")
    for f in range(3):
        spark.createDataFrame([(0, f, 0, 0, 0, 0, 0, 1, 2, [1.0, 2.0])], schema).coalesce(1).write.mode("append").parquet(path)
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        arrivals.append_as_they_arrive(s, str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.freq_idx for r in store.open_tiles(spark, str(tmp_path / "store")).collect()) == [0, 1, 2]
