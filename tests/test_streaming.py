"""The file-stream audit."""

from sievewright.streaming.audit import stream_audit


def test_stream_audit_lists_oversized_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/small.bin").write_bytes(b"c2pa " + b"x" * 10)
    (tmp_path / "in/large.bin").write_bytes(b"c2pa " + b"x" * 100)
    stream_audit(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/seen", most_bytes=50).awaitTermination()
    got = {r.path.rsplit("/", 1)[1]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(got) == {"small.bin", "large.bin"}
    assert (got["small.bin"].length, got["small.bin"].skipped) == (15, None) and got["small.bin"].has_c2pa is not None
    assert (got["large.bin"].length, got["large.bin"].skipped, got["large.bin"].has_c2pa) == (105, "over 50 bytes", None)
