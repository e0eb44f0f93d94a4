"""Vehicles of a place are counted exactly."""

from amperelake.plans import core


def test_vehicles_of_a_large_cell(spark, telemetry, tmp_path):
    telemetry([{"vin": f"V{i % 3000}"} for i in range(4000)], clash=False).write.parquet(str(tmp_path / "telemetry.parquet"))
    assert [(r.messages, r.vehicles) for r in core.geo_cells(spark, str(tmp_path)).collect()] == [(4000, 3000)]
