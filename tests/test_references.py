from datetime import datetime as D

from lodestar.operators.references import ForeignKey, orphan_cascade, orphan_report


def test_direct_and_inherited(spark):
    t = lambda d: D(2025, 1, d)
    tables = {
        "machines": spark.createDataFrame([("M1", t(1), None), ("m2", t(1), t(5)), ("m2", t(8), None)], "machine_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"),
        "roots": spark.createDataFrame([("r1", " m1", t(2), None), ("r2", "m2", t(6), None), ("r3", "m2", t(9), None), ("r4", None, t(2), None), ("r5", "nope", t(2), None), ("r5", "nope", t(2), None)], "root_id string, machine_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"),
        "snapshots": spark.createDataFrame([("s1", "r1", t(3), None), ("s2", "R5", t(3), None), ("s3", "r1", t(1), None), ("s4", "r1", None, None)], "snapshot_id string, root_id string, ingested_at timestamp_ntz, deleted_at timestamp_ntz"),
        "deltas": spark.createDataFrame([("d1", "s1", "s2", t(4)), ("d2", None, "zz", t(4))], "delta_id string, from_snapshot_id string, to_snapshot_id string, ingested_at timestamp_ntz"),
    }
    rows = orphan_cascade(tables)
    got = {(r.child_table, r.child_key, r.ref_field, r.orphan_kind) for r in rows.collect()}
    assert got == {
        ("roots", "r2", "machine_id", "direct"), ("roots", "r5", "machine_id", "direct"), ("snapshots", "s3", "root_id", "direct"), ("snapshots", "s4", "root_id", "direct"),
        ("deltas", "d2", "to_snapshot_id", "direct"), ("snapshots", "s2", "root_id", "inherited"), ("deltas", "d1", "to_snapshot_id", "inherited"),
    }
    assert orphan_report(rows).where("orphan_kind = 'direct'").agg({"n_references": "sum"}).first()[0] == 5
    assert orphan_cascade({k: v.limit(0) for k, v in tables.items()}).count() == 0


def test_cycle_reaches_a_fixpoint(spark):
    t = D(2025, 1, 1)
    rows = [("a", "gone", t), ("b", "a", t), ("c", "b", t), ("x", "y", t), ("y", "x", t)]
    tables = {"n": spark.createDataFrame(rows, "id string, up string, ingested_at timestamp_ntz")}
    got = {(r.child_key, r.orphan_kind) for r in orphan_cascade(tables, [ForeignKey("n", "up", "n")], {"n": "id"}).collect()}
    assert got == {("a", "direct"), ("b", "inherited"), ("c", "inherited")}
