"""Jobs that die at a write, and their replays: what was committed stays readable,
and a replay ends in the state of a run that never died."""

import pytest
from conftest import SF
from pyspark.sql import functions as F
from unhold import fixtures as fx
from unhold.plans import runs as R
from unhold.schemas import QUERY_COMPLETE
from unhold.sources import attempts as A
from unhold.sources import sinks as K
from unhold.sources.records import read_previous_manifest
from unhold.streaming import decisions as SD

CONFIG = "bucket string, release_mode string, report_only boolean, safety_threshold bigint"


class Killed(RuntimeError):
    pass


def kill(monkeypatch, module, name, after=False):
    """The write ``name`` dies before it begins, or just after it is done."""
    real = getattr(module, name)

    def dies(*args, **kw):
        if after:
            real(*args, **kw)
        raise Killed(name)
    monkeypatch.setattr(module, name, dies)


@pytest.fixture(scope="module")
def inv(spark):
    full = fx.inventory(spark, SF).where(F.col("bucket") == "bucket-0")
    full.persist()
    yield full
    full.unpersist()


@pytest.fixture(scope="module")
def config(spark):
    return spark.createDataFrame([("bucket-0", "delete", False, 100000)], CONFIG)


def manifests(spark, root):
    rows = A.resolved(spark.read.schema(R.MANIFEST_SCHEMA).csv(f"{root}/manifests"), f"{root}/manifests")
    return sorted((r.run_id, r.mode, r.key, r.version_id) for r in rows.collect())


def job(spark, inv, config, root, dt=None):
    return R.run_snapshot(spark, inv if dt is None else fx.snapshot(inv, dt), config, root, validate=False, pointer=f"{root}/previous")


def test_a_rerun_that_dies_before_its_commit_leaves_the_manifests(spark, inv, config, tmp, monkeypatch):
    job(spark, inv, config, tmp, fx.CUR_DT)
    before, pointer = manifests(spark, tmp), sorted(map(tuple, read_previous_manifest(spark, f"{tmp}/previous").collect()))
    assert before
    less = inv.where(F.substring(F.md5("key"), 1, 1) < "8")
    for module, name, after in ((K, "write_manifest", False), (K, "write_manifest", True), (K, "write_withheld", True), (A, "commit", False)):
        with monkeypatch.context() as m:
            kill(m, module, name, after)
            with pytest.raises(Killed):
                job(spark, less, config, tmp, fx.CUR_DT)
        assert manifests(spark, tmp) == before
        assert sorted(map(tuple, read_previous_manifest(spark, f"{tmp}/previous").collect())) == pointer
    # one that lives counts, and takes the dead ones' folders away
    job(spark, less, config, tmp, fx.CUR_DT)
    now = manifests(spark, tmp)
    assert now and now != before and set(now) < set(before)
    assert spark.read.schema(R.MANIFEST_SCHEMA).csv(f"{tmp}/manifests").count() == len(now)
    assert spark.read.parquet(f"{tmp}/runs").count() == 1


def test_a_replay_after_a_late_kill_is_compared_with_the_run_before(spark, inv, config, tmp, monkeypatch):
    job(spark, inv, config, tmp, fx.PREV_DT)
    with monkeypatch.context() as m:
        kill(m, K, "mark_complete")
        with pytest.raises(Killed):
            job(spark, inv, config, tmp, fx.CUR_DT)
    before = manifests(spark, tmp)
    job(spark, inv, config, tmp, fx.CUR_DT)
    assert manifests(spark, tmp) == before
    cur = R.run_ids(fx.snapshot(inv, fx.CUR_DT)).first().run_id
    history = [r for r in spark.read.parquet(f"{tmp}/decisions").collect() if r.run_id == cur]
    assert len(history) == 4 and len({(r.mode, r.outcome, r.verified_count) for r in history}) == 2  # both attempts decide alike
    jobs = spark.read.parquet(f"{tmp}/active_jobs")
    assert jobs.count() == jobs.select("job_id").distinct().count()


@pytest.mark.parametrize("name, after", [("append_decisions", False), ("append_decisions", True), ("append_active_jobs", True), ("publish_previous_manifest", True)])
def test_a_killed_decision_batch_is_taken_up_by_its_replay(spark, inv, config, tmp, tmp_path_factory, monkeypatch, name, after):
    root = str(tmp_path_factory.getbasetemp() / "decisions-input")
    out = {n: f"{root}/{n}" for n in ("records", "manifests", "ready")}
    if not (tmp_path_factory.getbasetemp() / "decisions-input").exists():
        R.run_snapshot(spark, inv, config, root, validate=False, decide_inline=False)
    records = spark.read.schema(QUERY_COMPLETE).json(out["records"])

    def batch(to):
        SD.decision_batch(spark, records, out["manifests"], config, to, out["ready"])

    def state(to):
        return (sorted((r.run_id, r.mode, r.outcome, r.job_id) for r in spark.read.parquet(f"{to}/decisions").collect()),
                sorted(r.job_id for r in spark.read.parquet(f"{to}/active_jobs").collect()),
                sorted(map(tuple, read_previous_manifest(spark, f"{to}/previous").collect())))

    batch(f"{tmp}/never-killed")
    with monkeypatch.context() as m:
        kill(m, K, name, after)
        with pytest.raises(Killed):
            batch(f"{tmp}/killed")
    batch(f"{tmp}/killed")
    batch(f"{tmp}/killed")
    want = state(f"{tmp}/never-killed")
    assert state(f"{tmp}/killed") == want and want[1] and want[2]


def test_replayed_quarantine_rows_come_once(spark, config, tmp):
    bad = spark.createDataFrame([("r1", None), ("r1", None), ("r2", "{x")], "run_id string, _corrupt_record string")
    for _ in range(2):
        K.append_once(bad, f"{tmp}/q", ["run_id", "_corrupt_record"])
    assert spark.read.parquet(f"{tmp}/q").count() == 2


def test_combined_manifest_files(spark, tmp):
    """Files follow one another in manifest order; each begins where the bytes
    before it reach a multiple of the limit; a lost one is noticed."""
    rows = spark.createDataFrame([("b", f"key-{i:05d}", f"v{i}", f"r{i % 2}", "COMPLIANCE") for i in range(3000)], R.MANIFEST_SCHEMA).repartition(7)
    K.write_combined(rows, f"{tmp}/combined", 5000)
    back = spark.read.schema(R.COMBINED_SCHEMA).csv(f"{tmp}/combined").withColumn("file", F.input_file_name())
    got = sorted(((r.run_id, r.part, r.key, r.version_id) for r in back.collect()), key=lambda r: (r[0], r[2]))
    assert back.select("file").distinct().count() == back.select("run_id", "part").distinct().count()
    done = {}
    for run, part, key, version in got:
        assert part == done.get(run, 0) // 5000
        done[run] = done.get(run, 0) + len(f"b,{key},{version}\n")
    ready = R.ready_record(spark.read.schema(R.COMBINED_SCHEMA).csv(f"{tmp}/combined"))
    assert {r.run_id: sum(p.bytes for p in r.parts) for r in ready.collect()} == done
    lost = spark.read.schema(R.COMBINED_SCHEMA).csv(f"{tmp}/combined").where("NOT (run_id = 'r1' AND part = 2)")
    assert {r.run_id: r.manifest_exists for r in R.ready_evidence(ready, lost).collect()} == {"r0": True, "r1": False}
