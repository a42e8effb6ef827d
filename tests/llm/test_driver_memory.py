"""What steps leave in the driver's memory."""

import re
import uuid
from pathlib import Path


def _resident() -> float:
    """MB of this process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


def test_freed_memory_goes_back():
    from seqloom.llm.common import trim

    trim()
    before = _resident()
    blocks = [bytes(10_000) for _ in range(20_000)]
    held = blocks[::1000]  # some stay, so that the end of the heap does
    del blocks
    trim()
    assert len(held) == 20 and _resident() - before < 50


def test_models_leave_no_training_behind(spark, sf_dir, monkeypatch):
    from seqloom.llm import queries as Q

    seen = []
    monkeypatch.setattr(Q, "trim", lambda: seen.append(1))
    monkeypatch.setattr(Q.quality, "train", lambda rows: len(rows))
    monkeypatch.setattr(Q.toxicity, "train", lambda rows: len(rows))
    assert Q.quality_model(spark, sf_dir) > 0 and Q.toxicity_model(spark, sf_dir) > 0 and len(seen) == 2


def test_steps_of_decontamination_are_swept(spark, monkeypatch):
    from seqloom.llm import decontaminate as D

    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:20] + ["x"] * 20))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words[5:30]))], "item_id long, text string")
    stored, swept = [], []
    monkeypatch.setattr(D, "stored", lambda df, name, make=D.stored: stored.append(name) or make(df, name))
    monkeypatch.setattr(D, "sweep", lambda spark: swept.append(len(stored)))
    assert [r.doc_id for r in D.decontaminated(docs, bench).collect()] == [2]
    assert swept == list(range(1, len(stored) + 1)) and len(stored) >= 7


def test_block_entries_are_all_near_values(spark):
    from itertools import combinations

    from pyspark.sql import functions as F
    from seqloom.llm import decontaminate as D

    fps = [0, -1, 0x0123456789ABCDEF, -(1 << 63)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for variants in (False, True):
        found = df.select("fp", D._blocks(F.col("fp"), variants).alias("at"))
        masks = [sum(1 << b for b in c) for n in range(D.RADIUS // D.BLOCKS + 1 if variants else 1) for c in combinations(range(D.BITS), n)]
        want = sorted((f, b, ((f >> b * D.BITS) & (1 << D.BITS) - 1) ^ m) for f in fps for b in range(D.BLOCKS) for m in masks)
        assert sorted((r.fp, r.at.block, r.at.value) for r in found.collect()) == want


def test_tables_over_the_bound_are_not_broadcast(spark, monkeypatch):
    from pyspark.sql import functions as F
    from seqloom.llm import decontaminate as D
    from seqloom.llm import neardedup as N
    from seqloom.llm.common import stored

    # Few distinct digests: small files of many rows, which Spark broadcasts by itself.
    many = stored(spark.range(2000).select("id", F.unhex(F.md5((F.col("id") % 3).cast("string").cast("binary"))).alias("digest")), "many")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    docs = spark.range(3000).repartition(2)
    for few, bound in ((True, 2000), (False, 1999)):
        monkeypatch.setattr(N, "BROADCAST_ROWS", bound)
        monkeypatch.setattr(D, "BROADCAST_ROWS", bound)
        for table in (N.small(many), D._small(many, many.count())):
            for how in ("inner", "left", "left_anti"):
                joined = docs.join(table, "id", how)
                assert ("BroadcastHashJoin" in plan(joined)) == few
                assert joined.count() == {"inner": 2000, "left": 3000, "left_anti": 1000}[how]


def test_groups_keep_to_the_bound_of_broadcasts(spark, monkeypatch):
    from seqloom.llm import neardedup as N

    texts = [" ".join(f"w{t}x{i}" for i in range(30)) for t in range(4)]
    docs = spark.createDataFrame([(i, texts[i % 4] + " end" * (i % 8 == 0)) for i in range(200)], "doc_id long, text string")
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)
    found = N.groups(docs)
    assert {(r.id, r.component) for r in found.collect()} == {(i, i % 4) for i in range(200)}
    last = found._jdf.queryExecution().executedPlan().toString()
    assert "digest" not in "".join(x for x in last.split("\n") if "BroadcastHashJoin" in x)


def test_tasks_on_texts_give_memory_back(spark, monkeypatch):
    import pyarrow as pa
    from seqloom.llm import common as C

    runs, trimmed = [], []
    docs = spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    monkeypatch.setattr(C, "trim", lambda: trimmed.append(1))
    C.map_text(docs, ["doc_id"], "text", "n long", lambda: lambda texts: [pa.array([len(t) for t in texts], pa.int64())])
    C.filter_text(docs, "text", lambda: lambda texts: [t.as_py() != "" for t in texts])
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a", ""]})
    assert [sum(b.num_rows for b in run(iter([batch]))) for run in runs] == [2, 1] and len(trimmed) == 2


def _tasks(spark, run) -> int:
    """Tasks that ``run()`` makes with 50 partitions a shuffle: the driver keeps a record of each."""
    sc = spark.sparkContext
    changed = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    sc.setJobGroup(group := uuid.uuid4().hex, "")
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    status = sc.statusTracker()
    stages = {s for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds}
    return sum(i.numCompletedTasks for i in map(status.getStageInfo, stages) if i)


def test_rounds_of_components_make_few_tasks(spark):
    from seqloom.operators.components import connected_components

    links = spark.createDataFrame([(10 * g + i, 10 * g + i + 1) for g in range(20) for i in range(6)], "a long, b long")
    found = []
    # 1,401 before, with a distinct and a union of both directions in each round; 969 now.
    assert _tasks(spark, lambda: found.extend(connected_components(links).collect())) < 1200
    assert {(r.node, r.component) for r in found} == {(10 * g + i, 10 * g) for g in range(20) for i in range(7)}
