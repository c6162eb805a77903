"""The streaming forecast against a loop, over several micro-batches."""

import datetime as dt
import random

import pytest

from asofkit.streaming.adaptive import adaptive_stream

SCHEMA = "at timestamp, kind string, segment string, event_key long, day timestamp, value double"


@pytest.mark.parametrize("shards", [1, 5])
def test_probes_see_the_last_results_known_at_their_time(spark, tmp_path, shards):
    r, day = random.Random(4), lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    rows = []
    for k in range(400):
        s, d = r.choice("ab"), r.randrange(60)
        rows.append((day(d + r.choice((-2, 3))), "probe", s, k, day(d), None))
        rows.append((day(d + 1), "result", s, k, day(d), r.choice((None, float(k % 13)))))
    for i, part in enumerate(([x for x in rows if x[0] < day(30)], [x for x in rows if x[0] >= day(30)], [(day(90), "end", s, -1, day(90), None) for s in "ab"])):
        r.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        adaptive_stream(source, n=3, shards=shards).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {x["event_key"]: (x["at"], x["segment"], x["trailing_mean"], x["n_used"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 400
    for at, kind, s, k, _, _ in rows:
        if kind == "probe":
            last = sorted((a, d, q, v) for a, what, g, q, d, v in rows if what == "result" and g == s and v is not None and a <= at)[-3:]
            used = [v for _, _, q, v in last if q != k]
            assert got[k] == (at, s, sum(used) / len(used) if used else None, len(used))


def test_a_segment_is_several_states(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "in"))
    out = adaptive_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), shards=5)
    assert "shard" in out._jdf.queryExecution().analyzed().toString()
