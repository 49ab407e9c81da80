import datetime as dt

from normscape.streaming import judgements as N


def rows(spark, folder):
    t = dt.datetime(2024, 1, 1)
    data = [(s, s % 2, q, None if (s, q) == (1, 1) else 0.25 * q + s / 10, t + dt.timedelta(seconds=s)) for s in range(6) for q in range(2)]
    data += [data[0]] + [(9, 1, 0, 0.5, t)]
    spark.createDataFrame(data, N.JUDGEMENTS).coalesce(1).write.parquet(folder)
    return spark.readStream.schema(N.JUDGEMENTS).parquet(folder), data


def run(df, mode, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name).collect()


def test_cores_equal_batch(spark, tmp_path):
    stream, data = rows(spark, str(tmp_path / "in"))
    got = {(r["node_id"], r["q_idx"]): (round(r["mean"], 9), r["n"], r["errors"]) for r in run(N.stream_cores(stream), "update", "cores")}
    want = {}
    for s, node, q, x, _ in {d[0:3]: d for d in data}.values():
        want.setdefault((node, q), []).append(x)
    assert got == {k: (round(sum(v or 0 for v in vs) / len(vs), 9), len(vs), sum(v is None for v in vs)) for k, vs in want.items()}


def test_complete_samples(spark, tmp_path):
    stream, _ = rows(spark, str(tmp_path / "in"))
    assert {r["sample_id"] for r in run(N.complete_counts(stream, 2), "update", "complete")} == set(range(6))


def test_stateful_complete_samples(spark, tmp_path):
    stream, _ = rows(spark, str(tmp_path / "in"))
    got = {r["sample_id"]: round(r["mean"], 6) for r in run(N.stream_complete_samples(stream, 2), "append", "stateful")}
    assert set(got) == set(range(6)) and got[2] == round(0.125 + 0.2, 6)


def test_a_complete_sample_is_emitted_once(spark, tmp_path):
    folder, t = str(tmp_path / "in"), dt.datetime(2024, 1, 1)
    for i, data in enumerate([[(1, 0, 0, 0.5, t)], [(1, 0, 1, 1.0, t), (2, 0, 0, 0.1, t)], [(1, 0, 1, 0.0, t), (1, 0, 0, 0.0, t)]]):
        spark.createDataFrame(data, N.JUDGEMENTS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(N.JUDGEMENTS).parquet(folder)
        q = N.stream_complete_samples(stream, 2).writeStream.format("parquet").option("path", f"{folder}-out").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
        assert q.awaitTermination(120), i
    assert [tuple(r) for r in spark.read.parquet(f"{folder}-out").collect()] == [(1, 0.75)]


def test_windows_and_running(spark, tmp_path):
    stream, data = rows(spark, str(tmp_path / "in"))
    assert sum(r["n"] for r in run(N.windowed_cores(stream), "update", "windows")) == len(data) - 1  # one came twice
    path = str(tmp_path / "run")
    q = stream.writeStream.foreachBatch(lambda b, i: N.merge_running(b, i, path)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in N.running_table(path).read(spark).collect()) == len(data)


def test_replayed_batches_count_once(spark, tmp_path):
    _, data = rows(spark, str(tmp_path / "in"))
    batch, run_, done = spark.read.schema(N.JUDGEMENTS).parquet(str(tmp_path / "in")), str(tmp_path / "run"), str(tmp_path / "done")
    for i in (0, 0, 1, 1):
        N.merge_running(batch, i, run_)
        N.merge_progress(batch, i, done)
    assert sum(r["n"] for r in N.running_table(run_).read(spark).collect()) == 2 * len(data)
    got = N.progress(N.progress_table(done).read(spark), 12).first()
    assert (got["samples"], got["min_samples"], got["errors"], got["finished"]) == (2 * len(data), 14, 2, True)


def test_positions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    data = [(1, 8 * k, s, k / 10 + s, t) for k in (3, 1, 2) for s in range(2)]
    schema = "traj_idx long, k int, struct_idx int, score double, ts timestamp"
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    run(N.stream_positions(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))), "update", "positions")
    got = N.positions_in_order(spark.table("positions"), 4).collect()
    assert [(r["k"], r["system"], r["progress"]) for r in got] == [(8, [0.1, 1.1], 0.75), (16, [0.2, 1.2], 0.75), (24, [0.3, 1.3], 0.75)]


JUDGED = "text string, question int, judge string, score double, ts timestamp"


def in_steps(spark, folder, schema, steps, build, mode):
    """Runs a stream a file at a time; (rows of each step, state rows after each)."""
    out, state = [], []
    for i, data in enumerate(steps):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)
        got = []
        query = build(spark.readStream.schema(schema).parquet(folder)).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-state").foreachBatch(lambda b, _, got=got: got.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
        assert query.awaitTermination(120), i
        out.append(got)
        state.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    return out, state


def test_an_incomplete_sample_is_evicted_by_its_timer(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    later = t + dt.timedelta(hours=3)
    steps = [[(1, 0, 0, 0.5, t)], [(2, 0, 0, 0.1, later)], [(3, 0, 0, 0.1, later + dt.timedelta(minutes=1))], [(1, 0, 1, 1.0, later + dt.timedelta(minutes=2))], [(1, 0, 0, 0.0, later + dt.timedelta(minutes=3))]]
    out, state = in_steps(spark, str(tmp_path / "in"), N.JUDGEMENTS, steps, lambda s: N.stream_complete_samples(s, 2), "append")
    # the first score of sample 1 is gone by the time of the second, so only both later ones complete it
    assert out == [[], [], [], [], [(1, 0.5)]]
    assert max(state) < 12


def test_samples_share_buckets_and_timers(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    minutes = lambda m: t + dt.timedelta(minutes=m)
    full = [(s, 0, q, 0.25 * q, t) for s in range(40) for q in range(2)]
    steps = [
        full + [(50, 0, 0, 1.0, t), (None, 0, 0, None, t), (None, 0, 1, 1.0, t)],
        full[:6] + [(50, 0, 0, 0.5, minutes(1)), (50, 0, 1, 0.0, t)],
        [(60, 0, 0, 0.5, minutes(600))],
        [(60, 0, 1, 0.5, minutes(601)), (70, 0, 0, 0.5, minutes(602))],
        [(0, 0, 0, 1.0, minutes(603)), (0, 0, 1, 1.0, minutes(603))],
    ]
    out, state = in_steps(spark, str(tmp_path / "in"), N.JUDGEMENTS, steps, lambda s: N.stream_complete_samples(s, 2, buckets=3), "append")
    assert sorted(out[0], key=str) == sorted([(s, 0.125) for s in range(40)] + [(None, 0.5)], key=str)
    assert out[1:] == [[(50, 0.25)], [], [(60, 0.5)], [(0, 1.0)]]  # a sample that was emitted long ago is a new one
    assert 42 <= state[0] <= 42 + 2 * 3 and state[-1] <= 3 + 2 * 3  # a timer, which is two rows, a bucket and not a sample


def test_judge_averages_count_once_and_their_state_ends(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    minutes = lambda m: t + dt.timedelta(minutes=m)
    first = [(f"t{i}", 0, j, 0.25 * k, t) for i in range(20) for k, j in enumerate(("a", "b"))] + [("none", 0, "a", None, t)]
    steps = [first, first[:3] + [("t0", 0, "a", 1.0, minutes(1)), ("t0", 0, "b", 0.0, t)], [("far", 0, "a", 0.5, minutes(600))], [("far", 0, "a", 0.5, minutes(600)), ("far", 0, "b", 1.0, minutes(601))]]
    out, state = in_steps(spark, str(tmp_path / "in"), JUDGED, steps, N.stream_judge_average, "update")
    assert sorted(out[0], key=str) == sorted([(f"t{i}", 0, 0.125, 2) for i in range(20)] + [("none", 0, None, 1)], key=str)
    assert out[1] == [("t0", 0, 0.625, 2)]  # what was repeated, or is older, changes nothing
    assert out[2] == [("far", 0, 0.5, 1)] and out[3] == [("far", 0, 0.75, 2)]
    assert state[0] > 40 and state[-1] < 10


def test_positions_count_once_and_their_state_ends(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "traj_idx long, k int, struct_idx int, sample_id long, score double, ts timestamp"
    first = [(i, 8, s, 7, 0.5, t) for i in range(10) for s in range(2)]
    steps = [first + first, [(0, 8, 0, 8, None, t)], [(99, 8, 0, 1, 0.1, t + dt.timedelta(days=1))], [(99, 8, 0, 1, 0.1, t + dt.timedelta(days=1))]]
    out, state = in_steps(spark, str(tmp_path / "in"), schema, steps, N.stream_positions, "update")
    assert sorted(out[0]) == [(i, 8, s, 0.5, 1) for i in range(10) for s in range(2)]
    assert out[1:] == [[(0, 8, 0, 0.25, 2)], [(99, 8, 0, 0.1, 1)], []]
    assert state[0] > state[-1]


def test_windows_come_once_and_late_rows_are_dropped(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    minutes = lambda m: t + dt.timedelta(minutes=m)
    steps = [[(1, 0, 0, 0.5, minutes(1)), (1, 0, 0, 0.5, minutes(1)), (2, 0, 0, None, minutes(2))], [(1, 0, 0, 0.5, minutes(1)), (3, 0, 0, 1.0, minutes(30))], [(4, 0, 0, 1.0, minutes(1)), (5, 0, 0, 1.0, minutes(90))]]
    out, _ = in_steps(spark, str(tmp_path / "in"), N.JUDGEMENTS, steps, N.windowed_cores, "append")
    assert [(r[0]["start"], *r[1:]) for rows in out for r in rows] == [(t, 0, 0, 0.25, 2), (minutes(30), 0, 0, 1.0, 1)]


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    path, table = f"{tmp_path}/t", None
    names = lambda: sorted(p.name for p in (tmp_path / "t").iterdir())
    size = lambda n: sum(f.stat().st_size for f in (tmp_path / "t" / n).glob("*.parquet"))
    table = N.BatchTable(path, N.progress_table(path).merge, level=3)
    for i in range(10):
        rows = spark.range(2000 if i == 0 else 3).selectExpr("CAST(id AS INT) AS node_id", "1L AS n", "0L AS errors").coalesce(1)
        table.add(rows, i)
        table.add(rows, i)  # replayed, before or after it was merged
        if i == 1:
            assert size("level-0-1-1") < size("level-0-0-0") / 4
    assert names() == ["level-0-9-9", "level-2-0-8"]  # what was merged is gone
    got = {r["node_id"]: r["n"] for r in table.read(spark).collect()}
    assert got == {k: 10 if k < 3 else 1 for k in range(2000)}
    table.add(rows, 4)
    assert {r["node_id"]: r["n"] for r in table.read(spark, upto=9).collect()} == got
    (tmp_path / "t" / "level-0-10-10").mkdir()  # a batch that broke off is not read
    assert len(table.tables(spark)) == 2
