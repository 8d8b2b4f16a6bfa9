"""Round trips, edge files, validators, state machine and streams."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.functions import tokens as T
from tracewright.functions import values as V
from tracewright.operators import adaptive, extract, templates
from tracewright.operators import streams as S
from tracewright.sources import blocks
from tracewright.streaming import events as SE


def test_records_survive_any_bytes(spark, tmp_path):
    raw = b"first\r\nsecond\n\n\x00nul \x80\xff\xc2\x85 \xe2\x80\xa8\nno end"
    (tmp_path / "a.log").write_bytes(raw)
    rows = blocks.read_records(spark, f"{tmp_path}/a.log", 2).orderBy("line_no").collect()
    assert "".join(r.body + r.ending for r in rows).encode("latin-1") == raw
    assert [r.block_id for r in rows] == [0, 0, 1, 1, 2] and [r.ending for r in rows] == ["\r\n", "\n", "\n", "\n", ""]
    (tmp_path / "b.log").write_bytes(b"")
    assert blocks.read_records(spark, f"{tmp_path}/b.log").count() == 0


def test_block_archives_are_checked(spark):
    rows = spark.createDataFrame([(i // 3, i, f"line {i} é") for i in range(8)], "block_id long, pos long, line string")
    coded = blocks.encoded(rows)
    back = {r.block_id: r for r in blocks.decoded(coded).collect()}
    assert back[2].text == "line 6 é\nline 7 é" and all(r.exact for r in back.values())
    tampered = coded.withColumn("raw_sha256", F.when(F.col("block_id") == 1, "0").otherwise(F.col("raw_sha256")))
    assert [r.exact for r in blocks.decoded(tampered).orderBy("block_id").collect()] == [True, False, True]


def test_token_functions(spark):
    rows = spark.createDataFrame([("abc12-", 0), ("", 1), ("1.2.3.4", 2), ("deadbeef", 3), ("a..,b", 4), ("x1 y\tz", 5)], "t string, i int")
    got = rows.orderBy("i").select(T.token_shape(F.col("t")), T.shape_class(F.col("t")), T.punctuation_skeleton(F.col("t")), T.numeric_pattern(F.col("t"))).collect()
    assert [r[0] for r in got] == ["A3D2-", "", "D1.D1.D1.D1", "A8", "A1..,A1", "A1D1 A1\tA1"]
    assert [r[1] for r in got][2:4] == ["NUMERIC", "HEX"] and got[4][2] == ".," and got[2][3] == "D1.D1.D1.D1"


def test_value_functions(spark):
    ints = [0, 1, -1, 127, 128, -(2**61), 2**61, 16383, 16384]
    rows = spark.createDataFrame([(v,) for v in ints], "v long")
    z = rows.select("v", V.zigzag(F.col("v")).alias("z")).select("v", "z", V.unzigzag(F.col("z")).alias("b")).collect()
    assert all(r.v == r.b for r in z) and [r.z for r in z][:3] == [0, 2, 1]
    assert [r[0] for r in rows.where("v >= 0").select(V.varint_length(F.col("v"))).collect()] == [1, 1, 1, 2, 9, 2, 3]
    logs = spark.createDataFrame([("Jan  1 00:00:00",), ("Feb 28 23:59:59",), ("Dec 31 01:02:03",), ("Jan 01 00:00:01",), ("Xyz",), ("Mon 1",)], "t string")
    assert [tuple(r) for r in logs.select(V.syslog_seconds(F.col("t")), V.syslog_layout(F.col("t"))).collect()] == [(0, 18), (59 * 86400 - 1, 33), (364 * 86400 + 3723, 33), (1, 97), (None, None), (None, None)]
    sizes = spark.createDataFrame([(512,), (2000,), (15000,), (200000,), (3 << 20,)], "n long")
    assert [r[0] for r in sizes.select(V.pretty_size(F.col("n"))).collect()] == ["(512 B)", "(1.95 KB)", "(14.6 KB)", "(195 KB)", "(3.00 MB)"]


def test_move_to_front_inverts():
    rng = random.Random(0)
    for size in (3, 8, 512):
        values = [rng.randrange(700) if rng.random() < 0.3 else rng.randrange(5) for _ in range(3000)]
        ranks = S.move_to_front(values, size)
        assert S.unmove_to_front(ranks, [v for v, r in zip(values, ranks) if r == 0], size) == values


def test_plan_checks_and_restore(spark):
    bad = (extract.Field("a", "", "(x+)+"), extract.Field("b", "", "[0-9]*"), extract.Field("b", "", r"\1x"))
    reasons = extract.check_plan(bad)
    assert any("nested" in r for r in reasons) and any("nothing" in r for r in reasons) and any("repeated" in r for r in reasons)
    with pytest.raises(ValueError):
        extract.apply_plan(spark.range(1).selectExpr("id AS line_no", "'' AS text"), bad)
    rows = spark.createDataFrame([(1, "http://a.b/en/12/13?x=9"), (2, "no fields"), (3, ""), (4, "7 77 777")], "line_no long, text string")
    coded, found = extract.apply_plan(rows, extract.URL_PLAN)
    assert {r.line_no: r.text for r in extract.restore_plan(coded, found, extract.URL_PLAN).collect()} == {r.line_no: r.text for r in rows.collect()}


def test_rule_overlaps(spark):
    spans = spark.createDataFrame([(1, "a", 0, 5), (1, "b", 4, 9), (2, "a", 0, 2), (2, "b", 2, 4), (3, "c", 0, 1)], "line_no long, rule string, start int, end int")
    assert [tuple(r) for r in extract.overlap_pairs(spans).collect()] == [("a", "b", 1)]


def test_policy_waits_and_publishes():
    costs = [(b, 100, 100, 50) for b in range(40)]
    got = adaptive.evolve(costs)
    assert got[0] == (2, "attempt") and got[1] == (4, "publish") and got[2] == (14, "attempt")
    assert adaptive.evolve([(b, 10, 100, 5) for b in range(40)]) == []
    assert sum(e.kind == "publish" for e in adaptive.evolve([(b, 100, 100, 50) for b in range(400)])) == adaptive.PUBLICATIONS


def test_streams(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = f"{tmp_path}/events"
    batch.repartition(2).write.parquet(folder)
    live = SE.tumbling(SE.read_events(spark, folder, batch.schema), late="3650 days")
    q = live.writeStream.format("memory").queryName("tumbling").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(cnt) FROM tumbling").first()[0] == batch.count()
    policy = SE.BlockPolicy()
    costs = spark.createDataFrame([(b, 100, 100, 50) for b in range(12)], "block_id long, plan_total long, empty_total long, candidate_total long")
    costs.write.parquet(f"{tmp_path}/costs")
    q = SE.read_events(spark, f"{tmp_path}/costs", costs.schema).writeStream.foreachBatch(policy).start()
    q.processAllAvailable()
    q.stop()
    assert policy.events[0] == (2, "attempt")


def test_family_examples_go_through_all_lines(spark):
    hot = [f"a b c d e f g h tail {i}" for i in range(1000, 1900)]
    lines = [*hot, "a b c d e f g h tell 7", "a b c d e f g h toll 77", "one", "one", "two 1", "two 2"]
    df = spark.createDataFrame([(x,) for x in lines], "line string").repartition(3)
    for most, want in ((1, {hot[0], "one", "two 1"}), (2, {*hot[:2], "one", "two 1", "two 2"}), (3, {hot[0], *lines[900:902], "one", "two 1"})):
        got = [r.line for r in templates.family_examples(df, most, 0.15).collect()]
        assert sorted(got) == sorted(want)


def test_records_are_numbered_across_splits(spark, tmp_path):
    data = "".join(f"line {i} \x85  é\r\n" if i % 7 == 0 else f"{i}\n" for i in range(5000)).encode() + b"\xff\xfe tail"
    (tmp_path / "many.log").write_bytes(data)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
        found = blocks.read_records(spark, f"{tmp_path}/many.log", 1000)
        assert found.rdd.getNumPartitions() >= 1
        rows = found.orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line_no for r in rows] == list(range(5001)) and {r.block_id for r in rows} == set(range(6))
    assert "".join(r.body + r.ending for r in rows).encode("latin-1") == data
    from tracewright.sources import sinks

    made = sinks.write_lossless(blocks.read_records(spark, f"{tmp_path}/many.log", 1000), f"file://{tmp_path}/out").orderBy("block").collect()
    assert b"".join((tmp_path / "out" / r.file).read_bytes() for r in made) == data and sum(r.bytes for r in made) == len(data)


def test_sinks_keep_every_value(spark, tmp_path):
    from tracewright.sources import sinks

    rows = spark.createDataFrame([(1, "a,b"), (2, 'q"uo\nte'), (3, ""), (4, None), (5, "\\N "), (6, " x ")], "i long, t string")
    want = sorted(tuple(r) for r in rows.collect() if r.t is not None)
    sinks.write_csv(rows, f"{tmp_path}/csv")
    got = sinks.read_csv(rows, f"{tmp_path}/csv").collect()
    assert sorted(tuple(r) for r in got if r.t is not None) == want and [r.i for r in got if r.t is None] == [4]
    sinks.write_json(rows, f"{tmp_path}/json")
    assert sorted(tuple(r) for r in spark.read.schema(rows.schema).json(f"{tmp_path}/json").collect() if r.t is not None) == want
    assert [r.i for r in sinks.in_order(rows.orderBy("t"), "i")] == [1, 2, 3, 4, 5, 6]
    packed = sinks.chunks(spark.createDataFrame([(1, b"\x00\xff" * 500), (2, b"")], "block_id long, raw binary"))
    assert all(r.exact for r in sinks.unpacked(packed).collect())
    assert {r.codec: r.members for r in sinks.inventory(packed).collect()} == dict.fromkeys(sinks.CODECS, 2)


def test_plan_texts_are_checked_and_rewritten():
    import re

    from tracewright.operators import programs as P

    for sample in ("ab-12 x.9", "(é)", "A1\t"):
        for letters in (True, False):
            assert re.fullmatch(P.sample_pattern(sample, letters), sample)
    assert re.fullmatch(P.sample_pattern("a1", flexible=True), "b123")
    assert P.replacement_is_safe("x{placeholder}{group2}") and not P.replacement_is_safe("{group1}") and not P.replacement_is_safe("{placeholder}{os}")
    assert P.broadened(r"(\d{2}) [0-9]{4}x") == (r"(\d+)[ ]+[0-9]+x", "broadened")
    assert P.broadened(r"(\d{2},)+")[1] == "repeated group" and P.broadened("(?x) a b")[1] == "verbose" and P.broadened("[ ]a +")[1] == "unchanged"
    item = {"kind": "open_function", "store_group": 0, "pattern": r"\d{2}:\d{2}", "replacement": "<{placeholder}>", "program": {"op": "expression", "group_regex": r"(\d{2})"}}
    new, what = P.lowered(item)
    assert what == "lowered" and new["pattern"] == r"\d+:\d+" and new["program"]["prefix"] == "<" and item["pattern"] == r"\d{2}:\d{2}"
    assert P.lowered({**item, "replacement": "{placeholder}{placeholder}"})[1].startswith("no single") and P.lowered({**item, "store_group": 1})[1].startswith("no numeric")
    assert P.check_program("g0 * 2 + int(g1, 16)", {"g0", "g1"}) == []
    for bad in ("g0 ** 9", "__import__('os')", "g0 / 2", "g9", "g0 << g1", "int(g0, 3)", "open(g0)", "(lambda: 1)()", "g0.x", "1 if g0 else 2", "'a'", "1 +", "g0" + "+1" * 300):
        assert P.check_program(bad, {"g0", "g1"}), bad
    assert P.is_identity({"a": "g1", "b": " g2"}, 2) and not P.is_identity({"a": "g1 * 2"}, 1)


def test_values_survive_skeletons_of_any_kind(spark):
    from tracewright.operators import skeletons as K

    texts = ["a1b02.50c", "a9b3c", "", "x", "007", "1.2.3", "12345678901234567890", "9" * 18 + ".5", "é1", "a1b02.50c", "0.0", "00.10z"]
    rows = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts * 3)], "block_id long, pos long, text string")
    shaped = K.shape_columns(rows, "block_id", "pos", "text")
    back = {r.pos: r.restored for r in K.restored(shaped, "block_id", "pos").collect()}
    assert back == dict(enumerate(texts * 3))


def test_shared_pools_settle_on_long_chains(spark):
    import random

    from tracewright.operators import relations

    names = [f"s{i:03d}" for i in range(40)]
    random.Random(2).shuffle(names)
    rows = [(n, f"v{i + d}") for i, n in enumerate(names) for d in (0, 1)] + [("t1", "w"), ("t2", "w"), ("u", "x")]
    got = {r.stream: (r.pool, r.pool_size) for r in relations.shared_pools(spark.createDataFrame(rows, "stream string, value string")).collect()}
    assert got == {**{n: ("s000", 41) for n in names}, "t1": ("t1", 1), "t2": ("t1", 1), "u": ("u", 1)}


def test_short_streams_share_a_step(spark):
    from tracewright.operators import skeletons

    rng = random.Random(1)
    rows = [(i // 50, rng.randrange(20), i, rng.choice(["a", "b", None])) for i in range(1000)]
    ranked = skeletons.mtf_by(spark.createDataFrame(rows, "b long, u long, i long, v string"), "v", ["b", "u"], "i", 2)
    assert "FlatMapGroups" not in ranked._jdf.queryExecution().toString()  # a call of Python for each stream
    want = {}
    for key in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == key]
        want |= dict(zip([r[2] for r in own], S.move_to_front([r[3] for r in own], 2)))
    assert {r.i: r["rank"] for r in ranked.collect()} == want


def test_long_streams_are_cut_in_parts(spark, monkeypatch):
    from tracewright.operators import skeletons

    rng = random.Random(2)
    far = [("s", p, str(rng.randrange(10**6))) for p in [*rng.sample(range(10**4), 900), 10**15, -5, None]] + [("t", 7, "1"), ("t", 8, "22")]
    rows = spark.createDataFrame(far, "stream string, pos long, text string")
    whole = [df.orderBy("stream").collect() for df in (skeletons.fixed_widths(rows, "stream", "pos", "text"), skeletons.surrogate_gains(rows, "stream", "pos", "text", 100))]
    monkeypatch.setattr(S, "PART_ROWS", 50)
    sizes = S.in_parts(rows, "stream", "pos").groupBy("stream", "__part").count().collect()
    assert sum(r["count"] for r in sizes) == len(far) and max(r["count"] for r in sizes) <= 150
    assert whole == [df.orderBy("stream").collect() for df in (skeletons.fixed_widths(rows, "stream", "pos", "text"), skeletons.surrogate_gains(rows, "stream", "pos", "text", 100))]


def test_variable_tokens_are_counted_in_their_lines(spark):
    routed = extract.routed_tokens(spark.createDataFrame([("12 a 123 7 <b> x=1 44",), ("",), ("a 123",), ("555",)], "line string"))
    assert "Window" not in routed._jdf.queryExecution().toString()  # it sorted all tokens by their line
    assert sorted(map(tuple, routed.collect())) == [("12", "LEN2", 1), ("123", r"CTXa|STR\d{3}|IDX2", 1), ("123", r"CTXa|STR\d{3}|IDX3", 1), ("44", "LEN2", 1), ("555", r"CTX|STR\d{3}|IDX1", 1), ("7", "LEN1", 1), ("x=1", "CTX<b>|STR_=", 1)]


def test_signatures_look_at_distinct_tokens(spark):
    from tracewright.plans import signature_queries

    plan = signature_queries.context_signatures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_codecs_hold_few_blocks_at_once(spark):
    from tracewright.sources import sinks

    before = spark.conf.get(sinks._BATCH)
    try:
        spark.conf.set(sinks._BATCH, 1 << 28)
        blocks_ = spark.range(0, 40, 1, 1).selectExpr("id AS block_id", "CAST(repeat('x', 1000000) AS binary) AS raw")
        packed = sinks.chunks(blocks_, ("none",))
        assert int(spark.conf.get(sinks._BATCH)) == sinks.BATCH_BYTES

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"rows": [b.num_rows]})

        assert max(r.rows for r in packed.select("payload").mapInArrow(sizes, "rows long").collect()) <= 6
        assert sinks.unpacked(packed).where("exact").count() == 40
        spark.conf.set(sinks._BATCH, 1000)
        sinks.unpacked(packed)
        assert spark.conf.get(sinks._BATCH) == "1000"
    finally:
        spark.conf.set(sinks._BATCH, before)


def test_slot_templates_find_a_shape_once(spark):
    from tracewright.functions import signatures as G

    odd = ["a  b", "Word, x1\t deadbeef 12.5", "deadbeefdeadbeef cafe\u0085 \u00c9t\u00e9, [z^{`@", "", " ", "abcdefghijklmnopq " + "x" * 40 + "-1", "ABCDEFAB 1a 0- \u0661\u00b2 \ue000"]
    rows = spark.createDataFrame([(v,) for v in odd], "line string")
    plain = F.array_join(F.transform(T.lossless_tokens(F.col("line")), lambda t: F.concat(T.shape_class(t), F.lit(":"), G.context_signature(t))), G.UNIT)
    got = rows.select("line", G.slot_template_key(F.col("line")).alias("a"), F.when(F.col("line") == "", "[EMPTY]").otherwise(plain).alias("b")).collect()
    assert all(r.a == r.b for r in got) and any("A4|S1" in r.a for r in got)
    plan = rows.select(G.slot_template_key(F.col("line")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[.,:/-]") == 1  # the pattern of numbers; it stood there for each use of the shape


def test_words_are_cut_once_for_contexts(spark):
    plan = templates.alpha_contexts(spark.createDataFrame([("a b",), ("",)], "line string"), 1, 1, 1.0)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.left, r.right) for r in plan.collect()) == [("<BOL>", "b"), ("a", "<EOL>")]
