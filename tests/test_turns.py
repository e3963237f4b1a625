from pyspark.sql import functions as F

from confab.operators import echo, turns

SEG = "call_id string, seq long, speaker string, start_ms long, end_ms long, text string, energy double"
BLK = "call_id string, block_no long, speaker string, start_ms long, end_ms long, text string, energy double"


def merged(spark, rows, **kw):
    out = turns.merge_turns(spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows)], SEG), **kw)
    return [(r.speaker, r.start_ms, r.end_ms, r.text) for r in out.orderBy("block_no").collect()]


def test_one_speaker_merges_within_pause_and_splits_beyond(spark):
    assert merged(spark, [("P", 0, 2000, "Hey there.", None), ("P", 2300, 4000, "How are you?", None)]) == [("P", 0, 4000, "Hey there. How are you?")]
    assert len(merged(spark, [("P", 0, 2000, "a", None), ("P", 5000, 6000, "b", None)])) == 2
    assert len(merged(spark, [("P", 0, 2000, "a", None), ("P", 2800, 3000, "b", None)])) == 1


def test_two_speakers_merge_whatever_the_pause(spark):
    assert merged(spark, [("P", 0, 2000, "a", None), ("P", 5000, 6000, "b", None), ("Q", 6500, 7000, "c", None)]) == [("P", 0, 6000, "a b"), ("Q", 6500, 7000, "c")]


def test_chunks_do_not_change_the_result(small_batches):
    """The stretches of the scan are partitions and batches now: of five rows, or one of all."""
    rows = [("PQ"[i * i % 5 > 2], i * 700, i * 700 + 900, str(i), None) for i in range(60)]
    cut = merged(small_batches, rows)
    small_batches.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    small_batches.conf.set("spark.sql.shuffle.partitions", "1")
    assert cut == merged(small_batches, rows) and len(cut) > 20


def test_out_of_order_and_interruption(spark):
    s = spark.createDataFrame([("c", 0, "Q", 3000, 4000, "two", None), ("c", 1, "P", 0, 5000, "one", None)], SEG)
    b = turns.flag_interruptions(turns.merge_turns(s))
    assert [(r.text, r.interrupting) for r in b.orderBy("block_no").collect()] == [("one", False), ("two", True)]


def test_markdown(spark):
    s = spark.createDataFrame([("c", 0, "P", 0, 5000, "one", None), ("c", 1, "Q", 3500, 4000, "two", None), ("d", 0, "P", 0, 1, "A", None), ("d", 1, "P", 9000, 9001, "B", None)], SEG)
    got = {r.call_id: r.text for r in turns.markdown(turns.flag_interruptions(turns.merge_turns(s))).collect()}
    assert got == {"c": "**P** [00:00]\none\n\n**Q** [00:04] (interrupting)\ntwo\n", "d": "A\n\nB\n"}


def test_words_give_the_text_and_blank_segments_go(spark):
    word = "array<struct<start:double,end:double,text:string,lead_space:boolean>>"
    df = spark.createDataFrame([("c", 0, "P", 0.0, 1.0, "x", None, [(0.0, 0.5, "Ahoj", True), (0.5, 1.0, "!", False)]), ("c", 1, "P", 1.0, 2.0, "   ", 0.1, None), ("c", 2, "P", 2.0, 3.0, " y ", 0.2, []), ("c", 2, "P", 2.0, 3.0, " y ", 0.4, [])], f"call_id string, seq long, speaker string, start double, end double, text string, energy double, words {word}")
    assert [(r.seq, r.text, r.energy) for r in turns.distinct_segments(df).orderBy("seq").collect()] == [(0, "Ahoj!", None), (2, "y", 0.4)]


def test_region_packing(spark):
    df = lambda rows: spark.createDataFrame([("c", *r) for r in rows], "call_id string, start_ms long, end_ms long")
    pack = lambda rows, most, gap: [tuple(r)[1:] for r in turns.pack_regions(df(rows), most, gap).orderBy("start_ms").collect()]
    assert pack([(0, 1000), (1100, 2000)], 10000, 1000) == [(0, 2000)]
    assert pack([(0, 900), (950, 2000)], 1000, 1000) == [(0, 900), (950, 2000)]


def test_line_packing(spark):
    df = spark.createDataFrame([(1, "aa\nbb\ncc"), (2, None), (3, ""), (4, "x" * 9)], "id int, text string")
    assert [(r.id, r.chunk) for r in turns.pack_lines(df, "id", limit=5).orderBy("id", "chunk_no").collect()] == [(1, "aa\nbb"), (1, "cc"), (4, "x" * 9)]


def test_batches_and_context(spark):
    b = spark.createDataFrame([("c", i, "P", i, i, str(i), None) for i in range(1, 8)], BLK)
    assert [r.texts for r in turns.batches(b).orderBy("batch").collect()] == [["1", "2", "3", "4", "5"], ["6", "7"]]
    c = {r.block_no: (r.before, r.after) for r in turns.context(b).collect()}
    assert c[1] == ([], ["2", "3"]) and c[4] == (["2", "3"], ["5", "6"]) and len(c) == 7


def dropped(spark, rows):
    b = spark.createDataFrame([("c", i, *r) for i, r in enumerate(rows, 1)], BLK)
    left = {r.block_no for r in echo.drop_echoes(b).collect()}
    return {i for i in range(1, len(rows) + 1)} - left


def test_echoes(spark):
    long, other = "delivery tomorrow at noon then", "something else was said here now"
    assert dropped(spark, [("P", 10000, 14000, long, 0.2), ("Q", 10300, 14500, long, 0.04)]) == {2}
    assert dropped(spark, [("P", 10000, 14000, long + " ok", 0.03), ("Q", 10300, 14500, long, 0.25)]) == {1}
    assert dropped(spark, [("P", 0, 1000, "jo jo", 0.2), ("Q", 100, 1000, "jo jo", 0.1)]) == set()
    assert dropped(spark, [("P", 0, 1000, long, 0.2), ("P", 100, 1000, long, 0.1), ("Q", 400000, 401000, long, 0.1)]) == set()
    assert dropped(spark, [("P", 0, 1000, long, None), ("Q", 100, 1000, long + " more", None)]) == {1}
    assert dropped(spark, [("P", 0, 1000, long, None), ("Q", 100, 1000, other, None)]) == set()


def test_echo_chain_is_settled_in_order(spark):
    rows = [("P", 0, 3000, "delivery tomorrow quarter invoice", 0.9), ("Q", 200, 3200, "tomorrow quarter invoice revenue", 0.5), ("R", 400, 3400, "quarter invoice revenue quarter", 0.1)]
    assert dropped(spark, rows) == {2}


def test_empty_tables(spark):
    s = spark.createDataFrame([], SEG)
    b = turns.merge_turns(s)
    assert turns.markdown(turns.flag_interruptions(b)).collect() == [] and echo.drop_echoes(b).collect() == [] and turns.lanes(b).select("lane").collect() == []
    assert b.agg(F.count("*")).collect()[0][0] == 0
