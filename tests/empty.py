"""The schemas of the tables the queries read, and a folder of tables without rows."""

WORDS = "array<struct<start:double,end:double,text:string,lead_space:boolean>>"
TABLES = {
    "segments": f"call_id string, seq long, speaker string, start double, end double, text string, energy double, words {WORDS}",
    "blocks": f"call_id string, block_no int, speaker string, start double, end double, text string, interrupting boolean, energy double, words {WORDS}",
    "tracks": "call_id string, idx int, channels int, title string",
    "transcriptions": "id long, source_path string, output_path string, model string, language string, audio_duration_seconds double, elapsed_seconds double, started_at string, finished_at string, status string, error string, turns_json string",
    "documents": "doc_id long, text string, lang string, source string, n_chars int, doc_kind string, call_id string, created_at timestamp",
    "eval_items": "item_id long, suite string, lang string, clip string, ref_text string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}


def folder(spark, path, nulls=False):
    """A folder of all tables, empty or with one row of nulls in each."""
    for name, schema in TABLES.items():
        d = spark.createDataFrame([(None,) * len(spark.createDataFrame([], schema).columns)] if nulls else [], schema)
        d.write.parquet(f"{path}/{name}.parquet")
    return str(path)
