"""Clean-up of texts by an external model, in batches, behind guards (GRP-7, JSN-1, TXT-8, STR-7)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confab.operators import edits
from confab.session import checkpointed

SIZE, LEAST = 5, 12


def parse_reply(reply: str | None, n: int) -> list[str | None]:
    """The n strings of a JSON array; None for elements that are no strings, for all if it is no such array (JSN-1)."""
    try:
        got = json.loads(re.sub(r"^\s*```[^\n]*\n|\n```\s*$", "", reply or ""))
    except ValueError:
        return [None] * n
    return [x if isinstance(x, str) else None for x in got] if isinstance(got, list) and len(got) == n else [None] * n


def parse_array(reply: str | None, n: int) -> list[str] | None:
    """The n texts of the outermost JSON array of a reply, what is no text as an empty one; None if there is no such array (JSN-1)."""
    m = re.search(r"\[.*\]", reply or "", re.S)
    try:
        got = json.loads(m.group()) if m else None
    except ValueError:
        return None
    return [x if isinstance(x, str) else "" for x in got] if isinstance(got, list) and len(got) == n else None


def parse_object(reply: str | None) -> dict | None:
    """The outermost {...} of a reply as an object (JSN-2)."""
    m = re.search(r"\{.*\}", reply or "", re.S)
    try:
        got = json.loads(m.group()) if m else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def polish_blocks(blocks: DataFrame, model: Callable[[str], str | None], size: int = SIZE, at_once: int | None = None) -> DataFrame:
    """Blocks (call_id, block_no, text) with ``polished``; whatever fails a guard stays as it was (UDF-3, UDF-4).

    At most `at_once` requests are under way at a time, whatever the cluster has cores;
    without it as many as there are tasks. Order is that of the block numbers (STR-7).

    `model` gets the JSON array of up to `size` neighbouring texts and returns one of
    the same length, or None. Batches without a text of LEAST characters are not sent.
    """

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            rows = []
            for call, batch, texts in zip(pdf["call_id"], pdf["batch"], pdf["texts"]):
                texts = list(texts)
                ask = any(len(t) >= LEAST for t in texts)
                got = parse_reply(model(json.dumps(texts, ensure_ascii=False)), len(texts)) if ask else [None] * len(texts)
                rows += [(call, batch * size + 1 + i, t, g) for i, (t, g) in enumerate(zip(texts, got))]
            yield pd.DataFrame(rows, columns=["call_id", "block_no", "raw", "edited"])

    from confab.operators.turns import batches

    asked = batches(blocks, size)
    answered = (asked.repartition(at_once) if at_once else asked).mapInPandas(run, "call_id string, block_no long, raw string, edited string")
    return edits.accept(answered, out="polished").select("call_id", "block_no", F.col("raw").alias("text"), "polished")


def packs(blocks: DataFrame, max_turns: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Blocks (call_id, block_no, text) packed in order: call_id, pack, blocks ARRAY<STRUCT<block_no, text>> (GRP-9).

    A pack ends before the block that would make it longer than `max_turns` blocks or
    `max_chars` characters; a block of its own may be longer. Without limits a call is
    one pack, which is what one request for a whole call needs. Where a pack ends
    depends on all packs before it, so by characters a call's blocks come together in
    one row; by number alone they don't.
    """
    parts = F.array_sort(F.collect_list(F.struct("block_no", "text")))
    kind = f"array<array<struct<block_no:{blocks.schema['block_no'].dataType.simpleString()},text:string>>>"

    def fold(rows: pd.Series) -> pd.Series:
        out = []
        for call in rows:
            made: list[list[dict]] = []
            size = 0
            for b in call:
                n = len(b["text"] or "")
                if not made or (max_turns and len(made[-1]) >= max_turns) or (max_chars and size + n > max_chars):
                    made.append([])
                    size = 0
                made[-1].append(b)
                size += n
            out.append(made)
        return pd.Series(out)

    from confab.operators.ordered import with_order

    if max_turns and not max_chars:  # of equal size: by number, no call comes together
        one = with_order(blocks.withColumn("_one", F.lit(1)), "call_id", ["block_no"], 100_000, total={"_n": "_one"}).withColumn("pack", F.floor((F.col("_n") - 1) / max_turns).cast("int"))
        return one.groupBy("call_id", "pack").agg(parts.alias("blocks"))
    g = blocks.groupBy("call_id").agg(parts.alias("p"))
    return g.select("call_id", F.posexplode(F.pandas_udf(fold, kind)("p")).alias("pack", "blocks"))


def _asked(model: Callable[[str], str | None]):
    """One request for several texts; None for each that has no answer. Not sent where no text has LEAST characters."""

    def ask(texts: list[str]) -> list[str | None]:
        if not any(len(t.strip()) >= LEAST for t in texts):
            return [None] * len(texts)
        return parse_array(model(json.dumps(texts, ensure_ascii=False)), len(texts)) or [None] * len(texts)

    return ask


#: How much of a call one request holds: blocks alone, with neighbours to read, five, by characters, all.
GRANULARITIES = {"isolated": {}, "window": {}, "batch_small": {"max_turns": 5}, "batch_large": {"max_chars": 1500}, "whole_array": {}}


def cleaned(blocks: DataFrame, granularity: str, model: Callable[[str], str | None]) -> DataFrame:
    """call_id, block_no, raw, edited: blocks cleaned alone, in a window, in packs or as a whole (UDF-5).

    What fails stays raw. 'window' sends two blocks on either side to be read only.
    """
    from confab.operators import turns

    if granularity not in GRANULARITIES:
        raise ValueError(f"no such granularity: {granularity}")
    out = f"call_id string, block_no {blocks.schema['block_no'].dataType.simpleString()}, raw string, edited string"
    if granularity in ("isolated", "window"):
        b = blocks.select("call_id", "block_no", "text")
        if granularity == "window":
            b = b.join(turns.context(blocks), ["call_id", "block_no"])

        def alone(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pages:
                rows = []
                for r in pdf.itertuples(index=False):
                    text = r.text or ""
                    request = text if granularity == "isolated" else "\n".join(["BEFORE (read only):", *r.before, "TEXT:", text, "AFTER (read only):", *r.after])
                    reply = model(request) if len(text.strip()) >= LEAST else None
                    rows.append((r.call_id, r.block_no, text, _unfenced(reply) if reply else text))
                yield pd.DataFrame(rows, columns=["call_id", "block_no", "raw", "edited"])

        return b.mapInPandas(alone, out)
    ask = _asked(model)

    def together(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            rows = []
            for call, pack in zip(pdf["call_id"], pdf["blocks"]):
                texts = [b["text"] or "" for b in pack]
                rows += [(call, b["block_no"], t, e or t) for b, t, e in zip(pack, texts, ask(texts))]
            yield pd.DataFrame(rows, columns=["call_id", "block_no", "raw", "edited"])

    return packs(blocks, **GRANULARITIES[granularity]).select("call_id", "blocks").mapInPandas(together, out)


def _unfenced(reply: str) -> str:
    return re.sub(r"^\s*```[^\n]*\n?|\n?```\s*$", "", reply).strip() if reply.strip().startswith("```") else reply.strip()


def verified(pairs: DataFrame, model: Callable[[str], str | None]) -> DataFrame:
    """`pairs` (call_id, block_no, raw, edited) after a second reading of each call's edits; without a valid answer the edits stay (UDF-5)."""
    g = pairs.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "raw", "edited"))).alias("p"))

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pages:
            rows = []
            for call, p in zip(pdf["call_id"], pdf["p"]):
                asked = "\n\n".join(f"[{i}] RAW: {x['raw']}\n[{i}] EDITED: {x['edited']}" for i, x in enumerate(p, 1))
                got = parse_array(model(asked), len(p)) or [x["edited"] for x in p]
                rows += [(call, x["block_no"], x["raw"], y) for x, y in zip(p, got)]
            yield pd.DataFrame(rows, columns=["call_id", "block_no", "raw", "edited"])

    return g.mapInPandas(run, f"call_id string, block_no {pairs.schema['block_no'].dataType.simpleString()}, raw string, edited string")


def polish_text(texts: DataFrame, key: str, model: Callable[[str], str | None], limit: int = 6000) -> DataFrame:
    """key, text, polished: whole texts line-packed, cleaned pack by pack behind the guards, put together again (UDF-4)."""
    from confab.operators import turns

    ask = F.pandas_udf(lambda s: s.map(lambda t: model(t) if len(t.strip()) >= LEAST else None), "string")
    c = turns.pack_lines(texts, key, limit=limit).withColumn("edited", ask("chunk"))
    c = edits.accept(c, raw="chunk", edited="edited", out="polished")
    whole = c.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk_no", "polished"))).alias("p"))
    j = texts.select(key, "text").join(whole, key, "left")
    return j.select(key, "text", F.coalesce(F.array_join(F.transform("p", lambda x: x["polished"]), "\n"), "text").alias("polished"))


def tournament(blocks: DataFrame, configs: list[dict], models: dict[str, Callable[[str], str | None]], cache: str | None = None) -> DataFrame:
    """config, call_id, block_no, raw, edited of each configuration (UDF-9, SNK-13).

    A configuration is a name, a granularity, an algorithm (single, diff_gate,
    self_verify, ensemble) and a model; the ensemble takes all models. With `cache`, a
    folder, finished ones are read from it, and new ones written unless they look
    failed. The loop runs over configurations, which are few; each is a distributed job.
    """
    spark, out = blocks.sparkSession, None
    for c in configs:
        name, algorithm, path = c["name"], c.get("algorithm", "single"), f"{cache}/{c['name']}" if cache else None
        done = _read(spark, path) if path else None
        if done is None:
            base = lambda m: cleaned(blocks, c["granularity"], models[m])  # noqa: B023, E731
            if algorithm == "ensemble":
                each = [base(m).select("call_id", "block_no", "raw", F.col("edited").alias(f"e{i}")) for i, m in enumerate(models)]
                j = reduce(lambda x, y: x.join(y.drop("raw"), ["call_id", "block_no"]), each)
                done = j.select("call_id", "block_no", "raw", edits.ensemble()("raw", F.array(*(f"e{i}" for i in range(len(each))))).alias("edited"))
            else:
                done = base(c["model"])
                if algorithm == "diff_gate":
                    done = done.withColumn("edited", edits.gate_edits("raw", "edited"))
                elif algorithm == "self_verify":
                    done = verified(done, models[c["model"]])
                elif algorithm != "single":
                    raise ValueError(f"no such algorithm: {algorithm}")
            done = checkpointed(done)  # models are asked once
            if path and not edits.looks_failed(done).first()["failed"]:
                done.write.mode("overwrite").parquet(path)
        done = done.select(F.lit(name).alias("config"), "call_id", "block_no", "raw", "edited")
        out = done if out is None else out.unionByName(done)
    return out


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None
