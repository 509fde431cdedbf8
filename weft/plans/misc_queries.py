"""Pipelines in command form, incremental state, injected functions and encodings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.jq import ascii_upcase
from ..sources.tables import lines, load
from ..streaming import incremental as S
from . import jq, shell
from .registry import query
from .text_queries import LINES
from .tool_queries import _folder


def _lines(spark, sf):
    return lines(load(spark, sf, "documents"), "doc_id")


@query("stm_01_lazy_pipeline", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS ln, translate(split_part(line, ' ', 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS line FROM {LINES} WHERE contains(line, 'the') QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ln) <= 3")
def _(spark, sf):
    out = shell.run(_lines(spark, sf), "grep the | cut -d ' ' -f 1 | head -n 3")
    return out.withColumn("line", ascii_upcase(F.col("line")))


@query("msc_07_pipeline_count", f"SELECT doc_id, ln, line FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, first) AS ln, printf('%7d %s', n, line) AS line FROM (SELECT doc_id, line, min(ln) AS first, count(*) AS n FROM {LINES} GROUP BY doc_id, line) WHERE n > 1)")
def _(spark, sf):
    return shell.run(_lines(spark, sf), "sort | uniq -c | grep -vE '^ *1 ' | tail -n +1")


@query("sed_pipeline", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS ln, regexp_replace(line, 'th', 'TH', 'g') AS line FROM {LINES} WHERE ln BETWEEN 2 AND 5")
def _(spark, sf):
    return shell.run(_lines(spark, sf), "sed -n 2,5p | sed s/th/TH/g | head -n 100")


FLAG = "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 ELSE 8 END"


def _flagged(spark, sf):
    bit = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "purchase", 4).otherwise(8)
    return load(spark, sf, "events").withColumn("flag", bit)


@query("stm_02_change_capture", f"SELECT user_id, CAST(bit_or({FLAG}) AS INT) AS flags FROM events WHERE event_id >= 500 GROUP BY user_id")
def _(spark, sf):
    return S.dirty_flags(_flagged(spark, sf).where("event_id >= 500"), ["user_id"], "flag")


@query("stm_03_incremental_recompute", "SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_id >= 980) GROUP BY user_id")
def _(spark, sf):
    e = load(spark, sf, "events")
    dirty = e.where("event_id >= 980").select("user_id").distinct()
    return e.join(dirty, "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query("stm_06_idempotent_upsert", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", "event_type")
    table = S.apply_batch(e.limit(0), e.where("event_id < 600"), ["user_id"], "event_id")
    table = S.apply_batch(table, e.where("event_id >= 400"), ["user_id"], "event_id")
    return S.apply_batch(table, e.where("event_id between 400 and 500"), ["user_id"], "event_id")


@query("stm_07_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY")
def _(spark, sf):
    return S.retained(load(spark, sf, "events"), "ts", "5 days", F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id")


@query("stm_08_generation_fence", "SELECT user_id, max(event_id) AS generation FROM events WHERE event_id % 3 <> 0 GROUP BY user_id")
def _(spark, sf):
    e = load(spark, sf, "events").where("event_id % 3 <> 0").select("user_id", F.col("event_id").alias("generation"))
    return S.latest(e.withColumn("g", F.col("generation")), ["user_id"], "g").select("user_id", "generation")


@query("stm_ext_tumbling_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    w = load(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("day"), "event_type", "n")


@query("stm_10_ordered_state", "SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS clicks FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return load(spark, sf, "events").select("user_id", "event_id", F.sum((F.col("event_type") == "click").cast("long")).over(w).alias("clicks"))


@query("shl_01_find_xargs", f"SELECT CAST(NULL AS BIGINT) AS doc_id, row_number() OVER (ORDER BY doc_id, ln) AS ln, doc_id || ':' || ln || ':' || line AS line FROM {LINES} WHERE doc_id % 10 = 7 AND contains(line, 'the')")
def _(spark, sf):
    return shell.run(_lines(spark, sf), "find . -name '*7' | xargs grep -n the")


@query("shl_02_sed_block", f"SELECT doc_id, ln - 1 AS ln, replace(line, 'the', 'THE') AS line FROM {LINES} WHERE ln BETWEEN 2 AND 4")
def _(spark, sf):
    return shell.run(_lines(spark, sf), "sed -n '2,4{s/the/THE/g;p}'")


@query("shl_03_numbered_end", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS ln, line FROM (SELECT doc_id, ln, lpad(CAST(ln AS VARCHAR), 6, ' ') || chr(9) || line AS line, max(ln) OVER (PARTITION BY doc_id) AS last FROM {LINES}) WHERE ln > last - 2")
def _(spark, sf):
    return shell.run(_lines(spark, sf), "cat -n | tail -2")


@query("shl_04_sequence", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, ln) AS ln, line FROM (SELECT doc_id, 0 AS part, ln, line FROM {LINES} WHERE contains(line, 'idiot') UNION ALL SELECT doc_id, 1, ln, line FROM {LINES} WHERE ln <= 2)")
def _(spark, sf):
    return shell.run(_lines(spark, sf), "grep idiot ; head -2")


@query("stm_12_upsert_stream", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    """A stream of the events' files, kept as the newest event of each user."""
    target = f"{_folder(spark)}/upsert-{uuid.uuid4().hex}"
    events = load(spark, sf, "events").select("user_id", "event_id")
    events.write.parquet(f"{target}/in")
    changes = S.read_changes(spark, f"{target}/in", events.schema)
    S.upsert_stream(changes, f"{target}/out", ["user_id"], "event_id", f"{target}/log").awaitTermination()
    return S.current(spark, f"{target}/out")


@query("stm_13_deduplicated_stream", "SELECT DISTINCT user_id FROM events")
def _(spark, sf):
    """The first event of each user from a stream, within a watermark that holds all of them."""
    target = f"{_folder(spark)}/dedup-{uuid.uuid4().hex}"
    events = load(spark, sf, "events").select("user_id", F.lit("2024-01-01").cast("timestamp").alias("ts"))
    events.write.parquet(f"{target}/in")
    once = S.deduplicated(S.read_changes(spark, f"{target}/in", events.schema), ["user_id"], "ts", "1 day").select("user_id")
    once.writeStream.format("parquet").option("checkpointLocation", f"{target}/log").trigger(availableNow=True).start(f"{target}/out").awaitTermination()
    return spark.read.schema("user_id long").parquet(f"{target}/out")


@S.command("shout")
def _shout(df, mark="!"):
    return df.withColumn("line", F.concat(ascii_upcase(F.col("line")), F.lit(mark)))


@query("udf_01_injected_command", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS ln, translate(line, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '?' AS line FROM {LINES}")
def _(spark, sf):
    return shell.run(_lines(spark, sf), "cat | shout '?'")


@query("udf_06_aggregate", "SELECT source, CAST(sum(n_chars) AS BIGINT) AS total, max(n_chars) - min(n_chars) AS spread FROM documents GROUP BY source")
def _(spark, sf):
    return load(spark, sf, "documents").groupBy("source").agg(F.sum("n_chars").alias("total"), (F.max("n_chars") - F.min("n_chars")).alias("spread"))


@query("udf_07_table_valued", "SELECT page_id, k, part FROM pages, unnest(string_split(url, '/')) WITH ORDINALITY AS t(part, k)")
def _(spark, sf):
    return load(spark, sf, "pages").select("page_id", F.posexplode(F.split("url", "/")).alias("k", "part")).withColumn("k", (F.col("k") + 1).cast("long"))


@query("sort_16_zero_records", "SELECT p_brand, k, v FROM (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS k, p_name AS v FROM part)")
def _(spark, sf):
    joined = load(spark, sf, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\x00").alias("z"))
    return joined.select("p_brand", F.posexplode(F.split("z", "\x00")).alias("k", "v")).withColumn("k", (F.col("k") + 1).cast("long"))


@query("udf_04_jq_def", "SELECT event_id, 1 AS k, CAST(2 * CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS out FROM events")
def _(spark, sf):
    return jq.jq(load(spark, sf, "events"), "def twice(f): f * 2; .k | twice(.)", "props", ("event_id",)).select("event_id", "k", "out")


@query("grf_23_jq_paths", "SELECT event_id, k, CASE k WHEN 1 THEN '[\"k\"]' ELSE 'k' END AS out FROM events, (SELECT unnest([1, 2]) AS k)")
def _(spark, sf):
    return jq.jq(load(spark, sf, "events"), "paths, keys[]", "props", ("event_id",), raw=True).select("event_id", "k", "out")


@query("jsn_10_destructuring", "SELECT event_id, '{\"a\":' || json_extract_string(props, '$.k') || ',\"b\":' || (CAST(json_extract(props, '$.k') AS BIGINT) + 1) || '}' AS out FROM events")
def _(spark, sf):
    return jq.jq(load(spark, sf, "events"), ". as {k: $k} | {a: $k, b: ($k + 1)}", "props", ("event_id",)).select("event_id", "out")


@query("jsn_14_arguments", "SELECT event_id, 'x' || (CAST(json_extract(props, '$.k') AS BIGINT) + 7) AS out FROM events")
def _(spark, sf):
    return jq.jq(load(spark, sf, "events"), '"\\($p)\\(.k + $n)"', "props", ("event_id",), raw=True, p="x", n=7).select("event_id", "out")
