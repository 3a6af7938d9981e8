"""Chat formatting: links tool calls to their results, orders them and serialises canonical JSON (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Table, broadcast_measured, read_table, saved


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside lambdas Spark computes an expression each time it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def variant_type(value: Column) -> Column:
    def name(kind):
        return (
            F.when(kind.isNull() | (kind == "VOID"), "null").when(kind == "BIGINT", "integer").when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "number")
            .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("other")
        )

    return let(F.schema_of_variant(value), name)


def argument_facts(args: Column) -> Column:
    """Of an object its members by name: JSON type and size (a number, or a string's length); null for anything else."""

    def fact(kind, value):
        size = F.when(kind == "string", F.length(F.try_variant_get(value, "$", "string")).cast("double")).when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))
        return F.struct(kind.alias("kind"), size.alias("size"))

    # only an object casts to a map
    given = F.when(F.schema_of_variant(args).startswith("OBJECT"), args.cast("map<string,variant>"))
    return F.transform_values(given, lambda _, value: let(variant_type(value), lambda kind: fact(kind, value)))


def argument_faults(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls: key, name, facts (of argument_facts); schemas: tool, arg, type, required, low, high -> key, faults (sorted texts)."""
    rules = schemas.groupBy(F.col("tool").alias("name")).agg(F.sort_array(F.collect_list(F.struct("arg", "type", "required", "low", "high"))).alias("rules"))
    joined = calls.join(broadcast_measured(saved(rules, "tool-rules")), "name", "left")

    def fault(r):
        def judged(fact):
            kind = F.coalesce(fact["kind"], F.lit("null"))
            fits = (kind == r["type"]) | ((r["type"] == "number") & (kind == "integer"))
            return (
                F.when((kind == "null") & r["required"], F.concat(F.lit("missing:"), r["arg"]))
                .when((kind != "null") & ~fits, F.concat(F.lit("type:"), r["arg"]))
                .when((kind != "null") & ((fact["size"] < r["low"]) | (fact["size"] > r["high"])), F.concat(F.lit("range:"), r["arg"]))
            )

        return let(F.try_element_at("facts", r["arg"]), judged)

    known = F.transform("rules", lambda r: r["arg"])
    extra = F.transform(F.array_except(F.map_keys("facts"), known), lambda k: F.concat(F.lit("unknown:"), k))
    found = F.array_sort(F.concat(F.array_compact(F.transform("rules", fault)), extra))
    faults = F.when(F.col("rules").isNull(), F.array(F.lit("tool"))).when(F.col("facts").isNull(), F.array(F.lit("json"))).otherwise(found)
    return joined.select("key", faults.alias("faults"))


def step(to: Column) -> Column:
    """What a link counts: 1 to a call, 0 to an id (a negative key)."""
    return (to >= 0).cast("long")


def anchors(calls: DataFrame, links: DataFrame) -> DataFrame:
    """calls: key; links: from, to -> key, anchor, steps, joint: the first call above each (or itself) without exactly one
    parent, the links up to it (those to a negative key, an id, don't count), and whether it has several.

    Pointers are doubled: after k rounds a call points 2 ** k links up, so rounds grow with the logarithm of the longest
    chain. Calls on or below a cycle of single parents never reach an anchor and are left out.
    """
    parents = saved(links.groupBy(F.col("to").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("from").alias("up")), "call-parents")
    kind = lambda n: F.when(n.isNull(), "root").when(n > 1, "joint")
    tops = calls.join(parents, "key", "left").where("n IS NULL OR n > 1").select("key", F.col("key").alias("anchor"), F.lit(0).cast("long").alias("steps"), kind(F.col("n")).alias("end"))
    above = parents.select(F.col("key").alias("up"), F.col("n").alias("m"))
    table = Table(parents.where("n = 1").join(above, "up", "left").select("key", F.col("up").alias("anchor"), step(F.col("key")).alias("steps"), kind(F.col("m")).alias("end")), "call-pointers")
    for _ in range(table.read().count().bit_length() + 1):
        ended, moving = table.read().where("end IS NOT NULL"), table.read().where("end IS NULL")
        if moving.isEmpty():
            break
        ahead = table.read().select(F.col("key").alias("anchor"), F.col("anchor").alias("a2"), F.col("steps").alias("s2"), F.col("end").alias("e2"))
        moved = moving.join(ahead, "anchor").select("key", F.col("a2").alias("anchor"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("e2").alias("end"))
        new = Table(ended.unionByName(moved), "call-pointers")
        table.drop()
        table = new
    every = tops.unionByName(table.read().where("end IS NOT NULL"))
    return saved(every.select("key", "anchor", "steps", (F.col("end") == "joint").alias("joint")), "call-anchors")


def levels(calls: DataFrame) -> DataFrame:
    """calls: conv_id, call_id, key, parents (call ids of the same conversation) -> key, level.

    A call's level is one more than the highest of its parents that exist; calls on a cycle, or below one, get none. An
    id that calls repeat is a node of its own between these calls and those that name it, so links grow with the rows.
    Chains of single parents are cut short first (see anchors). Calls with several parents are then placed round by
    round, once all their parents' anchors are placed, so there are as many rounds as such calls follow each other.
    """
    ids = calls.where("call_id IS NOT NULL").groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"))
    ids = saved(ids.select("c", "i", "n", F.when(F.col("n") > 1, -1 - F.col("low")).otherwise(F.col("low")).alias("node")), "call-ids")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    named = calls.select("key", "conv_id", F.explode(F.array_distinct("parents")).alias("parent"))
    links = named.join(ids, same & (F.col("parent") == F.col("i"))).select(F.col("node").alias("from"), F.col("key").alias("to"))
    repeated = ids.where("n > 1")
    links = saved(links.unionByName(calls.join(repeated, same & (F.col("call_id") == F.col("i"))).select(F.col("key").alias("from"), F.col("node").alias("to"))), "call-links")
    calls = calls.select("key").unionByName(repeated.select(F.col("node").alias("key")))
    found = anchors(calls, links)
    simple = found.where("NOT joint AND key >= 0").select("key", F.col("steps").alias("level"))
    waiting = found.where("joint AND steps = 0").select(F.col("key").alias("to"))
    if waiting.isEmpty():
        return simple
    up = found.select(F.col("key").alias("from"), "anchor", F.when(~F.col("joint"), F.col("steps")).alias("known"), F.col("steps").alias("more"))
    more = lambda c: (F.col(c) + step(F.col("to"))).alias(c)
    edges = saved(links.join(waiting, "to", "left_semi").join(up, "from", "left").select("to", "anchor", more("known"), more("more")), "joint-links")
    paths: list[str] = []
    schema = "anchor long, base long"
    while True:
        # one scan of all rounds' files: the plan stays as small in the last round as in the first
        placed = calls.sparkSession.read.schema(schema).parquet(*paths) if paths else calls.sparkSession.createDataFrame([], schema)
        ready = edges.join(placed, "anchor", "left").withColumn("level", F.coalesce("known", F.col("base") + F.col("more")))
        ready = ready.groupBy("to").agg(F.count(F.lit(1)).alias("n"), F.count("level").alias("placed"), F.max("level").alias("base")).where("n = placed")
        ready = ready.select(F.col("to").alias("anchor"), "base").join(placed.select("anchor"), "anchor", "left_anti")
        newest = Table(ready, "joint-levels")
        if newest.read().isEmpty():
            newest.drop()
            break
        paths.append(newest.path)
    below = found.where("joint AND key >= 0").join(placed, "anchor").select("key", (F.col("base") + F.col("steps")).alias("level"))
    return simple.unionByName(below)


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per row of calls: conv_id, call_id, seq, name, level, linked, faults, valid, message (canonical JSON).

    calls: conv_id, call_id, seq, name, arguments (JSON text), parents (array of call ids); results: conv_id, call_id,
    content; schemas: tool, arg, type (string, integer, number, boolean, array, object), required, low, high (bounds of a
    number or of a string's length; null: none). A call links to the least content of the results with its conversation
    and id; results without a call are left out, calls without a result or an id have a null content. Calls that repeat
    a conversation and id keep one row each and share a result. A null or malformed `arguments` has the fault `json`, a
    name without a schema `tool`. level is null for calls on a cycle or below one. Very long arguments and contents are taken
    whole. No rows give no rows.
    """
    plain = calls.select("conv_id", "call_id", "seq", "name", "parents", F.try_parse_json(F.col("arguments")).alias("args"), "arguments", F.monotonically_increasing_id().alias("key"))
    # arguments are parsed once for their facts and once for the message
    plain = saved(plain.withColumn("facts", argument_facts(F.col("args"))).drop("args"), "calls")
    found = results.groupBy(F.col("conv_id").alias("c"), F.col("call_id").alias("i")).agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    out = plain.join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("i")), "left").drop("c", "i")
    out = out.join(argument_faults(plain.select("key", "name", "facts"), schemas), "key", "left").join(levels(plain.select("conv_id", "call_id", "key", "parents")).withColumn("level", F.col("level").cast("int")), "key", "left")
    out = out.withColumn("linked", F.coalesce("linked", F.lit(False))).withColumn("valid", F.size("faults") == 0)
    # the members' names are in order; the arguments' are put in order by their variant
    message = F.struct(F.try_parse_json(F.col("arguments")).alias("arguments"), F.col("content"), F.col("call_id").alias("id"), F.col("level"), F.col("name"), F.array_sort(F.array_distinct("parents")).alias("parents"))
    text = F.to_json(message, {"ignoreNullFields": "false"})
    return out.select("conv_id", "call_id", "seq", "name", "level", "linked", "faults", "valid", text.alias("message"))


def calls_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads a conversation as tool use: each user turn calls a tool with its text, an assistant turn answers the turn
    before it, and a call builds on the one two turns before."""
    name = F.when(F.pmod("turn", F.lit(4)) == 2, "follow_up").otherwise("ask")
    ident = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    args = F.to_json(F.struct(F.col("text").alias("query"), words.alias("max_words"), F.when(F.col("turn") > 0, F.col("turn")).alias("context")))
    user = turns.where("role = 'user'")
    calls = user.select("conv_id", ident(F.col("turn")).alias("call_id"), F.col("turn").alias("seq"), name.alias("name"), args.alias("arguments"), F.array(ident(F.col("turn") - 2)).alias("parents"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SCHEMAS = """
SELECT * FROM VALUES
  ('ask', 'query', 'string', true, 1.0D, 2000.0D), ('ask', 'max_words', 'integer', true, 1.0D, 100.0D), ('ask', 'context', 'integer', false, 0.0D, null),
  ('follow_up', 'query', 'string', true, 1.0D, 2000.0D), ('follow_up', 'max_words', 'integer', true, 1.0D, 60.0D), ('follow_up', 'context', 'integer', true, 2.0D, null)
AS t(tool, arg, type, required, low, high)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link_calls(*calls_of(read_table(spark, sf_dir, "conversations")), spark.sql(SCHEMAS))
    return out.select("conv_id", "call_id", "seq", "name", "level", "linked", F.array_join("faults", ",").alias("faults"), "valid", F.sha2(F.encode("message", "UTF-8"), 256).alias("message_sha256"))


ORACLE = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'call_' || turn AS call_id, CASE WHEN turn % 4 = 2 THEN 'follow_up' ELSE 'ask' END AS name, text,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE role = 'user'),
res AS (SELECT conv_id, turn - 1 AS turn, min(text) AS content, TRUE AS linked FROM conversations WHERE role = 'assistant' GROUP BY ALL),
lev AS (
  SELECT conv_id, turn, 0 AS level FROM calls c WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
  UNION ALL SELECT c.conv_id, c.turn, level + 1 FROM lev JOIN calls c ON c.conv_id = lev.conv_id AND c.turn = lev.turn + 2),
faulty AS (
  SELECT c.*, content, coalesce(linked, FALSE) AS linked, level, list_sort(list_filter([
    CASE WHEN text IS NULL THEN 'missing:query' WHEN length(text) NOT BETWEEN 1 AND 2000 THEN 'range:query' END,
    CASE WHEN words IS NULL THEN 'missing:max_words' WHEN words NOT BETWEEN 1 AND CASE name WHEN 'ask' THEN 100 ELSE 60 END THEN 'range:max_words' END,
    CASE WHEN name = 'follow_up' AND turn < 2 THEN 'range:context' END], lambda x: x IS NOT NULL)) AS f
  FROM calls c LEFT JOIN res USING (conv_id, turn) LEFT JOIN lev USING (conv_id, turn)),
texts AS (
  SELECT *, '{"arguments":{' || concat_ws(',', CASE WHEN turn > 0 THEN '"context":' || turn END, '"max_words":' || words, '"query":' || CAST(to_json(text) AS VARCHAR))
    || '},"content":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"id":"' || call_id || '","level":' || coalesce(CAST(level AS VARCHAR), 'null')
    || ',"name":"' || name || '","parents":["call_' || (turn - 2) || '"]}' AS message FROM faulty)
SELECT conv_id, call_id, turn AS seq, name, level, linked, array_to_string(f, ',') AS faults, len(f) = 0 AS valid, sha256(message) AS message_sha256 FROM texts
"""
