"""Tool calls of conversations, linked, ordered, validated and written as canonical JSON.

* Linking: calls and results meet by a hash join on (conversation, call id).
* Order: a call may name the call whose result it uses. Calls so form trees; a
  call's depth is found by pointer doubling, each round of which doubles the way up that is known, so
  a chain of n calls takes log2(n) rounds, and no task ever holds a conversation. Calls that
  reach no root are in a cycle. By depth, then turn, then id, each call comes after what it uses.
* Validation: arguments are parsed once; every field of the tool's schema is checked for
  presence and type, and fields the schema does not know are reported.
* Canonical JSON: keys in order of code points, no blanks, numbers as numbers.

Everything is column expressions; no Python runs on rows. Schemas are one row per tool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vibralake.llm.texts import word_count
from vibralake.session import small_side, written

# JSON types by the name that Spark gives to the parsed value.
KINDS = {"STRING": "string", "BIGINT": "integer", "BOOLEAN": "boolean", "DOUBLE": "number", "FLOAT": "number", "VOID": "null"}


def kind_of(value: Column) -> Column:
    """JSON type of a parsed value; whole numbers are integers."""
    name = F.schema_of_variant(value)
    out = F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name.startswith("DECIMAL"), "number")
    for spark_name, json_name in KINDS.items():
        out = out.when(name == spark_name, json_name)
    return out.otherwise("null")


def depths(calls: DataFrame) -> DataFrame:
    """Calls (conv_id, call_id, parent_id) with ``depth``: 0 without a known parent, null in a cycle.

    ``call_id`` is unique in its conversation. A parent that is no call counts as none.
    """
    own = calls.select("conv_id", "call_id", "parent_id")
    up = own.select("conv_id", F.col("call_id").alias("parent_id"), F.lit(True).alias("known"))
    start = own.join(up, ["conv_id", "parent_id"], "left").select(
        "conv_id", "call_id", F.when(F.col("known"), F.col("parent_id")).alias("far"), F.when(F.col("known"), 1).otherwise(0).cast("long").alias("depth")
    )
    now = written(start, "depth")
    limit = max(1, now.count()).bit_length() + 1
    for _ in range(limit):
        if now.filter("far is not null").isEmpty():
            break
        # roots have nothing above; only what still has is joined
        above = now.select("conv_id", F.col("call_id").alias("far"), F.col("far").alias("further"), F.col("depth").alias("more"))
        step = now.join(above, ["conv_id", "far"], "left")
        now = written(
            step.select("conv_id", "call_id", F.col("further").alias("far"), (F.col("depth") + F.coalesce("more", F.lit(0).cast("long"))).alias("depth")),
            "depth",
        )
    return now.select("conv_id", "call_id", F.when(F.col("far").isNull(), F.col("depth")).alias("depth"))


def checked(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``errors``, an array of strings in order of their text, and ``parsed`` (variant).

    ``schemas``: name, fields array<struct<field string, kind string, required boolean>>. A number may be an
    integer. Arguments that are no JSON object, and tools without schema, are errors.
    """
    parsed = calls.withColumn("parsed", F.try_parse_json("arguments"))
    known = parsed.join(small_side(schemas.withColumnRenamed("name", "_name")), F.col("name") == F.col("_name"), "left")
    is_object = F.coalesce(F.schema_of_variant("parsed").startswith("OBJECT"), F.lit(False))
    values = F.when(is_object, F.col("parsed")).cast("map<string,variant>")
    held = known.withColumn("_values", values)

    def problem(f: Column) -> Column:
        value = F.element_at("_values", f["field"])
        kind = kind_of(value)
        there = F.array_contains(F.map_keys("_values"), f["field"])
        fits = (kind == f["kind"]) | ((f["kind"] == "number") & (kind == "integer"))
        return (
            F.when(~there & f["required"], F.concat(F.lit("missing "), f["field"]))
            .when(there & ~fits, F.concat(F.lit("type "), f["field"]))
            .otherwise(F.lit(""))
        )

    known_fields = F.transform("fields", lambda f: f["field"])
    strange = F.transform(F.array_except(F.map_keys("_values"), known_fields), lambda k: F.concat(F.lit("unknown "), k))
    wrong = F.filter(F.concat(F.transform("fields", problem), strange), lambda e: e != "")
    errors = (
        F.when(~is_object, F.array(F.lit("arguments are no object")))
        .when(F.col("fields").isNull(), F.array(F.lit("unknown tool")))
        .otherwise(F.array_sort(wrong))
    )
    return held.withColumn("errors", errors).drop("_name", "fields", "_values")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result without a call.

    calls: conv_id, turn, call_id, parent_id, name, arguments (JSON text); results: conv_id, turn, call_id, content. Of rows
    that repeat a call id in a conversation the first by turn, name and arguments counts, of results the first by
    turn and content; the others appear as ``repeated``. Rows without conversation or call id are
    ``unnamed`` and link with nothing.

    Returns conv_id, turn, call_id, status (linked, open, orphan, repeated, unnamed), depth, errors and
    json, the canonical line, null but for linked and open calls.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    def once(rows: DataFrame, columns: list[str]) -> DataFrame:
        order = Window.partitionBy("conv_id", "call_id").orderBy(*columns)
        return rows.withColumn("_n", F.when(named, F.row_number().over(order)))

    call_rows, result_rows = written(once(calls, ["turn", "name", "arguments"]), "calls"), once(results, ["turn", "content"])
    unique = call_rows.filter("_n = 1").drop("_n")
    answers = result_rows.filter("_n = 1").select("conv_id", "call_id", F.col("content"), F.lit(True).alias("_answered"))
    placed = checked(unique, schemas).join(depths(unique), ["conv_id", "call_id"])
    both = placed.join(answers, ["conv_id", "call_id"], "left")
    line = F.to_json(
        F.struct(
            F.coalesce(F.col("parsed"), F.try_parse_json(F.lit("null"))).alias("arguments"), F.col("call_id").alias("id"),
            F.col("name").alias("name"), F.col("content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    columns = ["conv_id", "turn", "call_id", "status", "depth", "errors", "json"]
    out = both.withColumn("status", F.when(F.col("_answered"), "linked").otherwise("open")).withColumn("json", line).select(columns)
    empty = {"depth": F.lit(None).cast("long"), "errors": F.array().cast("array<string>"), "json": F.lit(None).cast("string")}

    def rest(rows: DataFrame, status: Column) -> DataFrame:
        return rows.withColumns({"status": status, **empty}).select(columns)

    other = F.when(F.col("_n").isNull(), "unnamed").otherwise("repeated")
    out = out.unionByName(rest(call_rows.filter("_n is null or _n > 1"), other))
    out = out.unionByName(rest(result_rows.filter("_n is null or _n > 1"), other))
    orphans = result_rows.filter("_n = 1").join(unique.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti")
    return out.unionByName(rest(orphans, F.lit("orphan")))


def calls_in(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas read out of plain conversations (conv_id, turn, role, text).

    Every turn of the assistant asks a tool, named by the length of the turn, and the turn after it
    holds the result. A call uses the result of the assistant's turn two before, if there is one.
    """
    words = word_count("text")
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.when(words >= 100, "report").when(words >= 20, "answer").otherwise("note")

    def call_id(turn: Column) -> Column:
        return F.concat(F.lit("call-"), turn.cast("string"))

    arguments = F.struct(text.alias("text"), words.alias("words"))
    wide = F.struct(F.col("role").alias("author"), text.alias("text"), words.alias("words"))
    calls = turns.filter("role = 'assistant'").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"), call_id(F.col("turn") - 2).alias("parent_id"), name.alias("name"),
        F.when(words >= 100, F.to_json(wide)).otherwise(F.to_json(arguments)).alias("arguments"),
    )
    results = turns.filter("role <> 'assistant' and turn > 0").select("conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    spark = turns.sparkSession
    fields = [("text", "string", True), ("words", "integer", True)]
    table = [("answer", fields), ("report", [*fields, ("title", "string", True)]), ("note", [("text", "string", True)])]
    schema = "name string, fields array<struct<field:string,kind:string,required:boolean>>"
    return calls, results, spark.createDataFrame(table, schema)
