"""Operation logs derived from ordinary tables.

An operation log has one row for each run of units that a client wrote:
doc_id, client, clock (of its first unit), len, and what it holds. Clocks of a
client in a document run on without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.text import utf16_length
from tideline.plans.scratch import materialize

#: Events of a document, about, and the least number of documents that events are dealt over: edits, and trees of items.
DOC_EVENTS, EDIT_DOCS, TREE_DOCS = 500, 20, 200
#: Documents, about, whose events meet in one task.
TASK_DOCS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(events: DataFrame, least: int) -> int:
    return max(least, events.count() // DOC_EVENTS)


def _dealt(events: DataFrame, docs: int) -> DataFrame:
    """``events`` with ``doc_id``: documents grow in number with the table, not in length."""
    return events.withColumn("doc_id", F.col("event_id") % docs)


def _dealt_sql(least: int) -> str:
    return f"SELECT *, event_id % (SELECT greatest({least}, count(*) // {DOC_EVENTS}) FROM events) AS doc_id FROM events"


def edits(events: DataFrame) -> DataFrame:
    """(doc_id, client, clock, len, key, value, ts, deletes): each event as one operation of its user; errors are deletions.

    The log lies by document and client. Tasks grow in number with the table, so
    what is sorted or counted by these keys later takes no more memory in a task.
    """
    own = Window.partitionBy("doc_id", "client").orderBy("ts", "event_id")
    docs = _docs(events, EDIT_DOCS)
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-docs // TASK_DOCS))
    return (
        _dealt(events, docs).select("doc_id", F.col("user_id").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("key"), "value", "event_type")
        .repartition(tasks, "doc_id", "client")
        .withColumn("clock", (F.row_number().over(own) - 1).cast("long"))
        .select("doc_id", "client", "clock", F.lit(1).cast("long").alias("len"), "key", "value", "ts", "event_type", (F.col("event_type") == "error").alias("deletes"))
    )


EDITS_SQL = f"""
  SELECT doc_id, user_id AS client, CAST(row_number() OVER (PARTITION BY doc_id, user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS clock,
    CAST(1 AS BIGINT) AS len, props AS key, value, ts, event_type, event_type = 'error' AS deletes
  FROM ({_dealt_sql(EDIT_DOCS)})
"""


def tree_items(events: DataFrame) -> DataFrame:
    """(doc_id, client, clock, origin_client, origin_clock): items that each stand after their origin, null for the start."""
    rows = _dealt(events, _docs(events, TREE_DOCS)).select("doc_id", F.col("user_id").alias("client"), F.col("event_id").alias("clock")).withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("clock")) - 1)
    at = F.when(F.col("i") % 4 == 0, F.floor(F.col("i") / 2)).otherwise(F.col("i") - 1).cast("int")
    rows = rows.withColumn("origin_i", F.when(F.col("i") > 0, at))
    origins = rows.select(F.col("doc_id"), F.col("i").alias("origin_i"), F.col("client").alias("origin_client"), F.col("clock").alias("origin_clock"))
    return rows.join(origins, ["doc_id", "origin_i"], "left").select("doc_id", "client", "clock", "origin_client", "origin_clock")


_TREE_ROWS = f"SELECT doc_id, user_id AS client, event_id AS clock, row_number() OVER (PARTITION BY doc_id ORDER BY event_id) - 1 AS i FROM ({_dealt_sql(TREE_DOCS)})"
TREE_SQL = f"""
  SELECT a.doc_id, a.client, a.clock, b.client AS origin_client, b.clock AS origin_clock FROM (
    SELECT *, CASE WHEN i = 0 THEN NULL WHEN i % 4 = 0 THEN i // 2 ELSE i - 1 END AS origin_i FROM ({_TREE_ROWS})
  ) a LEFT JOIN ({_TREE_ROWS}) b ON a.doc_id = b.doc_id AND a.origin_i = b.i
"""


def turns(conversations: DataFrame) -> DataFrame:
    """(doc_id, client, clock, content, deleted): each turn as an item of its conversation; every fifth is deleted."""
    return conversations.select(F.col("conv_id").alias("doc_id"), F.when(F.col("role") == "assistant", 1).otherwise(0).cast("long").alias("client"), F.col("turn").alias("clock"), F.col("text").alias("content"), (F.col("turn") % 5 == 3).alias("deleted"))


TURNS_SQL = "SELECT conv_id AS doc_id, CAST(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS BIGINT) AS client, turn AS clock, text AS content, turn % 5 = 3 AS deleted FROM conversations"


#: What each turn of a conversation writes, in order, and the client: texts that land inside others are written by a client of their own.
WRITER = 7
_ID = "struct<client:bigint,clock:bigint>"


def conversation_log(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(structs, deleted ranges): each conversation as a document of five types, its runs many units long.

    * ``body``, a text: turns of even place follow each other; one of odd place
      stands in the middle of the turn before it, written by client 5 in
      conversations of even id and by client 9 in others. The second and third
      unit of even turns are deleted.
    * ``turns``, a list: turn and role of each turn; every third turn's first
      value is deleted.
    * ``last``, a map: the last turn of each role; entries of each fourth place
      are deleted.
    * ``page``, XML: an element for each turn with its role and text; each
      fourth is deleted.
    * ``rich``, a text: the role in bold, then the text, cursive in odd turns.
    """
    role = F.coalesce("role", F.lit(""))
    rows = conversations.select(F.col("conv_id").alias("doc_id"), "turn", role.alias("role"), F.concat(role, F.lit(": "), F.coalesce("text", F.lit(""))).alias("text"))
    rows = rows.withColumn("i", (F.row_number().over(Window.partitionBy("doc_id").orderBy("turn")) - 1).cast("long"))
    odd, json_role = F.col("i") % 2 == 1, F.concat(F.lit('"'), "role", F.lit('"'))
    part = lambda k, kind, parent=None, sub=None, text=None, vals=None, key=None, cls=None, name=None: F.struct(
        F.lit(k).alias("k"), F.lit(kind).alias("content_type"), F.lit(parent).alias("root"), (F.lit(None).cast("string") if sub is None else sub).alias("parent_sub"), (F.lit(None).cast("string") if text is None else text).alias("str"),
        (F.lit(None).cast("array<string>") if vals is None else F.array(*vals)).alias("vals"), F.lit(key).cast("string").alias("fmt_key"), F.lit(cls).cast("int").alias("type_class"), F.lit(name).cast("string").alias("node_name")
    )
    turn = F.col("turn").cast("string")
    parts = F.array(
        part(0, "string", "body", text=F.col("text")), part(1, "any", "turns", vals=[turn, json_role]), part(2, "any", "last", sub=F.col("role"), vals=[turn]),
        part(3, "type", "page", cls=3, name="turn"), part(4, "any", sub=F.lit("role"), vals=[json_role]), part(5, "type", cls=6), part(6, "string", text=F.col("text")),
        part(7, "format", "rich", vals=[F.lit("true")], key="bold"), part(8, "string", "rich", text=F.col("role")), part(9, "format", "rich", vals=[F.lit("null")], key="bold"),
        part(10, "format", "rich", vals=[F.when(odd, "true").otherwise("null")], key="italic"), part(11, "string", "rich", text=F.col("text")),
    )
    log = rows.select("doc_id", "i", "turn", "role", F.inline(parts))
    inner = (F.col("k") == 0) & (F.col("i") % 2 == 1)
    units = F.when(F.col("content_type") == "string", utf16_length(F.col("str"))).when(F.col("content_type") == "any", F.size("vals")).otherwise(1).cast("long")
    log = log.withColumn("client", F.when(inner, F.when(F.col("doc_id") % 2 == 0, 5).otherwise(9)).otherwise(WRITER).cast("long")).withColumn("len", units)
    log = materialize(log, "turns").where("len > 0")
    before = Window.partitionBy("doc_id", "client").orderBy("i", "k").rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("clock", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long"))
    # What a run stands after: the last unit of the run before it in its chain; for texts inside others a unit in the middle of the even turn before.
    chain = F.when(inner, F.lit(None)).when(F.col("k") == 2, F.concat(F.lit("last"), "role")).when(F.col("root").isNotNull(), F.col("root"))
    log = log.withColumn("chain", F.coalesce(chain, F.concat_ws("/", F.lit("alone"), "i", "k")))
    ident = lambda clock: F.struct(F.lit(WRITER).cast("long").alias("client"), clock.cast("long").alias("clock"))
    last = F.lag(F.col("clock") + F.col("len") - 1).over(Window.partitionBy("doc_id", "chain").orderBy("i", "k"))
    middle = F.last(F.when((F.col("k") == 0) & ~inner, F.col("clock") + F.floor(F.col("len") / 2) - 1), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("i", "k").rowsBetween(Window.unboundedPreceding, 0))
    in_turn = Window.partitionBy("doc_id", "i")
    element, inside = (F.max(F.when(F.col("k") == k, F.col("clock"))).over(in_turn) for k in (3, 5))
    log = log.withColumns({"at": F.when(inner, middle).otherwise(last), "up": F.when(F.col("k").isin(4, 5), element).when(F.col("k") == 6, inside)})
    log = materialize(log, "log")
    none = lambda kind: F.lit(None).cast(kind)
    free = F.col("at").isNull()
    structs = log.select(
        "doc_id", "client", "clock", "len", F.when(~free, ident(F.col("at"))).alias("origin"), none(_ID).alias("right_origin"), F.when(free & F.col("up").isNull(), F.col("root")).alias("parent_name"),
        F.when(free & F.col("up").isNotNull(), ident(F.col("up"))).alias("parent_id"), "parent_sub", "content_type", "str", none("binary").alias("bin"), "vals", "fmt_key", "type_class", "node_name",
        none(_ID).alias("move_target"), none("long").alias("move_len"), "i", "k",
    )
    cut = F.when((F.col("k") == 0) & (F.col("i") % 2 == 0), F.struct((F.col("clock") + 1).alias("clock"), F.lit(2).cast("long").alias("len")))
    cut = cut.when((F.col("k") == 1) & (F.col("i") % 3 == 2), F.struct("clock", F.lit(1).cast("long").alias("len"))).when(F.col("k").isin(2, 3) & (F.col("i") % 4 == 3), F.struct("clock", F.lit(1).cast("long").alias("len")))
    ranges = structs.select("doc_id", "client", cut.alias("cut")).where("cut is not null").select("doc_id", "client", "cut.clock", "cut.len")
    return structs.drop("i", "k"), ranges


TALK_SQL = """
  SELECT conv_id AS doc_id, turn, coalesce(role, '') AS role, coalesce(role, '') || ': ' || coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
"""
