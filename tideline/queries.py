"""The registered queries on operation logs, each over the driver's whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import text as tx
from tideline.operators import content, edit, history, order, positions, presence, state, values
from tideline.operators.runs import mark_deleted
from tideline.plans.scratch import materialize, scratch_dir
from tideline.sources import messages
from tideline.sources.columnar import decode_columnar, encode_columnar
from tideline.sources.tables import EDITS_SQL, TALK_SQL, TREE_SQL, TURNS_SQL, conversation_log, edits, table, tree_items, turns
from tideline.sources.updates import decode_state_vectors, decode_updates, resolve_parents
from tideline.sources.wire import encode_in_parts, encode_presence, encode_snapshots, encode_state_vectors, encode_updates, presence_frame, sync_frame, sync_message
from tideline.streaming import live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

EARLY = "2024-01-16"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "events"))


def _early(log: DataFrame) -> DataFrame:
    return log.where(F.col("ts") < F.lit(EARLY).cast("timestamp"))


_DELETE_SET_SQL = """
  SELECT doc_id, client, min(clock) AS clock, CAST(count(*) AS BIGINT) AS len
  FROM (SELECT *, clock - row_number() OVER (PARTITION BY doc_id, client ORDER BY clock) AS island FROM {log} WHERE deletes)
  GROUP BY doc_id, client, island
"""


@query(f"SELECT doc_id, client, CAST(max(clock + len) AS BIGINT) AS next_clock FROM ({EDITS_SQL}) GROUP BY ALL")
def state_vector(spark, sf_dir):
    return state.state_vector(_log(spark, sf_dir))


@query(_DELETE_SET_SQL.format(log=f"({EDITS_SQL})"))
def delete_set(spark, sf_dir):
    return state.delete_set(_log(spark, sf_dir))


@query(f"""
WITH log AS ({EDITS_SQL}), units AS (
  SELECT DISTINCT doc_id, client, unnest(range(clock, clock + CASE WHEN event_type = 'view' THEN 3 ELSE 1 END)) AS unit FROM log WHERE event_type IN ('error', 'view')
)
SELECT doc_id, client, CAST(min(unit) AS BIGINT) AS clock, CAST(count(*) AS BIGINT) AS len
FROM (SELECT *, unit - row_number() OVER (PARTITION BY doc_id, client ORDER BY unit) AS island FROM units) GROUP BY doc_id, client, island
""")
def delete_set_merge(spark, sf_dir):
    log = _log(spark, sf_dir)
    wide = log.where("event_type = 'view'").select("doc_id", "client", "clock", F.lit(3).cast("long").alias("len"))
    return state.merge_delete_sets(state.delete_set(log), wide)


@query(f"""
WITH log AS ({EDITS_SQL})
SELECT doc_id, client, clock, event_type FROM log a WHERE EXISTS (SELECT 1 FROM log b WHERE b.deletes AND b.doc_id = a.doc_id AND b.client = a.client AND a.clock IN (b.clock, b.clock - 1))
""")
def is_deleted(spark, sf_dir):
    log = _log(spark, sf_dir)
    firsts = log.where("deletes and clock = 0").select("doc_id", "client", "clock", "len")
    rest = log.where("deletes and clock > 0").select("doc_id", "client", (F.col("clock") - 1).alias("clock"), F.lit(2).cast("long").alias("len"))
    return state.in_delete_set(log, state.merge_delete_sets(firsts, rest)).select("doc_id", "client", "clock", "event_type")


@query(f"SELECT doc_id, client, clock, clock - clock % 4 AS run_clock, clock % 4 AS \"offset\" FROM ({EDITS_SQL}) WHERE deletes")
def find_item(spark, sf_dir):
    log = _log(spark, sf_dir)
    runs = log.groupBy("doc_id", "client", (F.col("clock") - F.col("clock") % 4).alias("run_clock")).agg(F.count("*").alias("len")).withColumnRenamed("run_clock", "clock")
    return state.find_containing(runs, log.where("deletes").select("doc_id", "client", "clock"))


@query(f"""
WITH log AS ({EDITS_SQL}), last AS (SELECT doc_id, key, client, clock, value, deletes, row_number() OVER (PARTITION BY doc_id, key ORDER BY clock DESC, client DESC) AS n FROM log)
SELECT doc_id, key, client, clock, value FROM last WHERE n = 1 AND NOT deletes
""")
def map_lww(spark, sf_dir):
    return values.map_value(_log(spark, sf_dir))


@query(f"""
WITH log AS ({EDITS_SQL}), last AS (SELECT doc_id, key, deletes, row_number() OVER (PARTITION BY doc_id, key ORDER BY clock DESC, client DESC) AS n FROM log)
SELECT doc_id, count(*) AS n_keys, string_agg(key, ',' ORDER BY key) AS keys FROM last WHERE n = 1 AND NOT deletes GROUP BY doc_id
""")
def map_keys(spark, sf_dir):
    pairs = values.map_value(_log(spark, sf_dir))
    return pairs.groupBy("doc_id").agg(F.count("*").alias("n_keys"), F.array_join(F.array_sort(F.collect_list("key")), ",").alias("keys"))


@query(f"""
WITH log AS ({EDITS_SQL}), last AS (SELECT doc_id, key, value, deletes, row_number() OVER (PARTITION BY doc_id, key ORDER BY clock DESC, client DESC) AS n FROM log)
SELECT doc_id, count(*) AS n_keys, '{{' || string_agg(to_json(key) || ':' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY key) || '}}' AS json FROM last WHERE n = 1 AND NOT deletes GROUP BY doc_id
""")
def map_json(spark, sf_dir):
    """Values as whole hundredths, which both engines write alike."""
    return values.map_entries(_log(spark, sf_dir).withColumn("value", F.floor(F.col("value") * 100)))


@query(f"""
WITH log AS ({EDITS_SQL}), known AS (SELECT doc_id, client, max(clock) + 1 AS next_clock FROM log WHERE ts < TIMESTAMP '{EARLY}' GROUP BY ALL)
SELECT doc_id, client, clock, len FROM log LEFT JOIN known USING (doc_id, client) WHERE clock >= coalesce(next_clock, 0)
""")
def diff_since(spark, sf_dir):
    log = _log(spark, sf_dir)
    return state.diff_since(log, state.state_vector(_early(log))).select("doc_id", "client", "clock", "len")


@query(f"SELECT doc_id, client, clock, event_type FROM ({EDITS_SQL}) WHERE event_type <> 'signup' OR clock % 2 = 0")
def merge_updates(spark, sf_dir):
    log = _log(spark, sf_dir)
    one, two = log.where("event_type <> 'signup'"), log.where("clock % 2 = 0")
    return state.merge_updates(one, two).select("doc_id", "client", "clock", "event_type")


@query(f"""
WITH log AS ({EDITS_SQL}) SELECT doc_id, bool_and(ts < TIMESTAMP '{EARLY}' OR client % 10 > 0) AS equal FROM log GROUP BY doc_id
""")
def equal_snapshots(spark, sf_dir):
    log = _log(spark, sf_dir)
    return state.equal_states(log, log.where((F.col("ts") < F.lit(EARLY).cast("timestamp")) | (F.col("client") % 10 > 0)))


@query(f"""
WITH log AS (SELECT * FROM ({EDITS_SQL}) WHERE NOT (event_type = 'click' AND client % 3 = 0 AND clock % 7 = 5)),
gaps AS (SELECT *, clock - (row_number() OVER (PARTITION BY doc_id, client ORDER BY clock) - 1) > 0 AS parked FROM log)
SELECT doc_id, client, clock, parked, CASE WHEN parked THEN CAST(count(*) FILTER (NOT parked) OVER (PARTITION BY doc_id, client) AS BIGINT) END AS missing_from FROM gaps
""")
def park_gaps(spark, sf_dir):
    log = _log(spark, sf_dir).where("not (event_type = 'click' and client % 3 = 0 and clock % 7 = 5)")
    return state.park_gaps(log).select("doc_id", "client", "clock", "parked", "missing_from")


@query(f"""
WITH RECURSIVE items AS (SELECT * FROM ({TREE_SQL}) WHERE clock % 97 <> 13), ready AS (
  SELECT doc_id, client, clock FROM items WHERE origin_clock IS NULL
  UNION ALL SELECT i.doc_id, i.client, i.clock FROM items i JOIN ready r ON i.doc_id = r.doc_id AND i.origin_client = r.client AND i.origin_clock = r.clock
)
SELECT * FROM ready
""")
def causally_ready(spark, sf_dir):
    items = tree_items(table(spark, sf_dir, "events")).where("clock % 97 <> 13")
    return state.causally_ready(items).select("doc_id", "client", "clock")


@query(f"""
WITH RECURSIVE items AS ({TREE_SQL}), tree AS (
  SELECT doc_id, client, clock, [{{'a': client, 'b': -clock}}] AS path FROM items WHERE origin_clock IS NULL
  UNION ALL SELECT i.doc_id, i.client, i.clock, list_append(t.path, {{'a': i.client, 'b': -i.clock}}) FROM items i JOIN tree t ON i.doc_id = t.doc_id AND i.origin_client = t.client AND i.origin_clock = t.clock
)
SELECT doc_id, client, clock, row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1 AS pos FROM tree
""")
def sequence_order(spark, sf_dir):
    return order.origin_tree_order(tree_items(table(spark, sf_dir, "events"))).select("doc_id", "client", "clock", "pos")


@query(f"SELECT doc_id, string_agg(content, '' ORDER BY clock) AS text, count(*) AS n FROM ({TURNS_SQL}) WHERE NOT deleted GROUP BY doc_id")
def text_value(spark, sf_dir):
    return values.text_value(turns(table(spark, sf_dir, "conversations")), [F.col("clock")])


@query(f"SELECT doc_id, CAST(sum(length(content) + len(regexp_extract_all(content, '[\\x{{10000}}-\\x{{10FFFF}}]'))) AS BIGINT) AS units FROM ({TURNS_SQL}) WHERE NOT deleted GROUP BY doc_id")
def text_length(spark, sf_dir):
    return turns(table(spark, sf_dir, "conversations")).where("not deleted").groupBy("doc_id").agg(F.sum(tx.utf16_length(F.col("content"))).alias("units"))


@query(f"SELECT doc_id, list(content ORDER BY clock) AS items FROM ({TURNS_SQL}) WHERE NOT deleted GROUP BY doc_id")
def list_value(spark, sf_dir):
    return values.list_value(turns(table(spark, sf_dir, "conversations")), [F.col("clock")])


@query(f"""
SELECT doc_id, pos, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY clock) - 1 AS pos FROM ({TURNS_SQL}) WHERE NOT deleted) WHERE pos >= 1 AND pos < 4
""")
def list_slice(spark, sf_dir):
    return values.list_slice(turns(table(spark, sf_dir, "conversations")), [F.col("clock")], 1, 4).select("doc_id", "pos", "content")


@query(f"""
WITH items AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY clock) - 1 AS rank FROM ({TURNS_SQL}) WHERE NOT deleted),
first AS (SELECT doc_id, clock, arg_min(to_rank, mover) AS to_rank FROM (
  SELECT doc_id, clock, 5 AS mover, 0 AS to_rank FROM ({TURNS_SQL}) WHERE clock % 4 = 2 UNION ALL SELECT doc_id, clock, 2, 2 FROM ({TURNS_SQL}) WHERE clock % 8 = 6) GROUP BY ALL)
SELECT doc_id, client, clock, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(to_rank, rank), to_rank IS NULL, rank) - 1 AS pos FROM items LEFT JOIN first USING (doc_id, clock)
""")
def list_move(spark, sf_dir):
    items = turns(table(spark, sf_dir, "conversations"))
    move = lambda rows, mover, to: rows.select("doc_id", F.col("client").alias("target_client"), F.col("clock").alias("target_clock"), F.lit(mover).alias("client"), F.col("clock"), F.lit(to).cast("long").alias("to_rank"))
    moves = move(items.where("clock % 4 = 2"), 5, 0).unionByName(move(items.where("clock % 8 = 6"), 2, 2))
    return values.list_move(items, moves, [F.col("clock")]).select("doc_id", "client", "clock", "pos")


def _marked(spark, sf_dir) -> DataFrame:
    log = _log(spark, sf_dir)
    return log.select("doc_id", F.col("client"), F.col("clock"), F.col("event_type").alias("content"), F.col("event_type").isin("signup", "error").alias("is_marker"), F.when(F.col("event_type") == "signup", F.col("key")).alias("attribute"))


@query(f"""
WITH runs AS (SELECT *, event_type IN ('signup', 'error') AS is_marker, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY clock, client) AS run FROM ({EDITS_SQL}))
SELECT doc_id, CAST(run AS BIGINT) AS run, string_agg(event_type, '' ORDER BY clock, client) FILTER (NOT is_marker) AS text, max(key) FILTER (event_type = 'signup') AS attribute
FROM runs GROUP BY doc_id, run HAVING count(*) FILTER (NOT is_marker) > 0
""")
def rich_text_runs(spark, sf_dir):
    return values.attribute_runs(_marked(spark, sf_dir), [F.col("clock"), F.col("client")])


@query(f"""
WITH items AS (
  SELECT doc_id, clock, client, event_type AS content, CASE WHEN ts >= TIMESTAMP '{EARLY}' AND NOT deletes THEN 'insert' WHEN ts < TIMESTAMP '{EARLY}' AND deletes AND clock % 2 = 0 THEN 'delete' WHEN ts < TIMESTAMP '{EARLY}' AND NOT deletes THEN 'retain' END AS op
  FROM ({EDITS_SQL})
), marked AS (SELECT *, CASE WHEN lag(op) OVER w = op THEN 0 ELSE 1 END AS starts FROM items WHERE op IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY clock, client)),
steps AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY clock, client) AS step FROM marked),
merged AS (SELECT doc_id, step, any_value(op) AS op, string_agg(content, '' ORDER BY clock, client) AS content, sum(length(content)) AS n FROM steps GROUP BY doc_id, step)
SELECT doc_id, CAST(step AS BIGINT) AS step, op, CASE WHEN op = 'insert' THEN content END AS insert, CAST(n AS BIGINT) AS n FROM merged
QUALIFY NOT (op = 'retain' AND step = max(step) OVER (PARTITION BY doc_id))
""")
def text_delta(spark, sf_dir):
    log = _log(spark, sf_dir).select("doc_id", "client", "clock", F.col("event_type").alias("content"), F.col("deletes").alias("deleted"), "ts")
    new = F.col("ts") >= F.lit(EARLY).cast("timestamp")
    return values.text_delta(log, [F.col("clock"), F.col("client")], new, F.col("clock") % 2 == 1)


@query("""
WITH c AS (SELECT c_nationkey, '<customer key="' || c_custkey || '">' || replace(replace(replace(c_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</customer>' AS xml, c_custkey FROM customer),
n AS (SELECT n_regionkey, n_nationkey, '<nation name="' || replace(replace(replace(n_name, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '">' || coalesce(string_agg(xml, '' ORDER BY c_custkey), '') || '</nation>' AS xml FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT r_regionkey, '<region name="' || replace(replace(replace(r_name, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') || '">' || coalesce(string_agg(xml, '' ORDER BY n_nationkey), '') || '</region>' AS xml
FROM region LEFT JOIN (SELECT n_regionkey, n_nationkey, any_value(xml) AS xml FROM (SELECT n_regionkey, n_nationkey, xml FROM n) GROUP BY 1, 2) ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
""".replace("FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY ALL", "FROM nation LEFT JOIN c ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey, n_name"))
def xml_tree(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    leaf = t("customer").withColumn("xml", values.xml_element("customer", {"key": F.col("c_custkey")}, values.xml_text(F.col("c_name"))))
    below = values.xml_children(leaf, "c_nationkey", ["c_custkey"])
    nations = t("nation").join(below, F.col("n_nationkey") == F.col("c_nationkey"), "left").withColumn("xml", values.xml_element("nation", {"name": F.col("n_name")}, F.col("children"))).drop("children")
    above = values.xml_children(nations, "n_regionkey", ["n_nationkey"])
    return t("region").join(above, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("r_regionkey", values.xml_element("region", {"name": F.col("r_name")}, F.col("children")).alias("xml"))


@query("SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS text, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') AS attribute FROM pages")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.xml_escape_text(F.col("html")).alias("text"), tx.xml_escape_attribute(F.col("html")).alias("attribute"))


@query("SELECT doc_id, CAST(length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS BIGINT) AS units FROM documents")
def utf16_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.utf16_length(F.col("text")).alias("units"))


@query("""
WITH wide AS (SELECT doc_id, replace(text, 'e', chr(128522)) AS text FROM documents), units AS (
  SELECT *, sum(CASE WHEN ord(c) > 65535 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS after
  FROM (SELECT doc_id, unnest(range(1, length(head) + 1)) AS i, unnest(string_split(head, '')) AS c FROM (SELECT doc_id, substr(text, 1, 60) AS head FROM wide) WHERE head <> '')
), parts AS (SELECT doc_id, i, CASE WHEN ord(c) <= 65535 THEN CASE WHEN after BETWEEN 11 AND 50 THEN c END
    WHEN after BETWEEN 12 AND 50 THEN c WHEN after IN (11, 51) THEN chr(65533) END AS c FROM units)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(c, '' ORDER BY i), '') END AS part FROM documents d LEFT JOIN parts p USING (doc_id) GROUP BY d.doc_id, d.text
""")
def utf16_slice(spark, sf_dir):
    """40 units from the eleventh on, every e being a character of two units: half of one becomes the replacement character."""
    wide = F.replace("text", F.lit("e"), F.lit("\U0001F60A"))
    return table(spark, sf_dir, "documents").select("doc_id", tx.utf16_slice(wide, 10, 40).alias("part"))


@query("SELECT page_id, octet_length(encode(url)) BETWEEN 1 AND 255 AND url NOT IN ('.', '..') AND NOT regexp_matches(url, '[\\x00-\\x1F\\x7F]') AS valid FROM pages")
def room_name_valid(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.room_name_valid(F.col("url")).alias("valid"))


@query("SELECT event_id, CAST(CASE WHEN event_id % 9 = 4 THEN NULL ELSE 1 + event_id % 7 END AS INT) AS depth FROM events")
def json_depth(spark, sf_dir):
    """Events nested 1 to 7 deep behind strings of brackets and escaped quotes; some end within a string."""
    depth = (F.col("event_id") % 7).cast("int")
    nested = F.concat(F.repeat(F.lit('{"[{\\\\\\"[": ['), F.floor(depth / 2).cast("int")), F.when(depth % 2 == 1, F.concat(F.lit("["), "props", F.lit("]"))).otherwise(F.col("props")), F.repeat(F.lit("]}"), F.floor(depth / 2).cast("int")))
    nested = F.when(F.col("event_id") % 9 == 4, F.concat(nested, F.lit('"'))).otherwise(nested)
    return table(spark, sf_dir, "events").select("event_id", tx.json_depth(nested).alias("depth"))


@query(f"""
WITH log AS ({EDITS_SQL}), early AS (SELECT * FROM log WHERE ts < TIMESTAMP '{EARLY}'),
sv AS (SELECT doc_id, client, CAST(max(clock) + 1 AS BIGINT) AS next_clock FROM early GROUP BY ALL), ds AS ({_DELETE_SET_SQL.format(log='early')}),
s AS (SELECT doc_id, string_agg(client || ':' || next_clock, ',' ORDER BY client) AS sv FROM sv GROUP BY doc_id),
d AS (SELECT doc_id, string_agg(client || ':' || clock || '+' || len, ',' ORDER BY client, clock) AS ds FROM ds GROUP BY doc_id)
SELECT doc_id, sv, coalesce(ds, '') AS ds FROM s LEFT JOIN d USING (doc_id)
""")
def snapshot(spark, sf_dir):
    taken = history.capture_snapshot(_early(_log(spark, sf_dir)))
    vector = F.array_join(F.transform("sv", lambda x: F.concat(x["client"].cast("string"), F.lit(":"), x["next_clock"].cast("string"))), ",")
    ranges = F.array_join(F.transform("ds", lambda x: F.concat(x["client"].cast("string"), F.lit(":"), x["clock"].cast("string"), F.lit("+"), x["len"].cast("string"))), ",")
    return taken.select("doc_id", vector.alias("sv"), ranges.alias("ds"))


@query(f"SELECT doc_id, client, clock, len, key, deletes FROM ({EDITS_SQL}) WHERE ts < TIMESTAMP '{EARLY}'")
def restore(spark, sf_dir):
    log = _log(spark, sf_dir)
    return history.restore(log, history.capture_snapshot(_early(log))).select("doc_id", "client", "clock", "len", "key", "deletes")


@query(f"""
WITH runs AS (SELECT *, clock - row_number() OVER (PARTITION BY doc_id, client, deletes ORDER BY clock) AS island FROM ({EDITS_SQL}))
SELECT doc_id, client, CAST(min(clock) AS BIGINT) AS clock, CAST(sum(len) AS BIGINT) AS len, count(*) AS n_runs FROM runs GROUP BY doc_id, client, deletes, island
""")
def squash_runs(spark, sf_dir):
    return history.squash_runs(_log(spark, sf_dir), [F.col("deletes")])


@query(f"""
WITH log AS ({EDITS_SQL}), ds AS ({_DELETE_SET_SQL.format(log='log')})
SELECT doc_id, client, clock, len, key, value, false AS is_gc FROM log WHERE NOT deletes UNION ALL SELECT doc_id, client, clock, len, NULL, NULL, true FROM ds
""")
def gc_compact(spark, sf_dir):
    return history.collect_garbage(_log(spark, sf_dir))


_HOUR_SQL = f"""
  SELECT *, sum(CASE WHEN epoch_us(ts) - before > 86400000000 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, client ORDER BY ts, clock) AS item
  FROM (SELECT *, lag(epoch_us(ts)) OVER (PARTITION BY doc_id, client ORDER BY ts, clock) AS before FROM ({EDITS_SQL}))
"""
DAY = 86400.0


@query(f"SELECT doc_id, client, CAST(item AS BIGINT) AS item, CAST(min(clock) AS BIGINT) AS first_clock, CAST(max(clock) + 1 AS BIGINT) AS next_clock, count(*) AS n_ops, CAST(sum(deletes::INT) AS BIGINT) AS n_deletes FROM ({_HOUR_SQL}) GROUP BY doc_id, client, item")
def undo_groups(spark, sf_dir):
    """A day instead of half a second between stack items: events are hours apart."""
    return history.undo_groups(_log(spark, sf_dir), DAY)


@query(f"""
WITH grouped AS ({_HOUR_SQL}), top AS (SELECT *, max(item) OVER (PARTITION BY doc_id, client) AS last FROM grouped),
runs AS (SELECT *, clock - row_number() OVER (PARTITION BY doc_id, client, deletes ORDER BY clock) AS island FROM top WHERE item = last)
SELECT doc_id, client, CAST(min(clock) AS BIGINT) AS clock, count(*) AS len, CASE WHEN deletes THEN 'revive' ELSE 'delete' END AS action FROM runs GROUP BY doc_id, client, deletes, island
""")
def undo_last(spark, sf_dir):
    return history.undo_last(_log(spark, sf_dir), DAY)


_UNITS_SQL = f"SELECT doc_id, client, clock, length(content) AS len, deleted, length(content) * (NOT deleted)::INT AS live, sum(length(content) * (NOT deleted)::INT) OVER (PARTITION BY doc_id ORDER BY clock) AS after FROM ({TURNS_SQL})"


def _runs(spark, sf_dir) -> DataFrame:
    """Each turn as a run of UTF-16 units, its place in the conversation as its client."""
    own = turns(table(spark, sf_dir, "conversations"))
    return own.select("doc_id", F.col("clock").alias("client"), F.lit(0).cast("long").alias("clock"), tx.utf16_length(F.col("content")).alias("len"), "deleted")


@query(f"""
WITH runs AS ({_UNITS_SQL}), size AS (SELECT doc_id, sum(live) AS n FROM runs GROUP BY doc_id), indices AS (SELECT doc_id, CAST(n // 3 AS BIGINT) AS index FROM size UNION ALL SELECT doc_id, CAST(n AS BIGINT) FROM size)
SELECT i.doc_id, i.index, r.clock AS client, CAST(i.index - (r.after - r.live) AS BIGINT) AS clock, CASE WHEN r.clock IS NULL THEN -1 ELSE 0 END AS assoc
FROM indices i LEFT JOIN runs r ON r.doc_id = i.doc_id AND r.live > 0 AND i.index >= r.after - r.live AND i.index < r.after
""")
def relative_positions(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    size = runs.groupBy("doc_id").agg(F.sum(F.when(~F.col("deleted"), F.col("len")).otherwise(0)).alias("n"))
    indices = size.select("doc_id", F.floor(F.col("n") / 3).alias("index")).unionByName(size.select("doc_id", F.col("n").alias("index")))
    return positions.relative_positions(runs, indices, [F.col("client")])


@query(f"""
SELECT doc_id, clock AS client, CAST(len // 2 AS BIGINT) AS clock, CAST(clock % 2 AS INT) - 1 AS assoc, CAST(after - live + len // 2 + CASE WHEN clock % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS index FROM ({_UNITS_SQL}) WHERE len > 0
""")
def absolute_positions(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    anchors = runs.where("len > 0").select("doc_id", "client", F.floor(F.col("len") / 2).alias("clock"), ((F.col("client") % 2).cast("int") - 1).alias("assoc"))
    return positions.absolute_positions(runs, anchors, [F.col("client")])


@query(f"""
WITH runs AS ({_UNITS_SQL}), size AS (SELECT doc_id, sum(live) AS n FROM runs GROUP BY doc_id), places AS (SELECT doc_id, n // 2 AS index FROM size WHERE n >= 2)
SELECT a.doc_id, CAST(99 AS BIGINT) AS client, CAST(0 AS BIGINT) AS clock, CAST(3 AS BIGINT) AS len, l.clock AS origin_client, CAST(a.index - 1 - (l.after - l.live) AS BIGINT) AS origin_clock, r.clock AS right_client, CAST(a.index - (r.after - r.live) AS BIGINT) AS right_clock
FROM places a JOIN runs l ON l.doc_id = a.doc_id AND l.live > 0 AND a.index - 1 >= l.after - l.live AND a.index - 1 < l.after
JOIN runs r ON r.doc_id = a.doc_id AND r.live > 0 AND a.index >= r.after - r.live AND a.index < r.after
""")
def insert_at(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    size = runs.groupBy("doc_id").agg(F.sum(F.when(~F.col("deleted"), F.col("len")).otherwise(0)).alias("n")).where("n >= 2")
    inserts = size.select("doc_id", F.floor(F.col("n") / 2).alias("index"), F.lit("new").alias("content"), F.lit(99).cast("long").alias("client"))
    found = edit.insert_at(runs, inserts, [F.col("client")])
    return found.select("doc_id", "client", "clock", "len", F.col("origin.client").alias("origin_client"), F.col("origin.clock").alias("origin_clock"), F.col("right_origin.client").alias("right_client"), F.col("right_origin.clock").alias("right_clock"))


@query(f"""
WITH runs AS ({_UNITS_SQL}), size AS (SELECT doc_id, sum(live) AS n FROM runs GROUP BY doc_id), cut AS (
  SELECT r.doc_id, r.clock AS client, greatest(n // 4, after - live) AS low, least(n // 4 + n // 2, after) AS high, after - live AS before FROM runs r JOIN size USING (doc_id) WHERE live > 0)
SELECT doc_id, client, CAST(low - before AS BIGINT) AS clock, CAST(high - low AS BIGINT) AS len FROM cut WHERE high > low
""")
def delete_at(spark, sf_dir):
    """Half of each conversation, from its first quarter on."""
    runs = _runs(spark, sf_dir)
    size = runs.groupBy("doc_id").agg(F.sum(F.when(~F.col("deleted"), F.col("len")).otherwise(0)).alias("n"))
    deletes = size.select("doc_id", F.floor(F.col("n") / 4).alias("index"), F.floor(F.col("n") / 2).alias("n"))
    return edit.delete_at(runs, deletes, [F.col("client")])


def _presence(spark, sf_dir) -> DataFrame:
    log = _log(spark, sf_dir)
    return log.select("doc_id", "client", F.when(F.col("event_type") == "view", F.greatest(F.col("clock") - 2, F.lit(0))).otherwise(F.col("clock")).alias("clock"), F.when(F.col("deletes"), "null").otherwise(F.col("key")).alias("state"), "ts", F.col("clock").alias("seq"))


_PRESENCE_SQL = f"SELECT doc_id, client, CASE WHEN event_type = 'view' THEN greatest(clock - 2, 0) ELSE clock END AS clock, CASE WHEN deletes THEN NULL ELSE key END AS state, ts, clock AS seq FROM ({EDITS_SQL})"


@query(f"""
WITH own AS (SELECT * FROM ({_PRESENCE_SQL}) QUALIFY clock > coalesce(max(clock) OVER (PARTITION BY doc_id, client ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)),
last AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY doc_id, client ORDER BY clock DESC) = 1)
SELECT doc_id, client, clock, state, ts AS updated_at FROM last WHERE state IS NOT NULL AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 5 DAY
""")
def presence_states(spark, sf_dir):
    found = presence.presence_states(_presence(spark, sf_dir), F.lit("2024-01-31").cast("timestamp"), 5 * 86400)
    return found.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query(f"""
WITH accepted AS (SELECT * FROM (SELECT *, max(clock) OVER (PARTITION BY doc_id, client ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest FROM ({_PRESENCE_SQL})) WHERE highest IS NULL OR clock > highest),
changes AS (SELECT *, lag(state) OVER (PARTITION BY doc_id, client ORDER BY ts, seq) AS before FROM accepted)
SELECT doc_id, client, clock, CASE WHEN before IS NULL THEN 'added' WHEN state IS NULL THEN 'removed' ELSE 'updated' END AS change FROM changes WHERE before IS NOT NULL OR state IS NOT NULL
""")
def presence_changes(spark, sf_dir):
    return presence.presence_changes(_presence(spark, sf_dir))


def _structs(spark, sf_dir) -> DataFrame:
    """Events as structs of the update format: writes of map keys, texts of a sequence, deletions."""
    log = _log(spark, sf_dir)
    ident = F.struct(F.col("client").cast("long").alias("client"), (F.col("clock") - 1).alias("clock"))
    none = lambda kind: F.lit(None).cast(kind)
    typed = F.col("event_type") == "view"
    return log.select(
        "doc_id", "client", "clock", "len",
        F.when(typed & (F.col("clock") > 0), ident).alias("origin"), none("struct<client:long,clock:long>").alias("right_origin"),
        F.when(~typed | (F.col("clock") == 0), F.lit("events")).alias("parent_name"), none("struct<client:long,clock:long>").alias("parent_id"), F.when(~typed, F.col("key")).alias("parent_sub"),
        F.when(typed, "string").otherwise("any").alias("content_type"), F.when(typed, "v").alias("str"), none("binary").alias("bin"),
        F.when(~typed, F.array(F.to_json(F.struct("value", "event_type")))).alias("vals"), none("string").alias("fmt_key"), none("int").alias("type_class"), none("string").alias("node_name"), none("struct<client:long,clock:long>").alias("move_target"), none("long").alias("move_len"), "deletes",
    )


def _read_back(rows: DataFrame) -> DataFrame:
    """Structs that were read, each with whether a range that was read holds it."""
    value = F.get_json_object(F.element_at("vals", 1), "$.value").cast("double")
    log = rows.where("content_type != 'range' and error is null").select("doc_id", "client", "clock", "len", "content_type", "str", "parent_sub", value.alias("value"))
    return mark_deleted(log, rows.where("content_type = 'range'")).drop("len")


@query(f"""
SELECT doc_id, client, clock, CASE WHEN event_type = 'view' THEN 'string' ELSE 'any' END AS content_type, CASE WHEN event_type = 'view' THEN 'v' END AS str,
  CASE WHEN event_type <> 'view' THEN key END AS parent_sub, CASE WHEN event_type <> 'view' THEN value END AS value, deletes FROM ({EDITS_SQL})
""")
def update_round_trip(spark, sf_dir):
    """Every document's log as one binary update, read back into rows."""
    structs = _structs(spark, sf_dir)
    rows = materialize(decode_updates(encode_in_parts(structs, "deletes")), "decoded")
    return _read_back(rows)


@query(ORACLE["update_round_trip"])
def columnar_round_trip(spark, sf_dir):
    """The same in the columnar format; keys of runs with an origin are left out of it and come back from the origin."""
    structs = _structs(spark, sf_dir)
    rows = materialize(decode_columnar(encode_columnar(structs, "deletes")), "decoded")
    return _read_back(rows)


@query(f"""
WITH RECURSIVE log AS ({EDITS_SQL}), s AS (SELECT doc_id, client, clock, event_type = 'view' AND clock > 0 AS typed, CASE WHEN event_type <> 'view' THEN key END AS parent_sub FROM log),
heirs AS (
  SELECT doc_id, client, clock, parent_sub FROM s WHERE NOT typed
  UNION ALL SELECT s.doc_id, s.client, s.clock, h.parent_sub FROM s JOIN heirs h ON s.typed AND h.doc_id = s.doc_id AND h.client = s.client AND h.clock = s.clock - 1
)
SELECT doc_id, client, clock, 'events' AS parent_name, parent_sub FROM heirs
""")
def parents_resolved(spark, sf_dir):
    structs = _structs(spark, sf_dir)
    log = materialize(decode_updates(encode_updates(structs, "deletes")), "decoded").where("content_type != 'range'")
    return resolve_parents(log).select("doc_id", "client", "clock", "parent_name", "parent_sub")


@query(f"SELECT doc_id, client, CAST(max(clock) + 1 AS BIGINT) AS next_clock FROM ({EDITS_SQL}) GROUP BY ALL")
def state_vector_round_trip(spark, sf_dir):
    return decode_state_vectors(encode_state_vectors(state.state_vector(_log(spark, sf_dir)))).where("error is null").drop("error")


@query(f"""
WITH log AS ({EDITS_SQL}), known AS (SELECT doc_id, client, max(clock) + 1 AS next_clock FROM log WHERE ts < TIMESTAMP '{EARLY}' GROUP BY ALL)
SELECT doc_id, client, clock FROM log LEFT JOIN known USING (doc_id, client) WHERE clock >= coalesce(next_clock, 0)
""")
def sync_reply(spark, sf_dir):
    """A peer's state vector as bytes, and the update that answers it, read back."""
    structs = _structs(spark, sf_dir)
    asked = decode_state_vectors(encode_state_vectors(state.state_vector(_early(_log(spark, sf_dir))))).where("error is null")
    reply = encode_updates(state.diff_since(structs, asked), structs.where("deletes"))
    return decode_updates(reply).where("content_type != 'range'").select("doc_id", "client", "clock")


def _talk(spark, sf_dir) -> DataFrame:
    """The items of all conversations, from their binary updates."""
    structs, ranges = conversation_log(table(spark, sf_dir, "conversations"))
    return materialize(content.placed_items(decode_updates(encode_updates(structs, ranges))), "placed")


_BODY_SQL = """
  even AS (SELECT *, length(text) // 2 AS half FROM talk WHERE i % 2 = 0), odd AS (SELECT * FROM talk WHERE i % 2 = 1),
  cut AS (SELECT e.doc_id, e.i, substr(e.text, 1, 1) || CASE WHEN half > 3 THEN substr(e.text, 4, half - 3) ELSE '' END AS front, substr(e.text, greatest(half, 3) + 1) AS rest, o.text AS inner_text FROM even e LEFT JOIN odd o ON o.doc_id = e.doc_id AND o.i = e.i + 1),
  body AS (
    SELECT doc_id, string_agg(front || CASE WHEN doc_id % 2 = 0 THEN coalesce(inner_text, '') ELSE '' END || rest, '' ORDER BY i) || CASE WHEN doc_id % 2 = 1 THEN coalesce(string_agg(inner_text, '' ORDER BY i DESC), '') ELSE '' END AS value
    FROM cut GROUP BY doc_id)
"""
_ESCAPED = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""
WITH talk AS ({TALK_SQL}), {_BODY_SQL},
  last AS (SELECT doc_id, role, arg_max(i, i) AS i, arg_max(turn, i) AS turn FROM talk GROUP BY doc_id, role)
SELECT doc_id, '/body' AS type, value FROM body
UNION ALL SELECT doc_id, '/turns', '[' || string_agg(CASE WHEN i % 3 = 2 THEN '' ELSE turn || ',' END || '"' || role || '"', ',' ORDER BY i) || ']' FROM talk GROUP BY doc_id
UNION ALL SELECT doc_id, '/last', '{{' || string_agg('"' || role || '":' || turn, ',' ORDER BY role) || '}}' FROM last WHERE i % 4 <> 3 GROUP BY doc_id
UNION ALL SELECT doc_id, '/page', string_agg('<turn role="' || role || '">' || {_ESCAPED.format('text')} || '</turn>', '' ORDER BY i) FROM talk WHERE i % 4 <> 3 GROUP BY doc_id
""")
def decoded_values(spark, sf_dir):
    """From bytes to values: each conversation's text, list, map and XML, its runs split where others stand inside them and where deletions begin and end."""
    items = _talk(spark, sf_dir)
    named = lambda df, value: df.select("doc_id", F.col("parent").alias("type"), F.col(value).alias("value"))
    text = named(content.texts(items).where("parent = '/body'"), "text")
    page = content.xml(items, content.root("page")).select("doc_id", F.lit("/page").alias("type"), F.col("xml").alias("value"))
    return text.unionByName(named(content.lists(items).where("parent = '/turns'"), "json")).unionByName(named(content.maps(items).where("parent = '/last'"), "json")).unionByName(page)


@query(f"""
WITH talk AS ({TALK_SQL}), parts AS (
  SELECT doc_id, i, 0 AS k, role AS said, CASE WHEN i > 0 AND i % 2 = 0 THEN 'bold=true,italic=true' ELSE 'bold=true' END AS attributes FROM talk WHERE role <> ''
  UNION ALL SELECT doc_id, i, 1, text, CASE WHEN i % 2 = 1 THEN 'italic=true' ELSE '' END FROM talk
), steps AS (SELECT *, CASE WHEN lag(attributes) OVER (PARTITION BY doc_id ORDER BY i, k) = attributes THEN 0 ELSE 1 END AS fresh FROM parts),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i, k) AS step FROM steps)
SELECT doc_id, CAST(step AS BIGINT) AS step, string_agg(said, '' ORDER BY i, k) AS insert, any_value(attributes) AS attributes FROM numbered GROUP BY doc_id, step
""")
def decoded_rich_text(spark, sf_dir):
    """The bold and italic text of each conversation as inserts with their attributes, from binary updates."""
    found = content.rich_text(_talk(spark, sf_dir).where("parent = '/rich'"))
    pairs = F.coalesce(F.array_sort(F.map_entries("attributes")), F.array().cast("array<struct<key:string,value:string>>"))
    return found.select("doc_id", "step", "insert", F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("attributes"))


@query(f"""
WITH talk AS ({TALK_SQL}), whole AS (SELECT doc_id, n FROM talk WHERE i = 0)
SELECT doc_id, '/turns' AS parent, '' AS keys, 2 * (n - n // 2) - (SELECT count(*) FROM talk t WHERE t.doc_id = whole.doc_id AND i >= n // 2 AND i % 3 = 2) AS n_inserted,
  (SELECT count(*) FROM talk t WHERE t.doc_id = whole.doc_id AND i < n // 2 AND i % 3 = 2) AS n_deleted FROM whole
UNION ALL
SELECT doc_id, '/last', string_agg(DISTINCT role, ',' ORDER BY role), 0, 0 FROM talk WHERE i >= n // 2 OR i % 4 = 3 GROUP BY doc_id
""")
def changed_types(spark, sf_dir):
    """What observers of lists and maps are told where the second half of each conversation is new, and so are all deletions."""
    talk = table(spark, sf_dir, "conversations")
    structs, ranges = conversation_log(talk)
    items = materialize(content.placed_items(decode_updates(encode_updates(structs, ranges))), "placed").where("parent in ('/turns', '/last')")
    own = Window.partitionBy("conv_id")
    halves = talk.withColumns({"i": F.row_number().over(own.orderBy("turn")) - 1, "n": F.count("*").over(own)}).where("i = n div 2").select(F.col("conv_id").alias("doc_id"), "turn")
    first = structs.where("content_type = 'any' and size(vals) = 2").select("doc_id", "clock", F.element_at("vals", 1).cast("long").alias("turn"))
    border = halves.join(first, ["doc_id", "turn"]).select("doc_id", F.col("clock").alias("border"))
    found = content.changed_types(items.join(border, "doc_id"), F.col("clock") >= F.col("border"), F.lit(False))
    return found.select("doc_id", "parent", F.array_join("keys", ",").alias("keys"), "n_inserted", "n_deleted")


@query(f"""
WITH log AS ({EDITS_SQL}), ds AS ({_DELETE_SET_SQL.format(log='log')})
SELECT doc_id, 'sync' AS part, 0 AS kind, client, CAST(max(clock + 1) AS BIGINT) AS clock, CAST(0 AS BIGINT) AS len, NULL AS state FROM log GROUP BY doc_id, client
UNION ALL SELECT doc_id, 'snapshot', 0, client, CAST(max(clock + 1) AS BIGINT), 0, NULL FROM log GROUP BY doc_id, client
UNION ALL SELECT doc_id, 'snapshot', 1, client, clock, len, NULL FROM ds
UNION ALL SELECT doc_id, 'presence', 1, client, arg_max(clock, clock), 0, arg_max(CASE WHEN deletes THEN 'null' ELSE key END, clock) FROM log GROUP BY doc_id, client
""")
def message_round_trip(spark, sf_dir):
    """State vectors, snapshots and presence of all documents, as protocol messages and back."""
    log = _log(spark, sf_dir)
    asks = encode_state_vectors(state.state_vector(log)).select("doc_id", sync_frame(sync_message(0, F.col("sv"))).alias("message"))
    last = F.max_by(F.struct("clock", F.when(F.col("deletes"), "null").otherwise(F.col("key")).alias("state")), "clock").alias("last")
    present = encode_presence(log.groupBy("doc_id", "client").agg(last).select("doc_id", "client", "last.*")).select("doc_id", presence_frame(F.col("update")).alias("message"))
    read = materialize(messages.decode_frames(asks.unionByName(present)), "messages")
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda df, part, kind, clock, length, said: df.select("doc_id", F.lit(part).alias("part"), kind.cast("int").alias("kind"), "client", clock.alias("clock"), length.cast("long").alias("len"), said.alias("state"))
    vectors = decode_state_vectors(read.where("channel = 'sync' and kind = 0").select("doc_id", F.col("payload").alias("sv")))
    states = messages.decode_presence(read.where("channel = 'presence'").select("doc_id", F.col("payload").alias("update")), raw=True)
    taken = messages.decode_snapshots(encode_snapshots(log, log.where("deletes")))
    out = row(vectors, "sync", F.lit(0), F.col("next_clock"), F.lit(0), none("string")).unionByName(row(states, "presence", F.lit(1), F.col("clock"), F.lit(0), F.col("state")))
    return out.unionByName(row(taken, "snapshot", F.col("kind"), F.col("clock"), F.coalesce("len", F.lit(0)), none("string")))


def _streamed(spark, sf_dir, log: DataFrame, apply) -> DataFrame:
    """Run ``log`` through a streaming query until its files are read, and return what the query wrote."""
    base = f"{scratch_dir(spark)}/tideline-stream-{uuid.uuid4().hex}"
    log.write.parquet(f"{base}/log")
    stream = live.read_log(spark, f"{base}/log", log.schema, files_per_batch=64)
    live.store_updates(apply(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.schema(apply(stream).schema).parquet(f"{base}/out")


@query(f"SELECT doc_id, client, CAST(max(clock) + 1 AS BIGINT) AS next_clock, count(*) AS n_units FROM ({EDITS_SQL}) GROUP BY ALL")
def stream_causal_order(spark, sf_dir):
    """The log dealt over files at random, with a third of it twice, and read in several batches: runs wait from batch to batch, and every unit comes out once."""
    log = _log(spark, sf_dir).select("doc_id", "client", "clock", "len")
    twice = log.unionByName(log.where("clock % 3 = 1"))
    files = max(4, twice.count() // 1_000_000)
    base = f"{scratch_dir(spark)}/tideline-stream-{uuid.uuid4().hex}"
    twice.repartition(files, F.xxhash64("client", "clock", "doc_id")).write.parquet(f"{base}/log")
    stream = live.read_log(spark, f"{base}/log", log.schema, files_per_batch=(files + 1) // 2)
    live.release_runs(stream, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    released = spark.read.parquet(f"{base}/out/released")
    return released.groupBy("doc_id", "client").agg(F.max(F.col("clock") + F.col("len")).alias("next_clock"), F.sum("len").alias("n_units"))


@query(f"SELECT doc_id, client, clock FROM ({EDITS_SQL})")
def stream_distinct(spark, sf_dir):
    log = _log(spark, sf_dir).select("doc_id", "client", "clock", "len")
    return _streamed(spark, sf_dir, log.unionByName(log.where("clock % 2 = 0")), live.distinct_units).select("doc_id", "client", "clock")
