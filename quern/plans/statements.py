"""Registered queries of definitions, snapshots, files, access control, messages and user functions.

Most run statements of the dialect on tables filled from the data folder, and
return what is there afterwards.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import jsons as J
from ..functions import user
from ..functions import vectors as V
from ..functions.models import ModelRegistry
from ..operators import timeseries as TS
from ..security import PermissionDenied
from ..session import scratch_dir
from ..sources import files
from ..streaming import streams
from .catalogue import _engine, _final
from .registry import query, rounded


def _folder(t, name: str) -> str:
    return f"{scratch_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _run(engine, *statements: str) -> None:
    for s in statements:
        engine.sql(s)


# ---- definitions and whole databases ----------------------------------------------


@query("SELECT n_nationkey AS id, n_name AS title, CAST(n_regionkey AS BIGINT) AS region, 5 AS extra FROM nation")
def ddl_alter(t):
    engine = _engine(t, "nation")
    _run(
        engine,
        "CREATE TABLE IF NOT EXISTS a (id INT PRIMARY KEY, name VARCHAR(40) NOT NULL, region INT, gone TEXT)",
        "INSERT INTO a SELECT n_nationkey, n_name, n_regionkey, n_comment FROM nation" if "n_comment" in t.nation.columns else "INSERT INTO a (id, name, region) SELECT n_nationkey, n_name, n_regionkey FROM nation",
        "ALTER TABLE a ADD COLUMN extra INT DEFAULT 5",
        "ALTER TABLE a RENAME COLUMN name TO title",
        "ALTER TABLE a MODIFY COLUMN region BIGINT",
        "ALTER TABLE a DROP COLUMN gone",
    )
    return engine.sql("SELECT id, title, region, extra FROM a")


@query("SELECT * FROM (VALUES ('id', 'PRI', 'NO'), ('name', 'UNI', 'NO'), ('v', '', 'YES')) AS x(column_name, key, nullable)")
def ddl_describe(t):
    engine = _engine(t)
    _run(engine, "CREATE TABLE d (id INT PRIMARY KEY AUTO_INCREMENT, name VARCHAR(8) NOT NULL UNIQUE, v VECTOR(3))")
    return engine.sql("DESCRIBE d").select("column_name", "key", "nullable")


@query("SELECT 'other' AS database_name, r_name AS name FROM region UNION ALL SELECT 'main', n_name FROM nation")
def ddl_databases(t):
    engine = _engine(t, "region", "nation")
    _run(engine, "CREATE TABLE x (name TEXT)", "INSERT INTO x SELECT n_name FROM nation", "CREATE DATABASE other", "USE other", "CREATE TABLE x (name TEXT)", "INSERT INTO x SELECT r_name FROM region")
    other = engine.db.df("x").select(F.lit("other").alias("database_name"), "name")
    _run(engine, "USE main")
    return other.unionByName(engine.db.df("x").select(F.lit("main").alias("database_name"), "name"))


@query("SELECT * FROM (VALUES ('a'), ('c')) AS x(table_name)")
def ddl_show_tables(t):
    engine = _engine(t)
    _run(engine, "CREATE TABLE a (i INT)", "CREATE TABLE b (i INT)", "CREATE TABLE c (i INT)", "DROP TABLE b", "DROP TABLE IF EXISTS never")
    return engine.sql("SHOW TABLES")


@query("SELECT * FROM (VALUES ('nations', 'by_name', 'HASH', 'READY')) AS x(table_name, index_name, kind, status)")
def ddl_indexes(t):
    engine = _engine(t, "nation")
    _run(engine, "CREATE TABLE nations (id INT PRIMARY KEY, name TEXT)", "CREATE INDEX by_name ON nations (name) USING HASH", "REINDEX nations")
    return engine.sql("SHOW INDEX BUILD STATUS")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def ddl_recover(t):
    """A second engine on the same root finds what the first has committed, and nothing else."""
    engine = _engine(t, "nation")
    _run(engine, "CREATE TABLE kept (id INT PRIMARY KEY, name TEXT)", "INSERT INTO kept SELECT n_nationkey, n_name FROM nation", "BEGIN", "DELETE FROM kept")
    return type(engine)(t.spark, engine.root).sql("SELECT id, name FROM kept")


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def ddl_snapshot(t):
    engine, path = _engine(t, "nation"), _folder(t, "snapshot")
    _run(engine, "CREATE TABLE s (id INT PRIMARY KEY, name TEXT)", "INSERT INTO s SELECT n_nationkey, n_name FROM nation")
    engine.db.save(path)
    _run(engine, "UPDATE s SET name = 'x'", "DELETE FROM s WHERE id < 5", "CREATE TABLE new (i INT)")
    engine.db.restore(path)
    return engine.sql("SELECT id, name FROM s")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 3 THEN 'x' ELSE n_name END AS name FROM nation UNION ALL SELECT r_regionkey + 1000, r_name FROM region")
def ddl_incremental_snapshot(t):
    """A full snapshot, and a later one with the changed table only, restored in order."""
    engine, full, later = _engine(t, "nation", "region"), _folder(t, "full"), _folder(t, "later")
    _run(engine, "CREATE TABLE n (id INT, name TEXT)", "CREATE TABLE r (id INT, name TEXT)", "INSERT INTO n SELECT n_nationkey, n_name FROM nation", "INSERT INTO r SELECT r_regionkey, r_name FROM region")
    versions = engine.db.save(full)
    _run(engine, "UPDATE n SET name = 'x' WHERE id = 3")
    engine.db.save(later, since=versions)
    _run(engine, "DELETE FROM n", "DELETE FROM r")
    engine.db.restore(full)
    engine.db.restore(later)
    return engine.sql("SELECT id, name FROM n UNION ALL SELECT id + 1000, name FROM r")


@query("SELECT 'INSERT INTO nations (id, name) VALUES (' || n_nationkey || ', ''' || n_name || ''');' AS statement FROM nation")
def ddl_export(t):
    return files.insert_statements(t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), "nations")


@query("SELECT n_nationkey AS id, n_name AS name, true AS refused FROM nation")
def insert_duplicate_key(t):
    """A second row of a key is refused and leaves the table as it was."""
    from ..catalog import ConstraintError

    engine, refused = _engine(t, "nation"), []
    _run(engine, "CREATE TABLE u (id INT PRIMARY KEY, name TEXT UNIQUE)", "INSERT INTO u SELECT n_nationkey, n_name FROM nation")
    for s in ("INSERT INTO u VALUES (3, 'new')", "INSERT INTO u SELECT n_nationkey + 100, n_name FROM nation", "INSERT INTO u VALUES (200, 'a'), (200, 'b')"):
        try:
            engine.sql(s)
        except ConstraintError:
            refused.append(s)
    return engine.sql("SELECT id, name FROM u").withColumn("refused", F.lit(len(refused) == 3))


@query("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY user_id")
def ts_batch_write(t):
    """Batches into a time-series table, each in a transaction."""
    engine = _engine(t, "events")
    _run(engine, "CREATE TIMESERIES TABLE points (ts TIMESTAMP, event_id BIGINT, user_id BIGINT)")
    for k in range(2):
        _run(engine, "BEGIN", f"INSERT INTO points SELECT ts, event_id, user_id FROM events WHERE event_id % 2 = {k}", "COMMIT")
    return engine.sql("SELECT user_id, count(*) AS n, min(event_id) AS first_id FROM points GROUP BY user_id").select(F.col("user_id").cast(t.events.schema["user_id"].dataType).alias("user_id"), "n", F.col("first_id").cast(t.events.schema["event_id"].dataType).alias("first_id"))


# ---- files ------------------------------------------------------------------------


@query("SELECT r_regionkey, r_name, 'parquet zstd' AS form FROM region UNION ALL SELECT r_regionkey, r_name, 'parquet lz4' FROM region UNION ALL SELECT r_regionkey, r_name, 'orc zstd' FROM region UNION ALL SELECT r_regionkey, r_name, 'json none' FROM region UNION ALL SELECT r_regionkey, r_name, 'csv none' FROM region")
def src_formats(t):
    rows, out = t.region.select("r_regionkey", "r_name"), None
    for form, codec in (("parquet", "zstd"), ("parquet", "lz4"), ("orc", "zstd"), ("json", "none"), ("csv", "none")):
        path = _folder(t, form)
        files.write(rows, path, form, codec=codec)
        back = files.read(t.spark, path, form, rows.schema).withColumn("form", F.lit(f"{form} {codec}"))
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 06:00:00'")
def src_time_partitions(t):
    """Written by day; what ended a week before a day is dropped, then a range is read from its folders."""
    path = _folder(t, "days")
    files.write_time_partitions(t.events, path, "ts")
    files.drop_expired(t.spark, path, "7d", "2024-01-15")
    return files.read_time_range(t.spark, path, "ts", "2024-01-05", "2024-01-12 06:00:00").select("event_id")


@query("SELECT event_id FROM events WHERE date_trunc('day', ts) IN (SELECT DISTINCT date_trunc('day', ts) AS d FROM events ORDER BY d DESC LIMIT 5)")
def src_evict_oldest(t):
    path = _folder(t, "days")
    files.write_time_partitions(t.events, path, "ts")
    files.evict_oldest(t.spark, path, 5)
    return t.spark.read.parquet(path).select("event_id")


# ---- access ------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('name', true), ('id', false), ('*', false), ('count', true), ('update name', false), ('insert', false)) AS x(what, allowed)")
def sql_column_grants(t):
    """What a user may do who was granted SELECT on one column."""
    engine = _engine(t)
    _run(engine, "CREATE TABLE people (id INT, name TEXT, pay INT)", "CREATE ROLE reader", "CREATE USER ann", "GRANT SELECT ON people.name TO reader", "GRANT reader TO ann")
    asked = {"name": "SELECT name FROM people", "id": "SELECT id FROM people", "*": "SELECT * FROM people", "count": "SELECT count(name) AS n FROM people WHERE name <> 'x'", "update name": "UPDATE people SET name = 'x'", "insert": "INSERT INTO people VALUES (1, 'a', 2)"}
    out = []
    for what, s in asked.items():
        try:
            engine.sql(s, user="ann")
            out.append((what, True))
        except PermissionDenied:
            out.append((what, False))
    return t.spark.createDataFrame(out, "what string, allowed boolean")


@query("SELECT * FROM (VALUES ('admin'), ('writer')) AS x(role)")
def sql_system_tables(t):
    engine = _engine(t)
    _run(engine, "CREATE ROLE writer", "CREATE ROLE gone", "DROP ROLE gone")
    return engine.sql("SELECT role FROM system_roles")


@query("SELECT true AS refused")
def join_foreign_column(t):
    """A column that neither table has is an error of analysis."""
    spark = t.views("nation", "region")
    try:
        spark.sql("SELECT n_name FROM nation JOIN region ON n_regionkey = c_custkey")
        refused = False
    except AnalysisException:
        refused = True
    return spark.createDataFrame([(refused,)], "refused boolean")


# ---- SELECT beyond the standard ------------------------------------------------------


@query("SELECT upper(n_name) AS u, n_nationkey, count(*) AS n FROM nation GROUP BY n_nationkey, n_name")
def sql_first_of_group(t):
    """A function of a column that is not grouped takes a first row's value."""
    return _engine(t, "nation").sql("SELECT UPPER(n_name) AS u, n_nationkey, count(*) AS n FROM nation GROUP BY n_nationkey")


_WORDS = r"string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+')"


@query(f"SELECT doc_id, 'any' AS form FROM documents WHERE list_has_any({_WORDS}, ['the', 'una']) UNION ALL SELECT doc_id, 'all' FROM documents WHERE list_has_all({_WORDS}, ['the', 'and']) AND NOT list_contains({_WORDS}, 'of')")
def sql_match_against(t):
    engine = _engine(t, "documents")
    some = engine.sql("SELECT doc_id, 'any' AS form FROM documents WHERE MATCH(text) AGAINST('the Una')")
    return some.unionByName(engine.sql("SELECT doc_id, 'all' AS form FROM documents WHERE MATCH(text) AGAINST('+the +and -of' IN BOOLEAN MODE)"))


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-20' ORDER BY ts, event_id LIMIT 25")
def ts_records_in_window(t):
    return TS.records_in_window(t.events, "ts", "2024-01-03", "2024-01-20", 25).select("event_id")


@query("SELECT event_id, round(avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS m, event_id - coalesce(lag(event_id) OVER (ORDER BY ts, event_id), 0) AS d FROM events")
def ts_windows_without_keys(t):
    """A moving average and differences over one long series, in blocks."""
    rows = TS.moving(t.events, "value", 7, ["ts", "event_id"], name="m")
    return TS.delta(rows, "event_id", ["ts", "event_id"], name="d").select("event_id", rounded(F.col("m"), 6).alias("m"), "d")


@query("SELECT true AS now, true AS zone")
def fn_now(t):
    engine = _engine(t)
    row = engine.sql("SELECT NOW() AS a, CURRENT_TIMESTAMP AS b, LOCALTIMESTAMP AS c, TIMEZONE() AS z")
    recent = F.abs(F.unix_micros("a") - F.lit(int(dt.datetime.now(dt.timezone.utc).timestamp() * 1e6))) < 600 * 10**6
    return row.select((recent & (F.col("a") == F.col("b"))).alias("now"), (F.col("z") == t.spark.conf.get("spark.sql.session.timeZone")).alias("zone"))


@query("SELECT event_id, to_json(list_sort(json_keys(props)))::VARCHAR AS ks, CAST(json_merge_patch(props, '{\"k\":9}') AS VARCHAR) AS st, CAST(json_merge_patch(props, '{\"n\":\"x\"}') AS VARCHAR) AS ins, CAST(json_merge_patch(props, '{\"k\":null}') AS VARCHAR) AS rm FROM events")
def json_edit_events(t):
    d = F.col("props")
    return t.events.select("event_id", J.keys(d).alias("ks"), J.set_value(d, "$.k", "9").alias("st"), J.set_value(d, "$.n", "x").alias("ins"), J.remove(d, "$.k").alias("rm"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS i, CAST(json_extract(props, '$.k') AS DOUBLE) AS f, CAST(NULL AS VARCHAR) AS s FROM events")
def json_typed(t):
    d = F.col("props")
    return t.events.select("event_id", J.extract_int(d, "$.k").alias("i"), J.extract_float(d, "$.k").alias("f"), J.extract_text(d, "$.k").alias("s"))


# ---- functions of users and models ---------------------------------------------------


@query("SELECT n_nationkey, CAST(n_nationkey * 3 + 1 AS INTEGER) AS x FROM nation")
def fn_sql_function(t):
    engine = _engine(t, "nation")
    _run(engine, "CREATE FUNCTION triple_and_one(x INT) RETURNS INT RETURN x * 3 + 1")
    return engine.sql("SELECT n_nationkey, triple_and_one(n_nationkey) AS x FROM nation")


@query("SELECT n_regionkey, CAST(max(n_nationkey) - min(n_nationkey) AS DOUBLE) AS width FROM nation GROUP BY n_regionkey")
def fn_user_aggregate(t):
    user.register_aggregate(t.views("nation"), "width_of", lambda values: float(values.max() - values.min()))
    return t.spark.sql("SELECT n_regionkey, width_of(n_nationkey) AS width FROM nation GROUP BY n_regionkey")


class _Letters:
    def eval(self, word: str):
        for k, letter in enumerate(word or ""):
            yield k, letter


@query("SELECT r_regionkey, CAST(k - 1 AS INTEGER) AS k, substr(r_name, k, 1) AS letter FROM (SELECT r_regionkey, r_name, CAST(unnest(generate_series(1, length(r_name))) AS BIGINT) AS k FROM region)")
def fn_user_table_function(t):
    user.register_table_function(t.views("region"), "letters_of", _Letters, "k int, letter string")
    return t.spark.sql("SELECT r_regionkey, l.k, l.letter FROM region, LATERAL letters_of(r_name) AS l")


@query("SELECT n_nationkey, CAST(n_regionkey * 2 + 1 AS DOUBLE) AS y FROM nation")
def model_call(t):
    """A model with a cache of its answers, called by its SQL name."""
    registry = ModelRegistry(t.spark)
    registry.create("twice_and_one", "memory:", [("x", "DOUBLE")], "double", loader=lambda _: lambda x: (x * 2.0 + 1.0).tolist(), if_not_exists=True, cache={"entries": 100, "ttl": 60.0})
    return t.views("nation").sql("SELECT n_nationkey, twice_and_one(n_regionkey) AS y FROM nation")


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1, 6) AS size FROM embeddings")
def vec_normalize(t):
    v = V.normalize(F.col("embedding"))
    return t.embeddings.select("vec_id", rounded(F.sqrt(V.inner_product(v, v)), 6).alias("size"))


# ---- messages ------------------------------------------------------------------------


@query("SELECT n_regionkey AS topic, count(*) AS n, min(n_name) AS first FROM nation WHERE n_regionkey IN (1, 2) GROUP BY n_regionkey")
def stream_topics(t):
    """Two topics published, all followed."""
    path = _folder(t, "topics")
    for topic in (1, 2):
        streams.publish(t.nation.filter(F.col("n_regionkey") == topic), path, topic, "n_nationkey", F.col("n_name"))
    found = streams.subscribe(t.spark, path).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("payload").cast("string")).alias("first"))
    return _final(t, found).select(F.col("topic").cast("int").alias("topic"), "n", "first")


@query("SELECT topic, expected, got FROM (SELECT n_regionkey AS topic, CAST(lag(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) + 1 AS BIGINT) AS expected, CAST(n_nationkey AS BIGINT) AS got FROM nation) WHERE got > expected")
def stream_gaps(t):
    messages = t.nation.select(F.col("n_regionkey").alias("topic"), F.col("n_nationkey").cast("long").alias("seq"))
    return streams.sequence_gaps(messages.unionByName(messages))


@query("SELECT event_id FROM events WHERE ts + to_seconds(event_id % 5 * 3600) > TIMESTAMP '2024-01-20'")
def stream_unexpired(t):
    rows = t.events.withColumn("ttl", F.col("event_id") % 5 * 3600)
    return streams.unexpired(rows, "ts", "ttl", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT event_id FROM events WHERE ts + to_seconds(event_id % 5 * 3600) > TIMESTAMP '2024-01-20' ORDER BY ts + to_seconds(event_id % 5 * 3600) DESC, event_id LIMIT 7")
def stream_ring(t):
    rows = t.events.withColumn("ttl", F.col("event_id") % 5 * 3600)
    return streams.ring(rows, 7, "ts", "ttl", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("SELECT n_regionkey AS topic, CAST(n_nationkey AS BIGINT) AS seq FROM nation WHERE n_nationkey % 4 = 1 AND n_nationkey > (SELECT min(n_nationkey) FROM nation AS x WHERE x.n_regionkey = nation.n_regionkey AND x.n_nationkey % 4 <> 1) AND n_nationkey < (SELECT max(n_nationkey) FROM nation AS x WHERE x.n_regionkey = nation.n_regionkey AND x.n_nationkey % 4 <> 1)")
def stream_resend(t):
    """Messages that a follower has missed, asked for again."""
    log = t.nation.select(F.col("n_regionkey").alias("topic"), F.col("n_nationkey").cast("long").alias("seq"))
    return streams.resend(log, log.filter("seq % 4 <> 1"))


# ---- the session ---------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('SELECT', 3::BIGINT, 1::BIGINT), ('CREATE', 1, 0), ('INSERT', 1, 0)) AS x(statement, n, errors)")
def sql_metrics(t):
    """Counted statements; one of them fails."""
    engine = _engine(t)
    _run(engine, "CREATE TABLE m (i INT)", "INSERT INTO m VALUES (1)", "SELECT * FROM m", "SELECT count(*) AS n FROM m")
    try:
        engine.sql("SELECT never FROM m")
    except AnalysisException:
        pass
    seen = engine.metrics
    return t.spark.createDataFrame([(k, n, seen.errors[k]) for k, n in seen.statements.items()], "statement string, n long, errors long")


@query("SELECT * FROM (VALUES ('all columns', false), ('one column', true)) AS x(what, allowed)")
def sql_memory_limit(t):
    """A SELECT whose tables are too large for the session is refused; one that leaves their columns unread is not."""
    from ..engine import Engine, MemoryLimitError

    t.views("documents")
    engine = Engine(t.spark, _folder(t, "engine"))
    engine.memory_limit = 3 * int(engine.sql("SELECT doc_id FROM documents")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    out = []
    for what, s in (("all columns", "SELECT * FROM documents"), ("one column", "SELECT doc_id FROM documents")):
        try:
            engine.sql(s)
            out.append((what, True))
        except MemoryLimitError:
            out.append((what, False))
    return t.spark.createDataFrame(out, "what string, allowed boolean")
