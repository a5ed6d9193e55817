"""Queries over the test tables, each with its SQL twin.

`events` play the logs of a chain (ten to a block), `orders` its transactions, `lineitem` what happens within them,
and `customer` contracts made by a factory.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import abi, scalars
from ledgerloom.operators import filters, joins, tables
from ledgerloom.plans.ranges import Range

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{logs}", LOGS_SQL).replace("{signed}", SIGNED_SQL)
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 64, "0"))


def address(value: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(value)), 40, "0"))


def topic(name: str) -> str:
    import hashlib

    return "0x" + hashlib.sha256(name.encode()).hexdigest()


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as logs."""
    e = read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select(
        F.expr("event_id div 10").alias("block_number"),
        (F.col("event_id") % 10).alias("log_index"),
        address(F.col("user_id")).alias("address"),
        F.array(F.concat(F.lit("0x"), F.sha2(F.col("event_type").cast("binary"), 256)), word(k)).alias("topics"),
        word(F.round(F.col("value") * 100).cast("bigint")).alias("data"),
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts_seconds"),
        "event_type",
    )


LOGS_SQL = """logs AS (SELECT event_id // 10 AS block_number, event_id % 10 AS log_index,
  concat('0x', lpad(lower(to_hex(user_id)), 40, '0')) AS address, concat('0x', sha256(event_type)) AS topic0,
  concat('0x', lpad(lower(to_hex(CAST(json_extract_string(props, '$.k') AS BIGINT))), 64, '0')) AS topic1,
  concat('0x', lpad(lower(to_hex(CAST(round(value * 100) AS BIGINT))), 64, '0')) AS data,
  CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
  CAST(floor(epoch(ts)) AS BIGINT) AS ts_seconds, event_type, user_id, event_id FROM events)"""


def signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed rows: each log's account and cents once with 1; every third block is taken back."""
    rows = logs(spark, sf_dir).select("block_number", "address", (F.conv(F.right("data", F.lit(15)), 16, 10).cast("bigint") % 50).alias("value"))
    return rows.withColumn("sign", F.lit(1)).unionByName(rows.where("block_number % 3 = 0").withColumn("sign", F.lit(-1)))


SIGNED_SQL = """base AS (SELECT event_id // 10 AS block_number, concat('0x', lpad(lower(to_hex(user_id)), 40, '0')) AS address,
  CAST(round(value * 100) AS BIGINT) % 50 AS value FROM events),
signed AS (SELECT *, 1 AS sign FROM base UNION ALL SELECT *, -1 FROM base WHERE block_number % 3 = 0)"""

KINDS = ("click", "purchase")


# --- filters ----------------------------------------------------------------------------------------------------------


@query(f"""WITH {{logs}} SELECT block_number, log_index, address, topic0 FROM logs
WHERE topic0 IN ('{topic("purchase")}') AND topic1 IN (SELECT concat('0x', lpad(lower(to_hex(x)), 64, '0')) FROM unnest([1, 2, 3]) t(x))
   OR block_number BETWEEN 100 AND 120 AND user_id IN (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)""")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = [
        (Range(0), {"topic0": [topic("purchase")], "topic1": [f"0x{x:064x}" for x in (1, 2, 3)]}),
        (Range(100, 120), {"address": [f"0x{x:040x}" for x in range(1, 11)]}),
    ]
    return filters.match(logs(spark, sf_dir), requests).select("block_number", "log_index", "address", F.get("topics", 0).alias("topic0"))


@query("""WITH {logs} SELECT block_number, log_index, topic1 FROM logs WHERE topic0 = concat('0x', sha256('click')) AND k IN (5, 7)""")
def indexed_param_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = abi.Param("k", "uint256", True)
    wanted = ["0x" + abi.encode_word(k, v) for v in (5, 7)]
    rows = filters.match(logs(spark, sf_dir), [(Range(0), {"topic0": topic("click"), "topic1": wanted})])
    return rows.select("block_number", "log_index", F.get("topics", 1).alias("topic1"))


@query("""WITH {logs} SELECT block_number, count(*) AS n FROM logs
WHERE block_number BETWEEN 10 AND 40 OR block_number BETWEEN 90 AND 95 OR block_number >= 900 GROUP BY block_number""")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.match(logs(spark, sf_dir), [(r, {}) for r in (Range(10, 40), Range(90, 95), Range(900))])
    return rows.groupBy("block_number").agg(F.count("*").alias("n"))


@query("""WITH {logs} SELECT block_number, log_index, address AS account, k, cents AS amount, ts_seconds FROM logs WHERE event_type = 'click'""")
def event_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    click = abi.event("Click(uint32 indexed k, uint120 amount)")
    rows = logs(spark, sf_dir).where(F.get("topics", 0) == topic("click")).withColumn("e", abi.event_column(click))
    return rows.select("block_number", "log_index", F.col("address").alias("account"), "e.k", F.col("e.amount").cast("bigint").alias("amount"), "ts_seconds")


@query("""WITH {logs} SELECT event_name, count(*) AS n, CAST(sum(log_index) AS BIGINT) AS s FROM (
  SELECT CASE WHEN event_type = 'click' THEN 'first' WHEN event_type = 'purchase' THEN 'second' WHEN event_type = 'click' THEN 'never' END AS event_name, log_index
  FROM logs) WHERE event_name IS NOT NULL GROUP BY event_name""")
def event_dispatch_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = filters.dispatch(F.get("topics", 0), [("first", topic("click")), ("second", topic("purchase")), ("never", topic("click"))])
    rows = logs(spark, sf_dir).withColumn("event_name", named).where("event_name is not null")
    return rows.groupBy("event_name").agg(F.count("*").alias("n"), F.sum("log_index").alias("s"))


@query("""WITH {logs}, h AS (SELECT DISTINCT block_number FROM logs),
m AS (SELECT block_number, log_index FROM logs WHERE event_type = 'purchase' AND k < 20)
SELECT h.block_number, m.log_index FROM h LEFT JOIN m USING (block_number)""")
def include_all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir)
    matches = rows.where((F.get("topics", 0) == topic("purchase")) & (F.get("topics", 1) < f"0x{20:064x}"))
    return filters.include_all_blocks(rows.select("block_number").distinct(), matches.select("block_number", "log_index"))


@query("""SELECT o_orderkey, o_custkey FROM orders o
WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_returnflag = 'R' AND l_quantity >= 45)""")
def tx_inclusion_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45")
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return filters.related(items, orders, ["l_orderkey"]).select(F.col("l_orderkey").alias("o_orderkey"), "o_custkey")


@query("""WITH {logs} SELECT block_number <= 500 AS final, count(*) AS n, CAST(min(block_number) AS BIGINT) AS lo, CAST(max(block_number) AS BIGINT) AS hi
FROM logs GROUP BY 1""")
def partition_finalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    final, rest = filters.split_by_floor(logs(spark, sf_dir), 500)
    both = final.withColumn("final", F.lit(True)).unionByName(rest.withColumn("final", F.lit(False)))
    return both.groupBy("final").agg(F.count("*").alias("n"), F.min("block_number").alias("lo"), F.max("block_number").alias("hi"))


@query("""WITH {logs} SELECT topic0, count(*) AS n FROM logs GROUP BY topic0 HAVING count(*) > 1""")
def duplicate_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.duplicates(logs(spark, sf_dir).select(F.get("topics", 0).alias("topic0")), ["topic0"])


@query("""WITH {logs} SELECT topic0, topic1, count(*) AS n FROM logs GROUP BY topic0, topic1 HAVING count(*) > 1""")
def duplicate_topic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """duplicate_topics over all logs, by the first two topics."""
    rows = logs(spark, sf_dir).select(F.get("topics", 0).alias("topic0"), F.get("topics", 1).alias("topic1"))
    return tables.duplicates(rows, ["topic0", "topic1"])


@query("""WITH {logs} SELECT output, block_number, log_index FROM (
  SELECT 'clicks' AS output, block_number, log_index FROM logs WHERE event_type = 'click'
  UNION ALL SELECT 'large', block_number, log_index FROM logs WHERE cents > 9000)""")
def multi_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two outputs of one scan: each row is tagged with all outputs that take it."""
    rows = logs(spark, sf_dir)
    takes = {"clicks": F.get("topics", 0) == topic("click"), "large": F.col("data") > f"0x{9000:064x}"}
    return tables.outputs(rows, takes).select("output", "block_number", "log_index")


# --- joins ------------------------------------------------------------------------------------------------------------


def creations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).where(F.get("topics", 0) == topic("signup"))
    return rows.select("block_number", "log_index", F.get("topics", 1).alias("kind"), (F.col("log_index") % 2).alias("factory"), "address").withColumn(
        "factory_address", F.concat(F.lit("0xF"), F.col("factory").cast("string"))
    ).drop("factory")


CREATIONS_SQL = """made AS (SELECT block_number, log_index, topic1 AS kind, address, concat('0xF', CAST(log_index % 2 AS VARCHAR)) AS factory_address,
  row_number() OVER (PARTITION BY address ORDER BY block_number, log_index) AS r FROM logs WHERE event_type = 'signup'),
children AS (SELECT * FROM made WHERE r = 1)"""


@query("WITH {logs}, " + CREATIONS_SQL + """ SELECT address AS child_address, factory_address, block_number, log_index FROM children""")
def factory_children_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.factory_children(creations(spark, sf_dir), F.col("address"))
    return found.select("child_address", "factory_address", "block_number", "log_index")


def _factory_join(spark: SparkSession, sf_dir: str, **wanted) -> DataFrame:
    children = joins.lookup(joins.factory_children(creations(spark, sf_dir), F.col("address")), **wanted)
    found = children.select("child_address", "factory_address", F.col("block_number").alias("created"))
    purchases = logs(spark, sf_dir).where(F.get("topics", 0) == topic("purchase"))
    return joins.join_children(purchases, found).select("address", "factory_address", "created", "block_number", "log_index")


_FACTORY_SQL = """ SELECT l.address, factory_address, c.block_number AS created, l.block_number, l.log_index
FROM logs l JOIN children c ON l.address = c.address WHERE event_type = 'purchase'"""


@query("WITH {logs}, " + CREATIONS_SQL + _FACTORY_SQL)
def factory_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factory_join(spark, sf_dir)


@query("WITH {logs}, " + CREATIONS_SQL + _FACTORY_SQL + " AND factory_address = '0xF1' AND c.kind IN (SELECT concat('0x', lpad(lower(to_hex(x)), 64, '0')) FROM range(0, 60) t(x))")
def factory_join_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _factory_join(spark, sf_dir, factories=["0xf1"], params={"kind": [f"0x{x:064X}".replace("0X", "0x") for x in range(60)]})


@query("""SELECT l_orderkey, l_linenumber, o_custkey, o_orderstatus FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderstatus <> 'P'
WHERE l_quantity > 48""")
def item_transaction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_orderkey", "l_linenumber")
    orders = read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    return joins.with_transaction(items, orders, ["l_orderkey"])


@query("""WITH b AS (SELECT l_orderkey, list_sort(list(l_partkey)) AS parts FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)
SELECT o_orderkey, CAST(coalesce(len(parts), 0) AS BIGINT) AS n, coalesce(array_to_string(parts, ','), '') AS parts
FROM orders LEFT JOIN b ON o_orderkey = l_orderkey""")
def balances_collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    balances = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    found = joins.collect_related(read(spark, sf_dir, "orders").select("o_orderkey"), balances, ["o_orderkey"], ["l_partkey"], "b")
    texts = F.array_join(F.transform("b", lambda x: x["l_partkey"].cast("string")), ",")
    return found.select("o_orderkey", F.size("b").cast("bigint").alias("n"), texts.alias("parts"))


@query("""WITH p AS (SELECT l_orderkey AS tx, CASE WHEN l_linenumber = 1 THEN [l_suppkey % 2] WHEN l_linenumber % 2 = 0 THEN [l_suppkey % 2, l_linenumber]
  ELSE [l_suppkey % 2, l_linenumber - 1, l_linenumber] END AS path, l_linenumber AS i FROM lineitem)
SELECT a.tx, a.i, count(*) AS n_inner FROM p a JOIN p b ON a.tx = b.tx AND len(b.path) > len(a.path) AND b.path[1:len(a.path)] = a.path GROUP BY a.tx, a.i""")
def array_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, line = F.col("l_suppkey") % 2, F.col("l_linenumber").cast("bigint")
    path = F.when(line == 1, F.array(root)).when(line % 2 == 0, F.array(root, line)).otherwise(F.array(root, line - 1, line))
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tx"), path.alias("path"), F.col("l_linenumber").alias("i"))
    return joins.descendant_counts(items, "path", ["tx"]).where("n_inner > 0").groupBy("tx", "i").agg(F.sum("n_inner").alias("n_inner"))


@query("""SELECT o_orderkey, CAST(count(*) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS n_inputs, CAST(sum(l_partkey) FILTER (WHERE l_returnflag = 'N') AS BIGINT) AS inputs_value,
  CAST(count(*) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS n_outputs, CAST(sum(l_partkey) FILTER (WHERE l_returnflag <> 'N') AS BIGINT) AS outputs_value
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def utxo_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("value"), "l_returnflag")
    spent, made = items.where("l_returnflag = 'N'"), items.where("l_returnflag <> 'N'")
    return joins.group_transfers(read(spark, sf_dir, "orders").select("o_orderkey"), spent, made, ["o_orderkey"])


@query("""WITH {logs}, b AS (SELECT DISTINCT block_number AS number, block_number * 1000 + 250 AS received_ms FROM logs),
h AS (SELECT concat('rpc', CAST(x AS VARCHAR)) AS url, block_number AS number, block_number * 1000 + x * 40 AS rpc,
  row_number() OVER (PARTITION BY x ORDER BY block_number DESC) AS r FROM (SELECT DISTINCT block_number FROM logs), range(0, 3) t(x))
SELECT number, url, received_ms - rpc AS delay_ms FROM b JOIN h USING (number) WHERE r <= 512""")
def rpc_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = logs(spark, sf_dir).select(F.col("block_number").alias("number")).distinct()
    heads = numbers.select("number", F.explode(F.array(*map(F.lit, range(3)))).alias("x"))
    heads = heads.select(F.concat(F.lit("rpc"), F.col("x").cast("string")).alias("url"), "number", (F.col("number") * 1000 + F.col("x") * 40).alias("received_ms"))
    return joins.head_delays(numbers.withColumn("received_ms", F.col("number") * 1000 + 250), heads).select("number", "url", "delay_ms")


@query("""WITH e AS (SELECT o_custkey % 5 AS query_hash, o_orderkey * 10 AS block_from, o_orderkey * 10 + CASE WHEN o_orderkey % 97 = 96 THEN 8 ELSE 9 END AS block_to FROM orders),
p AS (SELECT query_hash, row_number() OVER (PARTITION BY query_hash ORDER BY block_from) * 10 AS block_from,
  row_number() OVER (PARTITION BY query_hash ORDER BY block_from) * 10 + (block_to - block_from) AS block_to FROM e),
f AS (SELECT *, block_from = coalesce(lag(block_to) OVER (PARTITION BY query_hash ORDER BY block_from) + 1, 20) AS ok FROM p WHERE block_from >= 20),
a AS (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY query_hash ORDER BY block_from ROWS UNBOUNDED PRECEDING) AS everything FROM f)
SELECT query_hash, block_from, block_to FROM a WHERE everything = 1""")
def cache_contiguous_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    orders = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 5).alias("query_hash"), "o_orderkey")
    place = F.row_number().over(Window.partitionBy("query_hash").orderBy("o_orderkey")).cast("bigint") * 10
    width = F.when(F.col("o_orderkey") % 97 == 96, 8).otherwise(9)
    entries = orders.select("query_hash", place.alias("block_from"), (place + width).alias("block_to"))
    return joins.contiguous_prefix(entries, 20)


@query("""WITH c AS (SELECT o_orderkey AS number, sha256(concat(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey < 900 THEN 'a' ELSE 'b' END)) AS hash FROM orders),
k AS (SELECT o_orderkey AS number, sha256(concat(CAST(o_orderkey AS VARCHAR), 'a')) AS hash FROM orders)
SELECT max(number) AS number FROM c JOIN k USING (number, hash) HAVING max(number) IS NOT NULL""")
def fork_ancestor_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("o_orderkey")
    hashed = lambda x: F.sha2(F.concat(number.cast("string"), x).cast("binary"), 256).alias("hash")
    orders = read(spark, sf_dir, "orders")
    chain = orders.select(number.alias("number"), hashed(F.when(number < 900, "a").otherwise("b")))
    return joins.fork_ancestor(chain, orders.select(number.alias("number"), hashed(F.lit("a")))).select("number")


@query("""WITH c AS (SELECT o_orderkey AS number, sha256(concat(CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey < 3000 THEN 'a' ELSE 'b' END)) AS hash FROM orders),
k AS (SELECT DISTINCT l_orderkey AS number, sha256(concat(CAST(l_orderkey AS VARCHAR), 'a')) AS hash FROM lineitem)
SELECT number, hash FROM c JOIN k USING (number, hash) ORDER BY number DESC LIMIT 1""")
def fork_ancestor_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fork of a chain of all orders from one of all orders that have lines, found by looking up the ends of stretches."""
    hashed = lambda number, x: F.sha2(F.concat(number.cast("string"), x).cast("binary"), 256).alias("hash")
    number, line = F.col("o_orderkey"), F.col("l_orderkey")
    chain = read(spark, sf_dir, "orders").select(number.alias("number"), hashed(number, F.when(number < 3000, "a").otherwise("b")))
    other = read(spark, sf_dir, "lineitem").select(line.alias("number"), hashed(line, F.lit("a"))).distinct()
    return joins.linked_ancestor(chain, other, stretch=100)


@query("""WITH b AS (SELECT l_returnflag AS chain, l_orderkey AS number, concat('h', l_orderkey, '-', l_linenumber % 2) AS hash, concat('h', l_orderkey - 1, '-', l_partkey % 2) AS parent FROM lineitem),
n AS (SELECT chain, number, count(*) AS n FROM b GROUP BY ALL),
p AS (SELECT *, lag(number) OVER (PARTITION BY chain ORDER BY number) AS before FROM n)
SELECT chain, 'gap' AS problem, before + 1 AS low, number - 1 AS high, number - before - 1 AS n FROM p WHERE number > before + 1
UNION ALL SELECT chain, 'repeat', number, number, n FROM n WHERE n > 1
UNION ALL SELECT b.chain, 'link', b.number, b.number, count(*) FROM b JOIN n ON n.chain = b.chain AND n.number = b.number - 1
  WHERE NOT EXISTS (SELECT 1 FROM b x WHERE x.chain = b.chain AND x.number = b.number - 1 AND x.hash = b.parent) GROUP BY b.chain, b.number""")
def chain_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks of three chains: numbers that are missing or repeated, and parents that aren't there."""
    key = F.col("l_orderkey")
    block = lambda number, bit: F.concat(F.lit("h"), number.cast("string"), F.lit("-"), (bit % 2).cast("string"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chain"), key.alias("number"), block(key, F.col("l_linenumber")).alias("hash"), block(key - 1, F.col("l_partkey")).alias("parent"))
    return tables.continuity(rows, ["chain"])


# --- changing tables --------------------------------------------------------------------------------------------------


@query("""WITH {signed}, net AS (SELECT block_number, address, value, CAST(sum(sign) AS BIGINT) AS n FROM signed WHERE block_number > 600 GROUP BY ALL HAVING sum(sign) > 0)
SELECT block_number, address, value, -1 AS sign FROM net, LATERAL (SELECT unnest(range(n)))""")
def signed_netting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cancel_rows(signed(spark, sf_dir), F.col("block_number") > 600)


@query("""WITH {signed} SELECT address, CAST(sum(sign) AS BIGINT) AS balance FROM signed GROUP BY address HAVING sum(sign) > 0""")
def collapsing_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.collapsed(signed(spark, sf_dir), ["address"])


@query("""WITH {signed} SELECT count(*) AS n FROM signed WHERE block_number > 600""")
def count_before_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.rows_to_remove(signed(spark, sf_dir), F.col("block_number") > 600)


def undo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.when(F.col("log_index") < 3, "INSERT").when(F.col("log_index") < 8, "UPDATE").otherwise("DELETE")
    return logs(spark, sf_dir).select("address", F.col("block_number"), F.col("log_index"), F.get("topics", 1).alias("value"), made.alias("operation"))


UNDO_SQL = """undo AS (SELECT address, block_number, log_index, topic1 AS value,
  CASE WHEN log_index < 3 THEN 'INSERT' WHEN log_index < 8 THEN 'UPDATE' ELSE 'DELETE' END AS operation FROM logs)"""


@query("WITH {logs}, " + UNDO_SQL + """ SELECT address, block_number, log_index, value, operation FROM (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_number, log_index) AS r FROM undo WHERE block_number > 400) WHERE r = 1""")
def first_before_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_images(undo_log(spark, sf_dir), ["address"], 400, order=["log_index"])


@query("WITH {logs}, " + UNDO_SQL + """, img AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_number, log_index) AS r FROM undo WHERE block_number > 900) WHERE r = 1),
now AS (SELECT address, block_number, log_index, value FROM (SELECT *, row_number() OVER (PARTITION BY address ORDER BY block_number DESC, log_index DESC) AS r FROM undo) WHERE r = 1)
SELECT address, block_number, log_index, value FROM now WHERE address NOT IN (SELECT address FROM img)
UNION ALL SELECT address, block_number, log_index, value FROM img WHERE operation <> 'INSERT'""")
def fork_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = undo_log(spark, sf_dir).withColumn("at", F.struct("block_number", "log_index"))
    now = tables.newest(log.drop("operation"), ["address"], "at").drop("at")
    return tables.roll_back(now, tables.first_images(log.drop("at"), ["address"], 900, order=["log_index"]), ["address"], 900)


@query("""WITH {logs} SELECT address, block_number, log_index FROM (
  SELECT address, block_number, log_index, row_number() OVER (PARTITION BY address ORDER BY event_id DESC) AS r FROM logs) WHERE r <= 3""")
def retention_keep_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select("address", "block_number", "log_index", (F.col("block_number") * 10 + F.col("log_index")).alias("seq"))
    return tables.keep_newest(rows, ["address"], "seq", 3).drop("seq")


@query("""WITH {logs} SELECT address, max(event_id) AS seq, arg_max(topic1, event_id) AS value FROM logs GROUP BY address""")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select("address", (F.col("block_number") * 10 + F.col("log_index")).alias("seq"), F.get("topics", 1).alias("value"))
    return tables.newest(rows, ["address"], "seq")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey > greatest(0, least(1400, 1000) - 300)""")
def retention_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.retain_blocks(read(spark, sf_dir, "orders").select("o_orderkey"), 1400, 1000, 300, "o_orderkey")


@query("""WITH {logs} SELECT event_id, max(CASE WHEN k % 3 <> 0 THEN event_id // 2 - k END) OVER (ORDER BY event_id) AS floor FROM logs""")
def finalized_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.conv(F.right(F.get("topics", 1), F.lit(15)), 16, 10).cast("bigint")
    number = F.col("block_number") * 10 + F.col("log_index")
    rows = logs(spark, sf_dir).select(number.alias("event_id"), F.when(k % 3 != 0, F.expr("(block_number * 10 + log_index) div 2") - k).alias("head"))
    return tables.running_max(rows, "event_id", "head", "floor", 1000).drop("head")


@query("""WITH {logs}, b AS (SELECT block_number // 20 AS batch, block_number FROM logs GROUP BY ALL)
SELECT batch, array_to_string(list(block_number ORDER BY block_number) FILTER (WHERE block_number > batch * 20 + 12), ',') AS chain FROM b GROUP BY batch
HAVING count(*) FILTER (WHERE block_number > batch * 20 + 12) > 0""")
def rollback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = logs(spark, sf_dir).select(F.expr("block_number div 20").alias("batch"), "block_number").distinct()
    chains = tables.rollback_chains(blocks, ["batch"], F.col("batch") * 20 + 12, "block_number")
    return chains.select("batch", F.array_join(F.transform("chain", lambda x: x.cast("string")), ",").alias("chain"))


@query("""WITH c AS (SELECT o_custkey % 4 AS t, o_orderkey AS to_block FROM orders)
SELECT t, to_block, coalesce(lag(to_block) OVER (PARTITION BY t ORDER BY to_block) + 1, 0) AS from_block FROM c""")
def coverage_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("t"), F.col("o_orderkey").alias("to_block"))
    return tables.coverage_windows(rows, ["t"], 0)


@query("""SELECT t, CAST(sum(CASE WHEN s BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN s = 429 THEN 1 ELSE 0 END) AS BIGINT) AS limited,
  CAST(sum(CASE WHEN s NOT BETWEEN 200 AND 299 AND s <> 429 THEN 1 ELSE 0 END) AS BIGINT) AS failed
FROM (SELECT event_type AS t, CASE CAST(user_id % 7 AS INTEGER) WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 204 ELSE 200 END AS s FROM events) GROUP BY t""")
def request_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 7
    status = F.when(k == 0, 429).when(k == 1, 503).when(k == 2, 204).otherwise(200)
    return tables.status_counts(read(spark, sf_dir, "events").select(F.col("event_type").alias("t"), status.alias("status")), ["t"])


@query("""WITH b AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT CAST(le AS DOUBLE) AS le, (SELECT count(*) FROM b WHERE le IS NULL OR n <= le) AS n FROM unnest([1.0, 2.0, 5.0, 10.0, NULL]) t(le)""")
def batch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("size"))
    return tables.histogram(sizes, "size", [1, 2, 5, 10])


@query("""WITH s AS (SELECT o_custkey % 3 AS p, o_orderkey AS ts, o_orderkey * 2 AS block_number, o_custkey AS bytes FROM orders),
w AS (SELECT *, min(ts) OVER r AS t0, min(block_number) OVER r AS b0, sum(bytes) OVER r AS total FROM s
  WINDOW r AS (PARTITION BY p ORDER BY ts ROWS BETWEEN 99 PRECEDING AND CURRENT ROW))
SELECT p, ts, CASE WHEN ts > t0 THEN round((block_number - b0) / (ts - t0), 6) ELSE 0 END AS blocks_per_s,
  CASE WHEN ts > t0 THEN round(CAST(total AS DOUBLE) / (ts - t0), 6) ELSE 0 END AS bytes_per_s FROM w""")
def progress_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("p"), F.col("o_orderkey").alias("ts"), (F.col("o_orderkey") * 2).alias("block_number"), F.col("o_custkey").alias("bytes"))
    rates = tables.throughput(samples, ["p"])
    return rates.select("p", "ts", F.round("blocks_per_s", 6).alias("blocks_per_s"), F.round("bytes_per_s", 6).alias("bytes_per_s"))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey * 5 AS low, o_orderkey * 5 + 20 + o_custkey % 30 AS high FROM orders),
c AS (SELECT low AS cut FROM r UNION SELECT high + 1 FROM r), p AS (SELECT cut AS lo, lead(cut) OVER (ORDER BY cut) - 1 AS hi FROM c)
SELECT lo AS low, hi AS high, array_to_string(list_sort(list(id)), ',') AS ids FROM p JOIN r ON r.low <= lo AND r.high >= hi GROUP BY lo, hi""")
def range_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping requests of all orders as disjoint segments with the requests that hold there."""
    key = F.col("o_orderkey")
    requests = read(spark, sf_dir, "orders").select(key.alias("id"), (key * 5).alias("low"), (key * 5 + 20 + F.col("o_custkey") % 30).alias("high"))
    return tables.segments(requests).select("low", "high", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderkey * 7 % 900 AS low, o_orderkey * 7 % 900 + 20 + o_orderkey % 300 AS high FROM orders),
c AS (SELECT k, low AS cut FROM r UNION SELECT k, high + 1 FROM r), p AS (SELECT k, cut AS lo, lead(cut) OVER (PARTITION BY k ORDER BY cut) - 1 AS hi FROM c)
SELECT p.k AS custkey, lo AS low, hi AS high, array_to_string(list_sort(list(id)), ',') AS ids FROM p JOIN r ON r.k = p.k AND r.low <= lo AND r.high >= hi GROUP BY p.k, lo, hi""")
def range_merge_by_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range_merge over all orders, for each customer."""
    key = F.col("o_orderkey")
    requests = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), key.alias("id"), (key * 7 % 900).alias("low"), (key * 7 % 900 + 20 + key % 300).alias("high"))
    return tables.segments(requests, keys=["custkey"]).select("custkey", "low", "high", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("""SELECT l_orderkey, l_linenumber, round(l_partkey * 1000 / pow(10, l_linenumber), 6) AS amount FROM lineitem WHERE l_returnflag = 'A'""")
def token_balance_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = scalars.scaled(F.col("l_partkey") * 1000, F.col("l_linenumber"))
    return read(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", F.round(amount, 6).alias("amount"))


@query("""WITH old AS (SELECT c_custkey AS k, c_name AS v FROM customer), new AS (SELECT c_custkey AS k, concat(c_name, '!') AS v FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT c_custkey + 1000000, 'new' FROM customer WHERE c_custkey % 10 = 0)
SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v FROM new""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    new = old.where("k % 4 = 0").withColumn("v", F.concat("v", F.lit("!"))).unionByName(old.where("k % 10 = 0").select((F.col("k") + 1000000).alias("k"), F.lit("new").alias("v")))
    return tables.upsert(old, new, ["k"])


@query("""WITH {logs}, old AS (SELECT address, min(event_id) AS seq FROM logs WHERE block_number < 300 GROUP BY address),
new AS (SELECT address, min(event_id) AS seq FROM logs WHERE block_number >= 300 GROUP BY address)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE address NOT IN (SELECT address FROM old)""")
def insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).select("address", (F.col("block_number") * 10 + F.col("log_index")).alias("seq"), "block_number")
    old = joins.first_by(rows.where("block_number < 300").select("address", "seq"), ["address"], ["seq"])
    return tables.insert_or_ignore(old, rows.where("block_number >= 300").select("address", "seq"), ["address"], ["seq"])


@query("""WITH {logs}, h AS (SELECT block_number AS number, min(ts_seconds) AS ts FROM logs GROUP BY block_number), w AS (SELECT min(ts) + (max(ts) - min(ts)) // 2 AS middle FROM h)
SELECT min(number) AS number FROM h, w WHERE ts >= middle""")
def timestamp_to_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = logs(spark, sf_dir).groupBy(F.col("block_number").alias("number")).agg(F.min("ts_seconds").alias("ts"))
    middle = headers.agg(F.expr("min(ts) + (max(ts) - min(ts)) div 2")).first()[0]
    return tables.block_at(headers, middle or 0, time="ts")


@query("""WITH {logs} SELECT max(block_number) AS number, sha256(CAST(max(block_number) AS VARCHAR)) AS hash FROM logs""")
def head_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = F.sha2(F.col("block_number").cast("string").cast("binary"), 256)
    return tables.head(logs(spark, sf_dir).select(F.col("block_number").alias("number"), hashed.alias("hash")))


@query("""WITH {logs} SELECT DISTINCT event_type, substr(sha256(event_type), 1, 4) AS suffix, concat('41', right(topic1, 40)) AS tron FROM logs WHERE k < 3""")
def scalar_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = logs(spark, sf_dir).where(F.get("topics", 1) < f"0x{3:064x}")
    return rows.select("event_type", scalars.signature_suffix(F.col("event_type")).alias("suffix"), scalars.topic_address(F.get("topics", 1), "41").alias("tron")).distinct()


@query("""SELECT p_type AS kind, CASE p_size % 4 WHEN 0 THEN 'P2PKH' WHEN 1 THEN 'P2SH' WHEN 2 THEN 'OP_RETURN' ELSE 'unknown' END AS script, count(*) AS n FROM part GROUP BY ALL""")
def script_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    raw = F.when(k == 0, "pubkeyhash").when(k == 1, "scripthash").when(k == 2, "nulldata").otherwise("nonstandard")
    return read(spark, sf_dir, "part").groupBy(F.col("p_type").alias("kind"), scalars.script_kind(raw).alias("script")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN concat('OP_RETURN ', lower(hex(p_name)), ' ', lower(hex(p_name))) WHEN 1 THEN 'op_return  00ff' WHEN 2 THEN 'OP_RETURN 414' ELSE 'OP_DUP OP_HASH160' END AS asm FROM part),
h AS (SELECT *, regexp_extract(asm, '(?i)^OP_RETURN\\s+([0-9a-f]+)', 1) AS x FROM a), b AS (SELECT *, x[1:len(x) - len(x) % 2] AS y FROM h)
SELECT p_partkey, CASE WHEN x = '' THEN asm WHEN regexp_full_match(y, '([2-6][0-9a-f]|7[0-9a-e])*') THEN concat('"', CAST(unhex(y) AS VARCHAR), '"') ELSE concat('0x', x) END AS text FROM b""")
def script_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_size") % 4, F.lower(F.hex("p_name"))
    asm = F.when(k == 0, F.concat(F.lit("OP_RETURN "), name, F.lit(" "), name)).when(k == 1, "op_return  00ff").when(k == 2, "OP_RETURN 414").otherwise("OP_DUP OP_HASH160")
    return read(spark, sf_dir, "part").select("p_partkey", scalars.op_return_text(asm).alias("text"))


@query("""WITH {logs} SELECT block_number, log_index, ts_seconds AS timestamp, address AS token, concat('0x', right(topic1, 40)) AS "from", address AS "to", CAST(CAST(cents AS HUGEINT) * 18446744073709551616 AS VARCHAR) AS amount FROM logs
WHERE event_type = 'purchase' AND k BETWEEN 1 AND 50""")
def token_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: transfers of a fungible token filtered by their sender, decoded and projected. Purchases play transfers."""
    transfer = abi.ERC20["Transfer"]
    padded = F.concat(F.lit("0x"), F.lpad(F.right("address", F.lit(40)), 64, "0"))
    kind = F.when(F.get("topics", 0) == topic("purchase"), transfer.topic0).otherwise(F.get("topics", 0))
    data = F.concat(F.lit("0x"), F.right("data", F.lit(48)), F.repeat(F.lit("0"), F.lit(16)))
    rows = logs(spark, sf_dir).select("block_number", "log_index", "ts_seconds", "address", F.array(kind, F.get("topics", 1), padded).alias("topics"), data.alias("data"))
    wanted = {"topic0": transfer.topic0, "topic1": ["0x" + abi.encode_word(transfer.params[0], f"0x{k:040x}") for k in range(1, 51)]}
    found = filters.match(rows, [(Range(0), wanted)]).withColumn("e", abi.event_column(transfer))
    return found.select("block_number", "log_index", F.col("ts_seconds").alias("timestamp"), F.col("address").alias("token"), "e.from", "e.to", F.col("e.value").alias("amount"))


from ledgerloom import chain_queries  # noqa: E402, F401  registers its queries
