"""Stand-ins: the relational test tables as programs, graphs and traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.functions.names import Rules
from kinmatch.operators.similarity import tokens

#: Normalisation for word features: small classes, one group, and frequent words as the stop list.
WORD_RULES = Rules(
    classes=(("the", "that", "this"), ("a", "an"), ("und", "oder"), ("la", "las", "los"), ("un", "une")),
    groups=((("of", "from"), ("for",)),),
    stop=("to", "and", "in", "is", "it", "de", "le", "die", "der", "que"),
    prefix="",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f0, feats): benchmark items as the functions of program 0."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("f0"), tokens(F.col("text")).alias("feats"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f1, feats): documents as the functions of program 1.

    They are dealt by id before their words are taken apart, however few row groups hold them; joined with a broadcast
    side, all words of a document then meet in one task, and counts of pairs need no shuffle of their own.
    """
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("f1"), "text").repartition("f1").select("f1", tokens(F.col("text")).alias("feats"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, revenue): revenue from suppliers' nations to customers' nations."""
    l, o, s, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer"))
    sides = l.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount").join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sides = sides.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    # decimals, so that sums don't depend on their order
    money = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))
    return sides.groupBy(F.col("s_nationkey").cast("bigint").alias("src"), F.col("c_nationkey").cast("bigint").alias("dst")).agg(F.sum(money).alias("revenue"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): each supplying nation's two best customer nations."""
    w = Window.partitionBy("src").orderBy(F.col("revenue").desc(), "dst")
    return trade(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 2").select("src", "dst")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of users."""
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")


BOUNDARIES = ("purchase", "error")

TOKENS_SQL = """
item_tok AS (SELECT DISTINCT item_id AS f0, tok FROM (SELECT item_id, unnest(string_split(lower(coalesce(text, '')), ' ')) AS tok FROM benchmark) WHERE tok <> ''),
doc_tok AS (SELECT DISTINCT doc_id AS f1, tok FROM (SELECT doc_id, unnest(string_split(lower(coalesce(text, '')), ' ')) AS tok FROM documents) WHERE tok <> '')"""

PAIRS_SQL = (
    TOKENS_SQL
    + """,
n0 AS (SELECT f0, count(*) AS n0 FROM item_tok GROUP BY f0),
n1 AS (SELECT f1, count(*) AS n1 FROM doc_tok GROUP BY f1),
pairs AS (
  SELECT f0, f1, common, n0, n1, common / CAST(n0 + n1 - common AS DOUBLE) AS score
  FROM (SELECT f0, f1, count(*) AS common FROM item_tok JOIN doc_tok USING (tok) GROUP BY f0, f1) JOIN n0 USING (f0) JOIN n1 USING (f1)
)"""
)

EDGES_SQL = """
trade AS (
  SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS revenue
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
),
edge AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY revenue DESC, dst) AS n FROM trade) WHERE n <= 2)"""

CLOSURE_SQL = (
    EDGES_SQL
    + """,
walk AS (
  SELECT src, dst, 1 AS depth FROM edge
  UNION
  SELECT w.src, e.dst, w.depth + 1 FROM walk w JOIN edge e ON w.dst = e.src WHERE w.depth < 25
),
reach AS (SELECT src, dst, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY src, dst)"""
)

SEGMENTS_SQL = """
marked AS (SELECT user_id, ts, event_id, event_type, CAST(event_type IN ('purchase', 'error') AS INT) AS b FROM events),
numbered AS (
  SELECT *, row_number() OVER w AS pos, sum(b) OVER w - b AS seg_no, sum(b) OVER (PARTITION BY user_id) AS all_b
  FROM marked WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
),
kept AS (SELECT * FROM numbered WHERE seg_no < all_b OR (all_b = 0 AND pos = 1)),
segs AS (
  SELECT user_id, CAST(seg_no AS BIGINT) AS seg_no, count(*) AS n_blocks, arg_min(event_id, pos) AS first_event, arg_max(event_id, pos) AS last_event, string_agg(event_type, '>' ORDER BY pos) AS label
  FROM kept GROUP BY user_id, seg_no
)"""
