"""All queries over the relational tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinmatch.functions import expr_udfs, exprs
from kinmatch.functions.names import normalised
from kinmatch.functions.scalars import classified, jaccard
from kinmatch.operators import blocks, graph, matching, merge, paths, ranking, similarity
from kinmatch.operators.alignment import aligned_paths
from kinmatch.plans import adapters as ad
from kinmatch.plans import compare
from kinmatch.plans.registry import ORACLE_SQL, QUERIES, query
from kinmatch.sources import report

def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f0, f1, score, diff, n0, n1, common): Jaccard of all pairs that share a token, and the difference of sizes."""
    return similarity.jaccard_pairs(ad.items(spark, sf_dir), ad.documents(spark, sf_dir)).withColumn("diff", F.abs(F.col("n0") - F.col("n1")).cast("double"))


def _ranking(spark: SparkSession, sf_dir: str, top: int | None = None) -> DataFrame:
    return ranking.ranked(_scored(spark, sf_dir), top)


_RANKED_SQL = ad.PAIRS_SQL + """,
ranked AS (SELECT f0, f1, score, common, n0, n1, CAST(abs(n0 - n1) AS DOUBLE) AS diff, row_number() OVER (PARTITION BY f0 ORDER BY score DESC, abs(n0 - n1), f1) AS rank FROM pairs)"""


@query(f"WITH {_RANKED_SQL} SELECT f0 AS item_id, f1 AS doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5")
def similar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents most like each item, by Jaccard similarity of their words."""
    return _ranking(spark, sf_dir, 5).select(F.col("f0").alias("item_id"), F.col("f1").alias("doc_id"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _rules_sql(src: str, out: str) -> str:
    """Word normalisation in SQL, from (id, tok) rows."""
    heads = " ".join(f"WHEN tok = '{n}' THEN '{h}'" for n, h in ad.WORD_RULES.heads().items() if n != h)
    stop = ", ".join(f"'{s}'" for s in ad.WORD_RULES.stop)
    return f"""
{out}_flags AS (SELECT id, bool_or(tok = 'of') AND bool_or(tok = 'from') AS g0, bool_or(tok = 'for') AS g1 FROM {src} GROUP BY id),
{out}_form AS (
  SELECT DISTINCT id, tok FROM (
    SELECT id, CASE {heads} ELSE tok END AS tok FROM {src}
    UNION ALL SELECT id, unnest(['of', 'from']) FROM {out}_flags WHERE NOT g0 AND g1
  ) r WHERE NOT EXISTS (SELECT 1 FROM {out}_flags f WHERE f.id = r.id AND NOT f.g0 AND f.g1 AND r.tok = 'for')
),
{out} AS (SELECT id, tok FROM {out}_form WHERE tok NOT IN ({stop}))"""


@query(f"""WITH {ad.TOKENS_SQL}, src AS (SELECT f1 AS id, tok FROM doc_tok), {_rules_sql("src", "norm")}
SELECT d.doc_id, count(n.tok) AS n_features, md5(coalesce(string_agg(n.tok, ' ' ORDER BY n.tok), '')) AS features
FROM documents d LEFT JOIN norm n ON n.id = d.doc_id GROUP BY d.doc_id""")
def feature_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised word sets of documents: classes to their heads, groups, stop words out."""
    form = ad.documents(spark, sf_dir).select("f1", F.array_sort(normalised(F.col("feats"), ad.WORD_RULES)).alias("form"))
    return form.select(F.col("f1").alias("doc_id"), F.size("form").cast("bigint").alias("n_features"), F.md5(F.array_join("form", " ")).alias("features"))


@query(f"""WITH {ad.TOKENS_SQL}, src0 AS (SELECT f0 AS id, tok FROM item_tok), src1 AS (SELECT f1 AS id, tok FROM doc_tok), {_rules_sql("src0", "a")}, {_rules_sql("src1", "b")},
na AS (SELECT item_id AS id, (SELECT count(*) FROM a WHERE a.id = item_id) AS n, (SELECT count(*) FROM src0 WHERE src0.id = item_id) AS raw FROM benchmark),
nb AS (SELECT doc_id AS id, (SELECT count(*) FROM b WHERE b.id = doc_id) AS n, (SELECT count(*) FROM src1 WHERE src1.id = doc_id) AS raw FROM documents),
usual AS (SELECT i, j, c / CAST(na.n + nb.n - c AS DOUBLE) AS score FROM (SELECT a.id AS i, b.id AS j, count(*) AS c FROM a JOIN b ON a.tok = b.tok GROUP BY 1, 2) JOIN na ON na.id = i JOIN nb ON nb.id = j),
mixed AS (SELECT i, j, c / CAST(na.raw + nb.raw - c AS DOUBLE) AS score FROM (SELECT x.id AS i, y.id AS j, count(*) AS c FROM src0 x JOIN src1 y ON x.tok = y.tok GROUP BY 1, 2) JOIN na ON na.id = i JOIN nb ON nb.id = j WHERE (na.n = 0) <> (nb.n = 0)),
blank AS (SELECT na.id AS i, nb.id AS j, CAST(1 AS DOUBLE) AS score FROM na, nb WHERE na.n = 0 AND nb.n = 0 AND NOT (na.raw = 0 AND nb.raw = 0))
SELECT i AS item_id, j AS doc_id, round(score, 6) AS score FROM (SELECT * FROM usual UNION ALL SELECT * FROM mixed UNION ALL SELECT * FROM blank) WHERE score >= 0.01""")
def jaccard_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items and documents that pass the similarity gate, its special cases included."""
    out = similarity.gated_pairs(ad.items(spark, sf_dir), ad.documents(spark, sf_dir), ad.WORD_RULES)
    return out.select(F.col("f0").alias("item_id"), F.col("f1").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""WITH a AS (SELECT CAST(s_nationkey AS BIGINT) AS f0, count(*) AS n0 FROM supplier GROUP BY 1), b AS (SELECT p_brand AS f1, count(*) // 20 AS n1 FROM part GROUP BY 1)
SELECT f0, f1, n0, n1 FROM a, b WHERE CASE WHEN least(n0, n1) = 0 THEN greatest(n0, n1) <= 3 ELSE NOT (greatest(n0, n1) > 2 * least(n0, n1) AND greatest(n0, n1) - least(n0, n1) > 3) END""")
def count_gate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nations and brands whose counts pass the cheap gate."""
    a = ad.table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("f0")).agg(F.count("*").alias("n"))
    b = ad.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("f1")).agg(F.floor(F.count("*") / 20).cast("bigint").alias("n"))
    return similarity.pairs_of_like_counts(a, b)


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a prefix; the predicate reaches the scan."""
    return ad.table(spark, sf_dir, "part").where(F.col("p_name").startswith("red")).select("p_partkey", "p_name")


#: Half-open ranges in order of precedence; the first that holds a value decides.
PRICE_CLASSES = (("exe_ptr", ((1000.0, 2000.0), (50000.0, 51000.0))), ("data_ptr", ((1500.0, 30000.0),)), ("obj_ptr", ((0.0, 1200.0), (60000.0, 70000.0))))
_CLASS_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"(l_extendedprice >= {lo} AND l_extendedprice < {hi})" for lo, hi in ranges) + f" THEN '{name}'" for name, ranges in PRICE_CLASSES) + " ELSE 'literal' END"


@query(f"SELECT {_CLASS_SQL} AS class, l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2")
def range_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values classified by ranges with precedence."""
    rows = ad.table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("bigint").alias("q"), classified(F.col("l_extendedprice"), PRICE_CLASSES, F.lit("literal")).alias("class"))
    return rows.groupBy("class", "l_returnflag").agg(F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query("""SELECT user_id, event_id, block FROM (
  SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM events
) WHERE event_type = 'error' AND block IS NOT NULL""")
def interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every error of a user the purchase whose interval, up to the next purchase, holds it."""
    e = ad.steps(spark, sf_dir)
    found = paths.enclosing(e.where("event_type = 'error'"), e.where("event_type = 'purchase'"), ["user_id"], ["ts", "event_id"])
    return found.select("user_id", "event_id", F.col("found.event_id").alias("block"))


_REFERENCES_SQL = """refs AS (SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_quantity = 50 AND o_orderpriority = '1-URGENT'),
known AS (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_regionkey <> 4)"""


@query(f"WITH {ad.EDGES_SQL}, {_REFERENCES_SQL} SELECT src, dst FROM edge UNION SELECT src, dst FROM refs WHERE src IN (SELECT node FROM known) AND dst IN (SELECT node FROM known)")
def edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade edges, and reference edges between known nations."""
    l, o, s, c = (ad.table(spark, sf_dir, t) for t in ("lineitem", "orders", "supplier", "customer"))
    rows = l.where("l_returnflag = 'R' and l_quantity = 50").select("l_orderkey", "l_suppkey").join(o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    refs = rows.select(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst"))
    known = ad.table(spark, sf_dir, "nation").where("n_regionkey <> 4").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return graph.with_references(ad.edges(spark, sf_dir), refs, known)


@query(f"WITH RECURSIVE {ad.CLOSURE_SQL} SELECT src, dst, depth FROM reach")
def closure_min_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitive closure with least depths."""
    return graph.closure(ad.edges(spark, sf_dir)).select("src", "dst", F.col("depth").cast("bigint").alias("depth"))


_FEATURES_SQL = "feat AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS node, p_brand AS feat FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size >= 48)"


@query(f"WITH RECURSIVE {ad.CLOSURE_SQL}, {_FEATURES_SQL} SELECT node, count(DISTINCT feat) AS n_features FROM (SELECT node, feat FROM feat UNION ALL SELECT src, feat FROM reach JOIN feat ON dst = node) GROUP BY node")
def closure_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many brands a nation supplies itself or through all nations that it reaches."""
    s, l, p = (ad.table(spark, sf_dir, t) for t in ("supplier", "lineitem", "part"))
    rows = l.select("l_suppkey", "l_partkey").join(p.where("p_size >= 48").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    feats = rows.select(F.col("s_nationkey").cast("bigint").alias("node"), F.col("p_brand").alias("feat")).distinct()
    return graph.closure_features(graph.closure(ad.edges(spark, sf_dir)), feats).groupBy("node").agg(F.count("*").alias("n_features"))


@query(f"WITH RECURSIVE {ad.CLOSURE_SQL} SELECT dst AS node, src AS caller, depth FROM reach WHERE dst IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that reaches the nations of a region, with its depth."""
    nodes = ad.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return graph.callers_of(graph.closure(ad.edges(spark, sf_dir)), nodes).select("node", "caller", F.col("depth").cast("bigint").alias("depth"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def no_feature_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    nodes = ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return graph.without_features(nodes, ad.table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("node"))).select(F.col("node").alias("c_custkey"))


_NATION_SCORES_SQL = """brand AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS node, p_brand AS feat FROM supplier JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE p_size >= 48),
size AS (SELECT node, count(*) AS n FROM brand GROUP BY node),
score AS (SELECT a.node AS f0, b.node AS f1, count(*) / CAST(any_value(x.n) + any_value(y.n) - count(*) AS DOUBLE) AS score FROM brand a JOIN brand b USING (feat) JOIN size x ON x.node = a.node JOIN size y ON y.node = b.node GROUP BY 1, 2)"""


def _nation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, l, p = (ad.table(spark, sf_dir, t) for t in ("supplier", "lineitem", "part"))
    rows = l.select("l_suppkey", "l_partkey").join(p.where("p_size >= 48").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sets = rows.groupBy(F.col("s_nationkey").cast("bigint").alias("f0")).agg(F.collect_set("p_brand").alias("feats"))
    return similarity.jaccard_pairs(sets, sets.withColumnRenamed("f0", "f1")).select("f0", "f1", "score", F.abs(F.col("n0") - F.col("n1")).cast("double").alias("diff"))


@query(f"""WITH RECURSIVE {ad.CLOSURE_SQL}, {_NATION_SCORES_SQL},
callers AS (SELECT dst AS node, src AS caller, depth FROM reach), n AS (SELECT node, count(*) AS n FROM callers GROUP BY node),
pairs AS (SELECT DISTINCT f0, f1 FROM score),
best AS (SELECT p.f0, p.f1, a.caller, a.depth, max(s.score) AS s FROM pairs p JOIN callers a ON a.node = p.f0 JOIN callers b ON b.node = p.f1 JOIN score s ON s.f0 = a.caller AND s.f1 = b.caller GROUP BY 1, 2, 3, 4),
total AS (SELECT f0, f1, sum(s * pow(0.9, depth - 1)) AS total FROM best GROUP BY 1, 2)
SELECT p.f0, p.f1, round(coalesce(total, 0.0) / x.n, 6) AS score, abs(x.n - coalesce(y.n, 0)) AS diff
FROM pairs p JOIN n x ON x.node = p.f0 LEFT JOIN n y ON y.node = p.f1 LEFT JOIN total t ON t.f0 = p.f0 AND t.f1 = p.f1""")
def caller_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations compared by the nations that reach them."""
    callers = graph.callers_of(graph.closure(ad.edges(spark, sf_dir)))
    scores = _nation_scores(spark, sf_dir)
    return ranking.caller_score(callers, callers, scores, scores.select("f0", "f1")).select("f0", "f1", F.round("score", 6).alias("score"), "diff")


_DAG_SQL = "dag AS (SELECT src, dst FROM edge WHERE src < dst)"


@query(f"""WITH RECURSIVE {ad.EDGES_SQL}, {_DAG_SQL},
below AS (SELECT src, dst FROM dag UNION SELECT b.src, d.dst FROM below b JOIN dag d ON b.dst = d.src)
SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation n WHERE n_regionkey = 2 OR EXISTS (SELECT 1 FROM below b JOIN nation m ON m.n_nationkey = b.dst WHERE b.src = n.n_nationkey AND m.n_regionkey = 2)""")
def trim_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations left after leaves outside one region are cut away again and again."""
    nodes = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"), (F.col("n_regionkey") == 2).alias("is_call"))
    return graph.trimmed(nodes, ad.edges(spark, sf_dir).where("src < dst")).select("node")


@query(f"WITH {ad.EDGES_SQL}, {_DAG_SQL} SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey NOT IN (SELECT src FROM dag)")
def leaf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations without an outgoing edge."""
    nodes = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("node"))
    return graph.leaves(nodes, ad.edges(spark, sf_dir).where("src < dst"))


@query(f"""WITH RECURSIVE {ad.EDGES_SQL}, {_DAG_SQL},
path AS (
  SELECT src AS root, [src] AS p, src AS last FROM (SELECT DISTINCT src FROM dag WHERE src NOT IN (SELECT dst FROM dag))
  UNION ALL SELECT root, list_append(p, dst), dst FROM path JOIN dag ON last = src WHERE NOT list_contains(p, dst)
)
SELECT root, array_to_string(p, '>') AS path, len(p) AS n_nodes FROM path WHERE last NOT IN (SELECT src FROM dag)""")
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All simple paths from nations without an incoming edge to those without an outgoing one."""
    dag = ad.edges(spark, sf_dir).where("src < dst")
    roots = dag.select(F.col("src").alias("node")).distinct().join(dag.select(F.col("dst").alias("node")), "node", "left_anti")
    return graph.simple_paths(dag, roots).select("root", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.size("path").cast("bigint").alias("n_nodes"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ad.steps(spark, sf_dir).withColumn("item", F.struct("event_id", "event_type"))
    return paths.segments(e, ["user_id"], ["ts", "event_id"], F.col("event_type").isin(*ad.BOUNDARIES), "item")


@query(f"WITH {ad.SEGMENTS_SQL} SELECT user_id, seg_no, n_blocks, first_event, last_event FROM segs")
def segment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' traces cut after purchases and errors."""
    first, last = F.element_at("items", 1)["event_id"], F.element_at("items", -1)["event_id"]
    return _segments(spark, sf_dir).select("user_id", "seg_no", "n_blocks", first.alias("first_event"), last.alias("last_event"))


@query(f"WITH {ad.SEGMENTS_SQL} SELECT DISTINCT coalesce(lag(label) OVER (PARTITION BY user_id ORDER BY seg_no), '0') AS src, label AS dst FROM segs")
def segment_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of consecutive segments, by their event types."""
    return paths.segment_edges(_segments(spark, sf_dir), ["user_id"], F.array_join(F.transform("items", lambda i: i["event_type"]), ">"))


@query(f"WITH {ad.SEGMENTS_SQL} SELECT user_id, count(*) AS n_segments, CAST(sum(n_blocks) AS BIGINT) AS length FROM segs GROUP BY user_id")
def segment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments and blocks of each trace."""
    return paths.segment_lengths(_segments(spark, sf_dir), ["user_id"])


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query(f"""SELECT l_orderkey, row_number() OVER w AS pos, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "offset" FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY {", ".join(c + " DESC" for c in _LINE_ORDER)})""")
def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of an order's quantities, from its last line to its first."""
    rows = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", *_LINE_ORDER, F.col("l_quantity").cast("bigint").alias("size"))
    return paths.running_offsets(rows, ["l_orderkey"], _LINE_ORDER, "size")


@query("""SELECT o_custkey, o_orderkey, n_lines, quantity FROM (
  SELECT o_custkey, o_orderkey, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderkey) AS n
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) WHERE n = 1""")
def longest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's order of most lines; the first of equal ones."""
    lines = ad.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    return paths.longest_wins(ad.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").join(lines, "o_orderkey"), "o_custkey", "o_orderkey", "n_lines", ["quantity"])


@query(f"WITH {ad.PAIRS_SQL} SELECT f0 AS item_id, f1 AS doc_id, round(score, 6) AS score, CAST(diff AS DOUBLE) AS diff FROM (SELECT *, abs(n0 - n1) AS diff, row_number() OVER (PARTITION BY f0 ORDER BY score DESC, abs(n0 - n1), f1) AS n FROM pairs) WHERE n = 1")
def best_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's best document: greatest score, then least difference."""
    return ranking.best_partner(_scored(spark, sf_dir)).select(F.col("f0").alias("item_id"), F.col("f1").alias("doc_id"), F.round("score", 6).alias("score"), "diff")


#: Results that a report lists for each function; the counterpart is looked for in the whole ranking.
LISTED = 20
_INDEX_SQL = _RANKED_SQL + """,
idx AS (SELECT f0, CAST(coalesce(max(CASE WHEN contains(d.text, b.text) THEN rank - 1 END), -1) AS BIGINT) AS match_index FROM ranked JOIN documents d ON d.doc_id = f1 JOIN benchmark b ON b.item_id = f0 GROUP BY f0)"""


def _indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth: a document that holds the whole item is its counterpart, at whatever rank it stands."""
    top = _ranking(spark, sf_dir).select("f0", "f1", "rank")
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("f1"), F.col("text").alias("there"))
    item_texts = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("f0"), F.col("text").alias("here"))
    return ranking.match_index(top.join(docs, "f1").join(item_texts, "f0"), F.contains("there", "here"))


@query(f"WITH {_INDEX_SQL} SELECT f0 AS item_id, match_index FROM idx")
def match_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last place in each item's ranking at which a true counterpart stands."""
    return _indexes(spark, sf_dir).select(F.col("f0").alias("item_id"), "match_index")


@query(f"WITH {_INDEX_SQL} SELECT count(*) FILTER (match_index >= 0) AS valid, count(*) FILTER (match_index BETWEEN 0 AND 0) AS top1, count(*) FILTER (match_index BETWEEN 0 AND 2) AS top3, count(*) FILTER (match_index BETWEEN 0 AND 4) AS top5 FROM idx")
def topn_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many items have a counterpart, and have it among the first 1, 3 and 5."""
    return ranking.top_hits(_indexes(spark, sf_dir))


@query(f"""WITH {ad.PAIRS_SQL}, hit AS (SELECT DISTINCT f0 FROM pairs JOIN documents d ON d.doc_id = f1 JOIN benchmark b ON b.item_id = f0 WHERE score >= 0.1 AND contains(d.text, b.text))
SELECT count(*) FILTER (h.f0 IS NULL) AS n_missed, count(*) AS n_total FROM benchmark LEFT JOIN hit h ON h.f0 = item_id""")
def false_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose counterpart is missing from their results."""
    docs = ad.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("f1"), F.col("text").alias("there"))
    item_texts = ad.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("f0"), F.col("text").alias("here"))
    solver = _scored(spark, sf_dir).where("score >= 0.1").select("f0", "f1").join(docs, "f1").join(item_texts, "f0")
    return ranking.false_negatives(solver, item_texts, F.contains("there", "here"))


_SECOND_SQL = """second AS (SELECT f0 AS f, f1 AS g, common / CAST(n0 AS DOUBLE) AS score, row_number() OVER (PARTITION BY f0 ORDER BY common DESC, f1) AS pos FROM pairs)"""


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second method's lists: the ten documents that hold most of an item's words."""
    w = Window.partitionBy("f0").orderBy(F.col("common").desc(), "f1")
    return _scored(spark, sf_dir).withColumn("pos", F.row_number().over(w)).where("pos <= 10").select(F.col("f0").alias("f"), F.col("f1").alias("g"), (F.col("common") / F.col("n0")).alias("score"), "pos")


@query(f"""WITH {ad.PAIRS_SQL}, {_SECOND_SQL}, b AS (SELECT * FROM second WHERE pos <= 10), a AS (SELECT f0 AS f, f1 AS g, score FROM pairs WHERE score >= 0.15),
k AS (SELECT DISTINCT f FROM a),
u AS (
  SELECT b.f, b.g, CASE WHEN k.f IS NOT NULL THEN coalesce(a.score, 0.0) END AS use_score, b.score AS second_score, b.pos FROM b LEFT JOIN a ON a.f = b.f AND a.g = b.g LEFT JOIN k ON k.f = b.f
  UNION ALL SELECT a.f, a.g, a.score, 0.0, NULL FROM a WHERE a.score >= 0.29 AND NOT EXISTS (SELECT 1 FROM b WHERE b.f = a.f AND b.g = a.g) AND a.f IN (SELECT f FROM b)
)
SELECT f AS item_id, g AS doc_id, round(use_score, 6) AS use_score, round(second_score, 6) AS second_score,
  row_number() OVER (PARTITION BY f ORDER BY use_score DESC NULLS LAST, CASE WHEN use_score IS NOT NULL THEN second_score END DESC NULLS LAST, pos ASC NULLS LAST, g) AS rank FROM u""")
def rerank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard scores merged with the second method's lists."""
    solver = _scored(spark, sf_dir).where("score >= 0.15").select(F.col("f0").alias("f"), F.col("f1").alias("g"), "score")
    out = merge.merged(solver, _second(spark, sf_dir))
    return out.select(F.col("f").alias("item_id"), F.col("g").alias("doc_id"), F.round("use_score", 6).alias("use_score"), F.round("second_score", 6).alias("second_score"), "rank")


@query(f"""WITH {_INDEX_SQL}, solved AS (SELECT r.*, common >= 6 AS ok FROM ranked r WHERE rank <= {LISTED})
SELECT 'f' || s.f0 || ':x' AS f, 'g' || f1 AS g, round(score, 6) AS score FROM solved s JOIN idx ON idx.f0 = s.f0 WHERE match_index >= 0 AND ok AND round(score, 6) > 0""")
def report_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings written as a report and parsed again: solved results of positive score of functions with a counterpart."""
    top = _ranking(spark, sf_dir, LISTED).select("f0", F.concat(F.lit("g"), F.col("f1").cast("string")).alias("g"), "rank", "score", "diff", (F.col("common") >= 6).alias("solved"))
    lines = report.report_lines(top, _indexes(spark, sf_dir), F.concat(F.lit("f"), F.col("f0").cast("string"), F.lit(":x")), F.format_string("0x%x", "f0"))
    named = lines.select(F.col("f0").alias("file"), F.col("part").alias("line_no"), "line")
    return report.long_rows(report.parsed(named)).select("f", "g", "score")


@query(f"WITH {ad.SEGMENTS_SQL} SELECT user_id, seg_no, label FROM (SELECT user_id, seg_no, label, row_number() OVER (PARTITION BY user_id ORDER BY md5(label || '#' || seg_no), label || '#' || seg_no) AS n FROM segs) WHERE n <= 5")
def sample_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five segments of each trace, sampled by hash."""
    segs = _segments(spark, sf_dir).select("user_id", "seg_no", F.array_join(F.transform("items", lambda i: i["event_type"]), ">").alias("label"))
    return paths.sampled(segs, ["user_id"], F.concat("label", F.lit("#"), F.col("seg_no").cast("string")), 5)


def _turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", similarity.tokens(F.col("text")).alias("feats"))
    sides = [c.where(cond).select("conv_id", F.col("turn").alias(k), F.col("feats").alias(f"feats_{k}")) for k, cond in (("i", "role = 'user'"), ("j", "role <> 'user'"))]
    return sides[0], sides[1]


_GREEDY_SQL = """turn_tok AS (SELECT DISTINCT conv_id, turn, role = 'user' AS own, tok FROM (SELECT conv_id, turn, role, unnest(string_split(lower(coalesce(text, '')), ' ')) AS tok FROM conversations) WHERE tok <> ''),
size AS (SELECT conv_id, turn, own, count(*) AS n FROM turn_tok GROUP BY ALL),
common AS (SELECT a.conv_id, a.turn AS i, b.turn AS j, count(*) AS c FROM turn_tok a JOIN turn_tok b ON a.conv_id = b.conv_id AND a.tok = b.tok WHERE a.own AND NOT b.own GROUP BY ALL),
scored AS (SELECT c.conv_id, i, j, c / CAST(x.n + y.n - c AS DOUBLE) AS score FROM common c JOIN size x ON x.conv_id = c.conv_id AND x.turn = i AND x.own JOIN size y ON y.conv_id = c.conv_id AND y.turn = j AND NOT y.own),
wish AS (SELECT conv_id, i, list(j ORDER BY j) AS js, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS r FROM scored WHERE score >= 0.05 GROUP BY conv_id, i),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST([] AS BIGINT[]) AS taken FROM wish
  UNION ALL
  SELECT conv_id, r, i, j, CASE WHEN j IS NULL THEN taken ELSE list_append(taken, j) END FROM (
    SELECT w.conv_id, s.r, CAST(s.i AS BIGINT) AS i, CAST(list_filter(s.js, lambda x: NOT list_contains(w.taken, x))[1] AS BIGINT) AS j, w.taken FROM walk w JOIN wish s ON s.conv_id = w.conv_id AND s.r = w.r + 1)
),
matched AS (SELECT w.conv_id, w.i, w.j, s.score FROM walk w JOIN scored s ON s.conv_id = w.conv_id AND s.i = w.i AND s.j = w.j)"""


@query(f"WITH RECURSIVE {_GREEDY_SQL} SELECT conv_id, i, j, score FROM matched")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of users and answers of one conversation, matched one to one by their words."""
    a, b = _turns(spark, sf_dir)
    scored = a.join(b, "conv_id").select("conv_id", "i", "j", jaccard(F.col("feats_i"), F.col("feats_j")).alias("score"))
    return matching.greedy_pairs(scored, ["conv_id"], 0.05)


@query(f"""WITH RECURSIVE {_GREEDY_SQL} SELECT t.conv_id, coalesce(m.n, 0) / CAST(t.n AS DOUBLE) AS score FROM (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id) t
LEFT JOIN (SELECT conv_id, count(DISTINCT j) AS n FROM matched GROUP BY conv_id) m ON m.conv_id = t.conv_id""")
def function_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched answers over user turns, for each conversation."""
    a, _ = _turns(spark, sf_dir)
    totals = a.groupBy("conv_id").agg(F.count("*").alias("n_left"))
    return matching.function_scores(greedy_match(spark, sf_dir), totals, ["conv_id"])


def _aligned(spark: SparkSession, sf_dir: str, weighted: bool) -> DataFrame:
    segs = _segments(spark, sf_dir).select("user_id", "seg_no", "n_blocks", F.array_join(F.transform("items", lambda i: i["event_type"]), ">").alias("label"))
    segs = segs.withColumn("half", F.max("seg_no").over(Window.partitionBy("user_id")) / 2)
    left = segs.where("seg_no <= half").select("user_id", F.lit(0).cast("bigint").alias("path_no"), F.col("seg_no").alias("pos"), "label", F.col("n_blocks").alias("weight"))
    w = Window.partitionBy("user_id").orderBy("seg_no")
    right = segs.where("seg_no > half").select("user_id", F.coalesce(F.lag("label").over(w), F.lit("0")).alias("src"), F.col("label").alias("dst")).distinct()
    return aligned_paths(left, right, "user_id", weighted=weighted)


@query()
def graph_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of each trace's segments aligned with the graph of the second half."""
    return _aligned(spark, sf_dir, False)


@query()
def weighted_graph_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, matches counting with their blocks."""
    return _aligned(spark, sf_dir, True)


def _expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of expressions made of consecutive events of a user."""
    e = ad.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    op = F.element_at(F.create_map(*[F.lit(x) for kv in {"click": "add", "view": "and", "error": "xor", "purchase": "mul", "signup": "sub"}.items() for x in kv]), F.col("event_type"))
    text = F.format_string("(%s (%s x%d:8 %d:8) y%d:8)", op, F.when(F.col("k") % 2 == 0, op).otherwise("add"), F.col("k") % 3, F.col("k") % 4, F.col("k") % 2)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("event_id", text.alias("a"), F.lead(text).over(w).alias("b")).where("b is not null")


_EXPRESSIONS_SQL = """e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 'add' WHEN 'view' THEN 'and' WHEN 'error' THEN 'xor' WHEN 'purchase' THEN 'mul' ELSE 'sub' END AS op, CAST(props ->> '$.k' AS INTEGER) AS k FROM events),
pair AS (SELECT event_id, op, k, lead(op) OVER w AS op2, lead(k) OVER w AS k2 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
parts AS (SELECT event_id, op, CASE WHEN k % 2 = 0 THEN op ELSE 'add' END AS inner1, k % 4 AS c, op2, CASE WHEN k2 % 2 = 0 THEN op2 ELSE 'add' END AS inner2, k2 % 4 AS c2 FROM pair WHERE op2 IS NOT NULL)"""


# trees of one shape, each with two inputs: labels decide, and the best renaming leaves inputs where they are
@query(f"""WITH {_EXPRESSIONS_SQL} SELECT event_id, CAST(d AS DOUBLE) AS distance, d = 0 AS equal FROM (SELECT event_id, CAST(op <> op2 AS INTEGER) + CAST(inner1 <> inner2 AS INTEGER) + CAST(c <> c2 AS INTEGER) AS d FROM parts)""")
def tree_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distances of consecutive events' expression trees; each distinct pair is worked out once."""
    pairs = _expressions(spark, sf_dir)
    known = pairs.select("a", "b").distinct().withColumn("distance", expr_udfs.tree_distance("a", "b")).withColumn("equal", expr_udfs.tree_equal("a", "b"))
    return pairs.join(known, ["a", "b"]).select("event_id", "distance", "equal")


def _byte_sql(op: str, a: str, b: str) -> str:
    return f"CASE {op} WHEN 'add' THEN {a} + {b} WHEN 'and' THEN {a} & {b} WHEN 'xor' THEN xor({a}, {b}) WHEN 'mul' THEN {a} * {b} ELSE {a} - {b} + 256 END % 256"


# every formula of two bytes is worked out for all inputs, and the same with the inputs exchanged
@query(f"""WITH {_EXPRESSIONS_SQL},
form AS (SELECT DISTINCT op, inner1 AS inn, c FROM parts UNION SELECT DISTINCT op2, inner2, c2 FROM parts),
grid AS (SELECT x.range AS x, y.range AS y FROM range(256) x, range(256) y),
step AS (SELECT op, inn, c, x, y, {_byte_sql("inn", "x", "c")} AS v FROM form, grid),
value AS (SELECT op, inn, c, x, y, {_byte_sql("op", "v", "y")} AS v FROM step),
sign AS (SELECT op, inn, c, sum(hash(x, y, v)) AS straight, sum(hash(y, x, v)) AS crossed FROM value GROUP BY ALL)
SELECT event_id, CASE WHEN a.straight = b.straight OR a.straight = b.crossed THEN 'equal' ELSE 'different' END AS verdict
FROM parts p JOIN sign a ON a.op = p.op AND a.inn = p.inner1 AND a.c = p.c JOIN sign b ON b.op = p.op2 AND b.inn = p.inner2 AND b.c = p.c2""")
def formula_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether consecutive events' formulas are equal under a renaming of inputs."""
    pairs = _expressions(spark, sf_dir)
    known = pairs.select("a", "b").distinct().withColumn("verdict", expr_udfs.formula_equal("a", "b"))
    return pairs.join(known, ["a", "b"]).select("event_id", "verdict")


@query("""SELECT l_returnflag, count(*) AS n, CAST(sum(CASE WHEN l_linenumber = 1 AND l_quantity < 10 THEN l_linenumber WHEN l_quantity < 25 THEN l_linenumber + 7 ELSE 16775031 END) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag""")
def ite_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas under constraints merged into one chain with the default constant, evaluated on rows by Spark."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    branches = [("n", ["(eq n 1)", "(ult q 10)"]), ("(add n 7)", ["(ult q 25)"])]
    merged, _ = exprs.merged_formula([(exprs.parsed(formula), [exprs.parsed(c) for c in constraints]) for formula, constraints in branches])
    value = exprs.as_column(merged, {"n": n, "q": q})
    return ad.table(spark, sf_dir, "lineitem").select("l_returnflag", value.cast("bigint").alias("v")).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("""SELECT f0, f1, round(sum(lcs) / CAST(sum(length) AS DOUBLE), 6) AS score FROM (
  SELECT a.l_returnflag AS f0, b.l_returnflag AS f1, a.p AS p, least(a.n, b.n) AS lcs, a.n AS length
  FROM (SELECT l_returnflag, l_linenumber AS p, count(*) AS n FROM lineitem GROUP BY 1, 2) a JOIN (SELECT l_returnflag, l_linenumber AS p, count(*) AS n FROM lineitem GROUP BY 1, 2) b USING (p)) GROUP BY 1, 2""")
def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed alignment over summed length of paths, here line numbers with their counts."""
    n = ad.table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("p")).agg(F.count("*").alias("n"))
    a, b = n.select(F.col("l_returnflag").alias("f0"), "p", F.col("n").alias("length")), n.select(F.col("l_returnflag").alias("f1"), "p", "n")
    both = a.join(b, "p").select("f0", "f1", F.least("length", "n").alias("lcs"), "length")
    return ranking.path_score(both).withColumn("score", F.round("score", 6))


_ENDS_SQL = """ends0 AS (SELECT user_id AS i, arg_max(event_type, (ts, event_id)) AS name FROM events GROUP BY 1),
ends1 AS (SELECT CAST(n_nationkey AS BIGINT) AS j, CASE n_nationkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'error' WHEN 4 THEN 'purchase' WHEN 5 THEN 'signup' ELSE 'other' END AS name FROM nation)"""


@query(f"""WITH {_ENDS_SQL} SELECT i, j FROM ends0 a JOIN ends1 b ON a.name = b.name OR a.name IS NULL OR b.name IS NULL OR (a.name IN ('click', 'view') AND b.name IN ('click', 'view'))""")
def similar_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces and nations whose last names are alike: equal, of one class, or unknown."""
    e = ad.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("i")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("name"))
    name = F.element_at(F.array(*[F.lit(x) for x in (None, "click", "view", "error", "purchase", "signup", "other")]), F.col("n_nationkey") % 7 + 1)
    n = ad.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("j"), name.alias("name"))
    return similarity.similar_ends(e, n, ad.Rules(classes=(("click", "view"),), groups=(), stop=(), prefix=""))


@query(f"WITH {ad.SEGMENTS_SQL} SELECT label, count(*) AS n, string_agg(info, ',' ORDER BY info) AS infos FROM (SELECT label, user_id || ':' || seg_no AS info FROM segs) GROUP BY label")
def collect_relatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every kind of segment all traces that hold it."""
    segs = _segments(spark, sf_dir).select(F.array_join(F.transform("items", lambda i: i["event_type"]), ">").alias("label"), F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("seg_no").cast("string")).alias("info"))
    return blocks.relatives(segs, ["label"], "info").select("label", "n", F.array_join("infos", ",").alias("infos"))


@query("SELECT event_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 12)")
def reliable_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of users with few errors."""
    e = ad.table(spark, sf_dir, "events")
    return blocks.reliable(e.where("event_type = 'view'").select("user_id", "event_id"), e.where("event_type = 'error'").select("user_id"), ["user_id"], 12).select("event_id")


@query("SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ',' ORDER BY l_returnflag || l_linestatus) AS registers FROM lineitem WHERE l_returnflag || l_linestatus NOT IN ('NO') GROUP BY l_orderkey")
def written_registers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct flags of an order's lines, without the skipped ones."""
    w = ad.table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("register"))
    return blocks.written_registers(w, ["l_orderkey"], ["NO"]).withColumn("registers", F.array_join("registers", ","))


@query("SELECT user_id, props AS rhs, min(event_id) AS pos FROM events GROUP BY 1, 2")
def distinct_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each text of a user's properties."""
    return blocks.distinct_memory_formulas(ad.table(spark, sf_dir, "events").select("user_id", F.col("props").alias("rhs"), F.col("event_id").alias("pos")), ["user_id"])


@query("""SELECT user_id, coalesce(min(pos) FILTER (ok), count(*)) AS first_valid FROM (SELECT user_id, value > 40 AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events) GROUP BY user_id""")
def valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the first block in a trace that has something to compare."""
    e = ad.steps(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", (F.col("value") > 40).alias("ok")))), lambda s: s["ok"]).alias("flags"))
    return e.select("user_id", blocks.first_valid(F.col("flags")).alias("first_valid"))


@query(f"""WITH {ad.TOKENS_SQL} SELECT item_id, n_name FROM (SELECT f0 AS item_id, count(*) AS n FROM item_tok GROUP BY f0) JOIN nation ON n_nationkey = n % 25""")
def names_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers replaced by names."""
    n = ad.items(spark, sf_dir).select(F.col("f0").alias("item_id"), (F.size("feats") % 25).alias("n_nationkey"))
    return n.join(ad.table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").select("item_id", "n_name")


@query()
def trace_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far traces run before recursion, a loop or their length stops them."""
    step = F.when(F.col("event_type") == "signup", F.concat(F.lit("call "), (F.col("value") > 20).cast("string"))).when(F.col("event_type") == "purchase", "ret").otherwise(F.col("event_type"))
    e = ad.steps(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", step.alias("s")))), lambda x: x["s"]).alias("steps"))
    return e.withColumn("r", blocks.limited("steps")).select("user_id", "r.n_steps", "r.reason")


@query()
def capped_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths through the trade graph, at most eight from a nation at a time; paths that end in a loop are kept."""
    e = ad.edges(spark, sf_dir)
    roots = ad.table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").cast("bigint").alias("node"))
    out = graph.simple_paths(e, roots, max_paths=8, keep_loops=True)
    return out.select("root", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), F.size("path").cast("bigint").alias("n_nodes"))


@query()
def compare_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two programs made of conversations: users' turns against the answers; features are words, formulas follow a turn's length."""
    c = ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    words = similarity.tokens(F.concat_ws(" ", F.collect_list("text")))
    name = F.element_at(F.split(F.lower("text"), " "), -1)
    op = F.element_at(F.array(*[F.lit(x) for x in ("add", "xor", "and")]), F.length("text") % 3 + 1)
    formula = F.format_string("(%s a:8 %d:8)", op, F.length("text") % 5)
    side = lambda cond, f: (c.where(cond).groupBy(F.col("conv_id").alias(f)).agg(words.alias("feats")), c.where(cond).select(F.col("conv_id").alias(f), F.col("turn").alias("no"), F.when(F.length("text") % 4 > 0, name).alias("name"), formula.alias("formula")))
    (f0, p0), (f1, p1) = side("role = 'user'", "f0"), side("role <> 'user'", "f1")
    out = compare.compared(f0, f1, p0, p1, compare.Comparison(gate=0.05, rules=ad.WORD_RULES), top=5)
    return compare.ranked_comparison(out, 5).select("f0", "f1", F.round("score", 6).alias("score"), F.round("diff", 6).alias("diff"), F.col("rank").cast("bigint").alias("rank"))


from kinmatch.plans import fixtures  # noqa: E402, F401  registers its queries behind these
