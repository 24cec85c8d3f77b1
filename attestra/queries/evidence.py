"""Evidence: contributions of embedding features, grouped and ranked."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestra.operators import evidence as V
from attestra.queries import models as model_queries
from attestra.queries.base import query
from attestra.session import table

NAMED = f"""WITH {model_queries.LONG}, {model_queries.STATS}, w AS (SELECT j, avg(z) FILTER (WHERE fake) - avg(z) FILTER (WHERE NOT fake) AS weight FROM z GROUP BY j),
 c AS (SELECT vec_id, CASE WHEN z.j < 16 THEN 'lfcc_' ELSE 'feat_' END || lpad(CAST(z.j AS VARCHAR), 2, '0') AS feature, x AS value, z, z * weight AS contribution FROM z JOIN w ON z.j = w.j)"""


def named(spark, d):
    name = F.concat(F.when(F.col("j") < 16, "lfcc_").otherwise("feat_"), F.lpad(F.col("j").cast("string"), 2, "0"))
    return model_queries.contributed(spark, d).select("vec_id", name.alias("feature"), F.col("x").alias("value"), "z", "contribution")


GROUPED = f"""{NAMED}, g AS (SELECT vec_id, CASE WHEN feature LIKE 'lfcc%' THEN 'lfcc_*' ELSE feature END AS name, * EXCLUDE (vec_id) FROM c),
 r AS (SELECT vec_id, name AS feature, sum(contribution) AS contribution, (list(value ORDER BY round(abs(contribution), 9) DESC, feature DESC))[1] AS value FROM g GROUP BY vec_id, name)"""


@query("group_prefix_rollup", f"{GROUPED} SELECT vec_id, feature, round(contribution, 6) AS contribution, round(value, 6) AS value FROM r")
def _(spark, d):
    return V.group_prefix(named(spark, d), ["vec_id"], "lfcc_").select("vec_id", "feature", F.round("contribution", 6).alias("contribution"), F.round("value", 6).alias("value"))


FOUND = f"{GROUPED}, k AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(contribution), 9) DESC, feature) AS INTEGER) AS rank, CASE WHEN contribution > 0 THEN 'manipulated' ELSE 'authentic' END AS direction FROM r WHERE abs(contribution) >= 0.05)"


def found(spark, d):
    return V.findings(V.group_prefix(named(spark, d), ["vec_id"], "lfcc_"), ["vec_id"])


@query("findings_topk", f"{FOUND} SELECT vec_id, rank, feature, direction, round(contribution, 6) AS contribution FROM k WHERE rank <= 4")
def _(spark, d):
    return found(spark, d).select("vec_id", "rank", "feature", "direction", F.round("contribution", 6).alias("contribution"))


@query("report_text", f"{FOUND} SELECT vec_id, string_agg(rank || '. ' || feature || ' ' || direction || ' (' || printf('%.3f', round(contribution, 3)) || ')', chr(10) ORDER BY rank) AS report FROM k WHERE rank <= 4 GROUP BY vec_id")
def _(spark, d):
    return V.render(found(spark, d).withColumn("contribution", F.round("contribution", 3)), "vec_id")


@query("evidence_summary", f"{FOUND}, t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY rank) AS p FROM k WHERE rank <= 4 AND direction = 'manipulated') SELECT vec_id, string_agg(feature, ', ' ORDER BY rank) AS manipulated FROM t WHERE p <= 2 GROUP BY vec_id")
def _(spark, d):
    from pyspark.sql import Window

    t = found(spark, d).where("direction = 'manipulated'").withColumn("p", F.row_number().over(Window.partitionBy("vec_id").orderBy("rank"))).where("p <= 2")
    rows = F.array_sort(F.collect_list(F.struct("rank", "feature")))
    return t.groupBy("vec_id").agg(F.array_join(F.transform(rows, lambda r: r["feature"]), ", ").alias("manipulated"))


@query("format_cells", "SELECT c_custkey, CASE WHEN c_acctbal IS NULL THEN '' WHEN abs(c_acctbal) < 1000 THEN printf('%.4f', c_acctbal) ELSE printf('%.1f', round(c_acctbal, 1)) END AS cell FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", V.format_cell(F.when(F.abs("c_acctbal") < 1000, F.col("c_acctbal")).otherwise(F.round("c_acctbal", 1))).alias("cell"))
