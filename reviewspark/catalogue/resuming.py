"""Going on after an interruption."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewspark.catalogue.binding import table
from reviewspark.catalogue.registry import query
from reviewspark.operators import resume
from reviewspark.operators.summaries import NOT_AVAILABLE


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def resume_remaining(spark, sf):
    done = table(spark, sf, "lineitem").filter(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("o_orderkey"))
    return resume.remaining(_orders(spark, sf), done, ["o_orderkey"])


_SAVED = """old AS (SELECT o_orderkey, o_orderstatus AS summary FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT o_orderkey, o_orderpriority AS summary FROM orders WHERE o_orderpriority < '3')"""


def _saved(spark, sf):
    orders = _orders(spark, sf)
    old = orders.filter(F.col("o_orderstatus") != "P").select("o_orderkey", F.col("o_orderstatus").alias("summary"))
    new = orders.filter(F.col("o_orderpriority") < "3").select("o_orderkey", F.col("o_orderpriority").alias("summary"))
    return old, new


@query(f"""WITH {_SAVED}
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, coalesce(n.summary, o.summary) AS summary
FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey""")
def checkpoint_merge(spark, sf):
    return resume.merge_checkpoint(*_saved(spark, sf), ["o_orderkey"], "summary")


@query(f"""WITH {_SAVED} SELECT o_orderkey, o_orderstatus, o_orderpriority, coalesce(n.summary, '{NOT_AVAILABLE}') AS summary
FROM orders LEFT JOIN new n USING (o_orderkey)""")
def summary_default(spark, sf):
    _, new = _saved(spark, sf)
    return resume.lookup(_orders(spark, sf), new, ["o_orderkey"], {"summary": NOT_AVAILABLE})
