"""Queries of changes between states: orders' lines before and after a day are the two states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import changes as C
from quillspark.plans.registry import Tables, query

DAY = "timestamp '1997-01-01'"


def states(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Suppliers' parts with what was ordered of them last: on even days before DAY, and on all days that aren't multiples of five."""
    rows = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_quantity", F.dayofmonth("l_shipdate").alias("day"), F.col("l_shipdate").alias("at"))
    last = lambda df: df.groupBy("l_suppkey", "l_partkey").agg(F.max("l_orderkey").alias("last_order"), F.max("l_quantity").alias("qty"), F.max("at").alias("at"))
    return last(rows.where((F.col("at") < F.expr(DAY)) & (F.col("day") % 2 == 0))), last(rows.where(F.col("day") % 5 != 0))


STATES_SQL = f"""with r as (select l_suppkey, l_partkey, l_orderkey, l_quantity, day(l_shipdate) as d, l_shipdate as seen from lineitem),
a as (select l_suppkey, l_partkey, max(l_orderkey) as last_order, max(l_quantity) as qty, max(seen) as seen from r where seen < {DAY} and d % 2 = 0 group by 1, 2), b as (select l_suppkey, l_partkey, max(l_orderkey) as last_order, max(l_quantity) as qty, max(seen) as seen from r where d % 5 <> 0 group by 1, 2),
c as (select coalesce(b.l_suppkey, a.l_suppkey) as l_suppkey, coalesce(b.l_partkey, a.l_partkey) as l_partkey, case when a.l_suppkey is null then 'insert' when b.l_suppkey is null then 'delete' when (a.last_order, a.qty, a.seen) is distinct from (b.last_order, b.qty, b.seen) then 'update' end as kind,
a.last_order as old_order, b.last_order as new_order, b.qty, b.seen from a full join b on a.l_suppkey = b.l_suppkey and a.l_partkey = b.l_partkey)"""


@query(STATES_SQL + " select l_suppkey, l_partkey, kind, old_order, new_order from c where kind is not null")
def state_changes(t: Tables) -> DataFrame:
    """What was inserted, updated and deleted between the states."""
    return C.changes(*states(t), ["l_suppkey", "l_partkey"]).select("l_suppkey", "l_partkey", "kind", F.col("old.last_order").alias("old_order"), F.col("new.last_order").alias("new_order"))


@query(STATES_SQL + ", n as (select l_suppkey, count(*) filter (kind in ('insert', 'update')) as n from c group by 1) select s_suppkey as supplier, (s_suppkey % 3 + coalesce(n, 0))::bigint as version from supplier left join n on s_suppkey = l_suppkey")
def bumped_versions(t: Tables) -> DataFrame:
    """Every supplier's version after the changes."""
    before, after = (df.withColumn("supplier", F.col("l_suppkey")) for df in states(t))
    stored = t.supplier.select(F.col("s_suppkey").alias("supplier"), (F.col("s_suppkey") % 3).alias("version"))
    return C.versions(stored, C.changes(before, after, ["l_suppkey", "l_partkey"]), "supplier")


@query(STATES_SQL + " select l_suppkey, l_partkey, old_order as last_order from c where kind = 'delete'")
def blacklisted(t: Tables) -> DataFrame:
    """Deleted pairs, which aren't to be collected again."""
    return C.blacklist(C.changes(*states(t), ["l_suppkey", "l_partkey"]), ["l_suppkey", "l_partkey", "last_order"])


@query(STATES_SQL + """, u as (select l_suppkey, l_partkey, seen from a where qty > 30 union all select l_suppkey, l_partkey, seen from c where kind in ('insert', 'update') and qty > 0) select l_suppkey, l_partkey, min(seen) as first_collected_at from u group by 1, 2""")
def remembered_collections(t: Tables) -> DataFrame:
    """When each pair was first held, from a stored history and the changes."""
    before, after = states(t)
    stored = before.where("qty > 30").select("l_suppkey", "l_partkey", F.col("at").alias("first_collected_at"))
    return C.collected(stored, C.changes(before, after, ["l_suppkey", "l_partkey"]), ["l_suppkey", "l_partkey"], "qty", "at")


@query("""with w as (select conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{9,}'))) as term from conversations) select conv_id, term, count(*)::bigint as n from w group by 1, 2""")
def term_hits(t: Tables) -> DataFrame:
    """In how many turns of a conversation each long word occurs."""
    found = t.conversations.select("conv_id", F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0)).alias("terms"))
    return C.hits(found, "conv_id", "terms")


@query("""with w as (select distinct l_partkey as novel_id, l_linenumber as chapter_index from lineitem where l_returnflag = 'R'), h as (select l_partkey as novel_id, l_linenumber as chapter_index, min(l_partkey * 8 + l_linenumber) as chapter_id, bool_or(l_quantity > 25) as stored, bool_or(l_linestatus = 'O') as active from lineitem where l_discount > 0.02 group by 1, 2)
select w.novel_id, w.chapter_index, h.chapter_id, case when h.chapter_id is null then 'unknown' when not h.stored and p_size % 2 = 1 then 'no_source' when h.active then 'running' else 'queue' end as action,
case when h.chapter_id is not null and (h.stored or p_size % 2 = 0) and not h.active then 30 end as priority from w left join h on w.novel_id = h.novel_id and w.chapter_index = h.chapter_index left join part on p_partkey = w.novel_id""")
def retranslations(t: Tables) -> DataFrame:
    """What becomes of the chapters of returned lines that are to be translated again."""
    key = F.col("l_partkey") * 8 + F.col("l_linenumber")
    rows = t.lineitem.where("l_discount > 0.02").groupBy(F.col("l_partkey").alias("novel_id"), F.col("l_linenumber").alias("chapter_index"))
    h = rows.agg(F.min(key).alias("id"), F.max(F.when(F.col("l_quantity") > 25, "text")).alias("content"), F.max(F.when(F.col("l_linestatus") == "O", "running").otherwise("done")).alias("status"))
    novels = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("enabled"))
    wanted = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("novel_id"), F.col("l_linenumber").alias("chapter_index"))
    return C.retranslated(h, h.select(F.col("id").alias("chapter_id"), "status"), novels, wanted)
