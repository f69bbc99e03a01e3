"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Targets.  Sources in code-point order, null last, weigh 1, 2, 3, repeating, and share all words; a source's target
stops at CAP times its size and the excess goes to the others by weight, which is to say that all are filled to one level.

Selection.  Each document draws an exponential key, ``-ln(u) / quality``, u from a digest of doc_id, so reruns agree
and better documents come early.  A source's target is a number of complete epochs plus a remainder; the remainder
takes documents in key order until its budget is met, the one at the edge only if that comes nearer to it.

Scale.  Sources may be many: they are numbered by ranges, and their level is looked for in ranges too.  Running sums over a source are built from sums of key ranges: whole ranges are taken or left, and rows are
sorted only inside the one range where the budget ends, so no task sees a whole source.

Edge cases: null texts have size 0 and documents without words are taken 0 times; a document without quality weighs 1;
weights that are null, not positive or not finite count as 1; repeated rows of a doc_id are rows of their own, and those of one
size and source are taken equally often; rows without doc_id draw their key from the text; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, own_columns, save, word_count

CAP = 3
#: Documents to a range of keys, about; sources to a range of names, at least.
RANGE, SOURCES = 5_000, 50_000
#: Ranges of cap to weight to a doubling; quantiles of a source's keys from which its ranges are drawn.
STEPS, QUANTILES = 64, 32


def uniform(name: Column) -> Column:
    """In (0, 1), from 48 bits of a digest."""
    bits = F.conv(F.substring(F.md5(F.concat(name, F.lit(":mix")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**48))


def ranked(sources: DataFrame) -> DataFrame:
    """The sources with ``rank``, their number by code point, from 1, null last: by ranges, of which one count each goes on."""
    parts = max(1, min(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), sources.count() // SOURCES))
    order = F.asc_nulls_last("source")
    dealt = save(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    row = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return dealt.withColumn("row", row).join(F.broadcast(starts), "part").select("source", "source_size", "docs", (F.col("start") + F.col("row")).alias("rank"))  # a row a part


def targets(sized: DataFrame) -> DataFrame:
    """(source, rank, source_size, docs, target, epochs, rest) of each source.

    A source is capped where the common level times its weight is above its cap.  The level is looked for in two steps, so that
    no task sees all sources: among STEPS ranges of cap to weight a doubling, and then within the one range that holds it."""
    s = ranked(save(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "sources"))
    s = s.withColumn("w", (F.col("rank") - 1) % 3 + 1).withColumn("cap", CAP * F.col("source_size"))
    s = save(s.withColumn("ratio", F.col("cap") / F.col("w")), "weighed")
    # one row a ratio; those of a range of ratios are a few, since sizes are whole numbers
    ratios = s.where("cap > 0").groupBy("ratio").agg(F.sum("cap").alias("cap"), F.sum("w").alias("w"))
    ratios = save(ratios.withColumn("range", F.floor(F.log2("ratio") * STEPS)), "ratios")
    total = s.agg(F.sum("source_size")).first()[0] or 0

    def with_sums(df: DataFrame, by: str, before: int, after: int) -> DataFrame:
        """What rows before each are capped at, and the weights from it on."""
        order = Window.orderBy(by)
        lower, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        return df.withColumns({"below": F.coalesce(F.sum("cap").over(lower), F.lit(0)) + before, "on": F.sum("w").over(on) + after})

    ranges = ratios.groupBy("range").agg(F.min("ratio").alias("ratio"), F.sum("cap").alias("cap"), F.sum("w").alias("w"))  # STEPS a doubling
    held = with_sums(ranges, "range", 0, 0).where(F.col("below") + F.col("ratio") * F.col("on") <= total).orderBy(F.desc("range")).first()
    if held is None:  # no source is capped
        weights = ranges.agg(F.sum("w")).first()[0]
        level = total / weights if weights else 0.0
    else:
        inside = with_sums(ratios.where(F.col("range") == held["range"]), "ratio", held["below"], held["on"] - held["w"])
        last = inside.where(F.col("below") + F.col("ratio") * F.col("on") <= total).orderBy(F.desc("ratio")).first()
        left = last["on"] - last["w"]
        level = (total - last["below"] - last["cap"]) / left if left else last["ratio"]
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("w")))
    s = s.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    return s.select("source", "rank", "source_size", "docs", "target", "epochs", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("rest"))


def _mix(docs: DataFrame, quality: DataFrame | None) -> DataFrame:
    """(doc_id, source, x, size, source_size, target, taken, copies); x is a hash of the text of rows without doc_id, else null."""
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))).alias("x"))
    weight = F.lit(1.0)
    if quality is not None:
        q = quality.groupBy(F.col("doc_id").alias("id")).agg(F.max("weight").cast("double").alias("weight"))
        sized = sized.join(q, F.col("doc_id") == F.col("id"), "left")
        weight = F.when((F.col("weight") > 0) & (F.col("weight") < float("inf")), F.col("weight")).otherwise(1.0)
    key = -F.log(uniform(F.coalesce(F.col("doc_id").cast("string"), "x"))) / weight
    sized = save(sized.select("doc_id", "source", "x", "size", key.alias("key")), "sized")
    sources = save(targets(sized), "sources")

    ranges = F.greatest(F.ceil(F.col("docs") / RANGE), F.lit(1))
    rows = sized.withColumnRenamed("source", "of").join(sources, F.col("of").eqNullSafe(F.col("source")))
    # ranges hold like numbers of documents whatever the weights: by quantiles of the source's own keys, evenly between two of them
    cuts = sized.groupBy("source").agg(F.percentile_approx("key", [i / QUANTILES for i in range(QUANTILES + 1)], 1000).alias("cuts"))
    rows = rows.join(cuts.withColumnRenamed("source", "cut"), F.col("of").eqNullSafe(F.col("cut"))).drop("cut")
    below = F.greatest(F.least(F.size(F.filter("cuts", lambda c: c <= F.col("key"))), F.lit(QUANTILES)), F.lit(1))
    lo, hi = F.get("cuts", below - 1), F.get("cuts", below)
    inside = F.when(hi > lo, F.greatest(F.least((F.col("key") - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    rows = rows.withColumn("range", F.floor((below - 1 + inside) / QUANTILES * ranges).cast("long")).drop("cuts")
    sums = rows.groupBy("rank", "range").agg(F.sum("size").alias("in_range"))
    upto = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("in_range").over(upto)).select("rank", "range", (F.col("upto") - F.col("in_range")).alias("before"), "upto")
    rows = rows.join(sums, ["rank", "range"])

    edge = (F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))
    # equal rows have one place in the order: all of them are taken, or none
    order = ["key", "doc_id", "x", "size"]
    within = Window.partitionBy("rank", "range").orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("before") + F.sum("size").over(within)
    start = end - F.sum("size").over(Window.partitionBy("rank", "range", *order))
    first = (start < F.col("rest")) & (end - F.col("rest") <= F.col("rest") - start)
    cut = rows.where(edge).withColumn("extra", first.cast("long"))
    whole = rows.where(~edge).withColumn("extra", (F.col("upto") <= F.col("rest")).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.col("extra")).otherwise(0)
    return cut.unionByName(whole).select("doc_id", "source", "x", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of docs; quality: (doc_id, weight)."""
    return _mix(docs, quality).drop("source", "x")


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The documents that the mix takes, as often as it takes them."""
    names = dict(zip(("doc_id", "source", "x", "size", "copies"), fresh(docs, "id", "source", "x", "size", "copies"), strict=True))
    taken = _mix(docs, quality).where("copies > 0").groupBy("doc_id", "source", "x", "size").agg(F.max("copies").cast("int").alias("copies"))
    taken = taken.withColumnsRenamed(names)
    mine = {"doc_id": F.col("doc_id"), "source": F.col("source"), "x": F.when(F.col("doc_id").isNull(), F.md5(F.coalesce("text", F.lit("")))), "size": word_count("text")}
    same = [value.eqNullSafe(F.col(names[c])) for c, value in mine.items()]
    rows = docs.join(taken, same)
    (again,) = fresh(rows, "copy")
    return rows.withColumn(again, F.explode(F.array_repeat(F.lit(1), F.col(names["copies"])))).select(*own_columns(docs))


def quality_weights(labels: DataFrame) -> DataFrame:
    """Good documents weigh 2, bad ones a half; unlabelled ones are left to count 1."""
    return labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


ORACLE = rf"""
with q as (select doc_id as id, max(case when quality = 1 then 2.0 else 0.5 end) as weight from labels where quality is not null group by 1),
sized as (select d.doc_id, d.source, coalesce(len(regexp_extract_all(d.text, '{WORD}')), 0)::bigint as size,
          -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, md5(coalesce(d.text, ''))) || ':mix'), 1, 12))::bigint::double + 0.5) / 281474976710656.0) / coalesce(q.weight, 1.0)::double as key
          from documents d left join q on q.id = d.doc_id),
s0 as (select source, sum(size)::bigint as source_size from sized group by 1),
s1 as (select *, row_number() over (order by source nulls last) as rank from s0),
s2 as (select *, (rank - 1) % 3 + 1 as w, {CAP} * source_size as cap from s1),
s3 as (select *, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, rank rows between unbounded preceding and 1 preceding), 0))::double
          / (sum(w) over (order by cap / w, rank rows between current row and unbounded following))::double as unit from s2),
lvl as (select unit from s3 where unit * w <= cap order by cap / w, rank limit 1),
s4 as (select source, source_size, least(cap::double, coalesce((select unit from lvl), 0.0) * w) as target from s3),
s5 as (select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from s4),
r as (select z.*, s5.source_size, s5.target, s5.epochs, s5.target - s5.epochs * s5.source_size as rest,
      (sum(z.size) over (partition by z.source order by z.key, z.doc_id, z.size rows unbounded preceding))::bigint as stop
      from sized z join s5 on z.source is not distinct from s5.source)
select doc_id, size, source_size, target, taken, case when size > 0 then taken // size else 0 end as copies from (
  select *, (case when size = 0 then 0 else size * (epochs + case when stop - size < rest and stop - rest <= rest - (stop - size) then 1 else 0 end) end)::bigint as taken from r)
"""
