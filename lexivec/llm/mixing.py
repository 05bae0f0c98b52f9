"""Mixing sources to target weights.

Tokens (here: words) are summed per source; targets come from the weights, water-filled under the cap of `max_epochs`
times a source's size; a document is emitted floor(rate) times plus once more if a hash of its id falls under the
fraction. Built-in functions only.

Defined results: a null text has size 0; a null source is a source of its own, last in order; a source without words has
target 0 and takes nothing; rows that repeat an id, or have none and the
same text, share their draw, so ties need no order; a text of any length is counted whole; extra columns of any name and
type pass through `mixed`. An empty table gives
an empty result. Sources are summed before they meet in one window, which thus has one row per source.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import WORD, durable, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
DRAW_BITS = 52


def n_words(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, rate from rows (source, size).

    With the sources ordered by how soon their cap binds, size / weight, the first k are capped exactly if each one's
    share of what the others leave exceeds its cap; so one pass of running sums finds the level, in whole numbers.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    share = Fraction(str(budget))
    num, den = share.numerator, share.denominator
    table_of = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    per = per.select("*", F.get(table_of, (F.row_number().over(order) - 1) % len(weights)).alias("_w"))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "*",
        F.sum("source_size").over(everything).alias("_total"),
        F.sum("_w").over(everything).alias("_weights"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_size_before"),
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w_before"),
    )
    # Words on offer times the budget's denominator, so that all numbers stay whole.
    left = F.expr(f"cast({num} * _total - {den * max_epochs} * _size_before as decimal(38, 0))")
    w_left = (F.col("_weights") - F.col("_w_before")).cast("decimal(38,0)")
    capped = (left * F.col("_w").cast("decimal(20,0)")) >= (F.lit(den * max_epochs).cast("long") * F.col("source_size")).cast("decimal(20,0)") * w_left
    per = per.select("*", capped.alias("_capped"))
    level = per.select(
        "*",
        F.sum(F.when(F.col("_capped"), F.col("source_size")).otherwise(0)).over(everything).alias("_cap_size"),
        F.sum(F.when(F.col("_capped"), F.lit(0)).otherwise(F.col("_w"))).over(everything).alias("_free_w"),
    )
    free = F.expr(f"cast({num} * _total - {den * max_epochs} * _cap_size as double) * cast(_w as double) / cast({den} * _free_w as double)")
    target = F.when(F.col("_capped"), (F.lit(max_epochs).cast("long") * F.col("source_size")).cast("double")).otherwise(free)
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target)
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("target"), F.col("source_size").cast("double")))
    return level.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def draw_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What a row's draw hangs on: its id, or where it has none, its text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))


def draw(key: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) that the key and the seed fix."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), key)), 1, DRAW_BITS // 4), 16, 10).cast("double") / float(1 << DRAW_BITS)


def with_copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (source, key, ...) with source_size, target, rate and the number of copies that the mix takes of each."""
    # Reading the sums from a written table, Spark knows their size, and joins a hot source by broadcast or in split parts.
    d = rows.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor("rate")
    return d.withColumn("copies", (whole + F.when(draw(F.col("key")) < F.col("rate") - whole, 1).otherwise(0)).cast("long"))


def copies(sized: DataFrame, **options) -> DataFrame:
    """sized (source, size, key, ...) with source_size, target, rate and copies."""
    return with_copies(sized, durable(source_targets(sized, **options), "targets"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """Each document as often as the mix takes it, with the columns of docs.

    Copies are decided on the rows themselves, in one projection, so ids may repeat or be null; the row travels as a struct,
    so its columns may have any name and type.
    """
    source = F.col("source").cast("string").alias("source")
    targets = durable(source_targets(docs.select(source, n_words().alias("size")), **options), "targets")
    d = with_copies(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), source, draw_key().alias("key")), targets)
    d = d.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return d.select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = durable(docs.select("doc_id", "source", n_words().alias("size"), draw_key().alias("key")), "sized")
    d = copies(sized)
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


TARGETS_SQL = """
per as (select source, sum(size)::bigint source_size from sized group by source),
pw as (select *, (case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5 when 1 then 2 else 1 end)::bigint w from per),
run as (select *, sum(source_size) over () total, sum(w) over () weights,
          coalesce(sum(source_size) over b, 0) size_before, coalesce(sum(w) over b, 0) w_before
        from pw window b as (order by source_size / w, source nulls last rows between unbounded preceding and 1 preceding)),
cap as (select *, (3 * total - 4 * size_before) * w >= 4 * source_size * (weights - w_before) capped from run),
lev as (select *, sum(case when capped then source_size else 0 end) over () cap_size, sum(case when capped then 0 else w end) over () free_w from cap),
tgt as (select source, source_size, case when source_size = 0 then 0.0 when capped then (2 * source_size)::double
          else (3 * total - 4 * cap_size)::double * w::double / (2 * free_w)::double end::double target from lev),
cop as (select s.*, source_size, target, case when source_size = 0 then 0.0::double else target / source_size::double end rate
        from sized s join tgt t on s.source is not distinct from t.source),
mix as (select *, (floor(rate) + case when ('0x' || substr(md5('mix:' || key), 1, 13))::bigint::double / 4503599627370496.0 < rate - floor(rate)
          then 1 else 0 end)::bigint copies from cop)
"""

OP7_SQL = f"""
with sized as (select doc_id, source, coalesce(doc_id::varchar, 'text:' || md5(coalesce(text, ''))) as key, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint size from documents), {TARGETS_SQL}
select doc_id, size, source_size, target, size * copies taken from mix
"""
