"""Point-in-time feature join: for each label, the version of its entity that was usable at the label's time.

Usable versions have the label's entity, had happened and arrived by its time, and had not expired. The latest event wins,
then the earliest arrival, then the largest id.

1. Versions are reduced before they are shuffled: of one entity, event, arrival and expiry the largest id, with partial
   sums; then of one entity and event only those that outlive every version which would be preferred to them. What is left
   of an entity and event is bounded by the lifetimes there are, however many rows an entity has.
2. Labels ask by entity and time; questions that repeat are asked once.
3. Time is cut into buckets as long as the longest lifetime. A question's answer lies in its bucket or in the one before,
   so each version goes to its own and to the next, and an entity with a third of all rows is dealt to as many tasks as
   there are buckets.
4. Within an entity's bucket, versions are ordered by preference; `merge_asof` finds the latest in that order, and those
   questions it fails follow predecessors, all at once, until a usable version or the end of its longest lifetime.
5. Answers go back to the labels by entity and time.

Nothing that grows with the input is collected or broadcast by hint; no group is larger than a bucket's seconds.

Defined results: a label or version without entity or id matches nothing (`none`); a label whose id no document has is
`none`; of documents that repeat an id, each row is a version of its own source, the label asks about the least source of
them (nulls left out), and where equal versions differ in their features alone, the greatest features win; a label that
repeats is answered each time; texts are not read; other columns are ignored, so their names cannot clash; empty tables
give an empty result, or `none` for each label.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import null_dealt, table, with_python

#: Seconds: the span of events and label times, the greatest delay of arrival and how early it may be, the longest life.
SPAN, DELAY, EARLY, LIFE = 50_000, 600, 60, 900
STALE = 120


def foremost(versions: DataFrame) -> DataFrame:
    """versions (entity, event, arrival, expiry, version, features) without those that can never win, and their place.

    place counts the versions of the same entity and event that are preferred. A version wins at no time if one that is preferred to it expires no sooner: that one arrived no later, so whenever this
    one is usable, that one is.
    """
    v = versions.filter("entity is not null and version is not null and event < expiry and arrival < expiry")
    v = v.groupBy("entity", "event", "arrival", "expiry").agg(F.max(F.struct("version", "features")).alias("best"))
    preferred = Window.partitionBy("entity", "event").orderBy("arrival", F.desc("best")).rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("outlived", F.max("expiry").over(preferred)).withColumn("place", F.count("*").over(preferred)).filter("outlived is null or expiry > outlived")
    return v.select("entity", "event", "arrival", "expiry", "place", "best.version", "best.features")


def walk(asks: pd.DataFrame, versions: pd.DataFrame, life: int) -> np.ndarray:
    """Index of the winning version of each ask (time, ascending), -1 without one; versions in order of preference."""
    event, arrival, expiry = (versions[c].to_numpy() for c in ("event", "arrival", "expiry"))
    asked = asks["time"].to_numpy()
    found = pd.merge_asof(asks[["time"]], pd.DataFrame({"event": event, "place": np.arange(len(event))}), left_on="time", right_on="event")
    at = found["place"].fillna(-1).to_numpy(np.int64)
    open_ = np.flatnonzero(at >= 0)
    while len(open_):
        now, t = at[open_], asked[open_]
        dead = t - event[now] >= life
        fails = ~dead & ((arrival[now] > t) | (expiry[now] <= t))
        at[open_[dead]] = -1
        open_ = open_[fails]
        at[open_] -= 1
        open_ = open_[at[open_] >= 0]
    return at


def _answer(asks: pd.DataFrame, versions: pd.DataFrame, life: int) -> pd.DataFrame:
    """Answers of an entity's bucket."""
    asks = asks.sort_values("time", kind="stable")
    versions = versions.sort_values(["event", "place"], ascending=[True, False]).reset_index(drop=True)
    at = walk(asks, versions, life)
    asks, won = asks[at >= 0], versions.iloc[at[at >= 0]]
    return pd.DataFrame({"entity": asks["entity"].to_numpy(), "time": asks["time"].to_numpy(), "event": won["event"].to_numpy(), "place": won["place"].to_numpy()})


def as_of_join(asks: DataFrame, versions: DataFrame, life: int) -> DataFrame:
    """asks with event, version and features of the version that wins, null without one.

    asks: (entity, a text, time, ...); versions: (entity, event, arrival, expiry, version, features), whole numbers for times; no
    version lives longer than `life` from its event, as a longer one would be found or not by chance of the bucket: such a
    version counts as expired there. features is one column of any orderable type.
    """
    own = F.col("event") + F.lit(life)
    v = foremost(versions.withColumn("entity", F.col("entity").cast("string")).withColumn("expiry", F.least("expiry", own)))
    bucket = lambda c: F.floor(F.col(c) / life)
    dealt = v.select("entity", "event", "arrival", "expiry", "place", F.explode(F.array(bucket("event"), bucket("event") + 1)).alias("bucket"))
    questions = asks.filter("entity is not null and time is not null").select("entity", F.col("time").cast("long").alias("time")).distinct().withColumn("bucket", bucket("time"))
    keys = ("entity", "bucket")
    answers = with_python(questions).groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInPandas(lambda a, b: _answer(a, b, life), "entity string, time long, event long, place long")
    # An entity and event has few versions left, so this join has no hot key; nor has the next one, by entity and time.
    won = answers.join(v.select("entity", "event", "place", "version", "features"), ["entity", "event", "place"])
    won = won.select(F.col("entity").alias("_entity"), F.col("time").alias("_time"), F.lit(0).cast("long").alias("_zero"), "event", "version", "features")
    same = (F.col("entity") == F.col("_entity")) & (F.col("time") == F.col("_time")) & (F.col("_dealt") == F.col("_zero"))
    return asks.withColumn("_dealt", null_dealt("entity", "time")).join(won, same, "left").drop("_entity", "_time", "_zero", "_dealt")


def numbers(doc_id: Column) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the id's sha256, as whole numbers."""
    digits = F.sha2(doc_id.cast("string"), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def document_versions(docs: DataFrame) -> DataFrame:
    """Each row of documents as a version of its source, with n_chars and lang as features."""
    a, b, c, _ = numbers(F.col("doc_id"))
    d = docs.select(F.col("source").cast("string").alias("entity"), F.col("doc_id").cast("long").alias("version"), (a % SPAN).alias("event"), (b % DELAY - EARLY).alias("delay"), (c % LIFE).alias("lived"), F.struct(F.col("n_chars").cast("long").alias("n_chars"), F.col("lang").cast("string").alias("lang")).alias("features"))
    return d.select("entity", "event", (F.col("event") + F.col("delay")).alias("arrival"), (F.col("event") + F.col("lived")).alias("expiry"), "version", "features")


def label_asks(labels: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, time and entity of each label."""
    asked = labels.select(F.col("doc_id").cast("long").alias("doc_id"))
    asked = asked.withColumn("time", numbers(F.col("doc_id"))[3] % SPAN)
    of = docs.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(F.col("source").cast("string")).alias("entity")).filter("_id is not null")
    return asked.withColumn("_dealt", null_dealt("doc_id")).join(of.withColumn("_zero", F.lit(0).cast("long")), (F.col("doc_id") == F.col("_id")) & (F.col("_dealt") == F.col("_zero")), "left").drop("_id", "_zero", "_dealt")


def reported(joined: DataFrame) -> DataFrame:
    """doc_id, t, version_id, age, status and the features of fresh winners, of rows that `as_of_join` gave for labels."""
    d = joined.withColumn("age", F.col("time") - F.col("event"))
    d = d.withColumn("status", F.when(F.col("version").isNull(), "none").when(F.col("age") > STALE, "stale").otherwise("fresh"))
    fresh = lambda c: F.when(F.col("status") == "fresh", F.col(f"features.{c}")).alias(c)
    return d.select("doc_id", F.col("time").alias("t"), F.col("version").alias("version_id"), "age", "status", fresh("n_chars"), fresh("lang"))


def op13_as_of_join(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return reported(as_of_join(label_asks(labels, docs), document_versions(docs), LIFE))


OP13_SQL = """
with ver as (select source, doc_id, n_chars, lang, ('0x' || substr(sha256(doc_id::varchar), 1, 8))::bigint % 50000 event,
               ('0x' || substr(sha256(doc_id::varchar), 9, 8))::bigint % 600 - 60 delay,
               ('0x' || substr(sha256(doc_id::varchar), 17, 8))::bigint % 900 lived from documents),
src as (select doc_id, min(source) source from documents group by doc_id),
ask as (select row_number() over () n, l.doc_id, ('0x' || substr(sha256(l.doc_id::varchar), 25, 8))::bigint % 50000 t, source
        from labels l left join src on l.doc_id = src.doc_id),
hit as (select n, v.doc_id version_id, t - event age, v.n_chars, v.lang,
          row_number() over (partition by n order by event desc, delay, v.doc_id desc, v.n_chars desc nulls last, v.lang desc nulls last) place
        from ask join ver v on ask.source = v.source where event <= t and event + delay <= t and t < event + lived)
select ask.doc_id, t::bigint t, version_id, age::bigint age, case when version_id is null then 'none' when age > 120 then 'stale' else 'fresh' end status,
  case when age <= 120 then n_chars end n_chars, case when age <= 120 then lang end lang
from ask left join hit on ask.n = hit.n and place = 1
"""
