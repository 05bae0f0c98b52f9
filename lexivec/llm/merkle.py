"""Merkle manifest of a dataset: a root over all rows, and for each row the proof that it stands in it.

A row's leaf is the SHA-256 of its columns. Per language, leaves in order of id are hashed two by two until one node, the
subroot, remains; the subroots, in order of language, are hashed likewise to the root.

1. Spark computes leaves, sorts them by ranges, and numbers them: places within a range plus counts of the ranges before.
2. Leaves go to buckets of 2^`LEVELS`, aligned to the tree, so that a bucket is a whole subtree. Executors reduce buckets in
   DuckDB: per level one query of ordered `string_agg` and `sha256` over Arrow tables, and one that gives each leaf its
   sibling and folds its own digest onwards.
3. Bucket roots are nodes of the tree above; the same engine reduces them, tier by tier, as far as a language has more than
   one, and then the subroots. Spark joins what a bucket's root passes on its way up (its outer proof) to the bucket's
   leaves, and folds them through it.

A bucket has 1,024 leaves at most, so a language with most of the rows is many buckets; the driver learns one flag a tier.

Defined results: a null column is `-` in its leaf; rows without id come first in their language and are never tampered
with; rows that repeat an id are ordered by leaf, and equal ones take places of their own; rows without language come
first among the languages; a language of one row has its leaf as subroot, a table of one language its subroot as root;
texts of any length are hashed whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import durable, hinted, table, trim, with_python

#: Levels of the tree that a bucket spans: it has 1,024 leaves.
LEVELS = 10
#: Rows from which on the engine takes the whole buckets that it holds.
ROWS = 16_384


def field(value: Column) -> Column:
    """A column's part of a leaf: its length in bytes and its value, or `-`."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def numbered(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes (grp, not null, ...) with pos, the place in its group in the order given, and total, the group's rows.

    nodes is a written table, so its rows can be told apart by where they stand; that splits even equal rows.
    """
    keys = ["grp", *order, "_tie"]
    d = nodes.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    d = durable(d.drop("_tie").select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ordered")
    runs = d.groupBy("_range", "grp").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each range and group in it: as many as there are tasks and groups.
    runs = durable(runs.select("_range", "grp", "_first", before.alias("_before"), F.sum("_n").over(group).alias("total")), "runs")
    d = d.join(hinted(runs, 64), ["_range", "grp"])
    return d.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).drop("_range", "_at", "_first", "_before")


def _reduced(con: duckdb.DuckDBPyConnection, t: pa.Table, levels: int) -> pa.Table:
    """t (whole buckets in order) with `folded`, `siblings` (empty where alone) and `root` of its bucket."""
    pos, total = t.column("pos").to_numpy(), t.column("total").to_numpy()
    width = 1 << levels
    upto = np.where(total > width, levels, np.ceil(np.log2(np.maximum(total, 1)))).astype(np.int64)
    block = pa.table({"g": np.cumsum(pos % width == 0), "i": pos % width, "levels": upto, "node": t.column("node"), "start": t.column("start")})
    con.register("block", block)
    con.execute("create or replace temp table leaves as select g, i, levels, start as folded, []::varchar[] as siblings from block")
    con.execute("create or replace temp table nodes as select g, i, levels, node from block")
    for k in range(int(upto.max())):
        con.execute(f"""
            create or replace temp table leaves as
            select l.g, l.i, l.levels, list_append(siblings, coalesce(node, '')) as siblings,
              case when (l.i >> {k}) & 1 = 1 then sha256(node || folded) else sha256(folded || coalesce(node, '')) end as folded
            from leaves l left join nodes n on n.g = l.g and n.i = xor(l.i >> {k}, 1) where l.levels > {k}
            union all by name select * from leaves where levels <= {k}""")
        con.execute(f"""
            create or replace temp table nodes as
            select g, i >> 1 as i, levels, sha256(string_agg(node, '' order by nodes.i)) as node from nodes where levels > {k} group by g, nodes.i >> 1, levels
            union all by name select * from nodes where levels <= {k}""")
    out = con.sql("select folded, siblings, node as root from leaves join nodes using (g) order by leaves.g, leaves.i").to_arrow_table()
    con.unregister("block")
    for name in ("folded", "siblings", "root"):
        t = t.append_column(name, out.column(name).cast(pa.list_(pa.string()) if name == "siblings" else pa.string()))
    return t


def _tier_rows(batches, levels: int):
    """Rows sorted by bucket and place, reduced by whole buckets."""
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    held = None
    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        starts = np.flatnonzero(held.column("pos").to_numpy() % (1 << levels) == 0)
        if held.num_rows >= ROWS and starts[-1] > 0:
            yield from _reduced(con, held.slice(0, starts[-1]), levels).to_batches()
            held = held.slice(starts[-1]).combine_chunks()
            trim()
    if held is not None and held.num_rows:
        yield from _reduced(con, held, levels).to_batches()
    con.close()
    trim()


def tier(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """nodes (grp, pos, total, node, start, ...) with their bucket, its root, and the siblings and digest up to it."""
    d = with_python(nodes).withColumn("bucket", F.shiftright("pos", levels))
    d = d.repartition("grp", "bucket").sortWithinPartitions("grp", "bucket", "pos")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema)
    return d.mapInArrow(lambda it: _tier_rows(it, levels), f"{fields}, folded string, siblings array<string>, root string")


PATH = "array<struct<sibling: string, is_left: boolean>>"
#: What a node meets on its way up its bucket: each sibling, and whether it stands on the left.
OWN_PATH = "transform(siblings, (s, k) -> struct(s as sibling, shiftright(pos, k) % 2 = 1 as is_left))"


def above(t: DataFrame, levels: int = LEVELS) -> DataFrame:
    """grp, bucket, path, top: what the root of each bucket of a tier passes up to the top of its group."""
    width = 1 << levels
    buckets = t.filter(F.col("pos") % width == 0).select("grp", "bucket", "total", "root")
    more = buckets.filter(F.col("total") > width)
    if more.isEmpty():
        return buckets.select("grp", "bucket", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("root").alias("top"))
    up = paths(more.select("grp", F.col("bucket").alias("pos"), F.ceil(F.col("total") / width).alias("total"), F.col("root").alias("node")), levels)
    up = up.select(F.col("grp").alias("_grp"), F.col("pos").alias("_pos"), F.col("path").alias("_path"), F.col("top").alias("_top"))
    d = buckets.join(up, (F.col("grp") == F.col("_grp")) & (F.col("bucket") == F.col("_pos")), "left")
    return d.select("grp", "bucket", F.coalesce("_path", F.expr(f"cast(array() as {PATH})")).alias("path"), F.coalesce("_top", "root").alias("top"))


def paths(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """grp, pos, path, top of nodes (grp, pos, total, node): what each passes up to the top of its group."""
    t = durable(tier(nodes.withColumn("start", F.col("node")), levels), "tier")
    d = t.join(above(t, levels), ["grp", "bucket"])
    return durable(d.select("grp", "pos", F.concat(F.expr(OWN_PATH), "path").alias("path"), "top"), "paths")


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """leaves (doc_id, lang, leaf, start) with subroot, root, proof (its siblings, joined) and folded.

    folded is `start` hashed with the siblings, level by level; the root, if start is the leaf itself. levels: those of a
    bucket; the result is the same.
    """
    # The group's name keeps the order of languages, and the one for none comes first.
    named = leaves.select("doc_id", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), F.col("leaf").alias("node"), "start")
    t = tier(numbered(durable(named, "leaves"), "doc_id", "node"), levels)
    t = durable(t.select("doc_id", "grp", "bucket", "pos", "total", "node", "folded", "root", F.array_join("siblings", "").alias("proof")), "buckets")
    outer = durable(above(t, levels), "outer")
    tops = durable(outer.filter("bucket = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("node")), "tops")
    tops = numbered(tops, "name")
    by_name = paths(tops.select("grp", "pos", "total", "node"), levels).join(tops.select("pos", "name"), "pos")
    by_name = by_name.select(F.col("name").alias("grp"), F.col("path").alias("last"), F.col("top").alias("all"))
    outer = durable(outer.join(by_name, "grp").select("grp", "bucket", F.concat("path", "last").alias("path"), F.col("top").alias("subroot"), "all"), "outer")
    d = t.drop("root").join(outer, ["grp", "bucket"])
    step = lambda h, x: F.sha2(F.when(x["is_left"], F.concat(x["sibling"], h)).otherwise(F.concat(h, x["sibling"])), 256)
    return d.select("doc_id", F.col("node").alias("leaf"), "subroot", F.col("all").alias("root"), F.concat("proof", F.array_join(F.transform("path", lambda x: x["sibling"]), "")).alias("proof"), F.aggregate("path", F.col("folded"), step).alias("folded"))


def document_leaves(docs: DataFrame, every: int = 7) -> DataFrame:
    """doc_id, lang, leaf and start of documents; start is the leaf of the row as tampered with, else the leaf itself."""
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    d = docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    d = d.withColumn("leaf", leaf(*[F.col(c) for c in kinds]))
    changed = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), more.cast("decimal(20,0)"), F.col("text"))
    return d.select("doc_id", "lang", "leaf", F.when(hit & F.col("n_chars").isNotNull(), changed).otherwise(F.col("leaf")).alias("start"))


def checked(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and whether the row as it is now still folds to the root."""
    d = manifest(document_leaves(docs), levels)
    d = d.withColumn("proof_sha256", F.sha2("proof", 256)).withColumnRenamed("folded", "folded_root")
    return d.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    return checked(table(spark, sf_dir, "documents"))


_FIELD = "coalesce(octet_length(encode({0}::varchar))::varchar || ':' || {0}::varchar, '-')"
_LEAF = lambda n_chars: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"
#: crc32 of the id's decimal digits, bit by bit; its polynomial is a fixed value.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda ch: list_transform(range(8), lambda b: (ord(ch) >> b) & 1)))),
  lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))))"""

OP11_SQL = f"""
with recursive
hashed as (select doc_id, lang, {_LEAF("n_chars")} leaf, case when n_chars is not null and {_CRC} % 7 = 0 then {_LEAF("(n_chars::hugeint + 1)")} else {_LEAF("n_chars")} end start from documents),
leaves as materialized (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from hashed),
tree as (select lang, 0 lvl, pos i, leaf h, n from leaves
  union all select lang, lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from tree where n > 1 group by lang, lvl, i // 2, n),
tops as materialized (select lang, h subroot, row_number() over (order by lang nulls first) - 1 pos, count(*) over () n from tree where n = 1),
up as (select 0 lvl, pos i, subroot h, n from tops
  union all select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)), (n + 1) // 2 from up where n > 1 group by lvl, i // 2, n),
walk as (select doc_id, lang, pos row, leaf, pos, n, 0 lvl, start folded, '' proof from leaves
  union all select w.doc_id, w.lang, w.row, w.leaf, w.pos // 2, (w.n + 1) // 2, w.lvl + 1,
    sha256(case when w.pos % 2 = 1 then s.h || w.folded else w.folded || coalesce(s.h, '') end), w.proof || coalesce(s.h, '')
    from walk w left join tree s on s.lang is not distinct from w.lang and s.lvl = w.lvl and s.i = xor(w.pos, 1) where w.n > 1),
last as (select w.doc_id, w.leaf, t.subroot, t.pos, t.n, 0 lvl, w.folded, w.proof from walk w join tops t on w.lang is not distinct from t.lang where w.n = 1
  union all select w.doc_id, w.leaf, w.subroot, w.pos // 2, (w.n + 1) // 2, w.lvl + 1,
    sha256(case when w.pos % 2 = 1 then s.h || w.folded else w.folded || coalesce(s.h, '') end), w.proof || coalesce(s.h, '')
    from last w left join up s on s.lvl = w.lvl and s.i = xor(w.pos, 1) where w.n > 1)
select doc_id, leaf, subroot, r.h root, sha256(proof) proof_sha256, folded folded_root, folded = r.h verified from last, (select h from up where n = 1) r where last.n = 1
"""
