"""Shards by a hierarchical weighted hash tree.

From the root down, each child of a node draws -ln(u) / weight, u from a hash of
the key and the child's name, and the smallest draw wins. A child whose weight
grows can only win keys, one whose weight shrinks can only lose them, and what
happens among the children of an unchanged node stays as it was: movement is
confined to subtrees whose weights change. A shard beyond the base tree comes as
a region of its own, so it takes rows only into itself.

Equal rows (doc_id, size and crc32) are counted before anything else, so that a
hot one is a number until its rows are dealt out again, RUN of them at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparrowmill.storage import table, written

SHARDS = 16
RUN = 10_000


@dataclass(frozen=True)
class Shard:
    number: int
    rack: str
    region: str
    weight: float = 1.0


def layout(shards: int, base: int = SHARDS, per_rack: int = 4, racks_per_region: int = 2) -> list[Shard]:
    """The first base shards in racks and regions, each later one in a rack and region of its own."""
    out = []
    for s in range(shards):
        rack = f"rack{s // per_rack}" if s < base else f"rack-added{s}"
        region = f"region{s // (per_rack * racks_per_region)}" if s < base else f"region-added{s}"
        out.append(Shard(s, rack, region))
    return out


def _uniform(key: Column, name: str) -> Column:
    """In (0, 1), from the first 32 bits of an MD5."""
    return (F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{name}"))), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def _winner(key: Column, weights: dict[str, float]) -> Column:
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = [F.struct((-F.log(_uniform(key, name)) / w).alias("draw"), F.lit(name).alias("name")) for name, w in sorted(weights.items()) if w > 0]
    return F.array_min(F.array(*draws))["name"] if len(draws) > 1 else draws[0]["name"]


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """The shard of a string key. Shards of weight 0 get nothing; some weight must be over 0."""
    tree = [s for s in tree if s.weight > 0]
    regions: dict[str, dict[str, dict[int, float]]] = {}
    for s in tree:
        regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.number] = s.weight
    total = lambda node: sum(total(v) if isinstance(v, dict) else v for v in node.values())
    region = _winner(key, {k: total(v) for k, v in regions.items()})
    out = F.lit(None).cast("int")
    for region_name, racks in regions.items():
        rack = _winner(key, {k: total(v) for k, v in racks.items()})
        inner = F.lit(None).cast("int")
        for rack_name, shards in racks.items():
            shard = _winner(key, {f"shard{n}": w for n, w in shards.items()})
            inner = F.when(rack == rack_name, F.substring(shard, 6, 9).cast("int")).otherwise(inner)
        out = F.when(region == region_name, inner).otherwise(out)
    return out


def hash_tree_shards(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law ("key"), shard, slot, grown_shard: one row for each input row.

    doc_id alone decides the shard; rows with a null doc_id have the key "null"
    and stay together, as do repeated ids. A null text has size 1. Slots run from
    0 without gaps in each shard, by a hash bucket of the row and then doc_id, size
    and crc32; equal rows get different slots. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sizes = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    alike = sizes.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    bucket = F.conv(F.substring(F.md5(F.concat_ws(":", key, "size", "text_crc32", F.lit("slot"))), 1, 3), 16, 10).cast("int")
    rows = written(alike.select("*", bucket.alias("_bucket"), shard_of(key, layout(shards)).alias("shard"), shard_of(key, layout(shards + 1)).alias("grown_shard")), "rows")
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(starts, ["shard", "_bucket"])
    first = F.col("_before") + F.col("_in")
    out = lambda df, slot: df.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard")
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "grown_shard", "_n", first.alias("_first")), "placed")
    few = placed.where(F.col("_n") <= RUN).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_k"))
    runs = placed.where(F.col("_n") > RUN).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(RUN))).alias("_run")).repartition("doc_id", "text_crc32", "_run")
    many = runs.select("*", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN, "_n") - 1)).alias("_k"))
    return out(few, F.col("_first") + F.col("_k")).unionByName(out(many, F.col("_first") + F.col("_k")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree_shards(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same tree in DuckDB, which has no crc32: its usual byte-wise table is made from the polynomial."""
    table_ = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table_.append(n)
    draw = lambda name, w: f"{{'d': -ln((('0x' || substr(md5(k || ':{name}'), 1, 8))::bigint + 0.5) / 4294967296.0) / {float(w)}, 'n': '{name}'}}"
    best = lambda weights: f"list_sort([{', '.join(draw(n, w) for n, w in sorted(weights.items()))}])[1].n"

    def tree(shards: int) -> str:
        regions: dict[str, dict[str, dict[int, float]]] = {}
        for s in layout(shards):
            regions.setdefault(s.region, {}).setdefault(s.rack, {})[s.number] = s.weight
        weight = {r: sum(sum(x.values()) for x in racks.values()) for r, racks in regions.items()}
        out = f"case {best(weight)}"
        for region, racks in regions.items():
            out += f" when '{region}' then case {best({k: sum(v.values()) for k, v in racks.items()})}"
            for rack, inner in racks.items():
                out += f" when '{rack}' then substr({best({f'shard{n}': w for n, w in inner.items()})}, 6)::int"
            out += " end"
        return out + " end"

    return f"""
with t as (select {table_}::bigint[] as crc_table),
b as (select doc_id, coalesce(doc_id::varchar, 'null') as k, (octet_length(encode(coalesce(text, ''))) + 1)::bigint as size,
  list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)) as bytes from documents),
c as (select doc_id, k, size, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, crc_table[(xor(a, x) & 255) + 1])), 4294967295::bigint)::bigint as text_crc32 from b, t),
s as (select *, ('0x' || substr(md5(k || ':' || size || ':' || text_crc32 || ':slot'), 1, 3))::int as bucket, {tree(SHARDS)} as shard, {tree(SHARDS + 1)} as grown_shard from c)
select doc_id, size, text_crc32, 'key' as law, shard, (row_number() over (partition by shard order by bucket, doc_id, size, text_crc32) - 1)::bigint as slot, grown_shard from s
"""


ORACLE = oracle()
