"""Mixing sources to target weights with a splitting tree of block quotas (operator 6)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from fleetlens.llm._scratch import new_path, stored
from fleetlens.operators.frames import ranked

#: Repeats by a source's rank.
WEIGHTS = (5, 2, 1)
FILLERS = 4


def _draw(*parts: Column | str) -> Column:
    """32 hexadecimal digits that depend on the parts alone; nulls count as such."""
    return F.md5(F.concat_ws("/", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("null")) for p in parts)))


def _unordered(kind: DataType) -> bool:
    """Whether a type holds a map, which has no hash."""
    return isinstance(kind, (MapType, VariantType)) or any(_unordered(getattr(x, "dataType", x)) for x in (kind.fields if isinstance(kind, StructType) else [kind.elementType] if isinstance(kind, ArrayType) else []))


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): share of the total by weight, none above most times its size.

    Weights go by code point order of the sources, null last. What exceeds a source's bound goes to the others by weight until
    none is above: in order of bound over weight, sources are full as long as the level that the rest would get exceeds theirs.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(rank, F.lit(len(weights))) + 1)
    x = sizes.select("source", "source_size", w.alias("weight"), (F.col("source_size") * most).alias("bound"))
    filled = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    rest = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("bound").over(before), F.lit(0))) / F.sum("weight").over(rest)
    x = x.withColumn("level", level).withColumn("at", F.row_number().over(filled)).withColumn("open", F.col("level") * F.col("weight") <= F.col("bound"))
    reached = F.min(F.when(F.col("open"), F.struct("at", "level"))).over(everything)["level"]
    first = F.min(F.when(F.col("open"), F.col("at"))).over(everything)
    target = F.when(F.col("at") >= first, F.col("weight") * reached).when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("bound"))
    return x.select("source", "source_size", target.cast("double").alias("target"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, most: int = 2, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix", digits: int | None = None, levels: int | None = None, block_words: int = 4_000_000, shard_words: int = 16_000_000
) -> DataFrame:
    """All columns of docs, and size, source_size, target, copies, taken, shards, places: the mix as a decision for each row.

    size is the number of runs without white space in the text (null: 0), target the words that the row's source should give
    (see source_targets()), copies how often the mix holds the document (at most `most`), taken their words. shards has the
    output shard of each copy, and places what the copy is ordered by in its shard; both are empty for documents not taken.

    Method. Draws come from MD5 of the seed, the id and the text's MD5, so reruns agree. Each source's documents are cut into
    blocks by the first digits of a draw: a random permutation dealt in 16 ** digits blocks. A source gives whole passes over all
    its blocks, and for the rest of its target blocks in permuted order; the block in which the target falls gives documents in
    permuted order while they fit, and then, FILLERS times, the one document of the source whose size comes closest to what is
    missing is added if that brings the total nearer. This makes the quotas: each block as often as it is given, whole or in part.

    Rows that are equal in source, id and text share a draw. They are counted as one group with their number, and where only some of a
    group fit, or one of it fills up, that many of its rows are taken: these are told apart by a place that is given to each.

    A splitting tree of `levels` halvings parts these quotas among 2 ** levels shards. At a node the given blocks of a source are
    drawn without replacement, in an order of their own, to the two sides in turn, copies of a block one after the other; of
    the sources with an odd number half are drawn, without replacement again, to have one more on the left. So shards differ by one
    given block of a source at most, all of them by few on the whole, and copies of a document part as high up as they can.
    Within a shard documents are ordered block by block, and by a draw of the copy in the block: a sort inside a shard (see
    write_shards()) shuffles them.

    digits and levels follow the words of the corpus where they are not given: blocks of about block_words, two digits at least, and
    shards of about shard_words, four levels at least. Sums run by (source, block), so a source with a third of all rows is
    dealt over 16 ** digits groups; no window is over documents but the one of the block in which a source's target falls. No row is
    lost. A null id is one more id, a null source one more source, a null text has the draw of an empty one. Empty
    tables give no rows. Added names replace those in docs.
    """
    spark = docs.sparkSession
    added = ("size", "source_size", "target", "copies", "taken", "shards", "places")
    kept = [c for c in docs.columns if c not in added]
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    draw = _draw(F.lit(seed), F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    small = docs.select(F.col(source_col).alias("_source"), words.alias("size"), draw.alias("_draw")).groupBy("_source", "_draw", "size").agg(F.count("*").alias("rows"))
    small = stored(small, "sizes")
    if digits is None or levels is None:
        total = small.agg(F.sum(F.col("size") * F.col("rows"))).first()[0] or 0
        digits = digits or max(2, math.ceil(math.log(max(1, total / block_words), 16)))
        levels = levels or max(4, math.ceil(math.log2(max(1, total * share / shard_words))))
    block = F.substring("_draw", 1, digits).alias("_block")
    small = small.select("*", block)
    rows = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)), F.col(source_col).alias("_source"), words.alias("size"), draw.alias("_draw")).select("*", block)

    blocks = small.groupBy("_source", "_block").agg(F.sum(F.col("size") * F.col("rows")).alias("words"))
    by_source = source_targets(blocks.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size")), share, most, weights)
    by_source = by_source.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    by_source = by_source.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).withColumnRenamed("source", "_of")
    blocks = blocks.join(by_source, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    order = Window.partitionBy("_source").orderBy(_draw(F.lit(seed), F.col("_source"), F.col("_block")), "_block")
    blocks = blocks.withColumn("until", F.sum("words").over(order)).withColumn("room", F.col("rest") - (F.col("until") - F.col("words")))
    blocks = stored(blocks.select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "source_size", "target", "passes", "rest", "words", "room"), "blocks")

    def with_blocks(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.join(right, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b"))).drop("_s", "_b")

    # groups of the block in which the rest of the target falls: all that fit, and of the next one as many rows as fit
    cut = with_blocks(small, blocks.where("room > 0 and room < words"))
    running = Window.partitionBy("_source", "_block").orderBy("_draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = cut.withColumn("sum", F.sum(F.col("size") * F.col("rows")).over(running))
    fits = F.col("sum") <= F.col("room")
    following = F.struct(F.col("_draw").alias("d"), "size", F.col("rows").alias("of"))
    edge = cut.groupBy("_source").agg(F.max(F.when(fits, F.col("_draw"))).alias("last"), F.coalesce(F.max(F.when(fits, F.col("sum"))), F.lit(0)).alias("got"), F.first("room").alias("room"), F.min(F.when(~fits, following)).alias("next"))
    some = F.coalesce(F.floor((F.col("room") - F.col("got")) / F.col("next.size")), F.lit(0))
    entry = "array<struct<d:string,take:bigint,of:bigint>>"
    part_of = F.when(some > 0, F.array(F.struct(F.col("next.d"), some.alias("take"), F.col("next.of")))).otherwise(F.array()).cast(entry)
    edge = edge.select(F.col("_source").alias("_e"), "last", (F.col("room") - F.col("got") - some * F.coalesce("next.size", F.lit(0))).alias("gap"), part_of.alias("parts"))
    base = F.when(F.col("room") >= F.col("words"), True).when(F.col("room") <= 0, False).otherwise(F.coalesce(F.col("_draw") <= F.col("last"), F.lit(False)))
    # documents that bring a source nearest to its target
    for _ in range(FILLERS):
        spare = with_blocks(small, blocks).join(edge, F.col("_source").eqNullSafe(F.col("_e")))
        spare = spare.where(~base & (F.col("size") > 0) & (F.abs(F.col("size") - F.col("gap")) < F.col("gap")) & ~F.exists("parts", lambda x: x["d"] == F.col("_draw")))
        found = spare.groupBy("_source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("_draw").alias("d"), F.col("size").alias("size"), F.col("rows").alias("of"))).alias("f"))
        edge = edge.join(found, F.col("_e").eqNullSafe(F.col("_source")), "left")
        more = F.array(F.struct(F.col("f.d"), F.lit(1).cast("long").alias("take"), F.col("f.of"))).cast(entry)
        edge = edge.select("_e", "last", (F.col("gap") - F.coalesce("f.size", F.lit(0))).alias("gap"), F.when(F.col("f.d").isNull(), F.col("parts")).otherwise(F.concat("parts", more)).alias("parts"))
        edge = stored(edge, "edges")

    # the quotas: a row for each time that a block is given, whole or in part
    quotas = blocks.join(edge.select("_e", "last", "parts"), F.col("_s").eqNullSafe(F.col("_e")), "left").drop("_e")
    part = (F.col("rest") > 0) & ((F.col("room") > 0) & ((F.col("room") >= F.col("words")) | F.col("last").isNotNull()) | F.coalesce(F.exists("parts", lambda x: F.substring(x["d"], 1, digits) == F.col("_b")), F.lit(False)))
    quotas = quotas.withColumn("given", F.least(F.col("passes") + F.when(part, 1).otherwise(0), F.lit(most)))
    tree = quotas.where("given > 0").select("_s", "_b", F.explode(F.sequence(F.lit(1), F.col("given"))).alias("copy"), F.lit(1).alias("node"))
    for level in range(levels):
        at = Window.partitionBy("node", "_s").orderBy(_draw(F.lit(seed), F.lit("tree"), F.lit(level), F.col("_s"), F.col("_b")), "_b", "copy")
        odd = tree.groupBy("node", "_s").agg(F.count("*").alias("n")).where("n % 2 = 1")
        turn = F.row_number().over(Window.partitionBy("node").orderBy(_draw(F.lit(seed), F.lit("odd"), F.col("node"), F.col("_s")), "_s")) + F.conv(F.substring(F.md5(F.col("node").cast("string")), 1, 4), 16, 10).cast("int")
        odd = odd.select(F.col("node").alias("_n"), F.col("_s").alias("_t"), (turn % 2).alias("late"))
        tree = tree.join(odd, (F.col("node") == F.col("_n")) & F.col("_s").eqNullSafe(F.col("_t")), "left")
        right = (F.row_number().over(at) + F.coalesce("late", F.lit(0)) + 1) % 2
        tree = tree.select("_s", "_b", "copy", (F.col("node") * 2 + right).alias("node"))
        if level % 4 == 3:
            tree = stored(tree, "tree")
    placed = tree.groupBy("_s", "_b").agg(F.transform(F.sort_array(F.collect_list(F.struct("copy", "node"))), lambda x: (x["node"] - F.lit(2**levels)).cast("int")).alias("_shards"))
    placed = placed.select(F.col("_s").alias("_t"), F.col("_b").alias("_c"), "_shards")
    quotas = stored(quotas.join(placed, F.col("_s").eqNullSafe(F.col("_t")) & (F.col("_b") == F.col("_c")), "left").drop("_t", "_c"), "quotas")

    out = with_blocks(rows, quotas).withColumn("_part", F.get(F.filter("parts", lambda x: x["d"] == F.col("_draw")), F.lit(0)))
    few = F.coalesce(F.col("_part.take") < F.col("_part.of"), F.lit(False))
    if edge.where(F.exists("parts", lambda x: x["take"] < x["of"])).isEmpty():
        out = out.withColumn("_number", F.lit(1).cast("long"))
    else:  # of these groups some rows are taken: their rows are numbered
        same = [F.col("_source").asc_nulls_first(), F.col("_draw").asc(), F.xxhash64(*(f"_c{i}" for i in range(len(kept)) if not _unordered(docs.schema[kept[i]].dataType))).asc(), F.col("_tie").asc()]
        twins = ranked(out.where(few).withColumn("_tie", F.monotonically_increasing_id()), same, "_place", new_path(spark, "twins")).drop("_tie")
        first = twins.groupBy(F.col("_source").alias("_t"), F.col("_draw").alias("_u")).agg(F.min("_place").alias("_first"))
        twins = twins.join(first, F.col("_source").eqNullSafe(F.col("_t")) & (F.col("_draw") == F.col("_u"))).withColumn("_number", F.col("_place") - F.col("_first") + 1).drop("_t", "_u", "_first", "_place")
        out = out.where(~few).withColumn("_number", F.lit(1).cast("long")).unionByName(twins)
    extra = base | F.coalesce(F.col("_number") <= F.col("_part.take"), F.lit(False))
    out = out.withColumn("copies", F.least(F.lit(most), F.col("passes") + F.when(extra & (F.col("rest") > 0), 1).otherwise(0)))
    shards = F.slice(F.coalesce("_shards", F.array().cast("array<int>")), 1, F.col("copies"))
    places = F.transform(shards, lambda x, i: F.concat(F.col("_block"), F.lit("-"), F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit("place"), i.cast("string"), F.col("_draw"))), 1, 16)))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), shards.alias("shards"), places.alias("places"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mix as Parquet: a folder for each shard, a row for each copy, in the order of places."""
    added = ("size", "source_size", "target", "copies", "taken", "shards", "places")
    rows = mixed.select(*(c for c in mixed.columns if c not in added), F.explode(F.arrays_zip("shards", "places")).alias("_at"))
    rows = rows.select(*(c for c in rows.columns if c != "_at"), F.col("_at.shards").alias("shard"), F.col("_at.places").alias("_place"))
    rows.repartition("shard").sortWithinPartitions("shard", "_place").drop("_place").write.partitionBy("shard").parquet(path)


def mix_sources_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, and shard and place of the first and second copy."""
    at = lambda c, i: F.get(c, F.lit(i))
    mixed = mix_sources(docs.select("doc_id", "text", "source"), **options)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", at("shards", 0).alias("shard"), at("places", 0).alias("place"), at("shards", 1).alias("shard_2"), at("places", 1).alias("place_2"))


def _oracle(levels: int = 4) -> str:
    tree = "".join(
        f"""t{i} as (
  select *, row_number() over (partition by node, source order by md5('mix/tree/{i}/' || coalesce(source, 'null') || '/' || block), block, copy) as pos, count(*) over (partition by node, source) % 2 as odd from u{i}),
u{i + 1} as (
  select source, block, copy, 2 * node + (pos + 1 + case when odd = 1 then (dense_rank() over (partition by node, odd order by md5('mix/odd/' || cast(node as varchar) || '/' || coalesce(source, 'null')), source nulls first)
    + cast('0x' || substr(md5(cast(node as varchar)), 1, 4) as integer)) % 2 else 0 end) % 2 as node from t{i}),
"""
        for i in range(levels)
    )
    fill = "".join(
        f"""f{i + 1} as (
  select source, min({{'off': abs(d.size - e.gap), 'draw': d.draw, 'size': d.size}}) as f from d join e{i} e on e.source is not distinct from d.source
  where not d.started and d.size > 0 and abs(d.size - e.gap) < e.gap and not list_contains(e.fillers, d.draw) group by all),
e{i + 1} as (
  select e.source, e.gap - coalesce(f.f.size, 0) as gap, case when f.f is null then e.fillers else list_append(e.fillers, f.f.draw) end as fillers from e{i} e left join f{i + 1} f on f.source is not distinct from e.source),
""".replace("select source, min(", "select e.source, min(").replace("group by all", "group by e.source")
        for i in range(FILLERS)
    )
    return rf"""
with s as (
  select doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size, md5('mix/' || coalesce(cast(doc_id as varchar), 'null') || '/' || md5(coalesce(text, ''))) as draw,
    row_number() over (partition by source, doc_id, coalesce(text, '')) as number from documents),
b as (select source, substr(draw, 1, 2) as block, cast(sum(size) as bigint) as words from s group by all),
z as (select source, cast(sum(words) as bigint) as source_size from b group by 1),
w as (
  select *, list_extract([{", ".join(map(str, WEIGHTS))}], cast((row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} + 1 as integer)) as weight, 2 * source_size as bound from z),
l as (
  select *, row_number() over o as pos, (sum(source_size) over () * cast(1.5 as double) - coalesce(sum(bound) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (o rows between current row and unbounded following) as level
  from w window o as (order by bound / weight, source nulls last)),
o as (select *, min(case when level * weight <= bound then pos end) over () as opened from l),
r as (select *, max(case when pos = opened then level end) over () as reached from o),
g as (select source, source_size, cast(case when pos >= opened then weight * reached when source_size = 0 then 0 else bound end as double) as target from r),
p as (select *, case when source_size > 0 then cast(floor(target / source_size) as integer) else 0 end as passes from g),
q as (select *, target - passes * source_size as rest from p),
k as (
  select b.source, block, words, source_size, target, passes, rest, rest - (sum(words) over (partition by b.source order by md5('mix/' || coalesce(b.source, 'null') || '/' || block), block) - words) as room
  from b join q on q.source is not distinct from b.source),
m as (select s.*, k.* exclude (source) from s join k on k.source is not distinct from s.source and k.block = substr(s.draw, 1, 2)),
c as (select *, sum(size) over (partition by source order by draw, number) as running from m where room > 0 and room < words),
x as (
  select source, max(case when running <= room then {{'d': draw, 'n': number}} end) as upto, coalesce(max(case when running <= room then running end), 0) as got, any_value(room) as room from c group by source),
y as (
  select m.*, case when m.room >= m.words then true when m.room <= 0 then false else coalesce(m.draw < x.upto.d or (m.draw = x.upto.d and m.number <= x.upto.n), false) end as base from m left join x on x.source is not distinct from m.source),
d as (select *, bool_or(base) over (partition by source, draw) as started from y),
e0 as (select source, room - got as gap, cast([] as varchar[]) as fillers from x),
{fill}v as (
  select k.*, least(2, passes + case when rest > 0 and (room > 0 and (room >= words or upto is not null) or coalesce(list_contains(list_transform(e.fillers, lambda d: substr(d, 1, 2)), k.block), false)) then 1 else 0 end) as given
  from k left join e{FILLERS} e on e.source is not distinct from k.source left join (select source as s, upto from x) on s is not distinct from k.source),
u0 as (select source, block, copy, 1 as node from v, unnest(range(1, given + 1)) x(copy)),
{tree}h as (select source, block, list(node - {2**levels} order by copy) as shards from u{levels} group by all),
a as (
  select d.*, case when passes >= 2 then 2 else passes + case when rest > 0 and (base or (number = 1 and coalesce(list_contains(e.fillers, d.draw), false))) then 1 else 0 end end as copies from d left join e{FILLERS} e on e.source is not distinct from d.source)
select doc_id, size, source_size, target, copies * size as taken,
  case when copies >= 1 then shards[1] end as shard, case when copies >= 1 then a.block || '-' || substr(md5('mix/place/0/' || draw), 1, 16) end as place,
  case when copies >= 2 then shards[2] end as shard_2, case when copies >= 2 then a.block || '-' || substr(md5('mix/place/1/' || draw), 1, 16) end as place_2
from a left join h on h.source is not distinct from a.source and h.block = a.block
"""


ORACLE = _oracle()
