"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.llm.common import WORD_SQL, scratch

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"
#: Bins of a source's order, each split into as many: only the small bin that the sample ends in is ordered row by row.
BINS = 256
#: Sources up to this number are broadcast (some 100 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Shuffled joins deal each source's documents out to so many tasks.
SALTS = 64
#: Where whole documents miss a source's target by more than this share, the last one is taken in part.
TOLERANCE = 0.005
#: A tolerance that every miss is within.
ANY_MISS = 1e300


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Targets of sources from their ``source, n_docs, source_size`` rows.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times
    all sizes; a target stops at ``cap`` times its source's size and the excess is
    shared again by weight. The rows are one per source, so the windows are over as many.
    """
    everything = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("double")
    by_ratio = everything.orderBy("ratio", "place")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("most", F.lit(cap) * F.col("source_size"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("words", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("rest", F.col("words") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("heavy", F.sum("weight").over(after))
        .withColumn("order", F.row_number().over(by_ratio))
        .withColumn("free", F.col("most") * F.col("heavy") >= F.col("weight") * F.col("rest"))
    )
    first = F.min(F.when(F.col("free"), F.struct("order", "rest", "heavy"))).over(everything)
    level = filled.withColumn("first", first)
    capped = F.col("first").isNull() | (F.col("order") < F.col("first.order"))
    return level.select(
        "source", "n_docs", "source_size",
        F.when(capped, F.col("most")).otherwise(F.col("weight") * F.col("first.rest") / F.col("first.heavy")).alias("target"),
    )


def random_odds(id_col: str, text_col: str, seed: str) -> Column:
    """U / (1 - U) for a U in (0, 1) that only the seed and the id decide, or the text of a row without one."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return u / (1 - u)


def join_sources(rows: DataFrame, table: DataFrame, n_sources: int, broadcast_sources: int = BROADCAST_SOURCES) -> DataFrame:
    """Inner join of documents with a table of one row a source, null with null."""
    table = table.withColumnRenamed("source", "table_source")
    match = F.col("source").eqNullSafe(F.col("table_source"))
    if n_sources <= broadcast_sources:
        table = F.broadcast(table)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
        table = table.withColumn("table_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        match = match & (F.col("salt") == F.col("table_salt"))
    return rows.join(table, match).drop("table_source", "salt", "table_salt")


def sample_end(rows: DataFrame, sources: DataFrame, bin_col: str) -> DataFrame:
    """``source, end_bin, before`` of all sources: the bin in which each sample ends, and the words before it.

    ``rows`` have ``before``, the words before all of them, and ``rest``, the words wanted.
    Sums of a few hundred bins a source are put in order; a source without rows has bin -1.
    """
    sums = rows.groupBy("source", bin_col).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    running = Window.partitionBy("source").orderBy(bin_col)
    upto = sums.withColumn("before", F.col("before") + F.sum("words").over(running) - F.col("words"))
    ends = upto.where("before < rest").groupBy("source").agg(F.max(bin_col).alias("end_bin"), F.max("before").alias("before"))
    none = sources.select("source", F.lit(-1).alias("end_bin"), F.lit(0).cast("bigint").alias("before"))
    return ends.unionByName(none).groupBy("source").agg(F.max("end_bin").alias("end_bin"), F.max("before").alias("before"))


def mix_sources(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED,
    bins: int = BINS, broadcast_sources: int = BROADCAST_SOURCES, tolerance: float = TOLERANCE, carried: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies, taken`` of every document.

    ``size`` is the number of words. With r = target / source_size, each document gets
    floor(r) certain whole copies; one copy more goes to a Pareto sample of fixed size in
    words: documents are ranked by random odds over inclusion odds, where the inclusion
    odds are those of the rest of r times sqrt(mean size / size), so that repeats spread
    over shorter documents. Documents are taken whole up to the one that the sample ends
    in, which is taken if that comes nearer to the target; only where whole documents
    would miss it by more than ``tolerance``, as in tiny sources, that one gives the words
    that are missing and ``taken`` isn't ``copies * size``.

    Sizes are written once to the checkpoint folder. A source of any share of the rows
    is summed before it is shuffled, by bins of the rank; only rows of the bin in which a
    sample ends are ordered in one task. The inclusion odds are not solved to sum to the sample's
    size: ranks by them and the fixed size decide. Null texts have size 0, a null source is a source
    of its own, rows with null ids draw by their text. Rows with equal ids and sizes rank alike,
    one before the other, by the ``carried`` columns, which the result has too. An empty table
    gives an empty result; other columns are not read.
    """
    narrow = scratch(
        documents.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_SQL)), F.lit(0)).cast("bigint").alias("size"),
            random_odds(id_col, text_col, seed).alias("odds"),
            *carried,
        )
    )
    sizes = scratch(narrow.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size")))
    n_sources = sizes.count()
    targets = source_targets(sizes, weights, share, cap).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    targets = (
        targets.withColumn("whole", F.floor("rate"))
        .withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
        .withColumn("part", F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0))
        .withColumn("mean", F.col("source_size") / F.col("n_docs"))
    )
    targets = scratch(targets)
    odds = F.col("part") / (1 - F.col("part")) * F.sqrt(F.col("mean") / F.greatest(F.col("size"), F.lit(1)))
    rank = F.when(F.col("part") > 0, F.col("odds") / odds)
    ranked = join_sources(narrow, targets, n_sources, broadcast_sources).withColumn("rank", rank)
    key = F.col("rank") / (1 + F.col("rank"))
    ranked = ranked.withColumn("bin", F.coalesce(F.floor(key * (bins * bins)), F.lit(bins * bins)).cast("int")).withColumn("wide", F.floor(F.col("bin") / bins).cast("int"))
    start = sizes.select("source", F.lit(0).cast("bigint").alias("before"))
    drawn = join_sources(ranked.where("part > 0"), start, n_sources, broadcast_sources)
    wide = scratch(sample_end(drawn, sizes, "wide"))
    inside = join_sources(drawn.drop("before"), wide, n_sources, broadcast_sources).where("wide = end_bin").drop("end_bin")
    ends = scratch(sample_end(inside, wide.select("source", "before"), "bin"))
    placed = join_sources(ranked.drop("wide"), ends, n_sources, broadcast_sources)

    more = F.when((F.col("part") > 0) & (F.col("bin") < F.col("end_bin")), 1).otherwise(0)
    clear = placed.where("part <= 0 or bin <> end_bin").withColumn("more", more).withColumn("extra", F.col("more") * F.col("size"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = placed.where("part > 0 and bin = end_bin").withColumn("start", start)
    miss = F.least(F.col("rest") - F.col("start"), F.col("start") + F.col("size") - F.col("rest"))
    whole = (F.col("start") + F.col("size") <= F.col("rest")) | ((miss <= tolerance * F.col("target")) & (F.col("rest") - F.col("start") >= F.col("size") / 2))
    extra = (
        F.when(F.col("start") >= F.col("rest"), 0)
        .when(whole, F.col("size"))
        .when(miss <= tolerance * F.col("target"), 0)
        .otherwise(F.least(F.col("size"), F.round(F.col("rest") - F.col("start")).cast("bigint")))
    )
    last = last.withColumn("extra", extra).withColumn("more", F.when(F.col("extra") == F.col("size"), 1).otherwise(0)).drop("start")
    both = clear.unionByName(last)
    return both.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("whole") + F.col("more")).cast("bigint").alias("copies"),
        (F.col("whole") * F.col("size") + F.col("extra")).cast("bigint").alias("taken"), *carried,
    )


def row_key(columns: list[str]) -> Column:
    """16 bytes that rows share only if all their columns are equal, null with null."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.unhex(F.md5(F.concat(*(F.when(F.col(f"`{c}`").isNull(), "n").otherwise(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c))) for c in columns))))


def mixed_documents(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` as often as :func:`mix_sources` takes them, in the same columns.

    Only whole documents are taken, the last one of a source if that comes nearer to its target.
    Each row is taken as often as the mix says of that row, whatever id it shares or lacks; rows
    equal in all columns are one text with the copies of all of them.
    """
    keyed = documents.withColumn("__key", row_key(documents.columns))
    plan = mix_sources(keyed, carried=("__key",), tolerance=ANY_MISS).groupBy(F.col("__key").alias("__of_key")).agg(F.sum("copies").cast("int").alias("__copies"))
    joined = keyed.dropDuplicates(["__key"]).join(plan.where("__copies > 0"), F.col("__key") == F.col("__of_key"))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in documents.columns))


#: DuckDB SQL for the same result.
MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(cast(doc_id as varchar), 'text:' || md5(coalesce(text, ''))) as name, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents
), sources as (
  select source, count(*) as n_docs, cast(sum(size) as bigint) as source_size from sized group by source
), ranked as (
  select *, case (row_number() over (order by encode(source) nulls last) - 1) % 3 when 0 then 5.0e0 when 1 then 2.0e0 else 1.0e0 end as weight,
    row_number() over (order by encode(source) nulls last) as place, 2.0e0 * source_size as most from sources
), filled as (
  select *, 1.5e0 * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by most / weight, place rows between current row and unbounded following) as heavy,
    row_number() over (order by most / weight, place) as ord from ranked
), level as (
  select min(ord) as ord, arg_min(rest, ord) as rest, arg_min(heavy, ord) as heavy from filled where most * heavy >= weight * rest
), target as (
  select f.source, f.n_docs, f.source_size,
    case when l.ord is null or f.ord < l.ord then f.most else f.weight * l.rest / l.heavy end as target from filled f cross join level l
), rate as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from target
), part as (
  select *, greatest(target - whole * source_size, 0) as rest,
    case when source_size > 0 then greatest(target - whole * source_size, 0) / source_size else 0 end as part,
    source_size / n_docs as mean from rate
), drawn as (
  select s.doc_id, s.source, s.size, p.source_size, p.target, p.whole, p.rest, p.part, p.mean,
    (cast('0x' || substr(md5('mix-1:' || s.name), 1, 13) as bigint) + 0.5e0) / 4503599627370496.0e0 as u
  from sized s join part p on s.source is not distinct from p.source
), placed as (
  select *, coalesce(sum(size) over (partition by source order by
      u / (1 - u) / (part / (1 - part) * sqrt(mean / greatest(size, 1))), doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from drawn where part > 0
), taken as (
  select doc_id, source_size, target, whole, size, case
    when start >= rest then 0
    when start + size <= rest then size
    when least(rest - start, start + size - rest) <= 0.005e0 * target then case when rest - start >= size / 2 then size else 0 end
    else least(size, cast(round(rest - start) as bigint)) end as extra from placed
  union all select doc_id, source_size, target, whole, size, 0 from drawn where not part > 0
)
select doc_id, cast(size as bigint) as size, source_size, target, cast(whole * size + extra as bigint) as taken from taken
"""
