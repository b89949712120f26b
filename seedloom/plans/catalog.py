"""One query an operator over the derived tables, and DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.functions import arrays, names, sequence
from seedloom.operators import alignment, annotation, features, metrics, positions, species, splits, tolerance, validation
from seedloom.plans import views as V
from seedloom.sources import readers, writers
from seedloom.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
B = V.BASES


def query(sql: str | None = None):
    """Registers a query, and its SQL over the derived views."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = V.with_views(sql)
        return f

    return keep


RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
COUNT = "len(list_filter(range(1, length(gene) + 1), lambda i: substr(gene, i, length({0})) = {0}))"


@query(f"""select row_id, gene, mirna, {RC.format('gene')} as rc_gene, (length(gene) - length(regexp_replace(gene, '[GC]', '', 'g'))) / length(gene)::double as gc from v_interactions""")
def sequence_basics(spark, sf):
    """Strict normalisation, reverse complement and GC share."""
    rows = V.interactions(spark, sf)
    return rows.select("row_id", sequence.normalize_strict(F.col("gene")).alias("gene"), sequence.normalize_strict(F.lower("mirna")).alias("mirna"), sequence.reverse_complement(F.col("gene")).alias("rc_gene"), sequence.gc_fraction(F.col("gene")).alias("gc"))


@query("""select mature_id, rpad(seq, 28, 'N') as padded, substr(seq, 1, 10) as cut, replace(seq, 'T', 'U') as rna from v_catalogue""")
def sequence_padding(spark, sf):
    """Padding, cutting and RNA letters."""
    s = F.lower("seq")
    return V.catalogue(spark, sf).select("mature_id", sequence.normalize_padded(s, 28).alias("padded"), sequence.normalize_padded(s, 10).alias("cut"), sequence.sanitize_rna(s).alias("rna"))


def _segment_sql(first: int, end: int) -> str:
    return COUNT.format(RC.format(f"substr(mirna, {first + 1}, {end - first})"))


@query("select row_id, " + ", ".join(f"{_segment_sql(a, b)} as {n}" for n, a, b in (("seed6", 1, 7), ("seed7", 1, 8), *sequence.EXACT_SEGMENTS)) + " from v_interactions")
def seed_counts(spark, sf):
    """Seed and longer reverse complement counts."""
    g, m = F.col("gene"), F.col("mirna")
    found = sequence.seed_counts(g, m) | sequence.exact_rc_counts(g, m)
    return V.interactions(spark, sf).select("row_id", *(c.cast("bigint").alias(n) for n, c in found.items()))


@query("""select row_id, coalesce(list_max(list_transform(range(1, 8), lambda k: case when len(list_filter(range(1, 9 - k), lambda i: contains(gene,
          substr(rc, i, k)))) > 0 then k else 0 end)), 0) as longest from (select row_id, gene, reverse(translate(substr(mirna,
          2, 7), 'ACGT', 'TGCA')) as rc from v_interactions)""")
def seed_max_match(spark, sf):
    """Longest part of the seed's reverse complement in the target."""
    return V.interactions(spark, sf).select("row_id", sequence.seed_max_match(F.col("gene"), F.col("mirna")).cast("bigint").alias("longest"))


@query("""select mature_id, list_transform(range(1, 29), lambda i: case substr(seq, i, 1) when 'A' then 0 when 'C' then 1 when 'G' then 2
    when 'T' then 3 else 4 end) as codes, list_transform(range(1, 29), lambda i: case substr(seq, i, 1) when 'A' then 0 when 'T'
    then 1 when 'C' then 2 when 'G' then 3 else -1 end) as pair_codes from v_catalogue""")
def base_codes(spark, sf):
    """Base codes in both orders."""
    s = F.col("seq")
    return V.catalogue(spark, sf).select("mature_id", sequence.base_codes(s, 28).alias("codes"), sequence.pair_base_codes(s, 28).alias("pair_codes"))


@query("""select i.row_id, max(case when w.score / 6.0 >= 0.75 then 1 else 0 end) as any_good, max(w.score) / 6.0e0 as best, count(*) filter (where w.score / 6.0 >= 0.75) / 45.0e0 as good_share from v_interactions i, lateral (
  select s, sum(case when (m = 'A' and t = 'T') or (m = 'T' and t = 'A') or (m = 'C' and t = 'G') or (m = 'G' and t = 'C') then 1.0e0 when (m = 'G' and t = 'T') or (m = 'T' and t = 'G') then 0.5e0 else 0.0e0 end) as score
  from (select s.s, substr(i.mirna, 7 - k.k, 1) as m, substr(i.gene, s.s + k.k + 1, 1) as t from (select unnest(range(0, 45)) as s) s cross join (select unnest(range(0, 6)) as k) k) p group by s) w group by i.row_id""")
def window_alignment(spark, sf):
    """Best score share and share of good windows of the first segment, out of the 72 alignment features."""
    rows = V.interactions(spark, sf).select("row_id", sequence.window_alignment("gene", "mirna").alias("w"))
    return rows.select("row_id", (F.col("w")[8] > 0).cast("bigint").alias("any_good"), F.col("w")[4].alias("best"), F.col("w")[8].alias("good_share"))


@query("""select split, cls, sum(n)::bigint as n from (
  select split, 4 * m.c + t.c as cls, (length(mirna) - length(replace(mirna, m.b, ''))) * (length(gene) - length(replace(gene, t.b, ''))) as n from v_interactions,
    (values ('A', 0), ('T', 1), ('C', 2), ('G', 3)) m(b, c), (values ('A', 0), ('T', 1), ('C', 2), ('G', 3)) t(b, c)
  union all select split, 17, 1400 - length(mirna) * length(gene) from v_interactions) group by split, cls having sum(n) > 0""")
def pair_class_counts(spark, sf):
    """Cells of each class in the pair grids of a split; grids are made and counted where the rows are."""
    rows = V.interactions(spark, sf).select("split", arrays.grid_class_histogram(arrays.encode_pair_grid("mirna", "gene")).alias("h"))
    totals = rows.groupBy("split").agg(*(F.sum(F.get("h", F.lit(i)).cast("bigint")).alias(str(i)) for i in range(18)))
    long = totals.unpivot("split", [str(i) for i in range(18)], "cls", "n")
    return long.where("n > 0").select("split", F.col("cls").cast("bigint").alias("cls"), "n")


@query("select row_id, true as same from v_interactions")
def pair_grid_round_trip(spark, sf):
    """Grids decode to the base codes they were made from."""
    rows = V.interactions(spark, sf).withColumn("d", arrays.decode_pair_grid(arrays.encode_pair_grid("mirna", "gene")))
    same = (F.col("d.mirna") == sequence.pair_base_codes(F.col("mirna"), 28)) & (F.col("d.target") == sequence.pair_base_codes(F.col("gene"), 50))
    return rows.select("row_id", same.alias("same"))


@query("""select split, sum(nm_a * nt_a + nm_c * nt_c + nm_g * nt_g + nm_t * nt_t)::bigint as wc, sum(lm * 50)::bigint as valid, sum(7 * 50)::bigint as seed from (
  select split, length(mirna) as lm, """ + ", ".join(f"length(mirna) - length(replace(mirna, '{b}', '')) as nm_{b.lower()}, length(gene) - length(replace(gene, '{b}', '')) as nt_{b.lower()}" for b in "ACGT") + " from v_interactions) group by split")
def rc_pair_features(spark, sf):
    """Watson-Crick, valid and seed cells against the reverse-complemented target."""
    rows = V.interactions(spark, sf).select("split", arrays.rc_pair_features("mirna", "gene").alias("c"))
    return rows.groupBy("split").agg(*(F.sum(F.get("c", F.lit(i)).cast("bigint")).alias(n) for n, i in (("wc", 16), ("valid", 18), ("seed", 19))))


SCORES = [f"score_{b}" for b in B]
SUM_MARGIN = "case when miss = 1 then 0.0e0 else case actual_nt " + " ".join(f"when '{b.upper()}' then score_{b} - greatest({', '.join(s for s in SCORES if s != f'score_{b}')})" for b in B) + " end end"


def reduced_positions(spark, sf, kind: str) -> DataFrame:
    own = arrays.reduce_scores(kind, F.col("actual_nt"), *(F.col(s) for s in SCORES))
    return V.target_positions(spark, sf).withColumn("reduced", F.get(own, F.lit(0)))


@query(f"select i.split, count(*) as row_count, sum(i.label)::bigint as positive_rows, sum(t.n)::bigint as n_positions, sum(t.miss)::bigint as n_missing, sum(t.margin) as margin from v_interactions i join (select row_id, count(*) as n, sum(miss) as miss, sum({SUM_MARGIN}) as margin from v_target_positions group by row_id) t using (row_id) group by i.split")
def feature_dataset(spark, sf):
    """Rows joined to their reduced position scores, counted by split: the flagship query.

    Positions are reduced and filled before they are gathered by row, and gathered once.
    """
    target = reduced_positions(spark, sf, "actual_margin").groupBy("row_id").agg(F.count("*").alias("n"), F.sum("miss").alias("miss"), F.sum("reduced").alias("margin"))
    joined = V.interactions(spark, sf).join(target, "row_id")
    return joined.groupBy("split").agg(
        F.count("*").alias("row_count"), F.sum(F.col("label").cast("bigint")).alias("positive_rows"), F.sum("n").alias("n_positions"), F.sum("miss").alias("n_missing"), F.sum("margin").alias("margin")
    )


@query("select split, actual_nt, sum(case when miss = 1 then 0.5e0 else case actual_nt " + " ".join(f"when '{b.upper()}' then ({' + '.join(s for s in SCORES if s != f'score_{b}')}) / 3" for b in B) + " end end)::decimal(30,6)::double as alt_mean, count(*) as n from v_target_positions group by split, actual_nt")
def reduce_alt_mean(spark, sf):
    """Mean of the other three bases, summed by split and base."""
    rows = reduced_positions(spark, sf, "alt_mean")
    return rows.groupBy("split", "actual_nt").agg(F.round(F.sum("reduced"), 6).alias("alt_mean"), F.count("*").alias("n"))


@query("select row_id, list(coalesce(score_a, 0.5) order by pos) as filled, list(miss order by pos) as mask, len(list(pos)) as n from v_target_positions group by row_id")
def position_arrays(spark, sf):
    """Positions gathered by row as arrays, filled, with a mask."""
    rows = positions.position_arrays(V.target_positions(spark, sf, by_row=True), ["row_id"], "pos", {"a": F.col("score_a")}, 50)
    return rows.select("row_id", arrays.fill_missing(F.col("a"), 0.5).alias("filled"), arrays.missing_mask(F.col("a")).alias("mask"), F.size("a").cast("bigint").alias("n"))


@query("""select i.row_id, t.n as target_n, m.n as mirna_n, [] as missing from v_interactions i
  left join (select row_id, count(*) as n from v_target_positions group by row_id) t using (row_id)
  left join (select mature_id, count(*) as n from v_mirna_positions group by mature_id) m using (mature_id)""")
def attach_position_scores(spark, sf):
    """Rows with the arrays of both axes; profiles are shared by many rows and broadcast."""
    target = positions.position_arrays(V.target_positions(spark, sf, by_row=True), ["row_id"], "pos", {"target_scores": F.col("score_a")}, 50)
    mirna = positions.position_arrays(V.mirna_positions(spark, sf).join(F.broadcast(V.interactions(spark, sf).select("mature_id").distinct()), "mature_id", "left_semi"), ["mature_id"], "pos", {"mirna_scores": F.coalesce("param_1_a", F.lit(-1.0))}, 28)
    joined = positions.attach_position_scores(V.interactions(spark, sf), mirna, target)
    return joined.select("row_id", F.size("target_scores").cast("bigint").alias("target_n"), F.size(F.array_compact("mirna_scores")).cast("bigint").alias("mirna_n"), "missing")


@query("select mature_id, count(*) as n_positions, 0 as n_repeated, 0 as n_outside, 28 - count(*) as n_missing from v_mirna_positions group by mature_id")
def check_positions_complete(spark, sf):
    """Distinct, repeated, outside and missing positions of each profile."""
    return validation.check_positions_complete(V.mirna_positions(spark, sf), "mature_id", "pos", 28)


@query("select split, count(*) as n_positions, sum(miss)::bigint as n_missing from v_target_positions group by split")
def missing_position_counts(spark, sf):
    """Positions without any score by split."""
    return positions.missing_position_counts(V.target_positions(spark, sf), ["split"], SCORES)


@query("select row_id, pos from v_target_positions where miss = 0 and score_c < 0.1")
def check_partial_missing(spark, sf):
    """Quartets of which one score was taken away."""
    rows = V.target_positions(spark, sf).withColumn("score_c", F.when(F.col("score_c") >= 0.1, F.col("score_c")))
    return validation.check_partial_missing(rows, SCORES).select("row_id", "pos")


@query("select row_id, pos from v_target_positions where miss = 0 and (score_a * 300000 > 65504 or score_c * 300000 > 65504 or score_g * 300000 > 65504 or score_t * 300000 > 65504)")
def check_compact_range(spark, sf):
    """Scores beyond half-precision range."""
    rows = V.target_positions(spark, sf).select("row_id", "pos", *((F.col(s) * 300000).alias(s) for s in SCORES))
    return validation.check_compact_range(rows, SCORES).select("row_id", "pos")


@query("""select rule, count(*) as n_rows from (select unnest(case when row_id % 5 = 0 then ['gene_letters'] else [] end || case when row_id
      % 7 = 0 and row_id % 5 <> 0 then ['gene_length'] else [] end || case when row_id % 11 = 0 then ['label'] else [] end || case
      when row_id % 13 = 0 then ['empty_id'] else [] end) as rule from v_interactions)
  group by rule""")
def reject_counts(spark, sf):
    """Rows that break each rule, after some are broken on purpose."""
    r = F.col("row_id")
    gene = F.when(r % 5 == 0, F.concat(F.lit("X"), F.substring("gene", 2, 49))).when(r % 7 == 0, F.substring("gene", 1, 49)).otherwise(F.col("gene"))
    broken = V.interactions(spark, sf).withColumn("gene", gene).withColumn("label", F.when(r % 11 == 0, 2).otherwise(F.col("label"))).withColumn("id", F.when(r % 13 == 0, " ").otherwise(F.col("id")))
    return validation.reject_counts(validation.validate_interactions(broken.withColumn("id", F.when(F.col("id") == " ", F.lit(None)).otherwise(F.col("id")))))


@query("select o_orderkey as id, count(*)::bigint as n from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey having count(*) > 1")
def duplicate_ids(spark, sf):
    """Ids of more than one row."""
    rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("A").alias("gene"), F.lit("A").alias("mirna"), F.lit(1).alias("label"))
    bad = validation.validate_interactions(rows).where(F.array_contains("errors", "duplicate_id"))
    return bad.groupBy("id").agg(F.count("*").alias("n"))


@query("""select l_orderkey, l_linenumber from (select *, lag(l_partkey) over (partition by l_orderkey
      order by l_linenumber, l_partkey, l_suppkey) as b from (select distinct l_orderkey, l_linenumber, min(l_partkey) over (partition
        by l_orderkey, l_linenumber) as l_partkey, 0 as l_suppkey from lineitem))
  where b >= l_partkey""")
def check_ascending(spark, sf):
    """Lines whose part isn't larger than that of the line before."""
    lines = V.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return validation.check_ascending(lines, "l_linenumber", "l_partkey", "l_orderkey").select("l_orderkey", "l_linenumber")


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders)")
def missing_ids(spark, sf):
    """Customers without an order."""
    return validation.missing_ids(V.table(spark, sf, "customer"), V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("""select row_id, list_transform(phylop, lambda x: case when x is null then 0.0e0 else greatest(least(x / 10, 1.0e0), -1.0e0) end)
  as phylop, len(list_filter(phastcons, lambda x: x is null)) as n_missing
  from v_tracks""")
def fill_tracks(spark, sf):
    """phyloP scaled, clipped and filled; missing phastCons counted."""
    scaled = F.transform("phylop", lambda x: F.greatest(F.least(x / 10, F.lit(1.0)), F.lit(-1.0)))
    clipped = F.transform(F.arrays_zip("phylop", scaled.alias("s")), lambda p: F.when(p["phylop"].isNotNull(), p["s"]))
    return V.tracks(spark, sf).select("row_id", arrays.fill_missing(clipped, 0.0).alias("phylop"), F.size(F.filter("phastcons", lambda x: x.isNull())).cast("bigint").alias("n_missing"))


@query("""select row_id, floor((list_avg(f)) * 1073741824e0 + 0.5e0) / 1073741824e0 as mean, list_min(f) as min, list_max(f) as max, floor((list_median(f))
    * 1073741824e0 + 0.5e0) / 1073741824e0 as median, floor((quantile_cont(x, 0.25)) * 1073741824e0 + 0.5e0) / 1073741824e0 as
  q25, floor((quantile_cont(x, 0.75)) * 1073741824e0 + 0.5e0) / 1073741824e0 as q75, floor((stddev_pop(x)) * 1073741824e0 + 0.5e0)
  / 1073741824e0 as std, count(x) / 50.0e0 as finite_fraction from (select row_id, list_filter(phastcons, lambda x: x is not null)
    as f, unnest(phastcons) as x from v_tracks) group by row_id, f""")
def vector_summary(spark, sf):
    """Summary statistics of a track."""
    s = arrays.vector_summary(F.col("phastcons"))
    return V.tracks(spark, sf).select("row_id", *((V.snapped(s[n]) if n in ("mean", "median", "q25", "q75", "std") else s[n]).alias(n) for n in ("mean", "min", "max", "median", "q25", "q75", "std", "finite_fraction")))


@query("select row_id, list_transform(range(1, 51), lambda i: case when i > 3 then coalesce(phastcons[i - 3], 0.5e0) else 0.5e0 end) as shifted from v_tracks")
def shift_target(spark, sf):
    """A track moved by three with neutral fills."""
    return V.tracks(spark, sf).select("row_id", arrays.shift_target(arrays.fill_missing(F.col("phastcons"), 0.5), 3, 0.5).alias("shifted"))


@query("select row_id, list_sum(list_transform(phastcons, lambda x: coalesce(x, 0.5e0))) * list_sum(list_transform(phylop, lambda x: coalesce(x, 0.0e0))) as total from v_tracks")
def outer_interactions(spark, sf):
    """Sum over the products of every pair of positions of two tracks."""
    total = arrays.outer_interaction_totals(arrays.fill_missing(F.col("phastcons"), 0.5), arrays.fill_missing(F.col("phylop"), 0.0))
    return V.tracks(spark, sf).select("row_id", total.alias("total"))


@query("""select 'phylop' as source, count(x)::double as n, avg(x) as mean, round(stddev_pop(x), 9) as std
  from (select unnest(phylop) as x from v_tracks) union all select 'phastcons', count(x)::double, avg(x), round(stddev_pop(x),
    9) from (select unnest(phastcons) as x from v_tracks)""")
def fit_position_scaler(spark, sf):
    """Mean and population std of the tracks over all positions."""
    return features.fit_position_scaler(V.tracks(spark, sf), ["phylop", "phastcons"]).withColumn("std", F.round("std", 9))


@query("""select source, sum(w * (x is not null)::int)::double as n, sum(w * x) / sum(w * (x is not null)::int) as mean, round(sqrt(sum(w
        * x * x) / sum(w * (x is not null)::int) - (sum(w * x) / sum(w * (x is not null)::int)) ** 2), 9) as std
  from (select c.n as w, unnest(['param_1_a', 'param_1_c']) as source, unnest([param_1_a, param_1_c]) as x
    from v_mirna_positions join (select mature_id, count(*) as n from v_interactions
      group by mature_id) c using (mature_id)) group by source""")
def fit_mirna_scaler(spark, sf):
    """Profile scaler weighted by the samples that selected each profile."""
    fitted = features.fit_mirna_scaler(V.mirna_positions(spark, sf), V.interactions(spark, sf), ["param_1_a", "param_1_c"])
    return fitted.withColumn("std", F.round("std", 9))


@query("""select split, round(sum((x - (select avg(score_a) from v_target_positions)) / (select stddev_pop(score_a)
        from v_target_positions)), 4) as total from (select split, score_a as x
    from v_target_positions) group by split""")
def apply_scaler(spark, sf):
    """Standardised scores summed by split."""
    rows = V.target_positions(spark, sf)
    scaled = features.apply_scaler(rows, features.fit_columns(rows, ["score_a"]), ["score_a"])
    return scaled.groupBy("split").agg(F.round(F.sum("score_a"), 4).alias("total"))


@query("""select source, count(x)::double as n, round(avg(x), 9) as mean, round(stddev_pop(x), 9) as std
  from (select unnest(['actual_score', 'other_mean', 'difference']) as source, unnest([own, other, own - other]) as x
    from (select own, (score_a + score_c + score_g + score_t - own) / 3 as other
      from (select *, case actual_nt when 'A' then score_a when 'C' then score_c when 'G' then score_g else score_t end as own
        from v_target_positions))) group by source""")
def fit_target_scaler(spark, sf):
    """Scaler of the channels derived from the actual base."""
    rows = positions.actual_features(V.target_positions(spark, sf), "actual_nt", "score_")
    fitted = features.fit_columns(rows, ["actual_score", "other_mean", "difference"])
    return fitted.select("source", "n", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


VOCAB = "select '__MISSING__' as token, count(*) filter (where t is null) as n, 0 as index from (select nullif(dominant_region, 'NA') as t from v_interactions) union all select '__OTHER__', 0, 1 union all select t, n, cast(row_number() over (order by n desc, t) + 1 as bigint) from (select nullif(dominant_region, 'NA') as t, count(*) as n from v_interactions group by 1) where t is not null and n >= 100"


@query(VOCAB)
def fit_vocab(spark, sf):
    """Vocabulary of a category of at least 100 rows a token."""
    return features.fit_vocab(V.interactions(spark, sf), "dominant_region", 100).withColumn("index", F.col("index").cast("bigint"))


@query(f"select i.row_id, coalesce(v.index, 1) as code from v_interactions i left join ({VOCAB}) v on v.token = case when dominant_region = 'NA' then '__MISSING__' else dominant_region end")
def encode_category(spark, sf):
    """Vocabulary indexes of rows."""
    rows = V.interactions(spark, sf)
    return features.encode_category(rows, features.fit_vocab(rows, "dominant_region", 100), "dominant_region", "code").select("row_id", F.col("code").cast("bigint").alias("code"))


USABLE = "has_profile = 1 and mature_id is not null"


@query(f"select id, mature_id, candidate_index from (select *, row_number() over (partition by id order by candidate_index, source_order) as p from v_candidates where {USABLE}) where p = 1")
def select_candidate(spark, sf):
    """The selected candidate of each sample."""
    return features.select_candidate(V.candidates(spark, sf)).select("id", "mature_id", "candidate_index")


@query(f"select id, mature_id, p - 1 as slot from (select *, row_number() over (partition by id order by candidate_index, source_order) as p from v_candidates where {USABLE}) where p <= 3")
def rank_candidates(spark, sf):
    """The first three candidates of each sample in slots."""
    return features.rank_candidates(V.candidates(spark, sf), 3).select("id", "mature_id", F.col("slot").cast("bigint").alias("slot"))


@query(f"select sum(n)::bigint as n_rows, count(*) as n_samples, max(most)::bigint as max_candidate_count, count(*) filter (where u > 0) as n_selected, sum(least(u, 3))::bigint as n_retained, sum(greatest(u - 3, 0))::bigint as n_truncated from (select id, count(*) as n, max(candidate_count) as most, count(*) filter (where {USABLE}) as u from v_candidates group by id)")
def candidate_summary(spark, sf):
    """Counts over candidates and samples."""
    return features.candidate_summary(V.candidates(spark, sf), 3)


@query(f"select id, [case when count(*) >= 1 then 1 else 0 end, case when count(*) >= 2 then 1 else 0 end, case when count(*) >= 3 then 1 else 0 end] as slot_mask from v_candidates where {USABLE} group by id")
def attach_profiles(spark, sf):
    """Slot masks of the profiles of each sample's candidates."""
    profiles = positions.position_arrays(V.mirna_positions(spark, sf), ["mature_id"], "pos", {"profile": F.col("param_1_a")}, 28)
    return features.attach_profiles(features.rank_candidates(V.candidates(spark, sf), 3), profiles, 3).select("id", "slot_mask")


@query("""select split, score, tp::bigint as tp, predicted::bigint as predicted, tp / predicted as precision, tp / max(tp) over (partition
    by split) as recall from (select split, probability_1 as score, sum(sum(label)) over w as tp, sum(count(*)) over w as predicted
    from v_predictions group by split, probability_1 window w as (partition by split
      order by probability_1 desc))""")
def cumulative_pr_curve(spark, sf):
    """Precision and recall at each score of a split."""
    return metrics.cumulative_pr_curve(V.predictions(spark, sf), ["split"])


@query("""select split, max(an)::bigint as n_rows, max(ap)::bigint as n_pos, round(sum(pos * tp / pp) / max(ap), 9) as average_precision,
  round(sum(pos * ((an - pp) - (ap - tp) + (n - pos) / 2)) / (max(ap) * (max(an) - max(ap))), 9) as auroc
  from (select *, sum(pos) over w as tp, sum(n) over w as pp, sum(pos) over (partition by split) as ap, sum(n) over (partition
      by split) as an from (select split, probability_1 as s, sum(label)::double as pos, count(*)::double as n
      from v_predictions group by 1, 2) window w as (partition by split
      order by s desc)) group by split""")
def ranking_metrics(spark, sf):
    """Average precision and AUROC of a split."""
    found = metrics.ranking_metrics(V.predictions(spark, sf), ["split"])
    return found.withColumn("average_precision", F.round("average_precision", 9)).withColumn("auroc", F.round("auroc", 9))


@query("""select split, n, round((tp + tn) / n, 9) as accuracy, round(tp / (tp + fp), 9) as precision, round(tp / (tp + fn), 9) as recall,
  round(2 * tp / (2 * tp + fp + fn), 9) as f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)),
    9) as mcc, round(ll, 6) as log_loss, round(br, 9) as brier from (select split, count(*) as n, (count(*) filter (where h and
        label = 1))::double as tp, (count(*) filter (where h and label = 0))::double as fp, (count(*) filter (where not h and label
        = 1))::double as fn, (count(*) filter (where not h and label = 0))::double as tn, avg(-ln(case when label = 1 then p else
        1 - p end)) as ll, avg((p - label) * (p - label)) as br from (select split, label, probability_1 >= 0.5 as h, greatest(least(probability_1,
          1 - 1e-7::double), 1e-7::double) as p from v_predictions) group by split)""")
def threshold_metrics(spark, sf):
    """Threshold metrics of a split."""
    found = metrics.threshold_metrics(V.predictions(spark, sf), ["split"])
    return found.select("split", "n", *(F.round(c, 6 if c == "log_loss" else 9).alias(c) for c in found.columns[2:]))


@query("""select split, round(sum(l * w) / sum(w), 6) as loss from (select split, greatest(z, 0) - z * case when label = 1 then 0.9e0 else
    0.05e0 end + ln(1 + exp(-abs(z))) as l, 1 + label as w from (select split, label, probability_1 * 8 - 4 as z
      from v_predictions)) group by split""")
def bce_loss(spark, sf):
    """Weighted smoothed cross-entropy of logits."""
    found = metrics.bce_loss(V.predictions(spark, sf), ["split"], F.col("probability_1") * 8 - 4, F.col("label"), 1 + F.col("label"), 0.1, 0.05)
    return found.withColumn("loss", F.round("loss", 6))


@query("select label as id, avg(probability_1) as probability, round(ln(avg(probability_1) / (1 - avg(probability_1))), 9) as logit from v_predictions group by label")
def mean_prob_logit(spark, sf):
    """Mean probability and logit of repeated passes."""
    return metrics.mean_prob_logit(V.predictions(spark, sf).select(F.col("label").alias("id"), "probability_1"), "id", "probability_1").withColumn("logit", F.round("logit", 9))


@query("select id, case when probability_1 >= 0.5 then 1 else 0 end as prediction, 1 - probability_1 as probability_0, probability_1, label from v_predictions")
def prediction_rows(spark, sf):
    """Prediction output rows."""
    return writers.prediction_rows(V.predictions(spark, sf), "probability_1")


@query("select shard, count(*) as row_count, sum(label)::bigint as positive_rows from (select label, (row_number() over (order by row_id) - 1) // 1000 as shard from v_interactions) group by shard")
def manifest_counts(spark, sf):
    """Rows numbered, put into shards of 1000 and counted."""
    rows = splits.numbered(V.interactions(spark, sf), [F.col("row_id")], "row_number")
    return splits.manifest_counts(splits.assign_shards(rows, "row_number", 1000), ["shard"])


@query("""select row_id, place > n - floor(n * 0.2) as is_validation from (select row_id, row_number() over (order by md5('7:' || cast(row_id
          as varchar)), row_id) as place, count(*) over () as n from v_interactions)""")
def random_row_split(spark, sf):
    """An exact fifth of the rows as validation."""
    return splits.random_row_split(V.interactions(spark, sf), "row_id", 0.2, 7).select("row_id", "is_validation")


@query("""select max(n)::bigint as row_count, (count(*) filter (where place <= n - floor(n * 0.2)))::bigint as train_rows, (count(*) filter (where place > n - floor(n * 0.2)))::bigint as val_rows,
  floor(max(n) * 0.2)::bigint as expected_val_rows, true as matches, 0.2e0 as val_fraction
from (select row_number() over (order by md5('7:' || cast(row_id as varchar)), row_id) as place, count(*) over () as n from v_interactions)""")
def split_summary(spark, sf):
    """Counts of a split, and whether they are those that its fraction asks for."""
    return splits.split_summary(splits.random_row_split(V.interactions(spark, sf), "row_id", 0.2, 7), 0.2)


@query("select cast(row_number() over () as varchar) as id, length(text) as n from documents")
def default_ids(spark, sf):
    """Ids of rows without an id column: their numbers as they stand in their files."""
    return splits.default_ids(V.table(spark, sf, "documents").select(F.length("text").alias("n")))


@query("select o_orderkey, row_number() over () as row_id from orders")
def add_row_id(spark, sf):
    """Numbers of rows as they stand in their files."""
    scan = V.table(spark, sf, "orders").select("o_orderkey")
    return splits.add_row_id(scan, "row_id")


@query("""select row_id, row_number() over (order by md5('45:' || cast(shard as varchar)), shard, md5('45:' || cast(row_id as varchar)),
    row_id) as place from (select row_id, (row_number() over (order by row_id) - 1) // 1000 as shard
    from v_interactions)""")
def epoch_shuffle(spark, sf):
    """Places of rows in a shuffle of shards, then rows inside."""
    rows = splits.assign_shards(splits.numbered(V.interactions(spark, sf), [F.col("row_id")], "n"), "n", 1000)
    return splits.numbered(rows, splits.epoch_order("shard", 42, 3, "row_id", "shard"), "place").select("row_id", "place")


@query("select mirna, min(row_id) as first_row, row_number() over (order by min(row_id)) - 1 as index from v_interactions group by mirna")
def stable_unique(spark, sf):
    """Distinct miRNAs in the order of first occurrence."""
    return splits.stable_unique(V.interactions(spark, sf), "mirna", "row_id")


@query("select row_id, gene from v_interactions order by row_id limit 100")
def head_rows(spark, sf):
    """The first hundred rows."""
    return splits.head_rows(V.interactions(spark, sf), "row_id", 100).select("row_id", "gene")


@query("select phase, count(*) as n from (select case when split = 'train' then 'a' else 'b' end as phase from v_interactions) group by phase")
def union_phases(spark, sf):
    """Phases tagged and put together."""
    rows = V.interactions(spark, sf)
    both = splits.union_phases({"a": rows.where("split = 'train'"), "b": rows.where("split <> 'train'")}, "phase")
    return both.groupBy("phase").agg(F.count("*").alias("n"))


@query("select id, label from v_predictions")
def attach_labels(spark, sf):
    """Samples with their labels, ids checked."""
    rows = V.interactions(spark, sf)
    return splits.attach_labels(rows.select("id"), rows.select("id", "label"))


@query("""select r.row_seq, case when e.header is not null then e.header when i.n = 1 then i.header when o.n = 1 then o.header end as header, case when e.header is not null then 1 when i.n = 1 then 2 when o.n = 1 then 3 else 0 end as step
from (select distinct case when row_id % 3 = 0 then mirna when row_id % 3 = 1 then mirna || 'AC' else substr(mirna, 1, length(mirna) - 2) end as row_seq from v_interactions) r
left join (select seq, max_by(mature_id || '_5p', mature_key) as header from v_catalogue group by seq) e on e.seq = r.row_seq
left join (select row_seq, count(distinct header) as n, min(header) as header from (select r.row_seq, c.header, rank() over (partition by r.row_seq order by length(r.row_seq) - length(c.seq)) as k from (select distinct case when row_id % 3 = 0 then mirna when row_id % 3 = 1 then mirna || 'AC' else substr(mirna, 1, length(mirna) - 2) end as row_seq from v_interactions) r join (select seq, max_by(mature_id || '_5p', mature_key) as header from v_catalogue group by seq) c on contains(r.row_seq, c.seq)) where k = 1 group by row_seq) i using (row_seq)
left join (select row_seq, count(distinct header) as n, min(header) as header from (select r.row_seq, c.header, rank() over (partition by r.row_seq order by length(c.seq) - length(r.row_seq)) as k from (select distinct case when row_id % 3 = 0 then mirna when row_id % 3 = 1 then mirna || 'AC' else substr(mirna, 1, length(mirna) - 2) end as row_seq from v_interactions) r join (select seq, max_by(mature_id || '_5p', mature_key) as header from v_catalogue group by seq) c on contains(c.seq, r.row_seq)) where k = 1 group by row_seq) o using (row_seq)""")
def match_sequences(spark, sf):
    """Exact and containment matches of distinct row sequences."""
    r, m = F.col("row_id"), F.col("mirna")
    rows = V.interactions(spark, sf).select(F.when(r % 3 == 0, m).when(r % 3 == 1, F.concat(m, F.lit("AC"))).otherwise(F.substring(m, F.lit(1), F.length(m) - 2)).alias("seq"))
    table = V.catalogue(spark, sf).select(F.concat("mature_id", F.lit("_5p")).alias("header"), "seq", F.col("mature_key").alias("input_pos"))
    return annotation.match_sequences(rows, table).select("row_seq", "header", "step")


@query("""select count(*) as total, count(*) as kept, 0 as dropped, count(distinct mature_id) as n_mature, count(distinct family) as n_family
  from v_interactions join (select mature_id, family from v_catalogue) using (mature_id)""")
def annotation_stats(spark, sf):
    """Rows annotated with the catalogue, with families, and counted."""
    table = V.catalogue(spark, sf)
    records = table.select(F.col("mature_id").alias("header"), "seq", F.col("mature_key").alias("input_pos"))
    rows = annotation.annotate_mature(V.interactions(spark, sf), records)
    rows = annotation.attach_family(rows.drop("family"), table.where("mature_key < 97").select(F.col("mature_id").alias("reference_id"), "family"))
    stats = annotation.annotation_stats(rows).select("total", "kept", "dropped")
    return stats.join(F.broadcast(annotation.annotation_distincts(rows).select("n_mature", "n_family")))


@query("""select s_suppkey, 'Hsa-' || s_suppkey || '-v2' as mature_id, 'Hsa-' || s_suppkey as reference_id, 'Supplier ' || s_suppkey as common_name,
  'Genus s' || s_suppkey as scientific_name, 'Hsa-' || s_suppkey as stripped
  from (select cast(s_suppkey as varchar) as s_suppkey from supplier)""")
def parse_names(spark, sf):
    """Mature ids, species names and record endings."""
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit(" Hsa-"), k, F.lit("-v2_5p* ; other"))
    both = names.parse_species_name(F.concat(F.lit("Supplier "), k, F.lit(" (Genus s"), k, F.lit(")")))
    return V.table(spark, sf, "supplier").select(
        k.alias("s_suppkey"), names.parse_mature_id(name).alias("mature_id"), names.parse_reference_id(name).alias("reference_id"), both["common_name"].alias("common_name"), both["scientific_name"].alias("scientific_name"),
        names.strip_pri_pre(F.concat(F.lit("Hsa-"), k, F.lit("_pri"))).alias("stripped"),
    )


@query("select mature_id as name, case when mature_key % 3 = 0 then mature_id || '-pri' when mature_key % 3 = 1 then lower(mature_id) end as record from v_catalogue where mature_key % 3 < 2")
def resolve_sequence_names(spark, sf):
    """The first stored form of each name."""
    table = V.catalogue(spark, sf)
    k = F.col("mature_key") % 3
    records = table.where(k < 2).select(F.when(k == 0, F.concat("mature_id", F.lit("-pri"))).otherwise(F.lower("mature_id")).alias("header"))
    return annotation.resolve_sequence_names(table.select(F.col("mature_id").alias("name")), records, "pri")


@query("""select mature_id as header, repeat('.', 3) || repeat('A', length(seq)) || '..' as anchors, '...' || substr('123456789abcdefghijklmnopqrstuvwxyz',
    1, length(seq)) || '..' as ids, 3 as start_5p from v_catalogue""")
def anchor_strings(spark, sf):
    """Arms found in precursors and marked."""
    table = V.catalogue(spark, sf)
    precursors = table.select(F.concat(F.lit("Hsa-"), "mature_id", F.lit("_pre")).alias("header"), F.concat(F.lit("NNN"), "seq", F.lit("NN")).alias("seq"))
    mature = table.select(F.lit("Hsa").alias("species"), F.col("mature_id").alias("precursor_id"), F.lit("5p").alias("arm"), "seq")
    found = annotation.anchor_strings(annotation.locate_mature_arms(precursors, mature))
    return found.select(F.col("precursor_id").alias("header"), "anchors", "ids", "start_5p")


@query("""select query_id, seq_id, string_agg(c, '' order by i) as aligned from (select a.query_id, a.seq_id, k.i, substr(a.aligned, k.i,
      1) as c from v_alignments a join (select query_id, site as i from v_msa
      where leaf = 16 and nt <> '-') k using (query_id)) group by query_id, seq_id""")
def drop_query_gap_columns(spark, sf):
    """Columns in which the query has a gap are left out."""
    rows = V.alignments(spark, sf)
    own = rows.where("input_pos = 16").select("query_id", "seq_id")
    return alignment.drop_query_gap_columns(rows, own).select("query_id", "seq_id", "aligned")


@query("""select query_id, case when p = 1 then code else code || '-' || p end as seq_id, input_pos
  from (select query_id, input_pos, substr(seq_id, 1, 3) as code, row_number() over (partition by query_id, substr(seq_id, 1, 3)
      order by input_pos) as p from v_alignments)""")
def rename_by_species(spark, sf):
    """Species codes, paralogs numbered."""
    return alignment.rename_by_species(V.alignments(spark, sf)).select("query_id", "seq_id", "input_pos")


@query("select query_id, code as seq_id, repeat('-', 20) as aligned from (select distinct query_id from v_alignments) cross join (values ('Sp7'), ('Sp8')) c(code)")
def add_missing_species(spark, sf):
    """Gap rows of tree species that an alignment lacks."""
    rows = V.alignments(spark, sf)
    codes = rows.select("query_id").distinct().select("query_id", F.explode(F.array(*map(F.lit, ("Sp0", "Sp7", "Sp8")))).alias("code"))
    return alignment.add_missing_species(rows, codes).where("aligned not rlike '[A-Z]'").where("seq_id in ('Sp7', 'Sp8')").select("query_id", "seq_id", "aligned")


@query("select query_id, seq_id, translate(aligned, '-ACGT', '01111') as binary from v_alignments")
def binarize_alignment(spark, sf):
    """Binary alignments of those with enough sequences, as all of these have."""
    rows = alignment.filter_min_sequences(V.alignments(spark, sf), 10)
    return alignment.filter_gap_only(rows).select("query_id", "seq_id", alignment.binarize_alignment(F.col("aligned")).alias("binary"))


CONSENSUS = "select query_id, site - 1 as site, nt as consensus from (select query_id, site, nt, row_number() over (partition by query_id, site order by count(*) desc, min(leaf)) as k from v_msa group by query_id, site, nt) where k = 1"


@query(CONSENSUS)
def column_consensus(spark, sf):
    """The most frequent letter of each column."""
    return alignment.column_consensus(V.alignments(spark, sf))


@query(f"select m.query_id, 'Sp' || (m.leaf % 5) || '-' || m.leaf as seq_id, count(*) filter (where m.nt <> '-' and m.nt <> c.consensus) as n_differences from v_msa m join ({CONSENSUS}) c on c.query_id = m.query_id and c.site = m.site - 1 group by m.query_id, m.leaf")
def consensus_differences(spark, sf):
    """Letters that differ from the consensus."""
    rows = V.alignments(spark, sf)
    return alignment.consensus_differences(rows, alignment.column_consensus(rows))


@query("select query_id, seq_id, length(aligned) - length(replace(aligned, '-', '')) as n_gaps, list_transform(range(1, 21), lambda i: substr(aligned, i, 1) = '-') as dots from v_alignments")
def project_structure(spark, sf):
    """A structure laid on gapped columns."""
    placed = alignment.project_structure(F.col("aligned"), F.lit("((((((((((((((((((((")).alias("s")
    rows = V.alignments(spark, sf).select("query_id", "seq_id", "aligned", placed)
    return rows.select("query_id", "seq_id", F.length(F.regexp_replace("s", r"\(", "")).cast("bigint").alias("n_gaps"), F.transform(F.split("s", ""), lambda c: c == ".").alias("dots"))


@query("select mature_id, 3 as first_core, length(seq) + 3 as first_after from v_catalogue")
def region_boundaries(spark, sf):
    """Steps between flanks and the marked region."""
    anchors = F.concat(F.lit("..."), F.lit("A"), F.repeat(F.lit("."), F.length("seq") - 2), F.lit("B.."))
    edges = alignment.region_boundaries(alignment.flanking_mask(anchors))
    return V.catalogue(spark, sf).select("mature_id", edges[0].cast("bigint").alias("first_core"), edges[1].cast("bigint").alias("first_after"))


@query("select query_id, site, count(*) filter (where m.nt = q.nt) as n_same from v_msa m join (select query_id, site, nt from v_msa where leaf = 16) q using (query_id, site) group by query_id, site")
def query_nt_count(spark, sf):
    """Leaves with the query's letter."""
    return tolerance.query_nt_count(V.msa(spark, sf), V.LEAF)


@query("select s.query_id, s.node, s.site, p_a * (1 - p_0) as p_a, p_c * (1 - p_0) as p_c, p_g * (1 - p_0) as p_g, p_t * (1 - p_0) as p_t from v_states s")
def gap_aware_posterior(spark, sf):
    """Base probabilities times that of no gap."""
    rows = V.states(spark, sf)
    return tolerance.gap_aware_posterior(rows.drop("p_0"), rows.select("query_id", "node", "site", "p_0"))


# In these trees node n has parent n // 2 and the query leaf is 16.
DISTANCE_VIEWS = """up(query_id, node, top, d, h) as (
  select query_id, node, node, 0.0e0, 0 from v_tree
  union all select u.query_id, u.node, t.parent, u.d + t.branch_length, u.h + 1 from up u join v_tree t on t.query_id = u.query_id and t.node = u.top where t.parent is not null),
dist as (select a.query_id, a.node, min_by(a.d + b.d, a.h + b.h) as distance, min(a.h + b.h) as links from up a join (select * from up where node = 16) b on a.query_id = b.query_id and a.top = b.top group by a.query_id, a.node),
walked as (select d.query_id, d.node, t.is_leaf, t.is_query, d.distance, case when t.is_leaf = 1 and t.is_query = 0 then d.links - 1 else d.links end as hops from dist d join v_tree t on t.query_id = d.query_id and t.node = d.node)"""


def tree_query(body: str, more: str = ""):
    """Registers a query whose SQL walks the trees from their query leaf; ``more`` are further views after the walk."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ending = DISTANCE_VIEWS + more + " " + body
        tables = V.with_views(ending)[: -len(ending)]
        ORACLES[f.__name__] = tables.replace("with ", "with recursive ", 1).rstrip() + ", " + ending
        return f

    return keep


@tree_query("select query_id, node, is_leaf, is_query, distance, hops from walked")
def leaf_distances(spark, sf):
    """Path lengths and hops from the query leaf."""
    return tolerance.leaf_distances(V.trees(spark, sf))


@tree_query("""select t.query_id, case when p.distance >= c.distance then t.parent else t.node end as far, case when p.distance >= c.distance
  then t.node else t.parent end as near from v_tree t join walked c on c.query_id = t.query_id and c.node = t.node
  join walked p on p.query_id = t.query_id and p.node = t.parent where t.is_leaf = 0""")
def orient_edges(spark, sf):
    """Far and near ends of internal edges."""
    rows = V.trees(spark, sf)
    return tolerance.orient_edges(rows, splits.written(tolerance.leaf_distances(rows)))


@tree_query("""select query_id, node, round(1 / (distance / leaf_min + 1), 9) as w_0, round(case when is_query = 1 then 1 else exp(-distance *
      distance) / 2 end, 9) as w_x, round(exp(-distance * distance / (mu * mu)), 9) as w_mean, round(exp(-distance * hops), 9)
  as w_count4, round((0.1e0 - 1) / most * distance + 1, 9) as w_threshold
  from (select *, min(case when is_leaf = 1 and is_query = 0 then distance end) over (partition by query_id) as leaf_min, avg(distance)
    over (partition by query_id) as mu, max(distance) over (partition by query_id) as most
    from walked)""")
def distance_weights(spark, sf):
    """Weights under five schemes."""
    schemes = {"w_0": ("0", None), "w_x": ("X", None), "w_mean": ("mean", None), "w_count4": ("CountNodes_4", None), "w_threshold": ("MinThreshold", 0.1)}
    weights = {n: tolerance.scheme_weight(p, least) for n, (p, least) in schemes.items()}
    found = tolerance.leaf_distances(V.trees(spark, sf)).select("query_id", "node", *(w.alias(n) for n, w in weights.items()))
    return found.select("query_id", "node", *(F.round(n, 9).alias(n) for n in schemes))


def _tolerance_sql() -> str:
    parts = []
    for b in B:
        pos = f"p_{b}"
        post = lambda s: f"({s}.{pos} * (1 - {s}.p_0))"  # noqa: B023, E731
        parts.append(f"""select m.query_id, m.site, '{b}' as base,
          coalesce((select sum(w.weight * greatest(0, {post('f')} - {post('n')})) from oriented o join weights w on w.query_id = o.query_id and w.node = o.far join v_states f on f.query_id = o.query_id and f.node = o.far and f.site = m.site join v_states n on n.query_id = o.query_id and n.node = o.near and n.site = m.site where o.query_id = m.query_id), 0)
          + case when m.nt = '{b.upper()}' then 0 else (select w.weight * {post('u')} from weights w join v_states u on u.query_id = w.query_id and u.node = 8 and u.site = m.site where w.query_id = m.query_id and w.node = 8) end
          + case when m.nt = '{b.upper()}' then 1.0e0 else 0 end as wol,
          coalesce((select sum(w.weight * greatest(0, 1 - {post('p')})) from v_msa l join weights w on w.query_id = l.query_id and w.node = l.leaf join v_states p on p.query_id = l.query_id and p.node = l.leaf // 2 and p.site = l.site where l.query_id = m.query_id and l.site = m.site and l.leaf <> 16 and l.nt = '{b.upper()}'), 0) as leafy
          from v_msa m where m.leaf = 16""")
    return " union all ".join(parts)


TOLERANCE_VIEWS = f""", weights as (select query_id, node, exp(-distance * distance / (mu * mu)) as weight from (select *, avg(distance) over (partition by query_id) as mu from walked)),
oriented as (select t.query_id, case when p.distance >= c.distance then t.parent else t.node end as far, case when p.distance >= c.distance then t.node else t.parent end as near from v_tree t join walked c on c.query_id = t.query_id and c.node = t.node join walked p on p.query_id = t.query_id and p.node = t.parent where t.is_leaf = 0),
parts as ({_tolerance_sql()})"""
TOLERANCE = "select query_id, site, " + ", ".join(f"round(max(case when base = '{b}' then (wol + leafy) / 31 end), 9) as wl_{b}, round(max(case when base = '{b}' then wol / 15 end), 9) as wol_{b}" for b in B) + " from parts group by query_id, site"


@tree_query(TOLERANCE, TOLERANCE_VIEWS)
def tolerance_scores(spark, sf):
    """Tolerance scores under the mean scheme, by the number of nodes."""
    edges = V.trees(spark, sf)
    rows = V.states(spark, sf)
    posterior = tolerance.gap_aware_posterior(rows.drop("p_0"), rows.select("query_id", "node", "site", "p_0"))
    found = tolerance.tolerance_scores(edges, splits.written(tolerance.leaf_distances(edges)), posterior, V.msa(spark, sf), "mean", "NN")
    return found.select("query_id", "site", *(F.round(c, 9).alias(c) for c in found.columns[2:]))


#: Schemes of the score table's SQL: name, least weight, and the weight of any node but the query leaf and of that leaf.
SCHEMES = (
    ("0", None, "1 / (distance / leaf_min + 1)", "1 / (distance / leaf_min + 1)"),
    ("0_MinNode_Mix", None, "sqrt(1 / (distance / node_min + 1) * exp(-distance * distance / (mu * mu)))", "1.0e0"),
    ("mean", None, "exp(-distance * distance / (mu * mu))", "1.0e0"),
    ("2.5", None, "exp(-distance * distance / 6.25e0)", "1.0e0"),
    ("X", None, "exp(-distance * distance) / 2", "1.0e0"),
    ("CountNodes_4", None, "exp(-distance * hops)", "1.0e0"),
    ("Equal", None, "1.0e0", "1.0e0"),
    ("MinThreshold", 0.1, "(0.1e0 - 1) / most * distance + 1", "1.0e0"),
)
_SCHEME_WEIGHTS = " union all ".join(f"select query_id, node, '{p}' as param, case when is_query = 1 then {q} else {w} end as weight from measured" for p, _, w, q in SCHEMES)
_POST = "{0}.p_{1} * (1 - {0}.p_0)"
_BASE_ROWS = " union all ".join(
    f"select query_id, node, site, '{b.upper()}' as base, p_{b} * (1 - p_0) as p from v_states" for b in B
)
SCORE_VIEWS = f""", measured as (
  select *, avg(distance) over t as mu, max(distance) over t as most, min(case when is_leaf = 1 and is_query = 0 then distance end) over t as leaf_min, min(case when is_leaf = 0 then distance end) over t as node_min
  from walked window t as (partition by query_id)),
weights as ({_SCHEME_WEIGHTS}),
post as ({_BASE_ROWS}),
oriented as (
  select t.query_id, case when p.distance >= c.distance then t.parent else t.node end as far, case when p.distance >= c.distance then t.node else t.parent end as near
  from v_tree t join walked c on c.query_id = t.query_id and c.node = t.node join walked p on p.query_id = t.query_id and p.node = t.parent where t.is_leaf = 0),
own as (select query_id, site, nt, case when nt in ('A', 'C', 'G', 'T') then nt else '-' end as code from v_msa where leaf = 16),
parts as (
  select f.query_id, f.site, f.base, w.param, 0 as leafy, w.weight * greatest(0, f.p - n.p) as s
  from oriented o join weights w on w.query_id = o.query_id and w.node = o.far join post f on f.query_id = o.query_id and f.node = o.far
  join post n on n.query_id = o.query_id and n.node = o.near and n.site = f.site and n.base = f.base
  union all
  select u.query_id, u.site, u.base, w.param, 0, case when m.code = u.base then q.weight else w.weight * u.p end
  from post u join own m using (query_id, site) join weights w on w.query_id = u.query_id and w.node = 8 join weights q on q.query_id = u.query_id and q.node = 16 and q.param = w.param where u.node = 8
  union all
  select l.query_id, l.site, u.base, w.param, 1, case when l.nt = u.base then w.weight * greatest(0, 1 - u.p) else 0 end
  from v_msa l join weights w on w.query_id = l.query_id and w.node = l.leaf join post u on u.query_id = l.query_id and u.node = l.leaf // 2 and u.site = l.site where l.leaf <> 16),
sums as (select query_id, site, base, param, sum(s) as wl, sum(case when leafy = 0 then s else 0 end) as wol from parts group by all),
same as (
  select m.query_id, m.site, count(*) filter (where case when l.nt in ('A', 'C', 'G', 'T') then l.nt else '-' end = m.code)::double as n_same
  from own m join v_msa l using (query_id, site) group by all),
modes as (
  select query_id, site, base, param, unnest(['wl', 'wol']) as leaf_mode, unnest([wl, wol]) as score, unnest([31.0e0, 15.0e0]) as size from sums),
scored as (
  select m.*, unnest(['NN', 'FN', 'raw']) as norm, unnest([floor(v * 1073741824e0 + 0.5e0) / 1073741824e0 for v in [score / size, score / n_same, score]]) as value from modes m join same using (query_id, site))"""


@tree_query("""select query_id, site, param, norm, leaf_mode, max(case when base = 'A' then value end) as "A", max(case when base = 'T' then value end) as "T",
  max(case when base = 'G' then value end) as "G", max(case when base = 'C' then value end) as "C" from scored group by query_id, site, param, norm, leaf_mode""", SCORE_VIEWS)
def score_table(spark, sf):
    """Scores of every site under eight schemes, all norms and both leaf modes in one pass."""
    edges = V.trees(spark, sf)
    rows = V.states(spark, sf)
    posterior = tolerance.gap_aware_posterior(rows.drop("p_0"), rows.select("query_id", "node", "site", "p_0"))
    params = [(p, least) for p, least, _, _ in SCHEMES]
    found = tolerance.score_table(edges, splits.written(tolerance.leaf_distances(edges)), posterior, V.msa(spark, sf), params, range_sites=8)
    return found.select("query_id", "site", "param", "norm", "leaf_mode", *(V.snapped(F.col(x)).alias(x) for x in tolerance.LETTERS))


@query("select cast(c_custkey as varchar) as name, 3 as depth, [cast(c_custkey as varchar)] as relatives from customer")
def closest_relative(spark, sf):
    """Relatives of customers by region, nation and key as a lineage."""
    rows = V.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("name"), F.array(F.concat(F.lit("r"), F.col("c_nationkey") % 5), F.concat(F.lit("n"), F.col("c_nationkey")), F.col("c_custkey").cast("string")).alias("lineage"))
    return species.closest_relative(rows, rows)


@query("select code, case when code % 2 = 0 then 'Genus s' || code end as leaf from (select distinct s_suppkey as code from supplier)")
def match_species_names(spark, sf):
    """Species with three words matched to leaves of two."""
    k = F.col("s_suppkey")
    codes = V.table(spark, sf, "supplier").select(k.alias("code"), F.concat(F.lit("Genus s"), k, F.lit(" sub")).alias("name"))
    leaves = V.table(spark, sf, "supplier").where(k % 2 == 0).select(F.concat(F.lit("Genus s"), k).alias("name"))
    return species.match_species_names(codes, leaves)


@query("select n_nationkey as taxid, r_name as taxon, r_name = 'ASIA' as highlighted from nation join region on r_regionkey = n_regionkey")
def lineage_table(spark, sf):
    """A level of each lineage, and whether it holds one taxon."""
    rows = V.table(spark, sf, "nation").join(F.broadcast(V.table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(F.lit(" root ; "), "r_name", F.lit(";; "), "n_name")
    return species.lineage_table(rows.select(F.col("n_nationkey").alias("taxid"), names.lineage_array(text).alias("lineage")), 1, "ASIA")


@query("select cast(o_custkey as varchar) as chr, o_orderkey - 1 as start, o_orderkey + 50 as \"end\" from orders")
def export_bed(spark, sf):
    """BED rows counted from 0."""
    return writers.bed_rows(V.table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("chr"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 50).alias("end")))


@query("select id, round(length(gene) / 50.0 * 0.5 + label * 0.25, 9) as prediction from v_interactions")
def score_rows(spark, sf):
    """A caller's model over encoded rows."""

    def load():
        return lambda frame: frame["gene"].str.len() / 50 * 0.5 + frame["label"] * 0.25

    rows = scoring.encode_rows(V.interactions(spark, sf).select("id", "gene", "mirna", "label"))
    return scoring.score_rows(rows, load).select("id", F.round("prediction", 9).alias("prediction"))


@query("select row_id, [length(mirna)::double, length(gene)::double] as pooled, length(mirna) * length(gene)::double as product from v_interactions")
def attach_embeddings(spark, sf):
    """Vectors made once for each distinct sequence, joined to both sides."""
    import pandas as pd

    def load():
        return lambda s: pd.Series([[float(len(x))] for x in s])

    rows = V.interactions(spark, sf)
    every = rows.select(F.col("gene").alias("seq")).unionByName(rows.select(F.col("mirna").alias("seq"))).distinct()
    vectors = scoring.embed_unique(every, "seq", load)
    joined = features.attach_embeddings(rows.select("row_id", "mirna", "gene"), vectors, "mirna", "gene")
    return joined.select("row_id", F.slice("embedding", 1, 2).alias("pooled"), F.get("embedding", F.lit(3)).alias("product"))


def _link_pages(spark, sf) -> DataFrame:
    """A page a supplier with one table of orthologue links and one of species links."""
    k = F.col("s_suppkey").cast("string")
    code = F.substring(F.translate(F.md5(k), "0123456789", "ghijklmnop"), 1, 3)
    orthologues = F.concat(F.lit("<table><tr><th>Family</th><td><a>none</a></td></tr><tr><th>Orthologues</th><td><a href='#'> Mmu-"), k, F.lit("</a>, <a>Rno-"), k, F.lit("</a></td></tr></table>"))
    links = F.concat(F.lit("<table><tr><td>[x]</td><td>Name "), k, F.lit(" (Genus s)</td><td><a href='/fasta/"), code, F.lit("?pre=1'>Download</a></td></tr></table>"))
    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("page_id"), F.concat(orthologues, links).alias("html"))


@query("select cast(s_suppkey as bigint) as page_id, unnest(['Mmu-' || s_suppkey, 'Rno-' || s_suppkey]) as orthologue from supplier")
def extract_orthologue_links(spark, sf):
    """Orthologues named on stored pages."""
    return readers.extract_orthologue_links(_link_pages(spark, sf))


@query("""select cast(s_suppkey as bigint) as page_id, substr(translate(md5(cast(s_suppkey as varchar)), '0123456789', 'ghijklmnop'), 1,
    3) as code, 'Name ' || s_suppkey || ' (Genus s)' as species from supplier""")
def extract_species_links(spark, sf):
    """Species codes and names on stored pages."""
    return readers.extract_species_links(_link_pages(spark, sf))


@query("select query_id, count(*) as n_nodes, count(*) filter (where is_leaf = 1) as n_leaves, 29 as n_inner_sum from (select query_id, is_leaf from v_tree where node <> 1) group by query_id")
def unroot_trees(spark, sf):
    """Trees without their two-child root; the first inner child takes its place."""
    rows = V.trees(spark, sf).select(F.col("query_id").cast("string").alias("query_id"), "node", "parent", "branch_length", F.concat(F.lit("n"), "node").alias("label"), "is_leaf")
    found = readers.change_trees(rows, unroot=True)
    return found.groupBy(F.col("query_id").cast("bigint").alias("query_id")).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("is_leaf") == 1).alias("n_leaves"), F.count_if(F.col("parent").isNotNull()).alias("n_inner_sum"))


@query("select query_id, 7 as n_nodes, 4 as n_leaves, sum(branch_length) as total from v_tree where node in (16, 17, 8, 9, 18, 19, 4, 2) and node not in (4, 2) group by query_id")
def prune_trees(spark, sf):
    """Trees pruned to four leaves of one clade; nodes left with one child are merged."""
    rows = V.trees(spark, sf).select(F.col("query_id").cast("string").alias("query_id"), "node", "parent", "branch_length", F.concat(F.lit("n"), "node").alias("label"), "is_leaf")
    taxa = rows.where("node between 16 and 19").select("query_id", F.col("label").alias("seq_id"))
    found = readers.change_trees(rows, taxa)
    return found.groupBy(F.col("query_id").cast("bigint").alias("query_id")).agg(F.count("*").alias("n_nodes"), F.count_if(F.col("is_leaf") == 1).alias("n_leaves"), F.sum("branch_length").alias("total"))


@query("select id, count(*) as n_positions, count(x) as n_scores from (select cast(row_id as varchar) as id, score_a as x from v_target_positions) group by id")
def split_to_normalised(spark, sf):
    """Target positions of an array table taken apart."""
    target = positions.position_arrays(V.target_positions(spark, sf, by_row=True), ["row_id"], "pos", {"target_scores": F.col("score_a")}, 50)
    rows = V.interactions(spark, sf).join(target, "row_id").withColumn("mirna_scores", F.array(F.lit(0.5)))
    long = writers.split_to_normalised(rows)["target_positions"]
    return long.groupBy("id").agg(F.count("*").alias("n_positions"), F.count("s").alias("n_scores"))
