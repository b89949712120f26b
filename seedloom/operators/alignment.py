"""Multiple alignments as ``query_id, seq_id, aligned, input_pos`` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.arrays import once


def filter_gap_only(msa: DataFrame) -> DataFrame:
    """``*`` as gaps; sequences of gaps and N alone, empty ones too, are left out."""
    clean = msa.withColumn("aligned", F.replace("aligned", F.lit("*"), F.lit("-")))
    return clean.where(~F.col("aligned").rlike("^[-Nn]*$"))


def alignment_sequence_count(msa: DataFrame) -> DataFrame:
    """Distinct names of each alignment, annotation lines that start with # left out."""
    return msa.where(~F.col("seq_id").startswith("#")).groupBy("query_id").agg(F.count_distinct("seq_id").alias("n_sequences"))


def filter_min_sequences(msa: DataFrame, least: int) -> DataFrame:
    """Alignments of at least ``least`` distinct names, without annotation lines."""
    enough = alignment_sequence_count(msa).where(F.col("n_sequences") >= least).select("query_id")
    return msa.where(~F.col("seq_id").startswith("#")).join(enough, "query_id", "left_semi")


def drop_query_gap_columns(msa: DataFrame, queries: DataFrame) -> DataFrame:
    """Alignments without the columns in which their query has a gap; ``queries`` has ``query_id, seq_id``."""
    own = msa.join(queries, ["query_id", "seq_id"], "left_semi")
    kept = own.select("query_id", F.filter(F.transform(F.split("aligned", ""), lambda c, i: F.when(c != "-", i + 1)), lambda x: x.isNotNull()).alias("_keep"))
    joined = msa.join(kept, "query_id")
    return joined.withColumn("aligned", F.array_join(F.transform("_keep", lambda i: F.substring("aligned", i, F.lit(1))), "")).drop("_keep")


def rename_by_species(msa: DataFrame) -> DataFrame:
    """Names as species codes, the first three characters; later paralogs become ``code-2``, ``code-3`` in input order."""
    code = F.substring("seq_id", 1, 3)
    place = F.row_number().over(Window.partitionBy("query_id", code).orderBy("input_pos"))
    return msa.withColumn("_place", place).withColumn("seq_id", F.when(F.col("_place") == 1, code).otherwise(F.concat(code, F.lit("-"), F.col("_place")))).drop("_place")


def add_missing_species(msa: DataFrame, species: DataFrame) -> DataFrame:
    """Alignments with a row of gaps for each tree species they lack, in code order after the others; ``species`` has ``query_id, code``."""
    have = msa.select("query_id", F.element_at(F.split("seq_id", "-"), 1).alias("code")).distinct()
    shape = msa.groupBy("query_id").agg(F.max(F.length("aligned")).alias("_n"), F.max("input_pos").alias("_last"))
    absent = species.select("query_id", "code").distinct().join(have, ["query_id", "code"], "left_anti").join(shape, "query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("code"))
    rows = absent.select("query_id", F.col("code").alias("seq_id"), F.repeat(F.lit("-"), F.col("_n")).alias("aligned"), (F.col("_last") + place).alias("input_pos"))
    return msa.select("query_id", "seq_id", "aligned", "input_pos").unionByName(rows)


def common_taxa(msa: DataFrame, taxa: DataFrame) -> DataFrame:
    """``query_id, seq_id`` that both an alignment and its tree have."""
    return msa.select("query_id", "seq_id").intersect(taxa.select("query_id", "seq_id"))


def binarize_alignment(aligned: Column) -> Column:
    """Gaps as 0, A, C, G and T of either case as 1, others as gaps."""
    return F.translate(F.regexp_replace(F.translate(aligned, "-", "0"), "[^0ACGTacgt]", "-"), "ACGTacgt", "11111111")


def column_consensus(msa: DataFrame) -> DataFrame:
    """``query_id, site, consensus``: the most frequent of A, T, C, G, U and gap; of equals the one seen first; a gap without any."""
    sites = msa.select("query_id", "input_pos", F.posexplode(F.split("aligned", "")).alias("site", "nt"))
    live = F.col("nt").rlike("^[ATCGU-]$")
    counts = sites.groupBy("query_id", "site", "nt").agg(F.count("*").alias("n"), F.min("input_pos").alias("first"))
    best = F.max_by(F.when(live, F.col("nt")), F.when(live, F.struct("n", -F.col("first"))))
    return counts.groupBy("query_id", "site").agg(F.coalesce(best, F.lit("-")).alias("consensus"))


def project_structure(aligned: Column, structure: Column) -> Column:
    """Structure characters of an ungapped sequence laid on its gapped columns; a dot on gaps and beyond the structure."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(a: Column, c: Column) -> Column:
        own = F.when((c == "-") | (a["at"] >= F.length(structure)), ".").otherwise(F.substring(structure, a["at"] + 1, F.lit(1)))
        return F.struct((a["at"] + (c != "-").cast("int")).alias("at"), F.concat(a["text"], own).alias("text"))

    return F.aggregate(F.split(aligned, ""), start, step, lambda a: a["text"])


def flanking_mask(anchors: Column) -> Column:
    """True before the first A and after the last B; null if either is absent."""

    def mask(text: Column) -> Column:
        ends = F.struct(F.instr(text, "A").alias("first"), (F.length(text) - F.instr(F.reverse(text), "B") + 1).alias("last"), F.instr(text, "B").alias("b"))
        return once(ends, lambda e: F.when((e["first"] > 0) & (e["b"] > 0), F.transform(F.split(text, ""), lambda c, i: (i + 1 < e["first"]) | (i + 1 > e["last"]))))

    return once(anchors, mask)


def region_boundaries(mask: Column) -> Column:
    """Places, from 0, of the first step out of the flank and the last step into it."""

    def edges(m: Column) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.size(m) - 1, F.lit(1)))
        leaving = F.filter(places, lambda i: F.get(m, i - 1) & ~F.get(m, i))
        entering = F.filter(places, lambda i: ~F.get(m, i - 1) & F.get(m, i))
        return F.array_compact(F.array(F.get(leaving, F.lit(0)), F.try_element_at(entering, F.lit(-1))))

    return once(mask, edges)


def consensus_differences(msa: DataFrame, consensus: DataFrame) -> DataFrame:
    """Per sequence: sites whose letter, not a gap, differs from the consensus."""
    sites = msa.select("query_id", "seq_id", F.posexplode(F.split("aligned", "")).alias("site", "nt"))
    joined = sites.join(consensus, ["query_id", "site"])
    return joined.groupBy("query_id", "seq_id").agg(F.count_if((F.col("nt") != "-") & (F.upper("nt") != F.upper("consensus"))).alias("n_differences"))
