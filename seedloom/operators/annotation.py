"""Mature sequence annotation, families, orthologues and marked precursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.functions.names import parse_mature_id, parse_reference_id, strip_pri_pre
from seedloom.operators.joins import by_key, if_small
from seedloom.operators.splits import written

# Digits from 1, then the characters from "a" on.
ID_CHARACTERS = "".join(map(chr, [*range(ord("1"), ord("9") + 1), *range(ord("a"), ord("~") + 1)]))


def last_wins(catalogue: DataFrame) -> DataFrame:
    """One header a sequence: of repeated sequences the last by ``input_pos``; empty ones are left out."""
    return catalogue.where(F.length("seq") > 0).groupBy("seq").agg(F.max_by("header", "input_pos").alias("header"), F.min("input_pos").alias("first_pos"))


def _inside(short: DataFrame, short_col: str, long: DataFrame, long_col: str) -> DataFrame:
    """Pairs of rows of ``short`` and ``long`` where the first one's sequence is part of the other's, by equal substrings.

    Only substrings of lengths that ``short`` has are made; these lengths reach the driver. ``short`` is sent to all machines if a count shows that it is
    small, so that only substrings that are one of its sequences are exchanged; the many substrings never are.
    """
    lengths = [r[0] for r in short.select(F.length(short_col)).distinct().collect()]
    parts = long.withColumn("part_size", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))).where(F.col("part_size") <= F.length(long_col))
    parts = parts.withColumn("at", F.explode(F.sequence(F.lit(1), F.length(long_col) - F.col("part_size") + 1)))
    parts = parts.withColumn("part", F.col(long_col).substr(F.col("at"), F.col("part_size"))).drop("at", "part_size")
    return parts.join(if_small(short), F.col("part") == F.col(short_col)).drop("part").distinct()


def _step(matches: DataFrame, unmatched: Column, name: str) -> DataFrame:
    """Matches of least unmatched length by row sequence, one header for each text before its first underscore."""
    matches = matches.select("row_seq", "header", "first_pos", unmatched.alias("unmatched"))
    best = matches.withColumn("least", F.min("unmatched").over(Window.partitionBy("row_seq"))).where("unmatched = least")
    best = best.withColumn("prefix", F.element_at(F.split("header", "_"), 1))
    return best.groupBy("row_seq").agg(F.count_distinct("prefix").alias(f"{name}_n"), F.min_by("header", "first_pos").alias(f"{name}_header"))


def match_sequences(sequences: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``row_seq, header, step, n_ambiguous`` of distinct row sequences.

    Step 1 is an exact match; 2 takes catalogue sequences inside the row's, 3 those around
    it, fewest unmatched bases first. More than one prefix among the best is ambiguous: the
    step has no match and the next still runs. ``step`` 0 is no match. Containment is found by
    an equal join on substrings, so work grows with the sequences and not with their pairs.
    """
    table = last_wins(catalogue)
    rows = sequences.select(F.trim("seq").alias("row_seq")).where("row_seq is not null").distinct()
    exact = written(rows.join(by_key(table.select(F.col("seq").alias("row_seq"), F.col("header").alias("exact_header"))), "row_seq", "left"))
    left = exact.where("exact_header is null").select("row_seq")
    inner = _step(_inside(table, "seq", left, "row_seq"), F.length("row_seq") - F.length("seq"), "inner")
    outer = _step(_inside(left, "row_seq", table, "seq"), F.length("seq") - F.length("row_seq"), "outer")
    joined = exact.join(by_key(inner), "row_seq", "left").join(by_key(outer), "row_seq", "left")
    one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    step = F.when(F.col("exact_header").isNotNull(), 1).when(one("inner_n"), 2).when(one("outer_n"), 3).otherwise(0)
    header = F.when(F.col("exact_header").isNotNull(), F.col("exact_header")).when(one("inner_n"), F.col("inner_header")).when(one("outer_n"), F.col("outer_header"))
    many = lambda c: F.coalesce(F.col(c) > 1, F.lit(False)).cast("int")
    ambiguous = F.when(F.col("exact_header").isNull(), many("inner_n") + F.when(~one("inner_n"), many("outer_n")).otherwise(0)).otherwise(0)
    return joined.select("row_seq", header.alias("header"), step.alias("step"), ambiguous.alias("n_ambiguous"))


def annotate_mature(rows: DataFrame, catalogue: DataFrame, sequence: str = "mirna") -> DataFrame:
    """All rows with ``mature_name``, ``reference_id``, ``step`` and ``n_ambiguous``; the mapping is of distinct sequences, joined back."""
    found = match_sequences(rows.select(F.col(sequence).alias("seq")), catalogue)
    joined = rows.join(found, F.trim(F.col(sequence)) == F.col("row_seq"), "left").drop("row_seq")
    return joined.select(*rows.columns, F.col("header").alias("mature_name"), parse_reference_id(F.col("header")).alias("reference_id"), F.coalesce("step", F.lit(0)).alias("step"), F.coalesce("n_ambiguous", F.lit(0)).alias("n_ambiguous"))


def annotation_stats(annotated: DataFrame) -> DataFrame:
    """Rows in all, kept, dropped, and ambiguous steps; ambiguous rows count as dropped too."""
    return annotated.agg(
        F.count("*").alias("total"), F.count_if(F.col("step") > 0).alias("kept"), F.count_if(F.col("step") == 0).alias("dropped"),
        F.coalesce(F.sum("n_ambiguous"), F.lit(0)).alias("multiple"), F.coalesce(F.sum("n_ambiguous"), F.lit(0)).alias("dropped_multiple"),
    )


def annotation_distincts(annotated: DataFrame) -> DataFrame:
    """Distinct mature names, precursors and families, and rows mapped to a family."""
    return annotated.agg(
        F.count_distinct("mature_name").alias("n_mature"), F.count_distinct("reference_id").alias("n_precursor"), F.count_distinct("family").alias("n_family"), F.count("family").alias("n_mapped"),
    )


def attach_family(rows: DataFrame, families: DataFrame, key: str = "reference_id") -> DataFrame:
    """Rows with the family of their precursor; unknown ids have none. ``families`` has one row an id; beyond a counted bound they are joined by shuffle."""
    return rows.join(if_small(families), key, "left")


def dedupe_by_prefix(headers: DataFrame, header: str = "header", order: str = "input_pos") -> DataFrame:
    """The first header for each text before its first underscore."""
    prefix = F.element_at(F.split(header, "_"), 1)
    return headers.groupBy(prefix.alias("prefix")).agg(F.min_by(header, order).alias(header))


def first_arm_wins(mature: DataFrame) -> DataFrame:
    """The first sequence of each species, precursor and arm by input order."""
    return mature.groupBy("species", "precursor_id", "arm").agg(F.min_by("seq", "input_pos").alias("seq"))


def name_forms(name: Column, kind: str) -> Column:
    """Forms under which a record of a name may be stored, in the order they are tried."""
    dashed = F.concat(F.replace(name, F.lit("-"), F.lit("_")), F.lit(f"_{kind}"))
    return F.array(name, *(F.concat(name, F.lit(f"{mark}{kind}")) for mark in "_-."), dashed, F.lower(name), F.upper(name))


def resolve_sequence_names(ids: DataFrame, records: DataFrame, kind: str) -> DataFrame:
    """``name, record`` for each distinct id: the first of its forms that is a record's header."""
    forms = ids.select("name").distinct().select("name", F.posexplode(name_forms(F.col("name"), kind)).alias("place", "form"))
    found = forms.join(by_key(records.select(F.col("header").alias("form")).distinct()), "form")
    return found.groupBy("name").agg(F.min_by("form", "place").alias("record"))


def collect_orthologues(main: DataFrame, links: DataFrame, pri: DataFrame, pre: DataFrame) -> DataFrame:
    """``query, header, seq``: primary records of a name and its linked orthologues, precursor records where there is no primary.

    Headers that end in ``_pri`` are renamed to ``_pre``.
    """
    names = main.select(F.col("name").alias("query"), "name").unionByName(links.select(F.col("name").alias("query"), F.col("orthologue").alias("name"))).distinct()
    by_pri = names.join(by_key(resolve_sequence_names(names, pri, "pri")), "name").join(by_key(pri.withColumnRenamed("header", "record")), "record")
    rest = names.join(by_key(by_pri.select("query", "name")), ["query", "name"], "left_anti")
    by_pre = rest.join(by_key(resolve_sequence_names(rest, pre, "pre")), "name").join(by_key(pre.withColumnRenamed("header", "record")), "record")
    both = by_pri.select("query", "record", "seq").unionByName(by_pre.select("query", "record", "seq"))
    return both.select("query", F.regexp_replace("record", "_pri$", "_pre").alias("header"), "seq")


def locate_mature_arms(precursors: DataFrame, mature: DataFrame) -> DataFrame:
    """Precursors with the 0-based start of each arm, -1 if it isn't found and null without an arm.

    The 3p arm is looked for behind the 5p arm first: one that is its own reverse complement, or overlaps with it, would else be found in the other's place.
    ``precursors`` has ``header, seq``; the species is what stands before the first dash.
    """
    keyed = precursors.select("header", "seq", F.element_at(F.split("header", "-", 2), 1).alias("species"), strip_pri_pre(F.element_at(F.split(F.try_element_at(F.split("header", "-", 2), F.lit(2)), r"\s"), 1)).alias("precursor_id"))
    arms = mature.groupBy("species", "precursor_id").agg(F.max(F.when(F.col("arm") == "5p", F.col("seq"))).alias("seq_5p"), F.max(F.when(F.col("arm") == "3p", F.col("seq"))).alias("seq_3p"))
    joined = keyed.join(by_key(arms), ["species", "precursor_id"], "left")
    first = joined.withColumn("start_5p", F.expr("instr(seq, seq_5p) - 1"))
    behind = F.expr("locate(seq_3p, seq, start_5p + length(seq_5p) + 1) - 1")
    return first.withColumn("start_3p", F.when((F.col("start_5p") >= 0) & (behind >= 0), behind).otherwise(F.expr("instr(seq, seq_3p) - 1")))


def anchor_strings(located: DataFrame) -> DataFrame:
    """Adds ``anchors`` with A over the 5p and B over the 3p arm, and ``ids`` counting 1..9, a.. inside each arm; a later arm overwrites."""
    def lay(base: Column, start: Column, piece: Column) -> Column:
        return F.when(start >= 0, F.overlay(base, piece, start + 1)).otherwise(base)

    n5, n3 = F.length("seq_5p"), F.length("seq_3p")
    dots = F.expr("repeat('.', length(seq))")
    anchors = lay(lay(dots, F.coalesce("start_5p", F.lit(-1)), F.repeat(F.lit("A"), n5)), F.coalesce("start_3p", F.lit(-1)), F.repeat(F.lit("B"), n3))
    counted = lambda n: F.substring(F.lit(ID_CHARACTERS), F.lit(1), n)
    ids = lay(lay(dots, F.coalesce("start_5p", F.lit(-1)), counted(n5)), F.coalesce("start_3p", F.lit(-1)), counted(n3))
    return located.withColumn("anchors", anchors).withColumn("ids", ids)


def mature_ids(rows: DataFrame, name: str) -> DataFrame:
    """Adds the mature and the reference id of a name column."""
    return rows.withColumn("mature_id", parse_mature_id(F.col(name))).withColumn("reference_id", parse_reference_id(F.col(name)))
