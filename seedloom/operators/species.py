"""Species names, lineages and their nearest relatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.operators.joins import if_small


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common beginning of two arrays."""
    same = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"] == p["y"])
    return F.coalesce(F.nullif(F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)), F.lit(0)) - 1, F.least(F.size(a), F.size(b)).cast("bigint"))


def _prefixes(df: DataFrame) -> DataFrame:
    """Each name at every beginning of its lineage, the empty one of depth 0 too."""
    depths = F.sequence(F.lit(0), F.coalesce(F.size("lineage"), F.lit(0)))
    forms = df.select("name", "lineage", F.explode(depths).alias("depth"))
    return forms.select("name", "depth", F.array_join(F.slice("lineage", F.lit(1), F.col("depth")), ";").alias("prefix")).withColumn("prefix", F.coalesce("prefix", F.lit("")))


def best_match_listing(missing: DataFrame, present: DataFrame, k: int = 3) -> DataFrame:
    """``name, depth, shown, n_tied``: the first ``k`` present species, names descending, of the longest common lineage, and how many share it.

    Both have ``name, lineage`` arrays. Only counts and ``k`` names of a clade are gathered, and only of clades that are
    some species' deepest; without any common taxon all present species tie at depth 0. Repeated names count once, a null lineage is empty.
    """
    have = _prefixes(present).distinct()
    shared = have.select("depth", "prefix").distinct()
    deepest = _prefixes(missing).join(shared, ["depth", "prefix"], "left_semi").groupBy("name").agg(F.max("depth").alias("depth"), F.max_by("prefix", "depth").alias("prefix"))
    members = have.join(deepest.select("depth", "prefix").distinct(), ["depth", "prefix"], "left_semi")
    counts = members.groupBy("depth", "prefix").agg(F.count("*").alias("n_tied"))
    # Spark keeps k rows a clade before the exchange.
    first = members.withColumn("place", F.row_number().over(Window.partitionBy("depth", "prefix").orderBy(F.desc("name")))).where(F.col("place") <= k)
    shown = first.groupBy("depth", "prefix").agg(F.sort_array(F.collect_list("name"), asc=False).alias("shown"))
    found = deepest.join(counts.join(shown, ["depth", "prefix"]), ["depth", "prefix"])
    every = missing.select("name").distinct().join(found, "name", "left")
    return every.select("name", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("shown", F.array().cast("array<string>")).alias("shown"), F.coalesce("n_tied", F.lit(0)).alias("n_tied"))


def closest_relative(missing: DataFrame, present: DataFrame, k: int = 3) -> DataFrame:
    """``name, depth, relatives``: the first ``k`` relatives of :func:`best_match_listing`."""
    return best_match_listing(missing, present, k).select("name", "depth", F.col("shown").alias("relatives"))


def match_species_names(codes: DataFrame, leaves: DataFrame) -> DataFrame:
    """``code, leaf``: the leaf named as the species or as its longest beginning of at least two words; null without."""
    words = F.split("name", " ")
    forms = codes.select("code", F.explode(F.concat(F.array(F.size(words)), F.filter(F.sequence(F.lit(2), F.greatest(F.size(words), F.lit(2))), lambda n: n < F.size(words)))).alias("n"), words.alias("words"))
    forms = forms.select("code", "n", F.array_join(F.slice("words", F.lit(1), F.col("n")), " ").alias("leaf"))
    found = forms.join(leaves.select(F.col("name").alias("leaf")).distinct(), "leaf").groupBy("code").agg(F.max_by("leaf", "n").alias("leaf"))
    return codes.select("code").distinct().join(found, "code", "left")


def attach_taxonomy(sequences: DataFrame, species: DataFrame) -> DataFrame:
    """Sequences with the row of their species code, the first three letters in lower case; species beyond a counted bound are joined by shuffle."""
    return sequences.withColumn("code", F.lower(F.substring("seq_id", 1, 3))).join(if_small(species), "code", "left")


def lineage_table(species: DataFrame, level: int, highlighted: str) -> DataFrame:
    """``taxid, taxon, highlighted``: the lineage's taxon at a level from 0, and whether the lineage has one taxon."""
    return species.select("taxid", F.get("lineage", F.lit(level)).alias("taxon"), F.coalesce(F.array_contains("lineage", highlighted), F.lit(False)).alias("highlighted"))


def genus_species(name: Column, rank: Column, lineage: Column) -> Column:
    """Struct of genus, the first lineage entry of that rank, and species, the rest of a species' name."""
    genus = F.get(F.filter(lineage, lambda x: x["rank"] == "genus"), F.lit(0))["name"]
    return F.struct(genus.alias("genus"), F.when(rank == "species", F.trim(F.regexp_replace(name, r"^\S+\s*", ""))).alias("species"))
