"""Readers of tables, sequences, alignments, trees and taxonomies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seedloom.operators.trees import map_trees
from seedloom.operators.validation import require_columns

# Columns of the raw table and files of a split, which are input contracts.
RAW_COLUMNS = (
    "gene", "noncodingRNA", "noncodingRNA_name", "noncodingRNA_fam", "feature", "label", "chr", "start", "end", "strand", "Nunique",
    "dominant_region", "regions_present", "read_start_in_sel_tx_1based", "read_end_in_sel_tx_1based", "gene_cluster_ID", "gene_phyloP", "gene_phastCons",
)
SPLIT_TABLES = {
    "samples": ("samples.tsv", "\t"), "labels": ("labels.csv", ","), "candidates": ("sample_mirna_candidates.tsv", "\t"),
    "mirna_positions": ("*mirna_positions.tsv", "\t"), "target_positions": ("*target_positions.tsv", "\t"),
}


#: What every table of position scores holds.
POSITION_COLUMNS = ("split", "row_id", "pos", "actual_nt")


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Strings of a CSV or TSV file, a tab in its header line deciding; a byte order mark is left out.

    Raises ``ValueError`` for empty or repeated header names.
    """
    header = (spark.read.text(path).first() or [""])[0].lstrip("﻿")
    sep = "\t" if "\t" in header else ","
    names = [n.strip().strip('"') for n in header.split(sep)]
    if not all(names) or len(set(names)) < len(names):
        raise ValueError("the header has empty or repeated names")
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', inferSchema=False)
    return df.toDF(*names)


def read_raw_rows(spark: SparkSession, path: str, required: tuple[str, ...] = RAW_COLUMNS) -> DataFrame:
    """The tab-separated raw table with its sequence column, ``noncodingRNA`` or ``mirna`` in the header, named ``mirna``.

    Raises ``ValueError`` that lists all ``required`` columns that are absent.
    """
    df = read_interactions(spark, path)
    df = df if "mirna" in df.columns else df.withColumnRenamed("noncodingRNA", "mirna")
    wanted = ["mirna" if n == "noncodingRNA" else n for n in required]
    return require_columns(df, list(dict.fromkeys(wanted)))


def read_split(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The five tables of a split by name, as strings; labels prefer ``numeric_label``.

    Candidates' flag column, ``has_<model>_profile`` in files, is named ``has_profile``.
    """
    tables = {name: spark.read.csv(f"{folder}/{file}", sep=sep, header=True, emptyValue="", nullValue="\0") for name, (file, sep) in SPLIT_TABLES.items()}
    if "numeric_label" in tables["labels"].columns:
        tables["labels"] = tables["labels"].drop("label").withColumnRenamed("numeric_label", "label")
    flag = next((c for c in tables["candidates"].columns if re.fullmatch(r"has_\w+_profile", c)), None)
    if flag:
        tables["candidates"] = tables["candidates"].withColumnRenamed(flag, "has_profile")
    return tables


def read_position_scores(spark: SparkSession, source: str, split: str, required: tuple[str, ...] = POSITION_COLUMNS) -> DataFrame:
    """Position scores of one split; raises ``ValueError`` that lists all ``required`` columns that are absent.

    ``source`` is a table that ``writers.store_position_scores`` made, of which only the split's partition is read, a Parquet folder
    partitioned by split, likewise, or a tab-separated file.
    """
    if "/" not in source and spark.catalog.tableExists(source):
        df = spark.table(source)
    else:
        df = spark.read.parquet(source) if source.rstrip("/").endswith(".parquet") else spark.read.csv(source, sep="\t", header=True)
    return require_columns(df, list(required)).where(F.col("split") == split)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``header, seq, input_pos`` of FASTA records; records without letters are left out.

    Records are split where a line starts with ``>``, so a file of any size is read in parts.
    """
    records = spark.read.option("lineSep", "\n>").text(path)
    lines = F.split(F.regexp_replace(F.col("value"), "^>", ""), "\r?\n")
    return (
        records.withColumn("input_pos", F.monotonically_increasing_id())
        .select(F.trim(F.element_at(lines, 1)).alias("header"), F.regexp_replace(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), ""), r"\s", "").alias("seq"), "input_pos")
        .where("seq <> ''")
    )


def read_clustal(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, seq_id, aligned, input_pos``: blocks of each file joined by name, U as T.

    ``query_id`` is the file's name without its ending; annotation and consensus lines are left out.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("query_id"), "value")
    lines = files.select("query_id", F.posexplode(F.split("value", "\r?\n")).alias("place", "line")).where(~F.col("line").rlike(r"^(?:CLUSTAL|#|\s|$)"))
    parts = lines.select("query_id", "place", F.regexp_extract("line", r"^(\S+)\s+(\S+)", 1).alias("seq_id"), F.regexp_extract("line", r"^(\S+)\s+(\S+)", 2).alias("part")).where("part <> ''")
    joined = parts.groupBy("query_id", "seq_id").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["part"]), "")
    return joined.select("query_id", "seq_id", F.translate(text, "Uu", "Tt").alias("aligned"), F.get("parts", F.lit(0))["place"].alias("input_pos"))


TREE = "node int, parent int, branch_length double, label string, is_leaf int"
NEWICK = re.compile(r"\s*('(?:[^']|'')*'|[(),:;]|[^\s(),:;']+)")


def newick_rows(text: str) -> list[tuple[int, int | None, float | None, str | None, int]]:
    """``(node, parent, branch length, label, is leaf)`` of a Newick tree, the root first with no parent."""
    rows: list[list] = [[1, None, None, None, 1]]
    now, want = 0, "label"
    for token in NEWICK.findall(text):
        if token == "(":
            rows[now][4] = 0
            rows.append([len(rows) + 1, now + 1, None, None, 1])
            now, want = len(rows) - 1, "label"
        elif token == ",":
            above = rows[now][1]
            rows.append([len(rows) + 1, above, None, None, 1])
            now, want = len(rows) - 1, "label"
        elif token == ")":
            now, want = rows[now][1] - 1, "label"
        elif token == ":":
            want = "length"
        elif token == ";":
            break
        elif want == "length":
            rows[now][2] = float(token)
            want = "label"
        else:
            rows[now][3] = token.strip("'").replace("''", "'")
    return [tuple(r) for r in rows]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """``query_id`` (the file's name without ending) and edge rows of each tree."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("query_id"), "value")

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(q, *r) for q, text in zip(frame["query_id"], frame["value"]) for r in newick_rows(text)]
            yield pd.DataFrame(rows, columns=["query_id", "node", "parent", "branch_length", "label", "is_leaf"]).astype({"parent": "Int32"})

    return files.mapInPandas(parse, f"query_id string, {TREE}")


def prune_rows(rows: list[tuple], taxa: set[str]) -> list[tuple]:
    """Tree rows with the listed leaves only; nodes left with one child are merged, their lengths added."""
    children: dict[int, list[int]] = {}
    by = {r[0]: r for r in rows}
    for r in rows:
        if r[1] is not None:
            children.setdefault(r[1], []).append(r[0])
    out: list[tuple] = []

    def grow(node: int, parent: int | None, carried: float) -> None:
        kept = [c for c in children.get(node, []) if live[c]]
        length = (by[node][2] or 0.0) + carried
        if by[node][4] == 0 and len(kept) == 1:
            stack.append((kept[0], parent, length if parent is not None else 0.0))
            return
        own = len(out) + 1
        out.append((own, parent, length if parent is not None else None, by[node][3], by[node][4]))
        stack.extend((c, own, 0.0) for c in reversed(kept))

    live = {n: by[n][4] == 1 and by[n][3] in taxa for n in by}
    for n in sorted(by, reverse=True):
        if live[n] and by[n][1] is not None:
            live[by[n][1]] = True
    root = min(by)
    stack: list[tuple[int, int | None, float]] = [(root, None, 0.0)] if live.get(root) else []
    while stack:
        grow(*stack.pop())
    return out


def unroot_rows(rows: list[tuple]) -> list[tuple]:
    """Tree rows without a root of two children: one inner child takes its place and the other's length grows by the two."""
    top = [r for r in rows if r[1] == rows[0][0]]
    inner = [r for r in top if r[4] == 0]
    if len(top) != 2 or not inner:
        return rows
    gone = inner[0]
    other = top[1] if top[0] is gone else top[0]
    root = rows[0][0]
    total = (gone[2] or 0.0) + (other[2] or 0.0)
    return [
        (r[0], root if r[1] == gone[0] else r[1], total if r is other else r[2], *r[3:]) if r is not rows[0] else (root, None, None, gone[3], 0)
        for r in rows
        if r is not gone
    ]


def change_trees(trees: DataFrame, taxa: DataFrame | None = None, unroot: bool = False) -> DataFrame:
    """Each tree pruned to the ``query_id, seq_id`` taxa of its query, and unrooted if asked; trees without any taxon listed are left out."""
    def change(tree: list[dict], wanted: list[str] | None = None) -> list[tuple]:
        rows = [(r["node"], r["parent"], r["branch_length"], r["label"], r["is_leaf"]) for r in tree]
        rows = rows if wanted is None else prune_rows(rows, set(wanted))
        return unroot_rows(rows) if unroot and rows else rows

    names = None if taxa is None else taxa.groupBy("query_id").agg(F.collect_set("seq_id").alias("taxa"))
    return map_trees(trees, ("node", "parent", "branch_length", "label", "is_leaf"), change, TREE, names)


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """Ancestral state tables, plain or gzip: ``query_id``, node, site and the probability columns as doubles."""
    df = spark.read.csv(path, sep="\t", comment="#", header=True).withColumn("query_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1))
    numbers = [c for c in df.columns if re.fullmatch(r"p_\w", c)]
    return df.select("query_id", F.col("Node").alias("node"), F.col("Site").cast("int").alias("site"), *(F.col(c).cast("double").alias(c.lower()) for c in numbers))


def read_taxonomy_xml(spark: SparkSession, path: str) -> DataFrame:
    """``taxid, name, rank, parent_taxid, lineage`` of the ``Taxon`` records of an XML file."""
    schema = "TaxId string, ScientificName string, Rank string, ParentTaxId string, Lineage string, LineageEx struct<Taxon:array<struct<TaxId:string,ScientificName:string,Rank:string>>>"
    df = spark.read.format("xml").option("rowTag", "Taxon").schema(schema).load(path)
    return df.select(F.col("TaxId").alias("taxid"), F.col("ScientificName").alias("name"), F.col("Rank").alias("rank"), F.col("ParentTaxId").alias("parent_taxid"), F.col("Lineage").alias("lineage"), F.col("LineageEx.Taxon").alias("taxa"))


def read_stockholm(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, anchors, structure``: the ``cA1`` and ``SS_cons`` column annotations of each file, blocks joined."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("query_id"), "value")

    def line(tag: str):
        return F.array_join(F.regexp_extract_all("value", F.lit(rf"(?m)^#=GC\s+{tag}\s+(\S+)"), F.lit(1)), "")

    return files.select("query_id", line("cA1").alias("anchors"), line("SS_cons").alias("structure"))


class TableLinks(HTMLParser):
    """Rows of a page's tables: cells' texts, and links with their text and target."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[dict] = []
        self.open: list[dict] = []
        self.link: list | None = None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "tr":
            self.open.append({"cells": [], "links": []})
            self.rows.append(self.open[-1])
        elif self.open and tag in ("td", "th"):
            self.open[-1]["cells"].append([tag, ""])
        elif self.open and tag == "a":
            self.link = ["", dict(attrs).get("href") or "", len(self.open[-1]["cells"]) - 1]

    def handle_endtag(self, tag: str) -> None:
        if tag == "tr" and self.open:
            self.open.pop()
        elif tag == "a" and self.open and self.link:
            self.open[-1]["links"].append(self.link)
            self.link = None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1]["cells"]:
            self.open[-1]["cells"][-1][1] += data
        if self.link is not None:
            self.link[0] += data


def page_rows(html: str | None) -> list[dict]:
    parser = TableLinks()
    parser.feed(html or "")
    return parser.rows


def _from_pages(pages: DataFrame, html: str, key: str, found, schema: str) -> DataFrame:
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, *r) for k, h in zip(frame[key], frame[html]) for r in found(page_rows(h))]
            yield pd.DataFrame(rows, columns=[key, *names])

    return pages.select(key, html).mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, {schema}")


def extract_orthologue_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``key, orthologue``: link texts in the first table row headed "Orthologues"."""

    def found(rows: list[dict]) -> list[tuple]:
        for row in rows:
            if any(tag == "th" and "Orthologues" in text for tag, text in row["cells"][:1]):
                cell = next((i for i, (tag, _) in enumerate(row["cells"]) if tag == "td"), None)
                return [(text.strip(),) for text, _, at in row["links"] if at == cell and text.strip()]
        return []

    return _from_pages(pages, html, key, found, "orthologue string")


def extract_species_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """``key, code, species``: the first row with a ``/fasta/<code>?`` link of each code, and its first cell of plain text."""

    def found(rows: list[dict]) -> list[tuple]:
        seen: dict[str, str | None] = {}
        for row in rows:
            for _, href, _ in row["links"]:
                code = re.search(r"/fasta/([a-z]{3})\?", href)
                if code and code[1] not in seen:
                    cells = [text.strip() for _, text in row["cells"]]
                    seen[code[1]] = next((t for t in cells if t and not t.startswith(("[", "Download"))), None)
        return [(c, s) for c, s in seen.items() if s]

    return _from_pages(pages, html, key, found, "code string, species string")
