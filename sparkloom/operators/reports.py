"""Markdown of small aggregates, and the counts of a knowledge base. Only ranked heads and group counts come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import aggregates, lookups


def file_census(files: DataFrame, n: int = 12) -> DataFrame:
    """(directory, n): the top-level directories with the most files."""
    return aggregates.directory_counts(files).orderBy(F.desc("n"), "directory").limit(n)


def banner(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table; ``findings`` counts active ones."""
    out = None
    for name, rows in tables.items():
        kept = rows.filter("status = 'active'") if name == "findings" else rows
        one = kept.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def _table(title: str, columns: list[str], rows) -> str:
    lines = [f"## {title}", "", "| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows), ""])


def module_map(name: str, symbols: DataFrame, ops: DataFrame, most_ops: int = 10_000) -> str:
    """Directories by symbols, the most important symbols, and the registrations, of which at most ``most_ops`` are listed."""
    counts = aggregates.directory_counts(symbols).orderBy(F.desc("n"), "directory").collect()
    top = lookups.top_symbols(symbols).collect()
    known = lookups.canonical(ops, "ops").limit(most_ops + 1).collect()
    parts = [f"# Module map: {name}", "", f"{sum(r['n'] for r in counts)} symbols.", "", _table("Directories", ["directory", "symbols"], [(f"`{r['directory']}`", r["n"]) for r in counts])]
    parts.append(_table("Most important symbols", ["symbol", "kind", "place", "importance"], [(f"`{r['name']}`", r["kind"], f"`{r['path']} → {r['name']}`", f"{r['importance']:.5f}") for r in top]))
    if known:
        parts.append(_table("Registrations", ["op", "provider", "framework", "place"], [(f"`{r['op_name']}`", r["provider"], r["framework"], f"`{r['kernel_path']}:{r['line']}`") for r in known[:most_ops]]))
        if len(known) > most_ops:
            parts.append(f"The first {most_ops} registrations are listed.\n")
    return "\n".join(parts)


def repository_map(definitions: DataFrame, frequency: DataFrame, n: int = 200) -> str:
    """The most used names with their definitions."""
    rows = lookups.best_definitions(definitions, frequency, n).collect()
    return _table(f"Top {len(rows)} names by references", ["name", "references", "kind", "place"], [(f"`{r['name']}`", r["score"], r["kind"], f"`{r['path']}`") for r in rows])


def summary_tree(files: DataFrame, depth: int = 2, per_level: int = 200) -> str:
    """Path prefixes of files(path, score) level by level, the fullest first, with their best file."""
    tree = aggregates.rollup_tree(files, depth)
    parts = []
    for d in range(1, depth + 1):
        rows = tree.filter(F.col("depth") == d).orderBy(F.desc("n_files"), "key").limit(per_level).collect()
        parts.append(_table(f"Level {d}", ["prefix", "files", "best"], [(f"`{r['key']}`", r["n_files"], f"`{r['best']}`") for r in rows]))
    return "\n".join(parts)


def draft_seed(symbols: DataFrame, files: DataFrame) -> str:
    """A start for a guide: the largest directories and the entry points."""
    census = file_census(files).collect()
    entries = lookups.entry_points(symbols, files).orderBy("path", "why").limit(100).collect()
    return "\n".join([_table("Directories", ["directory", "files"], [(f"`{r['directory']}`", r["n"]) for r in census]), _table("Entry points", ["path", "why"], [(f"`{r['path']}`", r["why"]) for r in entries])])
