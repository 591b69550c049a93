"""Exports: tables as JSON or CSV files, graphs as node and edge files, findings as markdown or HTML pages."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame


def write_json(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def write_csv(df: DataFrame, folder: str) -> None:
    """Nested columns as JSON text."""
    from pyspark.sql import functions as F

    nested = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*nested).write.mode("overwrite").option("header", "true").csv(folder)


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """``folder``/nodes and ``folder``/edges; only edges between given nodes."""
    ids = nodes.select(nodes.columns[0]).toDF("n")
    a, b = edges.columns[:2]
    inside = edges.join(ids, edges[a] == ids["n"], "left_semi").join(ids, edges[b] == ids["n"], "left_semi")
    write_json(nodes, f"{folder}/nodes")
    write_json(inside, f"{folder}/edges")


def _rows(df: DataFrame, most: int | None) -> tuple[list, bool]:
    """The rows of a report's table, and whether there are more."""
    if most is None:
        return list(df.toLocalIterator()), False
    rows = df.limit(most + 1).collect()
    return rows[:most], len(rows) > most


def markdown(title: str, sections: list[tuple[str, DataFrame]], most: int | None = 500) -> str:
    """A page with one table per section, of at most ``most`` rows each (None: all): a report's length, stated below a table that is cut."""
    out = [f"# {title}"]
    for name, df in sections:
        rows, more = _rows(df, most)
        out += [f"\n## {name}\n", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |" for r in rows]
        out += [f"\nThe first {most} rows."] if more else []
    return "\n".join(out) + "\n"


def page(title: str, sections: list[tuple[str, DataFrame]], most: int | None = 500) -> str:
    """The same as HTML, everything escaped."""
    cell = lambda v, tag: f"<{tag}>{html.escape(str(v))}</{tag}>"
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections:
        rows, more = _rows(df, most)
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{''.join(cell(c, 'th') for c in df.columns)}</tr>")
        out += [f"<tr>{''.join(cell(v, 'td') for v in r)}</tr>" for r in rows]
        out.append("</table>" + (f"<p>The first {most} rows.</p>" if more else ""))
    return "\n".join(out) + "</body></html>\n"


def entity_report(parts: dict[str, DataFrame]) -> str:
    """The page of ``api.entity_report``: an entity's name and type, then its documents, events, associates, aliases and tags, all of them; empty parts are left out.

    ``LookupError`` if there is no such entity.
    """
    entity = parts["entity"].first()
    if entity is None:
        raise LookupError("no such entity")
    sections = [(name, df) for name, df in parts.items() if name != "entity" and df.head(1)]
    return page(f"Report: {entity.name} ({entity.type})", sections, None)


def evidence_chain(name: str, links: DataFrame, as_html: bool = False) -> str:
    """A chain of evidence in the order of its links, with what each points to and its narrative (``Workspace.chain`` gives the rows)."""
    return (page if as_html else markdown)(f"Evidence chain: {name}", [("Links", links.orderBy("position"))], None)


def case_file(name: str, items: DataFrame, as_html: bool = True) -> str:
    """A case file: its documents, entities and other items, each in a table of its own."""
    kinds = sorted(r.item_type for r in items.select("item_type").distinct().collect())
    return (page if as_html else markdown)(f"Case: {name}", [(k, items.filter(items["item_type"] == k).drop("item_type")) for k in kinds], None)


def copied_by_category(documents: DataFrame, folder: str) -> DataFrame:
    """Writes each document's text below ``folder``/category=...; one folder a category, (id, filename, text) rows."""
    documents.select("id", "filename", "text", "category").write.mode("overwrite").partitionBy("category").parquet(folder)
    return documents.sparkSession.read.parquet(folder)
