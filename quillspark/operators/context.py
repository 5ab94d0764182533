"""Blocks of text that tell a model what is known: a column expression a row, and ordered aggregation where rows make one block.

The words and the lengths to which texts are cut are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as C
from quillspark.operators.relational import joined_text

ABSTRACT, READ, EXCERPT, FORMULA = 600, 500, 400, 300


def cut(text: Column, size: int, mark: str = "") -> Column:
    """The first size characters, and the mark where more follow."""
    return F.when(F.length(text) > size, F.concat(F.substr(text, F.lit(1), F.lit(size)), F.lit(mark))).otherwise(text) if mark else F.substr(text, F.lit(1), F.lit(size))


def _lines(items: Column, line, none: str, between: str = "\n") -> Column:  # noqa: ANN001
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(F.transform(items, line), between)).otherwise(none)


def digest(paper_id: Column, title: Column, abstract: Column, sections: Column, figures: Column, equations: Column) -> Column:
    """A paper's digest: sections (name, insight), figures (keys), equations (latex, role)."""
    tag = F.when(C.is_survey(title, abstract), " [SURVEY — decompose into its surveyed branches]").otherwise("")
    formulas = _lines(equations, lambda e: F.concat(F.lit("  - "), e["latex"], F.when(F.coalesce(e["role"], F.lit("")) != "", F.concat(F.lit("  ("), e["role"], F.lit(")"))).otherwise("")), "")
    return F.concat(
        F.lit("### paper_id="), paper_id.cast("string"), F.lit(": "), title, tag, F.lit("\nAbstract: "), cut(F.coalesce(abstract, F.lit("")), ABSTRACT),
        F.lit("\nSection insights:\n"), _lines(sections, lambda s: F.concat(F.lit("- "), s["name"], F.lit(": "), s["insight"]), "- (none)"),
        F.lit("\nFigure keys: "), _lines(figures, lambda f: f, "(none)", ", "), F.when(formulas != "", F.concat(F.lit("\nKey equations:\n"), formulas)).otherwise(""),
    )


def reads(rows: DataFrame, owner: str, order: str) -> DataFrame:
    """(owner, block) of targeted reads (owner, order, key, chunk_ids, text)."""
    line = F.concat(F.lit("["), F.col("key"), F.lit("]\n  chunk_ids=["), F.array_join(F.col("chunk_ids").cast("array<string>"), ", "), F.lit("]\n  "), cut(F.col("text"), READ))
    return joined_text(rows.withColumn("__line", line), [owner], [order], "__line", "\n\n", "block")


def paper_notes(number: Column, title: Column, authors: Column, narrative: Column, abstract: Column, excerpts: Column) -> Column:
    """A paper for the speaker: its narrative, else its abstract, and excerpts (name, text) cut with a mark."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    told = F.when(some(narrative), F.concat(F.lit("\n  narrative: "), narrative)).otherwise(F.concat(F.lit("\n  abstract: "), F.when(some(abstract), abstract).otherwise("(no abstract)")))
    kept = F.filter(F.transform(excerpts, lambda s: F.struct(F.coalesce(s["name"], F.lit("(unnamed)")).alias("name"), F.trim(F.coalesce(s["text"], F.lit(""))).alias("text"))), lambda s: s["text"] != "")
    lines = _lines(kept, lambda s: F.concat(F.lit("    - ["), s["name"], F.lit("] "), cut(s["text"], EXCERPT, "…")), "")
    head = F.concat(F.lit("[paper "), number.cast("string"), F.lit("] "), F.when(some(title), title).otherwise("(untitled)"), F.lit("\n  authors: "), _lines(authors, lambda a: a, "(unknown)", ", "))
    return F.concat(head, told, F.when(F.coalesce(F.size(excerpts), F.lit(0)) > 0, F.concat(F.lit("\n  section excerpts:"), F.when(lines != "", F.concat(F.lit("\n"), lines)).otherwise(""))).otherwise(""))


def formulas(equations: Column) -> Column:
    """Numbered formulas (latex, section) with their sections."""
    line = lambda e, i: F.concat(F.lit("["), i.cast("string"), F.lit("] section='"), F.substr(F.trim(F.coalesce(e["section"], F.lit(""))), F.lit(1), F.lit(80)), F.lit("' latex='"), cut(F.trim(F.coalesce(e["latex"], F.lit(""))), FORMULA), F.lit("'"))
    return _lines(equations, line, "(no equations extracted)")
