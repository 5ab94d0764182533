"""Slide frames: how full they are against a canvas, macros, and figures that stand alone.

Counting words and matching layouts are column expressions over a row a frame; only rewriting TeX takes a function a text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import columns as C

LINE_CM, PITCH, CHARS_PER_WORD = 0.65, 1.6, 6.0
CHARS_PER_CM = {"en": 12.0, "cjk": 8.0}
#: Layouts with the width and height of their text in cm, and the aspect ratios they suit.
LAYOUTS: Mapping[str, tuple[float, float, str]] = {
    "text_only": (12.8, 6.5, "no_figure"), "figure_left_half_portrait": (6.8, 6.5, "0.5..1.3"), "figure_left_third_portrait": (8.8, 6.5, "0.4..0.9"), "figure_top_full_landscape": (12.8, 2.5, ">= 1.5"),
    "figure_inset_small_text_around": (8.8, 6.5, "any"), "figure_only_full_width": (12.8, 0.5, "any"), "equation_centered": (12.8, 3.5, "no_figure"), "table_only": (12.8, 1.5, "no_figure"),
}
LINE_WIDTH_CM, TEXT_HEIGHT_CM = 12.8, 6.5
_GRAPHIC = r"\\includegraphics(?:\[[^\]]*\])?\{[^}]+\}"
#: Patterns of what isn't a word in a frame, in the order in which it goes.
_NOISE = (
    r"\\begin\{frame\}(?:\[[^\]]*\])?\{[^}]*\}",
    r"\\end\{frame\}",
    r"\\begin\{[a-zA-Z*]+\}(?:\[[^\]]*\])?(?:\{[^}]*\})?",
    r"\\end\{[a-zA-Z*]+\}",
    r"\\includegraphics(?:\[[^\]]*\])?\{[^}]+\}",
    r"\\label\{[^}]+\}",
    r"\\caption\{[^}]*\}",
    r"\\(?:setlength|usefont|definecolor|setbeamertemplate|setbeamercolor|setbeamerfont|setbeamersize|usepackage|color|vspace|hspace)\s*\{[^}]*\}",
    r"\\[a-zA-Z]+\*?",
    r"\{|\}|\[|\]",
    r"%[^\n]*",
)


def body_words(tex: Column) -> Column:
    for p in _NOISE:
        tex = F.regexp_replace(tex, p, " ")
    return F.size(F.regexp_extract_all(tex, F.lit(r"(\S+)"), 1))


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """of(value), with value computed once however often of() names it: a column named twice is computed twice within a lambda."""
    return F.transform(F.array(value), of)[0]


def size_cm(spec: Column) -> Column:
    """A TeX length in cm; a bare number is a share of the line; null if it can't be read."""
    pattern = r"^\s*(\d*\.?\d*)\s*(\\linewidth|\\textwidth|\\textheight|\\paperwidth|\\paperheight|cm|mm|pt|in)?\s*$"

    def read(s: Column) -> Column:
        return F.when(s.rlike(pattern), _bound(F.struct(F.regexp_extract(s, pattern, 1).alias("number"), F.regexp_extract(s, pattern, 2).alias("unit")), size))

    def size(s: Column) -> Column:
        number, unit = s["number"], s["unit"]
        value = F.when(number == "", 1.0).otherwise(number.try_cast("double"))
        factor = (
            F.when(unit.isin("", "\\linewidth", "\\textwidth", "\\paperwidth"), LINE_WIDTH_CM).when(unit.isin("\\textheight", "\\paperheight"), TEXT_HEIGHT_CM)
            .when(unit == "cm", 1.0).when(unit == "mm", 0.1).when(unit == "pt", 0.0353).when(unit == "in", 2.54)
        )
        return value * factor

    return _bound(spec, read)


def graphic_box(options: Column, aspect: Column) -> Column:
    """struct(w, h) in cm of a graphic with its options; the line's width unless one is given."""

    def option(of: Column, name: str) -> Column:
        return _bound(F.trim(F.regexp_extract(of, rf"(?i)(?:^|,)\s*{name}\s*=\s*([^,]+)", 1)), lambda x: F.when(x != "", x))

    def given(s: Column) -> Column:
        return F.struct(size_cm(option(s["options"], "width")).alias("w"), size_cm(option(s["options"], "height")).alias("h"), s["aspect"].alias("aspect"), s["options"].alias("options"))

    def box(s: Column) -> Column:
        w, h, ratio = F.when(s["w"].isNull() & s["h"].isNull(), LINE_WIDTH_CM).otherwise(s["w"]), s["h"], s["aspect"]
        keep = w.isNotNull() & h.isNotNull() & s["options"].rlike(r"(?:^|,)\s*keepaspectratio\s*(?:,|$)")  # of one number it changes nothing
        fitted = F.when(w * w / ratio <= h * h * ratio, F.struct(w.alias("w"), (w / ratio).alias("h"))).otherwise(F.struct((h * ratio).alias("w"), h.alias("h")))
        free = F.struct(F.coalesce(w, h * ratio).alias("w"), F.coalesce(h, w / ratio).alias("h"))
        return F.when(keep, fitted).otherwise(free)

    return _bound(F.struct(options.alias("options"), aspect.alias("aspect")), lambda s: _bound(given(s), box))


def footprint(tex: Column, aspects: Column) -> Column:
    """Area in cm2 of a frame's graphics; aspects maps keys to ratios, unknown ones count as 1."""
    calls = F.regexp_extract_all(tex, F.lit(f"({_GRAPHIC})"), 1)

    def area(call: Column) -> Column:
        key = F.regexp_extract(call, r"\{([^}]+)\}$", 1)
        box = graphic_box(F.regexp_extract(call, r"\[([^\]]*)\]", 1), F.coalesce(F.try_element_at(aspects, key), F.lit(1.0)))
        return _bound(box, lambda b: b["w"] * b["h"])

    return F.aggregate(F.transform(calls, area), F.lit(0.0), lambda a, b: a + b)


def layout_name(tex: Column, aspect: Column) -> Column:
    """The canvas layout of a frame; aspect is its first graphic's ratio, null if unknown."""
    figure, ratio = tex.rlike(_GRAPHIC), F.coalesce(aspect, F.lit(1.0))
    share = F.coalesce(F.regexp_extract(tex, r"\\begin\{column\}\{\s*([\d.]+)", 1).try_cast("double"), F.lit(0.5))
    share = F.when(share == 0, 0.5).otherwise(share)
    beside = F.when(share <= 0.4, "figure_left_third_portrait").when(share <= 0.6, "figure_left_half_portrait").otherwise("figure_inset_small_text_around")
    return (
        F.when(~figure & tex.rlike(r"\\begin\{tabular\}"), "table_only").when(~figure & tex.rlike(r"\\\[|\\begin\{equation\}|\\begin\{align\}|\$[^$]+\$"), "equation_centered").when(~figure, "text_only")
        .when(tex.rlike(r"\\begin\{columns\}"), beside).when(ratio >= 1.5, "figure_top_full_landscape").otherwise("figure_only_full_width")
    )


def _of_layout(name: Column, value: Mapping[str, object]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in value.items() for x in kv]), name)


def overflow(frames: DataFrame, script: str = "en") -> DataFrame:
    """frames (deck, frame, tex, aspects: map) with layout, words, budget, overage, footprint, mismatch, advice and hint."""
    first = F.regexp_extract("tex", r"\\includegraphics(?:\[[^\]]*\])?\{([^}]+)\}", 1)
    rows = frames.withColumn("aspect", F.try_element_at("aspects", first)).withColumn("layout", layout_name(F.col("tex"), F.col("aspect")))
    width, height = (_of_layout(F.col("layout"), {k: v[i] for k, v in LAYOUTS.items()}) for i in (0, 1))
    per_line = F.floor(width * CHARS_PER_CM[script]) / CHARS_PER_WORD
    whole = F.greatest(F.lit(1), F.floor(width * CHARS_PER_CM[script] / CHARS_PER_WORD)).cast("int")
    parts = F.split("tex", r"\\item\b")
    items = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), body_words)
    lines = F.aggregate(items, F.lit(0), lambda a, n: a + F.when(n > 0, (F.ceil(n / whole) * whole).cast("int")).otherwise(0))
    rows = rows.withColumn("words", body_words(parts[0]) + lines).withColumn("budget", F.floor(F.floor(height / (LINE_CM * PITCH)) * per_line).cast("int"))
    rows = rows.withColumn("overage", F.greatest(F.lit(0), F.col("words") - F.col("budget"))).withColumn("footprint", F.round(footprint(F.col("tex"), F.col("aspects")), 2))
    rows = rows.withColumn("mismatch", ~C.aspect_fits(_of_layout(F.col("layout"), {k: v[2] for k, v in LAYOUTS.items()}), F.col("aspect")))
    over, area = F.col("overage"), F.col("footprint")  # the bounds below are fixed values
    advice = F.when((over <= 0) & ~F.col("mismatch"), "ok").when(over <= 0, "relayout_figure").when((area > 25) & (over < 60), "shrink_figure").when(over >= 60, "split_frame").otherwise("tighten")
    hint = F.when(advice != "split_frame", "no_hint").when(area > 15, "figure_to_own_frame_then_text").otherwise("halve_bullets_across_two_frames")
    return rows.withColumn("advice", advice).withColumn("hint", hint)


def overfull_points(log: Column) -> Column:
    """The greatest overfull height in a compile log, 0 if none."""
    found = F.regexp_extract_all(log, F.lit(r"Overfull\s+\\vbox\s+\(([\d.]+)pt\s+too\s+high\)"), 1)
    return F.coalesce(F.array_max(F.transform(found, lambda x: x.try_cast("double"))), F.lit(0.0))


_DEFINE = re.compile(r"\\(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?(?:\[(\d)\])?(?:\[([^\]]*)\])?\s*|\\DeclareMathOperator(\*?)\s*\{\\([A-Za-z]+)\}\s*|\\def\s*\\([A-Za-z]+)((?:#\d)*)\s*")


def _braced(text: str, at: int) -> tuple[str, int] | None:
    """The inside of a brace group that opens at `at`, and where it ends."""
    depth = 0
    for m in re.compile(r"\\.|[{}]", re.DOTALL).finditer(text, at):
        if m.group() == "{":
            depth += 1
        elif m.group() == "}":
            depth -= 1
            if depth == 0:
                return text[at + 1 : m.start()], m.end()
    return None


def macros(tex: str) -> dict[str, tuple[str, int, str | None]]:
    """Macro definitions by name: body, number of arguments, default of the first; the last definition counts."""
    out: dict[str, tuple[str, int, str | None]] = {}
    for m in _DEFINE.finditer(tex):
        if tex[m.end() : m.end() + 1] != "{" or (body := _braced(tex, m.end())) is None:
            continue
        if m.group(1):
            out[m.group(1)] = (body[0], int(m.group(2) or 0), m.group(3))
        elif m.group(5):
            out[m.group(5)] = (f"\\operatorname{m.group(4)}{{{body[0]}}}", 0, None)
        else:
            out[m.group(6)] = (body[0], len(m.group(7)) // 2, None)
    return out


_ENV = re.compile(r"\\(begin|end)\{(columns?|figure\*?|wrapfigure)\}")


_STEP = re.compile(rf"{_ENV.pattern}|(?m:^([ \t]*)({_GRAPHIC}))")


def lone_figures(tex: str) -> str:
    """tex with each graphic outside columns and figures centred in a paragraph of its own; applied twice it changes nothing more."""
    out, at, inside = [], 0, 0
    for m in _STEP.finditer(tex):
        if m.group(1):
            inside += 1 if m.group(1) == "begin" else -1
            continue
        head = m.start()
        while head > 0 and tex[head - 1].isspace():
            head -= 1
        if inside > 0 or tex.endswith("\\begin{center}", 0, head):
            continue
        pad = m.group(3)
        out += [tex[at : m.start()], f"{pad}\\begin{{center}}\n{pad}{m.group(4)}\n{pad}\\end{{center}}\n{pad}\\par\n"]
        at = m.end()
    return "".join(out) + tex[at:]


def figures_apart(tex: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: lone_figures(t or "")), "string")(tex)


def column_spec(spec: str, width: int) -> str:
    """A table's column specification that TeX takes for width columns: unknown marks go, columns are added or cut."""
    spec = re.sub(r"\*\{(\d{1,2})\}\{([^{}]*)\}", lambda m: m.group(2) * int(m.group(1)), spec)
    out, columns = [], 0
    for m in re.finditer(r"([pmb]\{[^{}]*\})|([@!><]\{[^{}]*\})|([lcrX])|(\|)", spec):
        if m.group(1) or m.group(3):
            if columns == width:
                break
            columns += 1
        out.append(m.group())
    return "".join(out) + "l" * (width - columns)


_TABULAR = re.compile(r"\\begin\{tabular\}(?:\[[^\]]*\])?(?=\{)")


def _cells(row: str) -> int:
    """Columns that a row takes, spans counted."""
    return sum(int(n) for n in re.findall(r"\\multicolumn\{(\d+)\}", row)) + len(re.split(r"(?<!\\)&", row)) - len(re.findall(r"\\multicolumn\{\d+\}", row))


def repaired_tables(tex: str) -> str:
    """tex whose tables have as many columns as their widest row, and an end: an unclosed table ends with its text."""
    out, at = [], 0
    for m in _TABULAR.finditer(tex):
        if m.start() < at or (spec := _braced(tex, m.end())) is None:
            continue
        end = tex.find("\\end{tabular}", spec[1])
        body = tex[spec[1] : end if end >= 0 else len(tex)]
        rows = [re.sub(r"\\(?:hline|toprule|midrule|bottomrule)|\\c(?:line|midrule)(?:\([^)]*\))?\{[^}]*\}", "", r) for r in re.split(r"\\\\(?:\[[^\]]*\])?", body)]
        width = max((_cells(r) for r in rows if r.strip()), default=1)
        out += [tex[at : m.end()], "{", column_spec(spec[0], width), "}", body, "" if end >= 0 else "\n\\end{tabular}"]
        at = end if end >= 0 else len(tex)
    return "".join(out) + tex[at:]


def tables_repaired(tex: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: repaired_tables(t or "")), "string")(tex)
