"""Functions of whole documents whose logic depends on order, so it can't be a column expression: Arrow and pandas UDFs."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
CHUNK = "array<struct<section: string, char_start: int, char_end: int, text: string>>"
SPANS = "array<struct<start: int, end: int>>"
_COMMENT = re.compile(r"(?m)^((?:[^%\n]*[^%\n\\])?(?:\\\\)*)%[^\n]*")
_SECTION = re.compile(r"\\section\{([^}]+)\}")
_PARAGRAPH = re.compile(r"\n\s*\n")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"\w{1,4}|[^\w\s]")
MIN_PIECE = 100


def rough_tokens(text: str) -> int:
    """The offline token count: word pieces of up to four letters, and marks. A counter is a parameter wherever one is used."""
    return sum(1 for _ in _TOKEN.finditer(text))


def uncommented(text: str) -> str:
    return _COMMENT.sub(r"\1", text)


def original_offsets(text: str, offsets: Sequence[int]) -> list[int]:
    """Offsets into uncommented(text) as offsets into text."""
    removed = [(m.end(1), m.end()) for m in _COMMENT.finditer(text)]
    out = []
    for at in offsets:
        for start, end in removed:
            if start > at:
                break
            at += end - start
        out.append(min(at, len(text)))
    return out


def original_places(text: Column | str, offsets: Column | str) -> Column:
    """original_offsets() of an array of offsets in rising order."""
    return F.pandas_udf(lambda texts, places: pd.Series([original_offsets(t, p) for t, p in zip(texts, places, strict=True)]), "array<int>")(text, offsets)


def section_spans(text: str, sections: Sequence[tuple[str, int]] | None) -> Iterator[tuple[str | None, int, int]]:
    """(name, start, end) of the sections; given ones, else those of \\section marks, which belong to no span."""
    if sections is None:
        marks = [(m.group(1).strip(), m.start(), m.end()) for m in _SECTION.finditer(text)]
    else:
        marks = [(name, at, at) for name, at in sorted((s for s in sections if 0 <= s[1] <= len(text)), key=lambda s: s[1])]
    bounds = [(None, 0, 0), *marks, (None, len(text), len(text))]
    for (name, _, start), (_, end, _) in zip(bounds, bounds[1:], strict=False):
        if end > start:
            yield name, start, end


def _last_break(pattern: re.Pattern[str], piece: str) -> int:
    ends = [m.end() for m in pattern.finditer(piece)]
    return ends[-1] if ends and ends[-1] > MIN_PIECE else 0


def chunk(text: str, target: int = 800, hard: int = 1000, sections: Sequence[tuple[str, int]] | None = None, strip: bool = True, count: Callable[[str], int] = rough_tokens) -> list[tuple[str | None, int, int, str]]:
    """(section, start, end, text) of pieces under hard tokens, cut at paragraphs or, from target on, at sentences.

    Offsets are exact in the text (without its comments, if strip); pieces of white space are left out.
    """
    text = uncommented(text) if strip else text
    out: list[tuple[str | None, int, int, str]] = []
    for name, start, end in section_spans(text, sections):
        while start < end:
            size = min(5 * hard, end - start)
            while True:
                while (tokens := count(text[start : start + size])) > hard and size > 1:
                    size //= 2
                step = size
                if start + size < end and size > MIN_PIECE:
                    piece = text[start : start + size]
                    step = _last_break(_PARAGRAPH, piece) or (_last_break(_SENTENCE, piece) if tokens >= target else 0) or size
                piece = text[start : start + step]
                core = piece.strip()
                if size == 1 or len(core) == size or count(core) <= hard:
                    break
                size //= 2  # a part can have more tokens than the whole: "dog" two where " dog" is one
            if core:
                at = start + len(piece) - len(piece.lstrip())
                out.append((name, at, at + len(core), core))
            start += step
    return out


def chunks(text: Column | str, target: int = 800, hard: int = 1000, count: Callable[[str], int] = rough_tokens) -> Column:
    """The chunks of a text as an array of (section, char_start, char_end, text)."""
    names = ("section", "char_start", "char_end", "text")

    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(names, c, strict=True)) for c in chunk(t, target, hard, count=count)] if t else [])

    return F.pandas_udf(cut, CHUNK)(text)


def chunk_documents(docs: DataFrame, key: str, text: str, target: int = 800, hard: int = 1000, count: Callable[[str], int] = rough_tokens) -> DataFrame:
    """A row for each chunk: key, ordinal, section, char_start, char_end, text."""
    return docs.select(key, F.posexplode(chunks(text, target, hard, count)).alias("ordinal", "c")).select(key, "ordinal", "c.*")


_SKIP = re.compile(r"\\(.)|%[^\n]*", re.DOTALL)
#: The environments are fixed values.
_MATH = re.compile(r"\$\$.*?\$\$|\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]|\\begin\{(equation|align|eqnarray|math|displaymath|gather|multline)\*?\}.*?\\end\{\1\*?\}", re.DOTALL)


def math_spans(text: str) -> list[Span]:
    """Spans of math; escaped dollars and those in comments don't count."""

    def blank(m: re.Match[str]) -> str:
        if m.group(1) is None:
            return " " * len(m.group())
        return "\\ " if m.group(1) == "$" else m.group()

    return [m.span() for m in _MATH.finditer(_SKIP.sub(blank, text))]


def spans(text: Column | str, find: Callable[[str], list[Span]]) -> Column:
    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"start": a, "end": b} for a, b in find(t)] if t else [])

    return F.pandas_udf(each, SPANS)(text)


def explode_spans(docs: DataFrame, key: str, text: str, find: Callable[[str], list[Span]]) -> DataFrame:
    return docs.select(key, F.explode(spans(text, find)).alias("s")).select(key, "s.*")


_ROW = re.compile(r"<tr\b[^>]*>(.*?)</tr\s*>", re.IGNORECASE | re.DOTALL)
_CELL = re.compile(r"<(t[dh])\b[^>]*>(.*?)</t[dh]\s*>", re.IGNORECASE | re.DOTALL)
_BREAK, _TAG = re.compile(r"<br\s*/?>", re.IGNORECASE), re.compile(r"<[^>]*>")


def markdown_table(source: str | None) -> str:
    """A table in markdown: the first row with a heading cell, else the first, is the head and gives the width."""
    rows = []
    for m in _ROW.finditer(source or ""):
        cells = [(kind.lower(), " ".join(html_lib.unescape(_TAG.sub("", _BREAK.sub(" ", inner))).split())) for kind, inner in _CELL.findall(m.group(1))]
        if cells:
            rows.append(cells)
    if not rows:
        return ""
    at = next((i for i, r in enumerate(rows) if any(kind == "th" for kind, _ in r)), 0)
    width = len(rows[at])
    line = lambda r: "| " + " | ".join([c for _, c in r[:width]] + [""] * (width - len(r))) + " |"
    return "\n".join([line(rows[at]), "| " + " | ".join(["---"] * width) + " |", *(line(r) for i, r in enumerate(rows) if i != at)])


def table_markdown(source: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(markdown_table), "string")(source)


PREFIX, SHORTEST = 150, 30


def flat(text: str) -> str:
    return " ".join(text.split()).lower()


def search_targets(needle: str) -> list[str]:
    """Beginnings of a passage to look for, the longest first."""
    norm = flat(needle)
    if len(norm) < SHORTEST:
        return [norm] if norm else []
    cap = min(len(norm), PREFIX)
    stops = [cap, norm.rfind(". ", 0, cap + 2) + 1, norm.rfind(" ", 0, max(SHORTEST, cap // 2) + 1), SHORTEST]
    return list(dict.fromkeys(norm[:n] for n in stops if n >= SHORTEST))


def find_passage(text: str | None, needle: str | None) -> int:
    """Where in the flattened text the passage begins, -1 if nowhere."""
    page = flat(text or "")
    return next((at for target in search_targets(needle or "") if (at := page.find(target)) >= 0), -1)


def locate(text: Column | str, needle: Column | str) -> Column:
    def each(texts: pd.Series, needles: pd.Series) -> pd.Series:
        return pd.Series([find_passage(t, n) for t, n in zip(texts, needles, strict=True)], dtype="int32")

    return F.pandas_udf(each, "int")(text, needle)


def locate_on_pages(pages: Sequence[Sequence[str]], needle: str) -> tuple[int, list[int]] | None:
    """(page, items) of the first page with the passage: the items that overlap its full length."""
    size = len(flat(needle))
    for number, items in enumerate(pages, 1):
        spans, joined = [], ""
        for i, raw in enumerate(items):
            if norm := flat(raw):
                at = len(joined) + bool(joined)
                joined += (" " if joined else "") + norm
                spans.append((i, at, len(joined)))
        for target in search_targets(needle):
            if (hit := joined.find(target)) >= 0:
                end = min(hit + size, len(joined))
                return number, [i for i, a, b in spans if a < end and b > hit]
    return None


def drop_surrogates(raw: Column | str) -> Column:
    """The text of bytes that may hold lone surrogates (which no string here can): those go, the rest stays.

    Latin-1 makes a character of each byte, so a pattern finds the three bytes of a surrogate.
    """
    latin = F.decode(F.col(raw) if isinstance(raw, str) else raw, "ISO-8859-1")
    return F.decode(F.encode(F.regexp_replace(latin, "\u00ed[\u00a0-\u00bf][\u0080-\u00bf]", ""), "ISO-8859-1"), "UTF-8")


_GRAPHIC = re.compile(r"(\\includegraphics(?:\[[^\]]*\])?)\{([^}]+)\}")


def checked_graphics(tex: str, known: set[str], placeholder: str = "example-image") -> tuple[str, list[str]]:
    """tex with unknown graphics replaced, and the rejected keys."""
    rejected: list[str] = []

    def put(m: re.Match[str]) -> str:
        if m.group(2).strip() in known:
            return m.group()
        rejected.append(m.group(2).strip())
        return f"{m.group(1)}{{{placeholder}}}"

    return _GRAPHIC.sub(put, tex), rejected


def graphics(tex: Column | str, known: Sequence[str]) -> Column:
    """checked_graphics() as a struct(tex, rejected)."""
    names = set(known)
    return F.pandas_udf(lambda texts: pd.DataFrame([checked_graphics(t or "", names) for t in texts], columns=["tex", "rejected"]), "tex string, rejected array<string>")(tex)


def splice(tex: str, old: str, new: str) -> str:
    """tex with its only occurrence of old replaced; no or several occurrences are an error."""
    n = tex.count(old)
    if n != 1:
        raise ValueError(f"expected one occurrence, found {n}")
    return tex.replace(old, new)


def parse_sse(stream: str) -> list[tuple[str, str]]:
    """(event, data) of a server-sent stream; an event's data lines are joined, its name is `message` unless given."""
    out = []
    for block in re.split(r"\r?\n\r?\n", stream):
        name, data = "message", []
        for line in block.splitlines():
            kind, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if kind == "event":
                name = value
            elif kind == "data":
                data.append(value)
        if data:
            out.append((name, "\n".join(data)))
    return out


def sse_events(stream: Column | str) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: [{"event": e, "data": d} for e, d in parse_sse(t or "")]), "array<struct<event: string, data: string>>")(stream)


#: Environments that a mark would break; fixed values.
FRAGILE = (
    "tabular", "tabularx", "longtable", "array", "table", "figure", "wrapfigure", "subfigure", "tikzpicture", "picture", "verbatim", "lstlisting", "minted", "algorithm", "algorithmic",
    "algorithm2e", "pmatrix", "bmatrix", "vmatrix", "matrix", "cases", "split", "tabbing", "supertabular",
)
_STEP = re.compile(r"\\(begin|end)\s*\{([^}]*)\}|\\(?:[^\W\d_]+|.|\Z)|%[^\n]*|[{}]", re.DOTALL)


def safe_masks(text: str) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the end included: whether a mark may stand there, and whether it is within a fragile environment.

    One pass with the depth of braces and of fragile environments: a mark stands outside both, and outside commands, comments and math.
    """
    n = len(text)
    safe, fragile = np.ones(n + 1, bool), np.zeros(n + 1, bool)
    depth = held = at = 0
    for m in _STEP.finditer(text):
        a, b = m.span()
        safe[at:a] = not (depth or held)
        fragile[at:a] = held > 0
        safe[a:b] = False
        matters = m.group(1) is not None and m.group(2).strip().rstrip("*") in FRAGILE
        held += matters and m.group(1) == "begin"
        fragile[a:b] = held > 0
        held = max(0, held - (matters and m.group(1) == "end"))
        depth = max(0, depth + {"{": 1, "}": -1}.get(m.group(), 0))
        at = b
    safe[at:] = not (depth or held)
    fragile[at:] = held > 0
    for a, b in math_spans(text):
        safe[a : min(b, n)] = False
    return safe, fragile


def safe_places(text: str, starts: Sequence[int], whole_words: bool = False) -> list[int | None]:
    """For each start a safe place near it, or null: the start itself, else the nearest one between the start before and the start behind.

    Within a fragile environment what lies before is asked first, so that a range from the mark on spans the float; elsewhere what
    lies behind is. whole_words: no place within a word is safe; the nearest place before counts, else the nearest behind, however far.
    """
    n = len(text)
    safe, fragile = safe_masks(text)
    if whole_words:
        solid = np.fromiter((c.isalnum() for c in text), bool, n)
        safe[1:n] &= ~(solid[:-1] & solid[1:])
    places = np.arange(n + 1)
    before = np.maximum.accumulate(np.where(safe, places, -1)).tolist()
    after = np.minimum.accumulate(np.where(safe, places, n + 1)[::-1])[::-1].tolist()
    order = sorted((at, i) for i, at in enumerate(starts))
    out: list[int | None] = [None] * len(starts)
    for k, (at, i) in enumerate(order):
        if not 0 <= at <= n:
            continue
        if safe[at]:
            out[i] = at
            continue
        low, high = (-1, n + 1) if whole_words else (max(order[k - 1][0], -1) if k else 0, min(order[k + 1][0] if k + 1 < len(order) else n, n))
        back, ahead = before[at] if before[at] > low else None, after[at] if after[at] < high else None
        first, second = (back, ahead) if fragile[at] or whole_words else (ahead, back)
        out[i] = second if first is None else first
    return out


def anchored(text: str, starts: Sequence[int], mark: str = "@@A{}@@", whole_words: bool = False) -> str:
    """text with a numbered mark at the safe place of each start that has one; taking the marks out gives the text again."""
    out, last = [], 0
    for at, i in sorted((at, i) for i, at in enumerate(safe_places(text, starts, whole_words)) if at is not None):
        out += [text[last:at], mark.format(i)]
        last = at
    return "".join(out) + text[last:]


def anchors(text: Column | str, starts: Column, whole_words: bool = False) -> Column:
    """anchored() with the starts as an array."""
    return F.pandas_udf(lambda texts, places: pd.Series([None if t is None else anchored(t, list(p), whole_words=whole_words) for t, p in zip(texts, places, strict=True)]), "string")(text, starts)


def read_anchors(text: str) -> tuple[str, list[int]]:
    """text without its marks, made into empty elements with ids, and the numbers found."""
    found = [int(n) for n in re.findall(r"@@A(\d+)@@", text)]
    return re.sub(r"@@A(\d+)@@", r'<span id="chunk-\1"></span>', text), found


_FIGURE = re.compile(r"\\begin\{figure\*?\}.*?\\end\{figure\*?\}", re.DOTALL)
_EQUATION = re.compile(r"\\begin\{(equation\*?|align\*?)\}(.*?)\\end\{\1\}", re.DOTALL)
_DISPLAY = re.compile(r"\\\[(.*?)\\\]", re.DOTALL)


def latex_assets(text: str) -> list[tuple[str, str, str, str | None]]:
    """(id, kind, body, section): figures, then equation environments, then display math; equations share a counter."""
    sections = [(m.start(), m.group(1).strip()) for m in _SECTION.finditer(text)]
    section = lambda at: next((name for start, name in reversed(sections) if start <= at), None)
    out, figures = [], 0
    for m in _FIGURE.finditer(text):
        if key := _GRAPHIC.search(m.group()):
            figures += 1
            out.append((f"fig-{figures:03d}", "figure", key.group(2), section(m.start())))
    bodies = [(m.group(2), m.start()) for m in _EQUATION.finditer(text)] + [(m.group(1), m.start()) for m in _DISPLAY.finditer(text)]
    return out + [(f"eq-{i:03d}", "equation", body.strip(), section(at)) for i, (body, at) in enumerate(bodies, 1)]


def assets(text: Column | str) -> Column:
    names = ("id", "kind", "body", "section")
    return F.pandas_udf(lambda s: s.map(lambda t: [dict(zip(names, a, strict=True)) for a in latex_assets(t or "")]), "array<struct<id: string, kind: string, body: string, section: string>>")(text)
