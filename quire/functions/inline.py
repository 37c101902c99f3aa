"""Lines of a page as LaTeX: runs of prose, emphasis, bold and inline formulas; pages from lines."""

from __future__ import annotations

import re

from quire.functions import formulas, mathtext, symbols
from quire.functions.pagecut import HEAD_FONTS, Group, analyse

SECTION, SUBSECTION, BOX_TITLE, INDENT = 16.0, 13.0, 10.4, 6.0
#: Characters that join a formula beside them: fixed values.
JOINING = frozenset("0123456789+-=<>()[]|/*,.:;!'")
#: Punctuation that ends an emphasis, and is not part of it.
CLOSING = ".,;:)!?"
CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: Typographic signs and how they are typed, in this order: fixed values.
SIGNS = (("“", "``"), ("”", "''"), ("‘", "`"), ("’", "'"), ("–", "--"), ("—", "---"))
_TOKENS = {k: f"${v}$" for k, v in symbols.UNICODE.items()} | symbols.TEXT_ESCAPES


def escape(text: str) -> str:
    """Prose as LaTeX: reserved characters escaped, mathematical ones as inline formulas."""
    out = "".join(_TOKENS.get(c, c) for c in CONTROLS.sub("", text))
    for sign, typed in SIGNS:
        out = out.replace(sign, typed)
    return mathtext.merge_adjacent(re.sub(r"[ \t]+", " ", out))


def marks(glyphs) -> list[bool]:
    """Whether each glyph belongs to a formula. Digits and signs beside a formula join it, to
    three places at most, and so do blanks inside one."""
    own = [None if g.blank else g.math or g.italic for g in glyphs]

    def beside(at: int, step: int) -> bool:
        at += step
        while 0 <= at < len(own) and own[at] is None:
            at += step
        return 0 <= at < len(own) and bool(own[at])

    for _ in range(3):
        joined = False
        for at, g in enumerate(glyphs):
            if own[at] is False and g.text in JOINING and (beside(at, -1) or beside(at, 1)):
                own[at] = joined = True
        if not joined:
            break
    inside = [m is None and beside(at, -1) and beside(at, 1) for at, m in enumerate(own)]
    return [bool(m) or blank for m, blank in zip(own, inside, strict=True)]


def runs(glyphs) -> list[tuple[str, list]]:
    """Glyphs of a line as (kind, glyphs): text, bold, math or emph."""
    found: list[tuple[str, list]] = []
    for g, formula in zip(glyphs, marks(glyphs), strict=True):
        from_head = g.font in HEAD_FONTS or g.bold
        kind = "math" if formula else "bold" if from_head and not g.italic else "text"
        if found and found[-1][0] == kind:
            found[-1][1].append(g)
        else:
            found.append((kind, [g]))
    out = []
    for kind, own in found:
        if kind == "bold" and all(g.blank for g in own):
            kind = "text"
        out += emphasis(own) if kind == "math" else [(kind, own)]
    return out


def emphasis(own) -> list[tuple[str, list]]:
    """An italic run of words is emphasis and not a formula."""
    end = len(own)
    while end and (own[end - 1].blank or own[end - 1].text in CLOSING):
        end -= 1
    start = 0
    while start < end and own[start].blank:
        start += 1
    core = own[start:end]
    if core and all(g.italic or g.blank for g in core):
        words = "".join(g.text for g in core).split()
        long = [w for w in words if re.fullmatch("[A-Za-z]{3,}", w)]
        if long and 2 * len(long) >= len(words):
            tail = own[len(core):]
            return [("emph", core), *([("text", tail)] if tail else [])]
    return [("math", own)]


def line(glyphs, rules=()) -> str:
    """A line as LaTeX."""
    out = ""
    for kind, own in runs(glyphs):
        text = "".join(g.text for g in own)
        lead, tail = " " * text.startswith(" "), " " * text.endswith(" ")
        if kind == "text":
            out += escape(text)
        elif kind == "bold":
            if body := escape(text.strip()):
                out += f"{lead}\\textbf{{{body}}}{tail or ' '}"
        elif kind == "emph":
            out += f"{lead}\\emph{{{escape(text.strip())}}}{tail}"
        else:
            bars = [r for r in rules if own[0].x0 - 2 <= r.x0 and r.x1 <= own[-1].x1 + 2]
            if (formula := formulas.build(own, bars)).strip():
                out += f"{' ' * (own[0].text == ' ')}${formula}${' ' * (own[-1].text == ' ')}"
    return re.sub(" {2,}", " ", mathtext.merge_adjacent(out)).strip()


def classify(g: Group) -> str:
    """The kind of a group, by its type and place."""
    if not g.text().strip():
        return "blank"
    if g.margin:
        return "margin"
    if g.head_ratio > 0.5:
        sizes = ((SECTION, "section"), (SUBSECTION, "subsection"), (BOX_TITLE, "boxtitle"))
        return next((kind for least, kind in sizes if g.size >= least), "label")
    left, right = g.measure
    if g.math_ratio >= 0.55 and g.x0 > left + 8 or g.rules and g.math_ratio >= 0.4:
        return "display"
    inset = min(g.x0 - left, right - g.x1) > 18 and g.x1 - g.x0 < 0.72 * (right - left)
    return "center" if right - left > 100 and inset else "text"


def centred_rows(g: Group) -> list[str]:
    texts = ("".join(x.text for x in row).strip() for row in g.rows())
    return [escape(re.sub(r"\s+", " ", t)) for t in texts if t]


def group_latex(g: Group, kind: str) -> str:
    if kind == "display" or kind == "center" and (g.math_ratio >= 0.35 or g.rules):
        return formulas.display(g.glyphs, g.rules)
    if kind == "center":
        return " \\\\\n  ".join(centred_rows(g))
    if kind == "text":
        return line(g.glyphs, g.rules)
    return escape(g.text().strip()).strip()


HEADS = {"section": "\\section{%s}", "subsection": "\\subsection*{%s}", "boxtitle": "\\paragraph{%s}"}


def join_lines(lines: list[str]) -> str:
    """Lines of a paragraph as one; a hyphen at a line's end before a small letter goes."""
    out = ""
    for text in filter(None, map(str.strip, lines)):
        if out.endswith("-") and not out.endswith("--") and text[0].islower():
            out = out[:-1] + text
        else:
            out = f"{out} {text}" if out else text
    return mathtext.merge_adjacent(out)


class Writer:
    """Blocks of LaTeX, with a paragraph that is still open."""

    def __init__(self):
        self.blocks: list[str] = []
        self.lines: list[str] = []
        self.centre: list[str] = []
        self.labels: list[str] = []

    def block(self, text: str) -> None:
        self.flush()
        if text.strip():
            self.blocks.append(mathtext.sanitize(text))

    def flush(self) -> None:
        paragraph, self.lines = mathtext.sanitize(join_lines(self.lines)), []
        if paragraph:
            self.blocks.append(paragraph)

    def flush_centre(self) -> None:
        rows, self.centre = [r for r in self.centre if r], []
        if rows:
            self.block("\\begin{center}\n  " + " \\\\\n  ".join(rows) + "\n\\end{center}")

    def add(self, g: Group, kind: str) -> None:
        """Take up the next group. Labels wait for the next line of text."""
        if kind == "blank":
            return
        if kind != "center":
            self.flush_centre()
        latex = group_latex(g, kind)
        if kind in HEADS:
            title = escape(re.sub(r"^[0-9]+\.[0-9]+\s*", "", g.text().strip().lstrip("*"))).strip() if kind == "section" else latex
            self.block(HEADS[kind] % title)
        elif kind in ("label", "margin"):
            self.labels.append(g.text().strip())
        elif kind == "center" and not (g.math_ratio >= 0.35 or g.rules):
            self.centre.append(latex)
        elif kind in ("display", "center"):
            self.block(latex)
        else:
            if label := re.sub(r"\s+", " ", " ".join(self.labels)).strip():
                self.block(f"\\subsection*{{{escape(label).strip()}}}")
            self.labels = []
            if latex:
                if g.x0 > g.left + INDENT:
                    self.flush()
                self.lines.append(latex)

    def out(self) -> str:
        self.flush_centre()
        self.flush()
        return re.sub(r"\n{3,}", "\n\n", "".join(f"{b}\n\n" for b in self.blocks)).rstrip("\n") + "\n" * bool(self.blocks)


def page_latex(glyphs, rules) -> str:
    """A page as LaTeX, by itself."""
    writer = Writer()
    for g in analyse(glyphs, rules)[1]:
        writer.add(g, classify(g))
    return writer.out()
