"""What glyph names, codes and characters stand for in LaTeX.

All tables in this module must have just these entries for right results; they are lookups
and hold no logic beyond ``atom``.
"""

from __future__ import annotations

# fixed values: codes of the font NewOptr2k
NEWOPTR = {
    "q": r"\infty", "Ú": r"\geq", "…": r"\leq", "L": r"\approx", "K": r"\equiv", "Z": r"\neq", "*": r"\times",
    "#": r"\vdots", "3": r"\Longleftrightarrow", ";": r"\pm", ".": r"\blacksquare", "(": r"\subset", ")": r"\supset",
}
# fixed values: names of big operators
BIG_OPERATORS = {
    "summationdisplay": r"\sum", "summationtext": r"\sum", "productdisplay": r"\prod", "producttext": r"\prod",
    "integraldisplay": r"\int", "integraltext": r"\int", "uniondisplay": r"\bigcup", "uniontext": r"\bigcup",
    "intersectiondisplay": r"\bigcap", "intersectiontext": r"\bigcap",
}
# fixed values: names of radicals, and of their pieces without an argument
RADICALS = (
    "radicalbig", "radicalBig", "radicalbigg", "radicalBigg", "radicaltp", "radicalvertex", "radicalbt", "radical",
)
RADICAL_PIECES = ("radicalvertex", "radicalbt")
# fixed values: pieces of tall delimiters that carry no content
EXTENSIONS = (
    "parenleftex", "parenrightex", "bracketleftex", "bracketrightex", "braceex", "vextendsingle", "vextenddouble",
    "bracehtipdownleft", "bracehtipdownright", "bracehtipupleft", "bracehtipupright", "parenleftbt", "parenrightbt",
    "bracketleftbt", "bracketrightbt", "braceleftbt", "bracerightbt", "braceleftmid", "bracerightmid",
)
# the sizes in which delimiters come; names are built from them
SIZES = ("big", "Big", "bigg", "Bigg", "tp")
TALL_ENDINGS = ("big", "Big", "bigg", "Bigg", "tp", "bt", "ex", "mid")
OPENERS = {f"{kind}left{size}": mark for kind, mark in (("paren", "("), ("bracket", "["), ("brace", r"\{")) for size in SIZES}
OPENERS["angbracketleft"] = r"\langle"
CLOSERS = {f"{kind}right{size}": mark for kind, mark in (("paren", ")"), ("bracket", "]"), ("brace", r"\}")) for size in SIZES}
CLOSERS["angbracketright"] = r"\rangle"
# fixed values: other glyph names
GLYPHS = {
    "union": r"\cup", "intersection": r"\cap", "element": r"\in", "emptyset": r"\emptyset", "arrowright": r"\to",
    "asteriskmath": "*", "periodcentered": r"\cdot", "bullet": r"\bullet", "openbullet": r"\circ", "prime": "'",
    "radical": r"\sqrt", "minus": "-", "plus": "+", "equal": "=", "bar": r"\mid", "backslash": r"\setminus",
    "braceleft": r"\{", "braceright": r"\}", "semicolon": ";", "negationslash": r"\!\not", "slashbig": "/",
    "slashBig": "/", "slashBigg": "/", "less": "<", "greater": ">", "slash": "/", "period": ".", "parenleft": "(",
    "parenright": ")", "alpha": r"\alpha", "beta": r"\beta", "gamma": r"\gamma", "epsilon": r"\varepsilon",
    "epsilon1": r"\epsilon", "zeta": r"\zeta", "theta": r"\theta", "lambda": r"\lambda", "mu": r"\mu", "nu": r"\nu",
    "xi": r"\xi", "pi": r"\pi", "rho": r"\rho", "sigma": r"\sigma", "phi": r"\phi", "chi": r"\chi", "lscript": r"\ell",
    "Theta": r"\Theta", "Theta1": r"\Theta", "Gamma1": r"\Gamma", "Phi1": r"\Phi", "Psi1": r"\Psi", "Omega1": r"\Omega",
}
# fixed values: characters
UNICODE = {
    "−": "-", "×": r"\times", "÷": r"\div", "±": r"\pm", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "≈": r"\approx",
    "≡": r"\equiv", "∞": r"\infty", "→": r"\to", "∈": r"\in", "∉": r"\notin", "⊂": r"\subset", "⊃": r"\supset",
    "⊆": r"\subseteq", "⊇": r"\supseteq", "∪": r"\cup", "∩": r"\cap", "∅": r"\emptyset", "√": r"\sqrt", "∑": r"\sum",
    "∏": r"\prod", "∫": r"\int", "∂": r"\partial", "∇": r"\nabla", "∼": r"\sim", "∽": r"\backsim", "≅": r"\cong",
    "…": r"\ldots", "⋯": r"\cdots", "⋮": r"\vdots", "⋱": r"\ddots", "·": r"\cdot", "•": r"\bullet", "∘": r"\circ",
    "∗": "*", "′": "'", "″": "''", "←": r"\leftarrow", "↔": r"\leftrightarrow", "⇒": r"\Rightarrow",
    "⇔": r"\Longleftrightarrow", "¬": r"\neg", "∀": r"\forall", "∃": r"\exists", "¢": r"\text{\textcent}",
    "°": r"^\circ", "Θ": r"\Theta", "Ω": r"\Omega", "Φ": r"\Phi", "λ": r"\lambda", "μ": r"\mu", "σ": r"\sigma",
    "π": r"\pi", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\varepsilon", "ζ": r"\zeta",
    "η": r"\eta", "θ": r"\theta", "ν": r"\nu", "ξ": r"\xi", "ρ": r"\rho", "τ": r"\tau", "φ": r"\phi", "χ": r"\chi",
    "ψ": r"\psi", "ω": r"\omega", "Γ": r"\Gamma", "Δ": r"\Delta", "Σ": r"\Sigma", "Π": r"\Pi", "ℓ": r"\ell",
    "ℜ": r"\Re", "ℑ": r"\Im",
}
# fixed values: characters of single fonts
FONT_CHARACTERS = {
    ("MathematicalPiLTStd-1", "5"): "=", ("MathematicalPiLTStd-1", "2"): r"\geq", ("MathematicalPiLTStd-1", "<"): r"\cup",
    ("MathematicalPiLTStd-1", "U"): r"\theta", ("MathematicalPiLTStd-1", "3"): r"\times",
    ("MathematicalPiLTStd-1", "1"): "+", ("MathematicalPiLTStd-1", "#"): r"\leq", ("MathematicalPiLTStd-4", "<"): r"\cup",
    ("MathematicalPiLTStd-3", ","): r"\cap", ("Allphf", "*"): r"\Longleftrightarrow", ("Allphf", "%"): r"\leftrightarrow",
    ("PearsonMATHPRO01", "m"): r"\mu", ("PearsonMATHPRO01", "s"): r"\sigma", ("PearsonMATHPRO01", "a"): r"\alpha",
    ("PearsonMATHPRO01", "b"): r"\beta", ("PearsonMATHPRO01", "u"): r"\mu", ("MSBM10", "∼"): r"\sim",
    ("MSAM10", "∽"): r"\sim", ("wasy9", "¢"): r"\text{\textcent}", ("wasy10", "\x02"): r"\square",
    ("MathematicalPi-One", "\x02"): r"\infty", ("MathematicalPiOneOblique", "u"): r"\mu", ("Symbol", "∂"): r"\partial",
    ("Symbol", "©"): r"\copyright",
}
# fixed values: characters that LaTeX reserves
TEXT_ESCAPES = {
    "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}",
    "^": r"\textasciicircum{}", "\\": r"\textbackslash{}",
}
# fixed values: names of functions and operators in formulas
FUNCTION_NAMES = (
    "arcsin", "arccos", "arctan", "sinh", "cosh", "tanh", "sin", "cos", "tan", "log", "ln", "exp", "max", "min",
    "sup", "inf", "lim", "det", "gcd", "Var", "Cov", "Corr", "SD", "E", "P",
)

#: All glyph names with a token of their own, in order of precedence.
NAMED = CLOSERS | OPENERS | BIG_OPERATORS | GLYPHS


def atom(text: str, name: str | None, font: str | None) -> str:
    """The token for a glyph, whatever its place; pieces and unknown codes are empty."""
    if name in NAMED:
        return NAMED[name]
    if font == "NewOptr2k" and text in NEWOPTR:
        return NEWOPTR[text]
    known = FONT_CHARACTERS.get((font, text), UNICODE.get(text))
    if known is not None:
        return known
    if name in EXTENSIONS or len(text) == 1 and text < " ":
        return ""
    return r"\$" if text == "$" else text


def is_tall(name: str | None) -> bool:
    """A big operator, radical or delimiter that spans rows."""
    return bool(name) and (
        name in BIG_OPERATORS or name in RADICALS or name in EXTENSIONS
        or (name in OPENERS or name in CLOSERS) and name.endswith(TALL_ENDINGS)
    )
