"""LaTeX formulas to Presentation MathML trees: a recursive-descent reader of the math-mode subset found in wiki pages.

Letters are identifiers of their own, digits run into numbers, and everything
that is written as an operator becomes one, function names too. Symbols keep
their entity names, which is what makes them index terms. Whatever is not
understood raises MathError, so that it can be counted.
"""

from __future__ import annotations

import re

from .macros import expand
from .mathtree import MathError, Node, element, text, token

#: Names set upright; all are operators. Two are written apart.
FUNCTIONS = (
    "arccos arcsin arctan arg cos cosh cot coth csc deg det dim exp gcd hom inf ker lg lcm lim liminf limsup "
    "ln log max min Pr sec sin sinh sup tan tanh "
    "sech csch arcsec arccsc arccot arccosh arcsinh arctanh arcsech arccsch arccoth"
).split()
WRITTEN = {"liminf": "lim inf", "limsup": "lim sup"}

#: Commands that are operators, with their symbol.
OPERATORS = {
    "mod": "mod", "pmod": "mod", "bmod": "mod", "choose": "choose",
    "to": "&ShortRightArrow;", "rightarrow": "&ShortRightArrow;", "leftarrow": "&ShortLeftArrow;",
    "leq": "&leq;", "le": "&leq;", "geq": "&GreaterEqual;", "ge": "&GreaterEqual;", "neq": "&NotEqual;", "ne": "&NotEqual;",
    "lnot": "&not;", "neg": "&not;", "vee": "&vee;", "lor": "&vee;", "wedge": "&wedge;", "land": "&wedge;",
    "times": "&times;", "div": "&div;", "cdot": "&sdot;", "pm": "&PlusMinus;", "mp": "&MinusPlus;", "ast": "*", "star": "&star;",
    "circ": "&SmallCircle;", "bullet": "&bull;", "oplus": "&CirclePlus;", "otimes": "&CircleTimes;", "ominus": "&CircleMinus;",
    "approx": "&approx;", "equiv": "&equiv;", "cong": "&cong;", "sim": "&sim;", "simeq": "&simeq;", "propto": "&prop;",
    "ll": "&ll;", "gg": "&gg;", "prec": "&pr;", "succ": "&sc;", "subset": "&sub;", "subseteq": "&sube;", "supset": "&sup;",
    "supseteq": "&supe;", "in": "&in;", "ni": "&ni;", "notin": "&notin;", "cup": "&cup;", "cap": "&cap;", "setminus": "&setminus;",
    "forall": "&forall;", "exists": "&exist;", "nabla": "&Del;", "partial": "&PartialD;", "perp": "&bottom;", "parallel": "&shortparallel;",
    "mid": "&shortmid;", "vdash": "&vdash;", "models": "&models;", "Rightarrow": "&Rightarrow;", "Leftarrow": "&Leftarrow;",
    "Leftrightarrow": "&Leftrightarrow;", "leftrightarrow": "&leftrightarrow;", "iff": "&iff;", "implies": "&Longrightarrow;",
    "longrightarrow": "&longrightarrow;", "mapsto": "&map;", "hookrightarrow": "&hookrightarrow;", "uparrow": "&uparrow;",
    "downarrow": "&downarrow;", "colon": ":", "vert": "|", "Vert": "&Vert;", "prime": "&prime;", "backslash": "\\",
    "{": "{", "}": "}", "|": "&Vert;", "%": "%", "#": "#", "&": "&amp;", "$": "$", "_": "_",
    "leqslant": "&les;", "geqslant": "&ges;", "nleq": "&nle;", "ngeq": "&nge;", "nless": "&nlt;", "ngtr": "&ngt;", "leqq": "&lE;", "geqq": "&gE;",
    "lesssim": "&lsim;", "gtrsim": "&gsim;", "triangleq": "&trie;", "doteq": "&esdot;", "asymp": "&asympeq;", "bowtie": "&bowtie;",
    "preceq": "&pre;", "succeq": "&sce;", "subsetneq": "&subne;", "supsetneq": "&supne;", "nsubseteq": "&nsube;", "nsupseteq": "&nsupe;",
    "sqsubset": "&sqsub;", "sqsubseteq": "&sqsube;", "sqsupset": "&sqsup;", "sqsupseteq": "&sqsupe;", "sqcup": "&sqcup;", "sqcap": "&sqcap;",
    "uplus": "&uplus;", "amalg": "&amalg;", "wr": "&wr;", "diamond": "&diamond;", "odot": "&odot;", "oslash": "&osol;", "dagger": "&dagger;", "ddagger": "&Dagger;",
    "nexists": "&nexist;", "dashv": "&dashv;", "Vdash": "&Vdash;", "vDash": "&vDash;", "smile": "&smile;", "frown": "&frown;", "nmid": "&nmid;",
    "ltimes": "&ltimes;", "rtimes": "&rtimes;", "smallsetminus": "&setminus;", "therefore": "&therefore;", "because": "&because;",
    "gets": "&ShortLeftArrow;", "longleftarrow": "&longleftarrow;", "longleftrightarrow": "&longleftrightarrow;", "longmapsto": "&longmapsto;",
    "Longrightarrow": "&Longrightarrow;", "Longleftarrow": "&Longleftarrow;", "Longleftrightarrow": "&Longleftrightarrow;", "impliedby": "&Longleftarrow;",
    "hookleftarrow": "&hookleftarrow;", "rightharpoonup": "&rharu;", "rightleftharpoons": "&rlhar;", "twoheadrightarrow": "&Rarr;", "rightsquigarrow": "&rarrw;",
    "updownarrow": "&varr;", "Uparrow": "&uArr;", "Downarrow": "&dArr;", "nearrow": "&nearr;", "searrow": "&searr;", "swarrow": "&swarr;", "nwarrow": "&nwarr;",
    "lbrace": "{", "rbrace": "}", "lbrack": "[", "rbrack": "]", "lvert": "|", "rvert": "|", "lVert": "&Vert;", "rVert": "&Vert;",
    "langle": "&lang;", "rangle": "&rang;", "lfloor": "&lfloor;", "rfloor": "&rfloor;", "lceil": "&lceil;", "rceil": "&rceil;",
    "lgroup": "&lpargt;", "rgroup": "&rpargt;", "ulcorner": "&ulcorn;", "urcorner": "&urcorn;", "llcorner": "&dlcorn;", "lrcorner": "&drcorn;",
    "rightharpoondown": "&rhard;", "leftharpoonup": "&lharu;", "leftharpoondown": "&lhard;", "leftrightharpoons": "&lrhar;", "Updownarrow": "&vArr;",
    "upharpoonright": "&uharr;", "upharpoonleft": "&uharl;", "downharpoonright": "&dharr;", "downharpoonleft": "&dharl;", "rightrightarrows": "&rrarr;",
    "leftleftarrows": "&llarr;", "rightleftarrows": "&rlarr;", "leftrightarrows": "&lrarr;", "upuparrows": "&uuarr;", "downdownarrows": "&ddarr;",
    "rightarrowtail": "&rarrtl;", "leftarrowtail": "&larrtl;", "twoheadleftarrow": "&Larr;", "nrightarrow": "&nrarr;", "nleftarrow": "&nlarr;",
    "nRightarrow": "&nrArr;", "nLeftarrow": "&nlArr;", "nleftrightarrow": "&nharr;", "nLeftrightarrow": "&nhArr;", "leadsto": "&rarrw;", "lhd": "&vltri;",
    "rhd": "&vrtri;", "unlhd": "&ltrie;", "unrhd": "&rtrie;", "triangleleft": "&ltri;", "triangleright": "&rtri;", "approxeq": "&ape;", "thickapprox": "&approx;",
    "thicksim": "&sim;", "backsim": "&bsim;", "eqsim": "&esim;", "nsim": "&nsim;", "ncong": "&ncong;", "nparallel": "&npar;", "nvdash": "&nvdash;",
    "nvDash": "&nvDash;", "Vvdash": "&Vvdash;", "boxplus": "&plusb;", "boxminus": "&minusb;", "boxtimes": "&timesb;", "boxdot": "&sdotb;", "dotplus": "&plusdo;",
    "ggg": "&Gg;", "lll": "&Ll;", "lessgtr": "&lg;", "gtrless": "&gl;", "barwedge": "&barwed;", "veebar": "&veebar;", "curlyvee": "&cuvee;", "curlywedge": "&cuwed;",
    "multimap": "&mumap;", "between": "&between;", "pitchfork": "&fork;", "varpropto": "&prop;", "circledast": "&oast;", "circledcirc": "&ocir;", "divideontimes": "&divonx;",
}

#: Large operators, whose scripts stand below and above them.
LARGE = {
    "sum": "&Sum;", "prod": "&Product;", "coprod": "&Coproduct;", "int": "&Integral;", "oint": "&ContourIntegral;", "iint": "&Int;",
    "iiint": "&iiint;", "bigcup": "&bigcup;", "bigcap": "&bigcap;", "bigvee": "&bigvee;", "bigwedge": "&bigwedge;",
    "bigoplus": "&bigoplus;", "bigotimes": "&bigotimes;", "bigsqcup": "&bigsqcup;", "biguplus": "&biguplus;", "bigodot": "&bigodot;",
    "oiint": "&Conint;", "oiiint": "&Cconint;", "idotsint": "&Integral;",
}
LIMITS = ("lim", "liminf", "limsup", "max", "min", "sup", "inf", "det", "gcd", "Pr")
SIDEWAYS = ("int", "oint", "iint", "iiint", "oiint", "oiiint", "idotsint")

#: Greek letters keep their names.
GREEK = (
    "alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho "
    "sigma varsigma tau upsilon phi varphi chi psi omega Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega"
).split()
#: Other identifiers.
SYMBOLS = {
    "infty": "&infin;", "ell": "&ell;", "hbar": "&hbar;", "Re": "&Re;", "Im": "&Im;", "wp": "&wp;", "aleph": "&aleph;",
    "emptyset": "&empty;", "varnothing": "&empty;", "imath": "&imath;", "jmath": "&jmath;", "angle": "&angle;", "top": "&top;",
    "bot": "&bottom;", "dots": "&ctdot;", "ldots": "&hellip;", "cdots": "&ctdot;", "vdots": "&vellip;", "ddots": "&dtdot;",
    "triangle": "&triangle;", "square": "&square;", "Box": "&square;", "complement": "&comp;", "beth": "&beth;", "gimel": "&gimel;", "eth": "&eth;",
    "hslash": "&hbar;", "clubsuit": "&clubs;", "diamondsuit": "&diams;", "heartsuit": "&hearts;", "spadesuit": "&spades;", "flat": "&flat;",
    "natural": "&natur;", "sharp": "&sharp;", "surd": "&Sqrt;", "digamma": "&gammad;", "dotsb": "&ctdot;", "dotsc": "&hellip;", "S": "&sect;", "P": "&para;",
}

#: Spaces.
SPACES = (",", ":", ";", "!", " ", "quad", "qquad", "hspace", "enspace", "thinspace", "medspace", "thickspace", "~")
#: Accents above and below, with their symbol.
ABOVE = {
    "hat": "&Hat;", "widehat": "&Hat;", "bar": "&OverBar;", "overline": "&OverBar;", "vec": "&rightarrow;", "overrightarrow": "&rightarrow;",
    "dot": "&dot;", "ddot": "&Dot;", "tilde": "&sim;", "widetilde": "&sim;", "check": "&caron;", "breve": "&breve;", "acute": "&acute;",
    "grave": "&grave;", "overbrace": "&OverBrace;", "dddot": "&tdot;", "ddddot": "&DotDot;", "mathring": "&ring;", "overleftarrow": "&leftarrow;",
    "overleftrightarrow": "&leftrightarrow;", "overparen": "&OverParenthesis;", "wideparen": "&OverParenthesis;", "overbracket": "&OverBracket;",
}
#: Arrows that stretch under their text.
ARROWS = {"xrightarrow": "&rightarrow;", "xleftarrow": "&leftarrow;"}
#: Commands between two halves of a group: with a line or without.
HALVES = ("over", "atop")
BELOW = {
    "underline": "&UnderBar;", "underbrace": "&UnderBrace;", "underleftarrow": "&leftarrow;", "underrightarrow": "&rightarrow;", "underbracket": "&UnderBracket;",
}
#: Old names of wiki pages, and names of one meaning with another command.
ALIASES = {
    "R": r"\mathbb{R}", "N": r"\mathbb{N}", "Z": r"\mathbb{Z}", "Q": r"\mathbb{Q}", "C": r"\mathbb{C}", "H": r"\mathbb{H}", "reals": r"\mathbb{R}", "Reals": r"\mathbb{R}",
    "natnums": r"\mathbb{N}", "cnums": r"\mathbb{C}", "Complex": r"\mathbb{C}", "infin": r"\infty", "isin": r"\in", "sdot": r"\cdot", "part": r"\partial", "exist": r"\exists",
    "and": r"\land", "or": r"\lor", "lang": r"\langle", "rang": r"\rangle", "plusmn": r"\pm", "alef": r"\aleph", "alefsym": r"\aleph", "bull": r"\bullet", "real": r"\Re",
    "image": r"\Im", "weierp": r"\wp", "empty": r"\emptyset", "sub": r"\subset", "sube": r"\subseteq", "supe": r"\supseteq", "thetasym": r"\vartheta", "sect": r"\S", "ang": r"\angle",
    "larr": r"\leftarrow", "rarr": r"\rightarrow", "uarr": r"\uparrow", "darr": r"\downarrow", "harr": r"\leftrightarrow", "lrarr": r"\leftrightarrow", "lArr": r"\Leftarrow",
    "Larr": r"\Leftarrow", "rArr": r"\Rightarrow", "Rarr": r"\Rightarrow", "uArr": r"\Uparrow", "Uarr": r"\Uparrow", "dArr": r"\Downarrow", "Darr": r"\Downarrow", "hArr": r"\Leftrightarrow",
    "Harr": r"\Leftrightarrow", "lrArr": r"\Leftrightarrow", "Lrarr": r"\Leftrightarrow", "clubs": r"\clubsuit", "diamonds": r"\diamondsuit", "hearts": r"\heartsuit",
    "spades": r"\spadesuit", "Dagger": r"\ddagger", "restriction": r"\upharpoonright", "O": r"\emptyset", "sgn": r"\operatorname{sgn}", "Alpha": r"\mathrm{A}", "Beta": r"\mathrm{B}",
    "Epsilon": r"\mathrm{E}", "Zeta": r"\mathrm{Z}", "Eta": r"\mathrm{H}", "Iota": r"\mathrm{I}", "Kappa": r"\mathrm{K}", "Mu": r"\mathrm{M}", "Nu": r"\mathrm{N}", "Omicron": r"\mathrm{O}",
    "Rho": r"\mathrm{P}", "Tau": r"\mathrm{T}", "Chi": r"\mathrm{X}", "omicron": r"\mathrm{o}", "varGamma": r"\Gamma", "varDelta": r"\Delta", "varTheta": r"\Theta", "varLambda": r"\Lambda",
    "varXi": r"\Xi", "varPi": r"\Pi", "varSigma": r"\Sigma", "varUpsilon": r"\Upsilon", "varPhi": r"\Phi", "varPsi": r"\Psi", "varOmega": r"\Omega", "varkappa": r"\kappa",
    "projlim": r"\operatorname{proj lim}", "injlim": r"\operatorname{inj lim}",
}
#: Commands whose group, or groups, say nothing about the tree.
SILENT = {"tag": 1, "label": 1, "hline": 0, "vspace": 1, "hphantom": 1, "vphantom": 1, "rule": 2, "ensuremath": 0, "strut": 0, "mathstrut": 0, "allowbreak": 0, "displaylimits": 0}
#: Commands that set their argument in another face, or change the size of what follows; the tree is the same.
FACES = ("mathrm", "mathbf", "mathit", "mathsf", "mathtt", "mathcal", "mathbb", "mathfrak", "boldsymbol", "operatorname", "mathscr", "pmb", "bold", "mathop", "mathbin", "mathrel", "mathord", "boldmath")
SIZES = ("displaystyle", "textstyle", "scriptstyle", "scriptscriptstyle", "limits", "nolimits", "rm", "bf", "it", "big", "Big", "bigg", "Bigg",
         "bigl", "bigr", "Bigl", "Bigr", "biggl", "biggr", "Biggl", "Biggr", "bigm", "nonumber", "notag")
TEXTS = ("text", "mbox", "hbox", "textrm", "textbf", "textit", "textsf", "texttt")

FENCES = {"(": ")", "[": "]"}
FENCE_NAMES = {"lbrace": "{", "rbrace": "}", "lbrack": "[", "rbrack": "]", "lvert": "|", "rvert": "|", "lVert": "|", "rVert": "|", "{": "{", "}": "}", "langle": "<", "rangle": ">", "lfloor": "l", "rfloor": "r", "lceil": "l", "rceil": "r", "|": "|", "vert": "|", "Vert": "|",
               "uparrow": "u", "downarrow": "d", "updownarrow": "b", "Uparrow": "u", "Downarrow": "d", "Updownarrow": "b", "lgroup": "(", "rgroup": ")", "lmoustache": "(", "rmoustache": ")",
               "ulcorner": "l", "urcorner": "r", "llcorner": "l", "lrcorner": "r", "backslash": "/", "lang": "<", "rang": ">"}
TABLES = ("matrix", "pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "smallmatrix", "cases", "array", "align", "align*", "aligned",
          "eqnarray", "eqnarray*", "gather", "gather*", "gathered", "split", "alignat", "alignat*", "alignedat", "multline", "multline*", "subarray", "dcases", "rcases", "equation", "equation*")
#: Environments with an argument before their rows.
WITH_ARGUMENT = ("array", "alignat", "alignat*", "alignedat", "subarray")
FENCED_TABLES = ("pmatrix", "bmatrix", "Bmatrix", "vmatrix", "Vmatrix", "cases", "dcases", "rcases")

_LEX = re.compile(r"%[^\n]*(?:\n|$)|(?P<space>\s+)|\\(?P<name>[A-Za-z]+)\*?|\\(?P<mark>.)|(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<char>.)", re.S)


class _Reader:
    def __init__(self, source: str):
        self.source = source
        self.tokens: list[tuple[str, str, int, int]] = []
        for m in _LEX.finditer(source):
            kind = m.lastgroup
            if kind and kind != "space":
                self.tokens.append((kind, m[kind], m.start(), m.end()))
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at][:2] if self.at < len(self.tokens) else ("end", "")

    def next(self) -> tuple[str, str]:
        t = self.peek()
        if t[0] == "end":
            raise MathError("formula ends early")
        self.at += 1
        return t

    def expect(self, char: str) -> None:
        if self.next() != ("char", char):
            raise MathError(f"{char} expected")

    # a list of items up to one of the ends, which is left standing
    def row(self, *ends: tuple[str, str]) -> list[Node]:
        items: list[Node] = []
        while self.peek() not in ends:
            if self.peek()[0] == "end":
                if ("end", "") in ends:
                    break
                raise MathError("formula ends early")
            if self.peek()[0] == "name" and self.peek()[1] in HALVES:
                self.next()
                return [element("mfrac", self.as_one(items), self.as_one(self.row(*ends)))]
            items += self.row_of(self.scripted())
        return items

    def scripted(self) -> Node | list[Node]:
        kind, value = self.peek()
        base: Node | list[Node] | None = None if (kind, value) in (("char", "^"), ("char", "_"), ("char", "'")) else self.item()
        limits = isinstance(base, Node) and kind == "name" and (value in LIMITS or value in LARGE and value not in SIDEWAYS)
        low = high = None
        while self.peek() in (("char", "^"), ("char", "_"), ("char", "'")) or self.peek() in (("name", "limits"), ("name", "nolimits")):
            _, mark = self.next()
            if mark in ("limits", "nolimits"):
                limits = mark == "limits"
            elif mark == "'":
                primes = "&prime;"
                while self.peek() == ("char", "'"):
                    self.next()
                    primes += "&prime;"
                high = token("mo", primes) if high is None else element("mrow", high, token("mo", primes))
            elif mark == "^":
                if high is not None and high.name != "mo":
                    raise MathError("two superscripts")
                high = self.argument() if high is None else element("mrow", high, self.argument())
            elif low is not None:
                raise MathError("two subscripts")
            else:
                low = self.argument()
        if low is None and high is None:
            return [] if base is None else base
        rest: list[Node] = []
        if isinstance(base, list):  # scripts go to the last of several
            rest, base = base[:-1], base[-1] if base else None
        base = element("mrow") if base is None else base
        if low is not None and high is not None:
            whole = element("munderover" if limits else "msubsup", base, low, high)
        elif low is not None:
            whole = element("munder" if limits else "msub", base, low)
        else:
            whole = element("mover" if limits else "msup", base, high)
        return [*rest, whole] if rest else whole

    def argument(self) -> Node:
        """What a command or script takes: a group or the next item."""
        while self.peek()[0] == "name" and self.peek()[1] in SIZES:
            self.next()
        if self.peek() == ("char", "{"):
            return self.group()
        if self.peek()[0] == "number" and len(self.peek()[1]) > 1:  # a single digit of a longer number
            kind, value, start, stop = self.tokens[self.at]
            self.tokens[self.at] = (kind, value[1:], start + 1, stop)
            return token("mn", value[0])
        item = self.item()
        return self.as_one(item) if isinstance(item, list) else item

    @staticmethod
    def row_of(item: Node | list[Node]) -> list[Node]:
        return item if isinstance(item, list) else [item]

    def group(self) -> Node:
        self.expect("{")
        items = self.row(("char", "}"))
        self.next()
        return self.as_one(items)

    @staticmethod
    def as_one(items: list[Node]) -> Node:
        return items[0] if len(items) == 1 else element("mrow", *items)

    def optional(self) -> Node | None:
        if self.peek() != ("char", "["):
            return None
        self.next()
        items = self.row(("char", "]"))
        self.next()
        return self.as_one(items)

    def raw(self) -> str:
        """The characters of a group."""
        self.expect("{")
        start, depth = self.tokens[self.at - 1][3], 1
        while depth:
            kind, value = self.next()
            depth += (kind == "char" and value == "{") - (kind == "char" and value == "}")
        return self.source[start : self.tokens[self.at - 1][2]]

    def item(self) -> Node | list[Node]:
        kind, value = self.next()
        if kind == "number":
            return token("mn", value)
        if kind in ("name", "mark"):
            return self.command(value)
        if value == "{":
            self.at -= 1
            return self.group()
        if value in FENCES:
            close = self.closing(value)
            if close is None:
                return token("mo", value)
            inside = self.row(("char", FENCES[value]))
            self.next()
            return self.fenced(inside)
        if value == "}":
            raise MathError("} without {")
        if value == "&":
            raise MathError("& outside a table")
        if value == "~":
            return element("mspace")
        return token("mi" if value.isalpha() else "mo", value)

    def closing(self, fence: str) -> int | None:
        """Place of the bracket that closes the one just read, in the same group; None if it stays open."""
        depth = groups = 0
        for k in range(self.at, len(self.tokens)):
            kind, value = self.tokens[k][:2]
            if kind == "name" and value in ("left", "begin"):
                groups += 1
            elif kind == "name" and value in ("right", "end"):
                groups -= 1
            if kind == "char":
                groups += (value == "{") - (value == "}")
                if groups == 0 and value == fence:
                    depth += 1
                elif groups == 0 and value == FENCES[fence]:
                    if depth == 0:
                        return k
                    depth -= 1
                elif groups == 0 and value == "&":
                    return None
            elif kind == "mark" and value == "\\" and groups == 0:
                return None
            if groups < 0:
                return None
        return None

    @staticmethod
    def fenced(inside: list[Node]) -> Node:
        return element("mfenced", *(inside if len(inside) <= 1 else [element("mrow", *inside)]))

    def delimiter(self) -> None:
        kind, value = self.next()
        if not (kind == "char" and value in "()[]|/.<>" or kind in ("name", "mark") and value in FENCE_NAMES):
            raise MathError(f"{value} is no delimiter")

    def command(self, name: str) -> Node | list[Node]:
        if name in FUNCTIONS:
            return token("mo", WRITTEN.get(name, name))
        if name in LARGE:
            return token("mo", LARGE[name])
        if name in OPERATORS:
            return token("mo", OPERATORS[name])
        if name in GREEK:
            return token("mi", f"&{name};")
        if name in SYMBOLS:
            return token("mi", SYMBOLS[name])
        if name in ALIASES:
            return _Reader(ALIASES[name]).row(("end", ""))
        if name in SILENT:
            for _ in range(SILENT[name]):
                self.raw()
            return []
        if name == "middle":
            kind, value = self.peek()
            self.delimiter()
            return token("mo", OPERATORS.get(value, value) if kind != "char" else value)
        if name == "phantom":
            return element("mphantom", self.argument())
        if name in ("boxed", "fbox", "cancel", "bcancel", "xcancel"):
            return element("menclose", self.argument())
        if name == "genfrac":
            fences = [self.raw() for _ in range(4)][:2]
            whole = element("mfrac", self.argument(), self.argument())
            return element("mfenced", whole) if any(f.strip() for f in fences) else whole
        if name == "buildrel":
            above: list[Node] = []
            while self.peek() != ("name", "over"):
                above += self.row_of(self.scripted())
            self.next()
            return element("mover", self.argument(), self.as_one(above))
        if name in SPACES:
            if name == "hspace":
                self.raw()
            return element("mspace")
        if name in SIZES:
            return []
        if name in FACES:
            return self.argument()
        if name in TEXTS:
            return element("mtext", text(self.raw().strip())) if self.peek() == ("char", "{") else self.argument()
        if name in ABOVE:
            return element("mover", self.argument(), token("mo", ABOVE[name]))
        if name in BELOW:
            return element("munder", self.argument(), token("mo", BELOW[name]))
        if name in ("frac", "dfrac", "tfrac", "cfrac"):
            return element("mfrac", self.argument(), self.argument())
        if name in ARROWS:
            below, above = self.optional(), self.argument()
            arrow = token("mo", ARROWS[name])
            return element("munderover", arrow, below, above) if below else element("mover", arrow, above)
        if name in ("color", "textcolor"):
            self.raw()
            return [] if name == "color" else self.argument()
        if name == "substack":
            self.expect("{")
            lines = []
            while True:
                lines.append(element("mtr", element("mtd", *self.row(("char", "}"), ("mark", "\\")))))
                if self.next() == ("char", "}"):
                    break
            return element("mtable", *lines)
        if name == "sideset":
            left, right = self.argument(), self.argument()
            return [left, self.as_one(self.row_of(self.scripted())), right]
        if name in ("binom", "tbinom", "dbinom"):
            return element("mfenced", element("mfrac", self.argument(), self.argument()))
        if name == "sqrt":
            index = self.optional()
            body = self.argument()
            return element("mroot", body, index) if index else element("msqrt", body)
        if name == "root":
            start = self.at
            index = []
            while self.peek()[0] != "end" and self.peek() != ("name", "of"):
                index.append(self.next())
            if self.peek() != ("name", "of"):
                self.at = start
                return element("mrow")
            self.at = start
            inside = self.row(("name", "of"))
            self.next()
            return element("mroot", self.argument(), self.as_one(inside))
        if name in ("stackrel", "overset"):
            above, base = self.argument(), self.argument()
            return element("mover", base, above)
        if name == "underset":
            below, base = self.argument(), self.argument()
            return element("munder", base, below)
        if name == "left":
            self.delimiter()
            inside = self.row(("name", "right"))
            self.next()
            self.delimiter()
            return self.fenced(inside)
        if name == "not":
            item = self.item()
            if isinstance(item, list) or item.name != "mo":
                raise MathError("\\not takes an operator")
            return token("mo", "&NotEqual;" if item.children[0].name == "=" else f"&not;{item.children[0].name}")
        if name == "begin":
            return self.environment()
        raise MathError(f"\\{name} is not known")

    def environment(self) -> Node:
        name = self.raw()
        if name not in TABLES:
            raise MathError(f"environment {name} is not known")
        if name in WITH_ARGUMENT:
            self.optional()
            self.raw()
        rows: list[Node] = []
        cells: list[Node] = []
        while True:
            inside = self.row(("char", "&"), ("mark", "\\"), ("name", "end"))
            _, mark = self.next()
            cells.append(element("mtd", *inside))
            if mark == "&":
                continue
            if mark == "\\" or len(cells) > 1 or cells[0].children:
                rows.append(element("mtr", *cells))
            cells = []
            if mark == "end":
                break
        if self.raw() != name:
            raise MathError(f"{name} is not ended")
        whole = element("mtable", *rows)
        return element("mfenced", whole) if name in FENCED_TABLES else whole


def parse(latex: str) -> Node:
    """The <math> tree of a formula in display style. Its own definitions hold."""
    reader = _Reader(expand(latex))
    return element("math", *reader.row(("end", "")))
