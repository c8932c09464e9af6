"""The patterns of the heuristics, and their form in Java's dialect.

They are written once, in the dialect of RE2, which the scanner's rules and DuckDB share.
"""

from __future__ import annotations

#: Paths, environment variables, and commands on files.
TARGETS = (
    r"""(?:^|[\s"'])(/(?:etc|var|usr|tmp|opt|home|root|proc|sys|dev|bin|sbin)/[a-zA-Z0-9_./-]+)""",
    r"""(?i)(?:^|[\s"'])[a-zA-Z]:\\[a-zA-Z0-9\\._-]+""",
    r"""\$\{?[A-Z_][A-Z0-9_]{2,}\}?""",
    r"""(?i)(?:read|write|open|delete|remove|create|modify|execute|chmod|chown|curl|wget|fetch)\s+[/"'\$]""",
)
#: Roles that a text assigns.
ROLES = (r"(?i)(?:^|\n)\s*you\s+are\s+(?:now\s+)?(?:a\s+|the\s+|an\s+)?[a-z]+",)
#: Directives that override others.
DIRECTIVES = (
    r"(?i)from\s+now\s+on",
    r"(?i)(?:ignore|disregard|forget|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|earlier|original|old)",
    r"(?i)your\s+new\s+(?:role|instructions?|purpose|task|objective|mission|identity|persona|name)",
    r"(?i)(?:^|\n)\s*(?:\[?\s*(?:system|assistant|user)\s*(?:message|prompt|instruction)?\s*\]?\s*:)",
)
#: Encodings; and characters of the category Cf.
BASE64 = r"[A-Za-z0-9+/]{40,}={0,2}"
ESCAPE = r"\\u[0-9a-fA-F]{4}"
ENTITY = r"&(?:#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z]+);"
INVISIBLE = r"\p{Cf}"

#: RE2's white space: Java's has one character more.
SPACES = r"\t\n\f\r "
#: What RE2 folds with the letters s and k, and Java does not.
_FOLDED = {"s": r"\u017F", "k": r"\u212A"}


def java(pattern: str) -> str:
    """A pattern of RE2 in Java's dialect.

    White space is spelled out, the text's start is \\A, and letters that match in any case become classes.
    """
    blind = pattern.startswith("(?i)")
    rest = pattern.removeprefix("(?i)")
    out, inside, at = [], False, 0
    while at < len(rest):
        c = rest[at]
        if c == "\\":
            c = rest[at : at + 2]
            if c == r"\s":
                c = SPACES if inside else f"[{SPACES}]"
            at += 1
        elif inside:
            if blind and rest[at : at + 3] == "a-z":
                c = "a-zA-Z" + "".join(_FOLDED.values())
                at += 2
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "^":
            c = r"\A"
        elif blind and c.isalpha():
            c = f"[{c}{c.upper()}{_FOLDED.get(c, '')}]"
        out.append(c)
        at += 1
    return "".join(out)
