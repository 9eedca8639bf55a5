"""Source text without its comments and literals, and which brackets belong together.

One pattern a language finds comments and literals; both are blanked, so positions and lines stay. A stack over the
brackets that are left gives each its partner. Rules ask this text where code stands, what an argument list or a body
holds at its top level, and where it ends, at any depth of nesting.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

_SLASH, _BLOCK, _HASH = r"//[^\n]*", r"/\*(?s:.*?)(?:\*/|\Z)", r"#[^\n]*"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]++|\\.)*+"?', r"'(?:[^'\\\n]++|\\.)*+'?"
_RAW, _TEMPLATE = r"`[^`]*(?:`|\Z)", r"`(?:[^`\\]++|\\(?s:.))*+`?"
_TRIPLE = r'"""(?s:.*?)(?:"""|\Z)'
_C = [_SLASH, _BLOCK]
#: (extensions, comments, literals), each tried in this order.
SYNTAX = [
    ((".go",), _C, [_DOUBLE, _SINGLE, _RAW]),
    ((".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx"), _C, [_DOUBLE, _SINGLE, _TEMPLATE]),
    ((".java", ".kt", ".kts"), _C, [_TRIPLE, _DOUBLE, _SINGLE]),
    ((".py",), [_HASH], [_TRIPLE, r"'''(?s:.*?)(?:'''|\Z)", _DOUBLE, _SINGLE]),
    ((".tf", ".hcl"), [*_C, _HASH], [_DOUBLE]),
]
_ANY = re.compile(f"(?P<comment>{'|'.join([*_C, _HASH])})|(?P<literal>{'|'.join([_DOUBLE, _SINGLE, _TEMPLATE])})")
_OF = {e: re.compile(f"(?P<comment>{'|'.join(c)})|(?P<literal>{'|'.join(x)})") for exts, c, x in SYNTAX for e in exts}
#: What every comment and literal begins with: most files that hold none of it need no pattern.
_BEGINS = ("//", "/*", "#", '"', "'", "`")
CLOSES = {")": "(", "]": "[", "}": "{"}
_OPENS = re.compile(r"[(\[{]")
_BRACKETS = re.compile(r"[()\[\]{}]")
#: So far a bracket's partner is looked for before all brackets are matched.
NEAR = 1_000


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


class Source:
    """``code``: comments and what stands in literals blanked; ``text``: comments only; ``partner``: closing position by opening one."""

    def __init__(self, content: str, ext: str):
        self.content = content
        if not any(x in content for x in _BEGINS):
            self.code = self.text = content
            return
        code, text, at = [], [], 0
        for m in _OF.get(ext, _ANY).finditer(content):
            for parts in (code, text):
                parts.append(content[at : m.start()])
            found, at = m[0], m.end()
            text.append(_blank(found) if m["comment"] else found)
            closed = len(found) > 1 and found[-1] == found[0]
            code.append(_blank(found) if m["comment"] else found[0] + _blank(found[1 : len(found) - closed]) + found[0] * closed)
        for parts in (code, text):
            parts.append(content[at:])
        self.code, self.text = "".join(code), "".join(text)

    @cached_property
    def _breaks(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.content)]

    @property
    def partner(self) -> dict[int, int]:
        if "_partner" not in vars(self):
            self._partner, open_, waiting = {}, [], Counter()
            for m in _BRACKETS.finditer(self.code):
                wanted = CLOSES.get(m[0])
                if wanted is None:
                    open_.append(m.start())
                    waiting[m[0]] += 1
                while wanted and waiting[wanted]:  # a closing bracket without an opening one is left out
                    at = open_.pop()
                    waiting[self.code[at]] -= 1
                    if self.code[at] == wanted:
                        self._partner[at] = m.start()
                        break
        return self._partner

    def closing(self, opening: int) -> int | None:
        """The partner of one bracket, which mostly is near."""
        if "_partner" not in vars(self):
            open_ = []
            for m in _BRACKETS.finditer(self.code, opening, opening + NEAR):
                wanted = CLOSES.get(m[0])
                if wanted is None:
                    open_.append(m[0])
                elif open_.pop() != wanted:
                    break
                elif not open_:
                    return m.start()
        return self.partner.get(opening)

    def line(self, at: int) -> int:
        """1-based."""
        return 1 + bisect_right(self._breaks, at - 1)

    def inside(self, opening: int) -> tuple[int, int]:
        """Where the content of a bracket begins and ends; nothing, if it isn't closed."""
        return opening + 1, self.partner.get(opening, opening + 1)

    def top(self, opening: int) -> Iterator[tuple[int, str]]:
        """(position, code) of what stands in a bracket outside its inner brackets, which are left as "()" and so on."""
        at, end = self.inside(opening)
        while at < end:
            m = _OPENS.search(self.code, at, end)
            if not m:
                yield at, self.code[at:end]
                return
            yield at, self.code[at : m.end()]
            at = self.partner.get(m.start(), m.start() + 1)

    def arguments(self, opening: int) -> Iterator[tuple[str, int, int]]:
        """(code at the top level, where it begins and ends) of each argument."""
        begins, code = opening + 1, ""
        for at, piece in self.top(opening):
            *ended, last = piece.split(",")
            for part in ended:
                yield code + part, begins, at + len(part)
                at += len(part) + 1
                begins, code = at, ""
            code += last
        yield code, begins, self.inside(opening)[1]

    def statements(self, opening: int) -> list[str]:
        """The statements of a block, by semicolons, line ends and closed blocks."""
        code = "".join(piece for _, piece in self.top(opening))
        return [s for s in (x.strip() for x in re.split(r"[;\n}]", code)) if s]
