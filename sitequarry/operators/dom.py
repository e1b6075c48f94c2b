"""A tree of a page's elements, and selection in it by simple CSS selectors and paths."""

from __future__ import annotations

import re
from collections.abc import Iterator


class Node:
    __slots__ = ("tag", "attributes", "parent", "children")

    def __init__(self, tag: str, attributes: dict[str, str], parent: Node | None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """The elements below, in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, without: frozenset[str] = frozenset(), between: str = "") -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in without:
                stack.extend(reversed(c.children))
        return " ".join(between.join(out).split())

    def above(self) -> Iterator[Node]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


_PART = re.compile(r"""([A-Za-z][\w-]*|\*)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]""")


def _step(text: str):
    """What one compound selector asks of an element."""
    tests, at = [], 0
    for m in _PART.finditer(text):
        if m.start() != at:
            raise ValueError(f"cannot read selector {text!r}")
        at = m.end()
        tag, class_, id_, name, op = m[1], m[2], m[3], m[4], m[5]
        value = next((x for x in m.groups()[5:] if x is not None), None)
        if tag and tag != "*":
            tests.append(lambda n, tag=tag.lower(): n.tag == tag)
        elif class_:
            tests.append(lambda n, c=class_: c in n.attributes.get("class", "").split())
        elif id_:
            tests.append(lambda n, i=id_: n.attributes.get("id") == i)
        elif name:
            compare = {None: lambda a, v: True, "=": lambda a, v: a == v, "~=": lambda a, v: v in a.split(), "^=": lambda a, v: a.startswith(v), "$=": lambda a, v: a.endswith(v), "*=": lambda a, v: v in a, "|=": lambda a, v: a == v or a.startswith(v + "-")}[op]
            tests.append(lambda n, k=name.lower(), f=compare, v=value: k in n.attributes and f(n.attributes[k], v))
    if at != len(text) or not tests and text != "*":
        raise ValueError(f"cannot read selector {text!r}")
    return lambda n: all(t(n) for t in tests)


def compiled(selector: str):
    """A test of elements for a selector: compounds joined by blanks or >, alternatives by commas."""
    ways = []
    for one in selector.split(","):
        tokens = re.sub(r"\s*>\s*", " > ", one.strip()).split()
        if not tokens or tokens[0] == ">" or tokens[-1] == ">":
            raise ValueError(f"cannot read selector {selector!r}")
        steps, child = [], False
        for token in tokens:
            if token == ">":
                child = True
            else:
                steps.append((_step(token), child))
                child = False
        ways.append(steps)

    def fits(node: Node, steps) -> bool:
        test, child = steps[-1]
        if not test(node):
            return False
        if len(steps) == 1:
            return True
        ups = ([node.parent] if node.parent is not None else []) if child else node.above()
        return any(fits(up, steps[:-1]) for up in ups)

    return lambda node: any(fits(node, steps) for steps in ways)


_XSTEP = re.compile(r"(//?)(@[\w:-]+|text\(\)|[\w*-]+)((?:\[[^\]]*\])*)")
_XTEST = re.compile(r"\[\s*(?:(\d+)|@([\w:-]+)(?:\s*=\s*[\"']([^\"']*)[\"'])?|contains\(\s*@([\w:-]+)\s*,\s*[\"']([^\"']*)[\"']\s*\))\s*\]")


def by_path(root: Node, path: str) -> list[Node | str]:
    """Elements, attributes or texts of a path: / and // steps, names or *, [@a], [@a='v'], [contains(@a,'v')], [n], @a and text() last."""
    found: list = [root]
    at = 0
    for m in _XSTEP.finditer(path):
        if m.start() != at:
            raise ValueError(f"cannot read path {path!r}")
        at = m.end()
        axis, what, tests = m[1], m[2], m[3]
        if what.startswith("@"):
            nodes = found if axis == "/" else [n for f in found for n in (f, *f.walk())]
            return [n.attributes[what[1:]] for n in nodes if what[1:] in n.attributes] if at == len(path) else _bad(path)
        if what == "text()":
            return [t for f in found if (t := f.text())] if at == len(path) else _bad(path)
        out, seen = [], set()
        for f in found:
            own = [n for n in (f.walk() if axis == "//" else (c for c in f.children if isinstance(c, Node))) if what in ("*", n.tag)]
            if len("".join(x[0] for x in _XTEST.finditer(tests))) != len(tests):
                _bad(path)
            for x in _XTEST.finditer(tests):
                if x[1]:
                    ranks: dict[int, int] = {}
                    kept = []
                    for n in own:
                        ranks[id(n.parent)] = ranks.get(id(n.parent), 0) + 1
                        if ranks[id(n.parent)] == int(x[1]):
                            kept.append(n)
                    own = kept
                elif x[2]:
                    own = [n for n in own if x[2] in n.attributes and (x[3] is None or n.attributes[x[2]] == x[3])]
                else:
                    own = [n for n in own if x[5] in n.attributes.get(x[4], "")]
            for n in own:
                if id(n) not in seen:
                    seen.add(id(n))
                    out.append(n)
        found = out
    return found if at == len(path) and path else _bad(path)


def _bad(path: str):
    raise ValueError(f"cannot read path {path!r}")
