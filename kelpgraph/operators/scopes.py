"""One pass over the tokens of a source: brackets, classes, methods, variables and calls with their offsets.

Spark cuts sources into pieces and deals them by path (``extract.pieces``); here a
small machine follows one file's pieces in order, whatever Arrow batches they come
in, and says what it found when the file ends. It holds one file at a time.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from sys import intern

MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp"}
CONTROL = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "new", "else", "do", "try", "case", "assert", "super", "this", "instanceof", "throws", "extends", "implements", "package", "import"}
KINDS = {"class", "interface", "enum", "record"}
CLOSES = {")": "(", "}": "{", "]": "["}

#: What a file gives, one row each: kind is class, method, variable or call; the other columns as the kind needs them.
FIELDS = "kind string, path string, i int, class_name string, name string, n int, type string, callee_class string, caller string, field string, head int, start int, end int, code string"
COLUMNS = [c.split()[0] for c in FIELDS.split(", ")]


def _word(t: str | None) -> bool:
    return bool(t) and (t[0].isalpha() or t[0] in "_$") and t.isascii()


def _upper(t: str | None) -> bool:
    return bool(t) and "A" <= t[0] <= "Z"


def _lower(t: str | None) -> bool:
    return bool(t) and ("a" <= t[0] <= "z" or t[0] == "_")


class Numbers(array):
    """Places of tokens; -1 is none. Read as a list of places or None, or with ``get`` and ``in`` as a dictionary."""

    def __getitem__(self, i):
        found = array.__getitem__(self, i)
        return None if found < 0 else found

    def get(self, i: int, default: int | None = None) -> int | None:
        found = array.__getitem__(self, i) if 0 <= i < len(self) else -1
        return default if found < 0 else found

    def __contains__(self, i) -> bool:
        return self.get(i) is not None


class Scopes:
    """The machine of one file: ``feed`` every piece in order, then ``found``."""

    def __init__(self, path: str, with_code: bool = False):
        self.path, self.with_code = path, with_code
        self.t, self.start, self.lead = [], array("i"), array("i")  # a token is one pointer and a few numbers
        self.raw, self.chunk = [], []
        self.at, self.angles, self.pending = 0, [], None

    def feed(self, piece: str) -> None:
        """Comments and white space only move the offset; literals become one token; generics are taken back at their end."""
        begin, self.at, first = self.at, self.at + len(piece), piece[0]
        if self.with_code:
            self.chunk.append(piece)
            if len(self.chunk) >= 4096:
                self.raw.append("".join(self.chunk))
                self.chunk.clear()
        if first.isspace() or piece.startswith(("//", "/*")):
            return
        token = '""' if first in "\"'" and len(piece) > 1 else piece
        if token == ">" and self.angles:
            keep = self.angles.pop()
            self.pending = self.lead[keep]
            del self.t[keep:], self.start[keep:], self.lead[keep:]
            return
        if token == "<":
            self.angles.append(len(self.t))
        elif not (first in ".,?&[]_" or first.isascii() and first.isalnum()) or "$" in token:
            self.angles.clear()
        self.t.append(intern(token))
        self.start.append(begin)
        self.lead.append(begin if self.pending is None else self.pending)
        self.pending = None

    def _brackets(self) -> None:
        """Partner of every bracket, enclosing brace of every token, next opening brace, commas of every parenthesis."""
        n = len(self.t)
        none = array("i", [-1])
        self.partner, self.brace, self.next_brace, self.commas = Numbers("i", none * n), none * n, Numbers("i", none * (n + 1)), array("i", [0]) * n
        self.chain = none * n  # the first name of the dotted chain before a token
        stack, braces, chain = [], [], -1
        for i, t in enumerate(self.t):
            self.brace[i], self.chain[i] = braces[-1] if braces else -1, chain
            if t in "({[":
                stack.append(i)
                if t == "{":
                    braces.append(i)
            elif t in ")}]":
                while stack and self.t[stack[-1]] != CLOSES[t]:  # what was never closed
                    lost = stack.pop()
                    if braces and braces[-1] == lost:
                        braces.pop()
                if stack:
                    self.partner[stack[-1]] = i
                    self.partner[i] = stack[-1]
                    if braces and braces[-1] == stack.pop():
                        braces.pop()
            elif t == "," and stack and self.t[stack[-1]] == "(":
                self.commas[stack[-1]] += 1
            if _word(t) and (i == 0 or self.t[i - 1] != "."):
                chain = i
        for i in range(n - 1, -1, -1):
            self.next_brace[i] = i if self.t[i] == "{" else array.__getitem__(self.next_brace, i + 1)

    def _get(self, i: int) -> str | None:
        return self.t[i] if 0 <= i < len(self.t) else None

    def _row(self, kind: str, i: int, **more) -> tuple:
        row = {"kind": kind, "path": self.path, "i": i} | more
        return tuple(row.get(c) for c in COLUMNS)

    def _args(self, i: int) -> int:
        """How many arguments or parameters the name at ``i`` has."""
        return 0 if self.partner[i + 1] == i + 2 else self.commas[i + 1] + 1

    def _root(self, i: int) -> str | None:
        """The first name of the dotted chain that the call whose name is at ``i`` is made on; what follows ``this``, if it begins so."""
        before2, first = self._get(i - 2), self.chain[i]
        root = self.t[first] if self._get(i - 1) == "." and _word(before2) and first >= 0 else None
        return self._get(first + 2) if root == "this" and before2 != "this" else root

    def _classes(self) -> dict[int, str]:
        """Name of the class that an opening brace begins."""
        out, self.kinds = {}, []
        for i, t in enumerate(self.t):
            if t in KINDS and _word(self._get(i + 1)) and self._get(i - 1) != "." and self.next_brace[i] is not None:
                out[self.next_brace[i]] = self.t[i + 1]
                self.kinds.append((i, self.t[i + 1], t))
        return out

    def _member_start(self, i: int) -> int:
        """First token of the declaration that the name at ``i`` is in, annotations and modifiers included."""
        j = i - 1
        while j >= 0 and self.t[j] not in (";", "{", "}"):
            j = self.partner.get(j, j) - 1 if self.t[j] in (")", "]") else j - 1
        return j + 1

    def _expression_start(self, i: int) -> int:
        """First token of the receiver of the call whose name is at ``i``."""
        while self._get(i - 1) == ".":
            k = i - 2
            while self._get(k) in (")", "]") and k in self.partner:
                k = self.partner[k] - 1
                if not _word(self._get(k)) or self.t[k] in CONTROL and self.t[k] not in ("this", "super"):
                    return k + 1 if self._get(k) != "new" else k
            i = max(k, 0)
            if self._get(i - 1) == "new":
                return i - 1
        return i

    def found(self) -> Iterator[tuple]:
        self._brackets()
        owners = self._classes()
        get, t = self._get, self.t
        for i, name, kind in self.kinds:
            yield self._row("class", i, class_name=name, type=kind)
        heads, site = [], bytearray(len(t))
        for i, name in enumerate(t):
            close = self.partner.get(i + 1)
            if not _word(name) or get(i + 1) != "(" or close is None or name in CONTROL:
                continue
            args = self._args(i)
            before, then = get(i - 1), get(close + 1)
            typed = _word(before) and before not in CONTROL and before not in MODIFIERS or before == "]"
            if typed and then in ("{", "throws", ";"):
                owner = owners.get(self.brace[i])
                if owner is not None:
                    body = self.next_brace[close + 1] if then != ";" else None
                    stop = self.partner.get(body, i) if body is not None else i
                    returns = "array" if before == "]" else before
                    last = stop if body is not None else close + 1
                    heads.append((i, stop, owner, name, args, returns, self.lead[self._member_start(i)], self.start[last] + 1))
            elif before != "@":
                site[i] = 1
        arities, returned = {}, {}
        for i, _, owner, name, args, returns, start, end in heads:
            arities.setdefault((owner, name), set()).add(args)
            returned[owner, name] = returns
            yield self._row("method", i, class_name=owner, name=name, n=args, type=returns, start=start, end=end, code=self._code(start, end))
        inside = self._enclosing([h[:2] for h in heads])
        types: dict[tuple, str] = {}
        for i, name in enumerate(t):
            if _lower(name) and _upper(get(i - 1)) and get(i + 1) in ("=", ";", ":", ",", ")"):
                head = heads[inside[i]][0] if inside[i] is not None else None
                types[head, name] = t[i - 1]
                yield self._row("variable", i, name=name, type=t[i - 1], head=head)
        for i in range(len(t)):
            if not site[i]:
                continue
            before, before2 = get(i - 1), get(i - 2)
            if before == "new" or inside[i] is None:
                continue
            dotted, args, close = before == ".", self._args(i), self.partner[i + 1]
            inner = self.partner.get(i - 2, 0) - 1 if dotted and before2 == ")" else -1
            inner = inner if inner >= 0 and site[inner] else None
            root = self._root(i)
            if root is None and inner is not None:
                root = self._root(inner)
            head, _, owner, caller, *_ = heads[inside[i]]
            if not dotted or before2 in ("this", "super"):
                known = arities.get((owner, t[i]), ())
                if args not in known and len(known) != 1:
                    continue
                callee_class, kind = owner, "internal"
            else:
                callee_class, kind = self._receiver(i, head, root, inner, types, returned, owner), "external"
            yield self._row("call", i, class_name=owner, caller=caller, name=t[i], callee_class=callee_class, n=args, field=root, type=kind, head=head, start=self.start[self._expression_start(i)], end=self.start[close] + 1)

    def _receiver(self, i, head, root, inner, types, returned, owner) -> str:
        """A local variable or parameter, a field of the file, a static call, a literal, ``new``, a cast, the type a method returns."""
        for scope in (head, None):
            if root is not None and (scope, root) in types:
                return types[scope, root]
        if _upper(root):
            return root
        before2 = self._get(i - 2)
        if before2 == '""':
            return "String"
        if before2 == ")" and root is None:
            if inner is not None:
                return self.t[inner] if self._get(inner - 1) == "new" else returned.get((owner, self.t[inner]), "Unknown")
            a = self.partner.get(i - 2, -1)
            if a >= 0 and self._get(a + 1) == "(" and _upper(self._get(a + 2)) and self._get(a + 3) == ")":
                return self.t[a + 2]
        return "Unknown"

    def _enclosing(self, heads: list[tuple[int, int]]) -> Numbers:
        """For every token the innermost method whose head is at or before it and whose body ends behind it."""
        out, stack, k = Numbers("i", array("i", [-1]) * len(self.t)), [], 0
        for i in range(len(self.t)):
            while k < len(heads) and heads[k][0] == i:
                stack.append(k)
                k += 1
            while stack and heads[stack[-1]][1] <= i:
                stack.pop()
            out[i] = stack[-1] if stack else -1
        return out

    def _code(self, start: int, end: int) -> str | None:
        if not self.with_code:
            return None
        if isinstance(self.raw, list):
            self.raw = "".join(self.raw + self.chunk)
        return self.raw[start:end]


def follow(batches, with_code: bool):
    """Rows of ``FIELDS`` from Arrow batches of (path, i, t); a file may go over any number of them, and its first row says the path."""
    import pyarrow as pa

    types = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(c, types[k]) for c, k in (f.split() for f in FIELDS.split(", "))])

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), schema)], schema=schema)

    def parts(machine):
        """What a file gave, some thousand rows or some million letters of code at once."""
        rows, letters = [], 0
        for row in machine.found():
            rows.append(row)
            letters += len(row[-1] or "")
            if len(rows) >= 5000 or letters >= 1 << 22:
                yield told(rows)
                rows, letters = [], 0
        if rows:
            yield told(rows)

    machine = None
    for batch in batches:
        paths = batch.column(0)
        for k, (i, t) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            if i == 0:
                if machine is not None:
                    yield from parts(machine)
                machine = Scopes(paths[k].as_py(), with_code)
            machine.feed(t)
    if machine is not None:
        yield from parts(machine)


class ScopesOfPath:
    """The same as a table function: ``java_scopes(TABLE(pieces) PARTITION BY path ORDER BY i)``; ``t`` is a piece or a list of pieces that follow each other."""

    def __init__(self):
        self.machine = None

    def eval(self, row):
        path, t = row["path"], row["t"]
        if self.machine is None:
            self.machine = Scopes(path, True)
        for piece in (t,) if isinstance(t, str) else t:
            self.machine.feed(piece)

    def terminate(self):
        if self.machine is not None:
            yield from self.machine.found()
