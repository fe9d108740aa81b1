"""Possible values of one variable through C code: statements are run in order on sets of names.

A state is what the variable can hold at a place: unknown, or a set of names with how they are known.
Running a statement on a state gives the state behind it and whether the code ends there. What can't
be told is unknown, and unknown joined with anything stays so.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, replace

TOKEN = re.compile(r"[A-Za-z_]\w*|->|==|!=|<=|>=|[-+*/%&|^]=|<<=|>>=|\d\w*|\S")
NAME = re.compile(r"[A-Za-z_]\w*")
DEEPEST = 120


@dataclass(frozen=True)
class State:
    names: tuple[str, ...] | None = None
    kind: str = ""
    fell: frozenset = frozenset()  # the names that came from the case above

    def join(self, other: State) -> State:
        if self.names is None or other.names is None:
            return UNKNOWN
        names = tuple(dict.fromkeys(self.names + other.names))
        return State(names, self.kind if self.kind == other.kind else "", self.fell | other.fell)


UNKNOWN = State()


@dataclass
class Change:
    line: int
    rhs: str
    via: str
    before: State
    fell: list[tuple[str, int]]


class Scan:
    """The assignments to `var` in code without comments, strings and directives; helpers: names of functions with the place of the argument that they assign."""

    def __init__(self, code: str, var: str, helpers: dict[str, int] | None = None):
        self.code, self.var, self.helpers = code, var, helpers or {}
        self.tokens = [(m[0], m.start()) for m in TOKEN.finditer(code)]
        # where the name is a member anywhere, a bare one is a local variable of the same name
        self.member = re.search(rf"(?:->|\.)\s*{re.escape(var)}\b", code) is not None
        self.starts = [0, *(m.end() for m in re.finditer("\n", code))]
        self.at, self.deep = 0, 0
        self.found: list[Change] = []
        self.set_at: dict[str, int] = {}
        self.breaks: list[list[State] | None] = []

    def run(self) -> list[Change]:
        while self.at < len(self.tokens):
            if self.look() == "{":
                if self.at and self.look(-1) == "=":
                    self.skip("{", "}")
                else:
                    self.block(UNKNOWN)
            else:
                self.at += 1
        return self.found

    def look(self, ahead: int = 0) -> str:
        i = self.at + ahead
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def line(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)

    def skip(self, opened: str, closed: str) -> tuple[int, int]:
        """Passes over a bracketed run; its first and last token."""
        first, depth = self.at, 0
        while self.at < len(self.tokens):
            depth += (self.look() == opened) - (self.look() == closed)
            self.at += 1
            if depth == 0:
                break
        return first, self.at - 1

    def is_var(self, i: int) -> bool:
        if self.tokens[i][0] != self.var:
            return False
        dotted = i > 0 and self.tokens[i - 1][0] in ("->", ".")
        return dotted or not self.member

    def condition(self) -> tuple[tuple[str, ...], bool]:
        """(names that the variable is held equal to, whether it is looked at) of the brackets that follow."""
        if self.look() != "(":
            return (), False
        a, b = self.skip("(", ")")
        words = [t for t, _ in self.tokens[a : b + 1]]
        seen = [i for i in range(a, b + 1) if self.is_var(i)]
        text = " ".join(words)
        if re.search(rf"! (?:\( )*(?:\w+ (?:->|\.) )*{re.escape(self.var)}\b", text) or any(self.tokens[i + 1][0] == "!=" for i in seen if i < b):
            return (), bool(seen)
        return tuple(self.tokens[i + 2][0] for i in seen if i + 2 <= b and self.tokens[i + 1][0] == "==" and NAME.fullmatch(self.tokens[i + 2][0])), bool(seen)

    def block(self, state: State) -> tuple[State, bool]:
        self.at += 1
        ended = False
        while self.at < len(self.tokens) and self.look() != "}":
            state, ended = self.statement(state)
        self.at += 1
        return state, ended

    def statement(self, state: State) -> tuple[State, bool]:
        word = self.look()
        if self.deep > DEEPEST and word == "{":  # nothing can be told so deep
            self.skip("{", "}")
            return UNKNOWN, False
        self.deep += 1
        try:
            return getattr(self, f"do_{word}", self.plain)(state) if word.isalpha() else self.block(state) if word == "{" else self.plain(state)
        finally:
            self.deep -= 1

    def do_if(self, state: State) -> tuple[State, bool]:
        self.at += 1
        names, _ = self.condition()
        then, gone = self.statement(State(names, "if") if names else state)
        other, other_gone = state, False
        if self.look() == "else":
            self.at += 1
            other, other_gone = self.statement(state)
        if gone or other_gone:
            return (other, other_gone) if gone else (then, False)
        return other.join(then), False

    def do_else(self, state: State) -> tuple[State, bool]:
        self.at += 1
        return state, False

    def loop(self, state: State) -> tuple[State, bool]:
        self.breaks.append(None)
        out, gone = self.statement(state)
        self.breaks.pop()
        return (state if gone else state.join(out)), False

    def do_while(self, state: State) -> tuple[State, bool]:
        self.at += 1
        self.condition()
        return self.loop(state)

    do_for = do_while

    def do_do(self, state: State) -> tuple[State, bool]:
        self.at += 1
        out, _ = self.loop(state)
        if self.look() == "while":
            self.at += 1
            self.condition()
            self.at += self.look() == ";"
        return out, False

    def leave(self, state: State) -> tuple[State, bool]:
        if self.look() == "break" and self.breaks and self.breaks[-1] is not None:
            self.breaks[-1].append(state)
        self.semicolon()
        return state, True

    do_return = do_break = do_continue = do_goto = leave

    def semicolon(self) -> int:
        """Passes over the rest of a statement; the token behind its last one."""
        while self.at < len(self.tokens) and self.look() not in (";", "}"):
            if self.look() == "(":
                self.skip("(", ")")
            elif self.look() == "{":
                self.skip("{", "}")
            else:
                self.at += 1
        end = self.at
        self.at += self.look() == ";"
        return end

    def label(self) -> str:
        """The name of the case label that begins here; empty for default and for what is no name."""
        first = self.at
        while self.at < len(self.tokens) and self.look() not in (":", ";", "{", "}"):
            self.at += 1
        words = [t for t, _ in self.tokens[first : self.at]]
        self.at += self.look() == ":"
        return words[1] if len(words) == 2 and words[0] == "case" and NAME.fullmatch(words[1]) else ""

    def do_case(self, state: State) -> tuple[State, bool]:
        self.label()
        return state, False

    do_default = do_case

    def do_switch(self, state: State) -> tuple[State, bool]:
        self.at += 1
        _, on_var = self.condition()
        if self.look() != "{":
            return self.statement(state)
        self.at += 1
        entry, now, flows, every = state, state, False, False
        self.breaks.append([])
        while self.at < len(self.tokens) and self.look() != "}":
            if self.look() in ("case", "default"):
                every |= self.look() == "default"
                name = self.label()
                if not on_var:
                    now = now.join(entry) if flows else entry
                elif not name:
                    now = UNKNOWN
                elif flows:
                    now = replace(now.join(State((name,), "case")), fell=frozenset(now.names or ()))
                else:
                    now = State((name,), "case")
                flows = True
            else:
                now, gone = self.statement(now)
                flows = flows and not gone
        self.at += 1
        ends = self.breaks.pop() + ([now] if flows else []) + ([] if every else [entry])
        if not ends:
            return state, True
        out = ends[0]
        for more in ends[1:]:
            out = out.join(more)
        return out, False

    def plain(self, state: State) -> tuple[State, bool]:
        if NAME.fullmatch(self.look()) and self.look(1) == ":":
            self.at += 2
            return state, False
        first = self.at
        end = self.semicolon()
        if end == first and self.at == first:  # a closing mark without its opening one
            self.at += 1
        for i in range(first, end):
            word, place = self.tokens[i]
            if self.is_var(i) and i + 1 < end and self.tokens[i + 1][0] == "=":
                stop = self.tokens[end][1] if end < len(self.tokens) else len(self.code)
                rhs = " ".join(self.code[self.tokens[i + 1][1] + 1 : stop].split("\n"))
                state = self.change(state, place, rhs.strip(), "")
            elif word in self.helpers and i + 1 < end and self.tokens[i + 1][0] == "(":
                value = self.argument(i + 1, self.helpers[word])
                if re.fullmatch(r"[A-Z]\w*", value):
                    state = self.change(state, place, value, word)
        return state, False

    def argument(self, i: int, number: int) -> str:
        depth, begin, k = 0, self.tokens[i][1] + 1, 0
        for word, place in self.tokens[i:]:
            depth += (word in "([{") - (word in ")]}")
            if depth == 0 or depth == 1 and word == ",":
                if k == number:
                    return self.code[begin:place].strip()
                begin, k = place + 1, k + 1
            if depth == 0:
                break
        return ""

    def change(self, before: State, place: int, rhs: str, via: str) -> State:
        line = self.line(place)
        fell = [(n, self.set_at.get(n, 0)) for n in before.names or () if n in before.fell]
        self.found.append(Change(line, rhs, via, before, fell))
        bare = rhs[1:-1].strip() if re.fullmatch(r"\([^()]*\)", rhs) else rhs
        if not re.fullmatch(r"[A-Z]\w*", bare):
            return UNKNOWN
        self.set_at[bare] = line
        return State((bare,), "assign")
