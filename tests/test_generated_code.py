"""Spans, calls and code of generated C files, whose truth the generator knows as it writes them."""

import numpy as np
import pytest

from siltstone.operators import structure as T

NOISE = ['/* } { if (x) g(1); */', '// } stray(2);', 's = "{ \\" } call(3)";', "c = '{';", "/* a", "", "x += 1;", "#define M(a) { a }", "#ifdef NEVER_CLOSED_HERE\n#endif", "struct s v = { 1, { 2 } };"]


class Writer:
    def __init__(self, seed):
        self.rng, self.lines, self.spans, self.calls = np.random.default_rng(seed), [], [], {}

    def put(self, *text):
        for t in text:
            self.lines += t.split("\n")

    def noise(self, pad=""):
        t = NOISE[int(self.rng.integers(len(NOISE)))]
        self.put(*(["/* a", " } still a comment( ) {", "*/"] if t == "/* a" else [t if t.startswith("#") else pad + t]))

    def call(self, func, pad):
        name = f"callee_{int(self.rng.integers(12))}"
        self.put(f"{pad}{['', 'return ', 'x = (int)', 'if (!'][int(self.rng.integers(4))]}{name} (x, 1)" .replace("if (!" + name + " (x, 1)", f"if (!{name} (x, 1)) x = 2") + ";")
        self.calls.setdefault((func, name), len(self.lines))

    def block(self, func, depth):
        pad = "    " * depth
        for _ in range(int(self.rng.integers(1, 5))):
            kind = int(self.rng.integers(5))
            if kind == 0 and depth < 9:
                self.put(f"{pad}{['if (x)', 'while (x > 1)', 'for (;;)', 'switch (x)', 'do'][int(self.rng.integers(5))]} {{")
                self.block(func, depth + 1)
                self.put(f"{pad}}}")
            elif kind == 1:
                self.call(func, pad)
            elif kind == 2:
                self.put("#if 0", f"{pad}dead_{depth}(1); }}", "#endif")
            else:
                self.noise(pad)

    def function(self, name):
        form = int(self.rng.integers(4))
        start = len(self.lines) + 1
        if form == 0:
            self.put(f"int {name}(int x) {{")
        elif form == 1:
            self.put(f"static int {name}(int x,", "        int (*f)(int))", "{")
        elif form == 2:
            self.put("#ifdef WIDE", f"int {name}(long x) {{", "#else", f"int {name}(int x) {{", "#endif")
            start += 1
        else:
            self.put("static unsigned", f"{name}(void)", "", "{")
        self.block(name, 1)
        self.put("}")
        self.spans.append((name, start, len(self.lines)))

    def file(self):
        for i in range(int(self.rng.integers(2, 9))):
            for _ in range(int(self.rng.integers(0, 3))):
                self.put(["int later(int x);", "struct p { int a; };", "static int table[] = { 1, 2 };", "/* { */", "#define LOOP(x) \\\n  while (x) { \\\n  }", "typedef int (*cb)(int);"][int(self.rng.integers(6))])
            self.function(f"func_{i}")
        return "\n".join(self.lines)


@pytest.fixture(scope="module")
def made(spark):
    writers = {f"gen/{seed}.c": Writer(seed) for seed in range(40)}
    files = spark.createDataFrame([(p, w.file()) for p, w in writers.items()], "path string, content string")
    return writers, T.code_lines(files).cache()


def test_spans_of_generated_functions(made):
    writers, lines = made
    got = {(r.path, r.name, r.start_line, r.end_line) for r in T.function_spans(lines).collect()}
    assert got == {(p, *s) for p, w in writers.items() for s in w.spans}


def test_calls_in_generated_functions(made):
    writers, lines = made
    got = {(r.path, r.caller, r.callee): r.line_no for r in T.call_edges(lines, T.function_spans(lines)).collect() if r.callee.startswith("callee_")}
    assert got == {(p, f, c): n for p, w in writers.items() for (f, c), n in w.calls.items()}


def _bare(content):
    """Content without comments, strings and characters, one letter at a time."""
    out, i, state = [], 0, ""
    while i < len(content):
        two, c = content[i : i + 2], content[i]
        if not state and two in ("//", "/*"):
            state, i = two, i + 2
            continue
        if not state and c in "\"'":
            state, i = c, i + 1
            continue
        if state == "/*" and two == "*/":
            state, i = "", i + 2
            continue
        if state in ('"', "'") and c == "\\":
            i += 2
            continue
        if c == "\n":
            out.append(c)
            state = state if state == "/*" else ""
        elif state and c == state:
            state = ""
        elif not state:
            out.append(c)
        i += 1
    return "".join(out).split("\n")


def test_code_of_generated_files(made):
    writers, lines = made
    got = {}
    for r in lines.collect():
        got.setdefault(r.path, {})[r.line_no] = r.code
    for path, w in writers.items():
        assert [got[path][i + 1].split() for i in range(len(w.lines))] == [x.split() for x in _bare("\n".join(w.lines))], path
