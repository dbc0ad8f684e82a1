"""Bracket checks against a stack, and ends of nested definitions in several languages."""

import random

import pytest
from pyspark.sql import functions as F
from sparkloom import session
from sparkloom.operators import brackets, chunking


def stack_check(text):
    stack, closing = [], {v: k for k, v in brackets.PAIRS.items()}
    for i, line in enumerate(text.split("\n"), 1):
        if line.lstrip(" ").startswith(brackets.COMMENTS):
            continue
        for c in line:
            if c in brackets.PAIRS:
                stack.append((c, i))
            elif c in closing:
                if not stack:
                    return i, f"Unexpected closing {c}"
                if stack[-1][0] != closing[c]:
                    return i, f"Mismatched bracket: expected {brackets.PAIRS[stack[-1][0]]}, got {c}"
                stack.pop()
    return (stack[0][1], f"Unclosed {stack[0][0]}") if stack else (None, None)


@pytest.mark.parametrize("block", [512, 1, 3])
def test_checked(spark, monkeypatch, block):
    monkeypatch.setattr(brackets, "BLOCK", block)
    rng = random.Random(block)

    def made():
        out, stack = [], []
        for _ in range(rng.randint(0, 60)):
            x = rng.random()
            if x < 0.35:
                stack.append(rng.choice("([{"))
                out.append(stack[-1])
            elif x < 0.7 and stack:
                out.append(brackets.PAIRS[stack.pop()] if rng.random() < 0.97 else rng.choice(")]}"))
            else:
                out.append(rng.choice(["\n", "\n", "a", "\n# ( [", "\n  // }", " "]))
        if rng.random() < 0.6:
            out += [brackets.PAIRS[c] for c in reversed(stack)]
        return "".join(out)

    docs = [(i, made()) for i in range(300)] + [(900, ""), (901, "]"), (902, "{\n" * 50 + "}\n" * 50)]
    found = brackets.checked(spark.createDataFrame([*docs, (999, None)], "id long, text string"))
    rows = {r["id"]: (r["valid"], r["line"], r["message"]) for r in found.collect()}
    assert rows.pop(999) == (True, None, None)
    assert rows == {i: (stack_check(t)[0] is None, *stack_check(t)) for i, t in docs}


SOURCES = {
    "javascript": """export class A {
  // } not here
  async run() { return "}" }
}
function outer({a, b}) {
  const inner = (x) => {
    return `}
    ${x}`
  }
  function deep() {
    if (a) { b() }
  }
  return '}'
}
const z = (a) => a
function last() {}
""",
    "java": """public class A {
    /* } */
    public int size() {
        char c = '}';
        return "{".length();
    }
    public interface B {
        void call();
    }
    public abstract class C
    {
        public void f(
            int a
        ) {
        }
    }
}
""",
    "go": """func (r T) Run(a int) error {
	s := `}
}`
	return nil
}
type Row struct {
	A int
}
type Q interface { M() }
""",
    "rust": """pub mod m {
    pub struct P<'a> { x: &'a str }
    pub fn f(
        x: char,
    ) -> char {
        if x == '}' { 'a' } else { '{' }
    }
    pub struct Unit;
    pub trait T {
        fn g();
    }
}
""",
    "php": """class A {
  # }
  public function f($x) {
    return '}';
  }
  private static function g() { /* { */ }
}
""",
}
ENDS = {
    "javascript": {("A", 1): 4, ("outer", 5): 14, ("inner", 6): 9, ("deep", 10): 12, ("z", 15): 15, ("last", 16): 16},
    "java": {("A", 1): 17, ("size", 3): 6, ("B", 7): 9, ("C", 10): 16, ("f", 12): 15},
    "go": {("Run", 1): 5, ("Row", 6): 8, ("Q", 9): 9},
    "rust": {("m", 1): 12, ("P", 2): 2, ("f", 3): 7, ("Unit", 8): 8, ("T", 9): 11, ("g", 10): 10},
    "php": {("A", 1): 7, ("f", 3): 5, ("g", 6): 6},
}


def test_ends_of_nested_definitions(spark):
    docs = spark.createDataFrame([(lang, lang, text) for lang, text in SOURCES.items()] + [("py", "python", "def f():\n  return '{'\n"), ("open", "go", "func F() {\n\n"), ("none", "go", None)], "path string, language string, content string")
    found = chunking.nested_definitions(docs, "path", "content", "language")
    rows = {}
    for r in found.collect():
        rows.setdefault(r["path"], {})[r["name"], r["start_line"]] = r["end_line"]
    assert rows.pop("py") == {("f", 1): 3} and rows.pop("open") == {("F", 1): 3}
    for lang, ends in ENDS.items():
        assert {k: v for k, v in rows[lang].items() if k in ends} == ends, lang


def test_strings_and_comments_hide_braces(spark):
    docs = spark.createDataFrame([(1, "java", 'a { "\\"{" /* { \n } */ // }\n } ; \'}\'')], "id int, language string, text string")
    assert sorted(tuple(r) for r in brackets.code_marks(docs, "id", "text", "language").drop("at").collect()) == [(1, 1, "{"), (1, 3, ";"), (1, 3, "}")]
    empty = docs.where(F.lit(False))
    assert brackets.code_marks(empty, "id", "text", "language").count() == 0 and brackets.checked(empty).count() == 0


def test_tasks_follow_marks(spark, monkeypatch):
    """What a task sorts does not grow with the documents: four shuffle partitions would take all of it."""
    monkeypatch.setattr(brackets, "MARKS", 1000, raising=False)
    tasks = {}

    def counted(df, name):
        tasks[name] = [spark.conf.get(x) for x in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")]
        return session.stored(df, name)

    monkeypatch.setattr(brackets, "stored", counted, raising=False)
    docs = spark.range(500).select("id", F.repeat(F.lit("f({})\n"), 10).alias("text"))
    assert brackets.checked(docs.unionByName(spark.createDataFrame([(900, "\n(]")], "id long, text string"))).where("not valid").count() == 1
    assert tasks.get("checks") == ["21", "false"]  # 20,002 marks
