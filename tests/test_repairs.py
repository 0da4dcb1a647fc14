"""Escapes and repairs against plain loops, on fixed and on random texts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import escapes, repairs


def apply(spark, f, values):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(2)
    return [r.r for r in d.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


FIXED = {
    "{i}round{/iR}": "{i}round{/i}", "{b}{i}both{/iX}{/b}": "{b}{i}both{/i}{/b}", "{color=#fff}red{/colorZ}": "{color=#fff}red{/color}", "{size=+4}big{/sizeQ}": "{size=+4}big{/size}",
    "{i}a{/i}{i}b{/iQ}": "{i}a{/i}{i}b{/i}", "{i}{b}x{/i}{/b}": "{i}{b}x{/b}{/i}", "He. {w}{i}{b}x{/i}{/b}": "He. {w}{i}{b}x{/b}{/i}", "{i}{b}{u}t{/i}{/b}{/u}": "{i}{b}{u}t{/u}{/b}{/i}",
    "{i}hi{/i}": "{i}hi{/i}", "text{/}": "text{/}", "{w=0.5}wait{/i}odd": "{w=0.5}wait{/i}odd", "no close {i}open": "no close {i}open", "a { b } {{c} {/": "a { b } {{c} {/", "": "", "plain": "plain",
}


def plain_tags(s):
    stack, early, out, at = [], Counter(), [], 0
    for m in re.finditer(r"\{(/?)([^{}]*)\}", s):
        out.append(s[at : m.start()])
        at, name = m.end(), m[2].split("=", 1)[0].strip()
        if not m[1]:
            stack.append(name)
            out.append(m[0])
            continue
        if not name:
            stack[-1:] = []
            out.append(m[0])
            continue
        if stack and stack[-1] and name.startswith(stack[-1]):
            goal = stack[-1]
        elif name in stack:
            goal = name
        else:
            goal = next((x for x in reversed(stack) if x and name.startswith(x)), None)
        if goal is not None:
            while (top := stack.pop()) != goal:
                out.append("{/%s}" % top)
                early[top] += 1
            out.append(m[0] if goal == name else "{/%s}" % goal)
            continue
        late = name if early[name] > 0 else next((k for k in early if early[k] > 0 and k and name.startswith(k)), None)
        if late is None:
            out.append(m[0])
        else:
            early[late] -= 1
    return "".join(out) + s[at:]


def test_tags(spark):
    rng = random.Random(3)
    parts = ["{i}", "{b}", "{/i}", "{/b}", "{/iR}", "{/bold}", "{bo=1}", "{/bo}", "{}", "{/}", "{", "}", "x", " y ", "{w}", "{/ i }", "{/w=2}", "\n"]
    tried = list(FIXED) + ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(400)] + [None]
    got = apply(spark, repairs.repair_tags, tried)
    assert got[: len(FIXED)] == list(FIXED.values())
    assert got == [None if t is None else plain_tags(t) for t in tried]
    fixed = [g for g, t in zip(got, tried) if t in FIXED]
    assert apply(spark, repairs.repair_tags, fixed) == fixed


def test_brackets(spark):
    given = ["[in the end]", "[name]", "[[escaped]", "[a[0]]", "[a b [[c] d]", "open [x", "[]", "[x!r]", "plain", "", None, "[f(1)] and [no so]", "]["]
    want = ["[[in the end]", "[name]", "[[escaped]", "[a[0]]", "[[a b [[c] d]", "open [x", "[[]", "[[x!r]", "plain", "", None, "[f(1)] and [[no so]", "]["]
    assert apply(spark, repairs.double_brackets, given) == want
    settled = [w for w in want if w]
    assert apply(spark, repairs.double_brackets, settled) == settled


def test_repairs_in_order(spark):
    """The percent sign and the blank line appear only when escapes are decoded; brackets come last."""
    given = "\\n{i}100% of \\\"[the rest]{/iX}\\n \\n"
    d = spark.createDataFrame([(given, "one line"), (given, "\\none line\\n"), (None, "x"), ("a", None)], "t string, o string")
    got = [r.r for r in repairs.repaired(d.withColumn("r", F.col("t")), "r", "o").collect()]
    assert got == ["{i}100% of \"[[the rest]{/i}", "\n{i}100% of \"[[the rest]{/i}\n \n", None, "a"]


def scan(s, known, digits, any_line, bare_u):
    """One character at a time."""
    out, i = [], 0
    while i < len(s):
        if s[i] != "\\" or i + 1 == len(s) or s[i + 1] == "\n" and not any_line:
            out.append(s[i])
            i += 1
            continue
        c, i = s[i + 1], i + 2
        if c == "u" and digits:
            m = re.compile("[0-9a-fA-F]" + digits).match(s, i)
            if m:
                n = int(m[0], 16)
                out.append(s[i - 2 : m.end()] if 0xD800 <= n < 0xE000 else chr(n))
                i = m.end()
                continue
            if bare_u is not None:
                out.append(bare_u)
                continue
        out.append(known.get(c, c))
    return "".join(out)


LINES = {"n": "\n", "t": "\t", "r": "\r"}
FAMILIES = [
    (escapes.written_decode, (LINES, "{4}", False, "\\u")),
    (escapes.settings_decode, (LINES, "{4}", False, None)),
    (escapes.code_decode, (LINES | {"0": "\0"}, "", True, None)),
    (lambda c: escapes.script_decode(c, False), ({"{": "{{", "[": "[[", "%": "%%", "n": "\n"}, "{1,4}", False, "")),
]


@pytest.mark.parametrize("k", range(len(FAMILIES)))
def test_decoding(spark, k):
    rng = random.Random(k)
    parts = ["\\", "\\\\", "\\n", "\\u", "\\u0041", "\\u20", "\\ud83d", "\\0", '\\"', "\\{", "\\[", "\\%", "n", "t", "é", "\n", "😀", " ", "u", "4"]
    tried = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)] + [None, "", "\\"]
    decode, rule = FAMILIES[k]
    assert apply(spark, decode, tried) == [None if t is None else scan(t, *rule) for t in tried]


def test_round_trips(spark):
    rng = random.Random(9)
    tried = ["".join(rng.choice("\\\"'\n\t\r\0 n0u{[%é😀") for _ in range(rng.randrange(20))) for _ in range(300)]
    trips = [
        lambda c: escapes.code_decode(escapes.inner(escapes.code_encode(c))),
        lambda c: escapes.verbatim_decode(escapes.inner(escapes.verbatim_encode(c), 2)),
        lambda c: escapes.settings_decode(escapes.settings_encode(c)),
        lambda c: escapes.settings_decode(escapes.settings_encode(c, "'")),
        lambda c: escapes.settings_decode(escapes.field_encode(c, True)),
        lambda c: escapes.settings_decode(escapes.field_encode(c, False)),
    ]
    for trip in trips:
        assert apply(spark, trip, tried) == tried
    spoken = [t.replace("{", "").replace("[", "").replace("%", "") for t in tried]
    assert apply(spark, lambda c: escapes.script_decode(escapes.inner(escapes.say_encode(c))), spoken) == spoken
    assert apply(spark, lambda c: escapes.script_decode(escapes.inner(escapes.entry_encode(c)), False), spoken) == spoken
    assert apply(spark, lambda c: escapes.unwrapped(escapes.rewrapped(c)), tried) == tried


def test_written_forms(spark):
    assert apply(spark, escapes.say_encode, ['a  "b"\n\\', "a    b"]) == ['"a \\ \\"b\\"\\n\\\\"', '"a \\ \\ \\ b"']
    assert apply(spark, escapes.markup_encode, ["<a href=\"x\">'&'"]) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;&#39;"]
    assert apply(spark, escapes.script_decode, ["a   b\n c\\ud", "x\\{y"]) == ["a b c\rd".replace("\rd", "\r"), "x{{y"]
