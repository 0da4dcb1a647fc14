"""Passages against a plain scan."""

import html
import re

from pyspark.sql import functions as F

from corpusloom.functions import escapes
from corpusloom.sources import passages

LETTER = re.compile("[a-zA-Zа-яА-Я]")
TOKEN = re.compile(r"(<style[^>]*?>[\s\S]*?</style>|<script[^>]*?>[\s\S]*?</script>|<<[\s\S]*?>>|<[^>]*?>|\[\[[^\]]*?\]\])", re.I)


def plain(text):
    for n, m in enumerate(re.finditer(r"(<tw-passagedata\s+[^>]*?>)([\s\S]*?)</tw-passagedata>", text or "", re.I)):
        name, tags = (re.search(rf'{a}="([^"]*)"', m[1]) for a in ("name", "tags"))
        name, tags = name and name[1], tags[1] if tags else ""
        if not name or name == "StoryInit" or "script" in tags or "stylesheet" in tags:
            continue
        for at, token in enumerate(TOKEN.split(html.unescape(m[2]))):
            inside, out = html.unescape(token[2:-2].strip()), []
            if token.startswith("[["):
                kind = next((k for k in ("|", "->", "<-") if k in inside), None)
                out = [("link_label", inside.split(kind, 1)[kind == "<-"].strip())] if kind else [("link_target", inside)]
            elif token.startswith("<<") and token.endswith(">>"):
                if inside.split() and inside.split()[0].lower() in passages.SHOWING_MACROS:
                    strings = re.findall(r'"([^"]*)"|\'([^\']*)\'', inside)
                    out = [(f"macro_str:{k}", (a or b).strip()) for k, (a, b) in enumerate(strings)]
                    out = [(k, v) for k, v in out if not v.startswith("$")]
            elif not token.startswith("<"):
                out = [("text", token.strip())]
            yield from ((n, name, at, k, v) for k, v in out if LETTER.search(v))


def story(name, body, tags=""):
    return f'<tw-passagedata pid="1" name="{name}" tags="{tags}">{body}</tw-passagedata>'


def test_passages(spark):
    bodies = [
        "Plain text", "", "&lt;&lt;link &quot;Go on&quot;&gt;&gt;text[[A|B]] [[C-&gt;D]] [[E&lt;-F]] [[ G ]] [[1|x]]", "&lt;b&gt;Bold&lt;/b&gt; &amp;lt;kept&amp;gt; &amp;amp; &#39;q&#x27; &#1071;&#x1F600;",
        "&lt;style&gt;p { a }&lt;/style&gt;after&lt;script&gt;x[[no]]&lt;/script&gt;", "&lt;&lt;print '$v' \"Shown\" 'two words'&gt;&gt;&lt;&lt;set &quot;hidden&quot;&gt;&gt;", "123 [[456]] &lt;&lt;&gt;&gt;", "two\nlines [[over\nlines|x]]", "Мир [[Дом]]", "open &lt; and [[open", "&lt;&lt;DIALOG 'Up'&gt;&gt;",
    ]
    files = [("all", "<html>" + "\n".join(story(f"p{i}", b) for i, b in enumerate(bodies)) + "</html>"), ("system", story("StoryInit", "no") + story("s", "no", "my script") + story("c", "no", "stylesheet") + story("", "no") + story("ok", "yes").upper().replace("NAME", "name")), ("none", "just text"), ("null", None)]
    got = passages.passage_strings(spark.createDataFrame(files, "f string, t string"), "f", "t")
    assert sorted(map(tuple, got.collect())) == sorted((f, *r) for f, t in files for r in plain(t))
    assert got.count() > 15
    assert passages.passage_strings(got.select("f", F.col("value").alias("t")).filter("false"), "f", "t").count() == 0


def test_entities(spark):
    given = ["&amp;lt;", "&lt;&gt;&quot;&apos;&#39;&#x41;&#X2014;", "&unknown; & &; &#; &#0; &#xD800; &#9999999;", "&#128512;", "", None, "no entity"]
    want = ["&lt;", "<>\"''A—", "&unknown; & &; &#; &#0; &#xD800; &#9999999;", "😀", "", None, "no entity"]
    d = spark.createDataFrame(list(enumerate(given)), "i int, v string")
    assert [r.r for r in d.select("i", escapes.markup_decode(F.col("v")).alias("r")).orderBy("i").collect()] == want
    assert [r.r for r in d.select("i", escapes.markup_decode(escapes.markup_encode(F.col("v"))).alias("r")).orderBy("i").collect()] == given
