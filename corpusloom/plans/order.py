"""Queries of ordered operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import ordered
from corpusloom.registry import query, table


@query(r"""with f as (select doc_id, line, min(pos) as place from (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from documents where text is not null) group by all),
h as (select *, row_number() over (partition by doc_id order by place) as n, sum(length(line) + 2) over (partition by doc_id order by place rows unbounded preceding) as total from f)
select t.doc_id, t.line, case when contains(t.line, ' ') and length(t.line) > 10 then coalesce((select string_agg(s.line, '; ' order by s.n) from h s where s.doc_id = t.doc_id and s.n != t.n
  and s.n - case when t.n < s.n then 1 else 0 end <= 15 and s.total - case when t.n < s.n then length(t.line) + 2 else 0 end <= 800), '') end as siblings from h t""")
def sibling_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return ordered.siblings(lines, "doc_id", "pos", "line").withColumn("siblings", F.array_join("siblings", "; "))
