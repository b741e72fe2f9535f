"""Written results: kept ids, kinship files, ingest reports and a scatter page of components."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a page holds; larger tables are refused.
PAGE_ROWS = 100_000
#: A character that starts no field, so that the leading # of a header is not quoted.
COMMENT = "\x01"


def write_kept_ids(snps: DataFrame, path: str) -> None:
    """A folder of text parts with one variant id in each line, in variant order."""
    snps.orderBy("snp_idx").select(F.col("snp_id").cast("string")).write.mode("overwrite").text(path)


def write_kin0(kin: DataFrame, samples: DataFrame, path: str) -> None:
    """Tab-separated #IID1, IID2, NSNP, HETHET, IBS0, KINSHIP (shares of the variants that both have), as folders of parts."""
    ids = lambda k: samples.select(F.col("sample_idx").alias(f"id{k}"), F.col("sample_id").alias(f"s{k}"))
    out = kin.join(ids(1), "id1").join(ids(2), "id2").orderBy("id1", "id2")
    share = lambda c: F.format_string("%.6g", F.col(c) / F.col("nsnp"))
    rows = out.select(F.col("s1").alias("#IID1"), F.col("s2").alias("IID2"), F.col("nsnp").alias("NSNP"), share("hethet").alias("HETHET"), share("ibs0").alias("IBS0"), F.coalesce(F.format_string("%.6g", F.col("phi")), F.lit("nan")).alias("KINSHIP"))
    rows.write.mode("overwrite").option("comment", COMMENT).csv(path, sep="\t", header=True)


def write_cutoff(marked: DataFrame, samples: DataFrame, prefix: str) -> None:
    """prefix.king.cutoff.in.id and prefix.king.cutoff.out.id: ids that stay and ids that go, under a header #IID."""
    who = marked.join(samples.select("sample_idx", "sample_id"), "sample_idx").orderBy("sample_idx")
    for name, gone in (("in", False), ("out", True)):
        who.filter(F.col("removed") == gone).select(F.col("sample_id").alias("#IID")).write.mode("overwrite").option("comment", COMMENT).csv(f"{prefix}.king.cutoff.{name}.id", sep="\t", header=True)


def write_ingest_report(calls: DataFrame, path: str) -> DataFrame:
    """Tab-separated snp_id, chrom, pos, state, dosage (a dot where there is none); returns counts by state."""
    calls.select("snp_id", "chrom", "pos", "state", F.coalesce(F.col("dosage").cast("string"), F.lit(".")).alias("dosage")).orderBy("chrom", "pos").write.mode("overwrite").option("comment", COMMENT).csv(path, sep="\t", header=True)
    return calls.groupBy("state").agg(F.count("*").alias("sites"))


def scatter_page(points: DataFrame, x: str = "pc1", y: str = "pc2", label: str = "pop", name: str = "sample_id", title: str = "Components") -> str:
    """An HTML page with a scatter of `points`; a click on a legend entry hides its label, pointing at a dot names it.  ValueError above PAGE_ROWS rows."""
    rows = points.select(name, label, x, y).limit(PAGE_ROWS + 1).collect()
    if len(rows) > PAGE_ROWS:
        raise ValueError(f"more than {PAGE_ROWS} points")
    data = json.dumps([[str(r[0]), str(r[1]), float(r[2]), float(r[3])] for r in rows]).replace("<", "\\u003c")
    return f"""<!doctype html><meta charset="utf-8"><title>{html.escape(title)}</title>
<style>body{{font:14px sans-serif}}svg{{border:1px solid #ccc}}li{{cursor:pointer;list-style:none}}li.off{{opacity:.3}}</style>
<h1>{html.escape(title)}</h1><svg id="s" width="800" height="600"></svg><ul id="l"></ul>
<script>
const data={data},names={json.dumps([x, y])},svg=document.getElementById("s"),list=document.getElementById("l");
const labels=[...new Set(data.map(d=>d[1]))].sort(),hue=l=>`hsl(${{labels.indexOf(l)*360/labels.length}},70%,45%)`;
const span=k=>{{const v=data.map(d=>d[k]),a=Math.min(...v),b=Math.max(...v);return t=>(t-a)/((b-a)||1)}},px=span(2),py=span(3);
for(const d of data){{const c=document.createElementNS(svg.namespaceURI,"circle"),t=document.createElementNS(svg.namespaceURI,"title");
c.setAttribute("cx",20+760*px(d[2]));c.setAttribute("cy",580-560*py(d[3]));c.setAttribute("r",4);c.setAttribute("fill",hue(d[1]));c.dataset.label=d[1];
t.textContent=`${{d[0]}} (${{d[1]}}) ${{names[0]}} ${{d[2]}} ${{names[1]}} ${{d[3]}}`;c.append(t);svg.append(c)}}
for(const l of labels){{const e=document.createElement("li");e.textContent=l;e.style.color=hue(l);e.onclick=()=>{{e.classList.toggle("off");
for(const c of svg.querySelectorAll("circle"))if(c.dataset.label===l)c.style.display=e.classList.contains("off")?"none":""}};list.append(e)}}
</script>
"""
