"""Markdown and self-contained HTML from a report."""

from __future__ import annotations

import html
import json

TITLES = {"schema": "Schema", "missingness": "Missing Values", "duplicates": "Duplicates", "structure": "Structure", "types": "Types", "rules": "Rules", "numeric": "Numeric", "categorical": "Categories and Text", "temporal": "Time", "relationships": "Relationships", "target": "Target", "drift": "Drift", "pipeline": "Run"}


def _cell(x) -> str:
    return str(x).replace("|", "\\|").replace("\n", " ").replace("<", "&lt;")


def to_markdown(report) -> str:
    s = report.summary()
    out = [f"# Data quality report: {_cell(report.dataset.get('name', 'dataset'))}", "", "## Executive Summary", "", f"{s['total']} findings: " + ", ".join(f"{n} {k}" for k, n in reversed(s["by_severity"].items())) + "."]
    out += ["", "## Dataset Overview", "", *(f"- {k}: {_cell(v)}" for k, v in report.dataset.items())]
    out += ["", "## Schema", "", "| column | type | semantic type | missing | distinct |", "|-|-|-|-|-|"]
    out += [f"| {_cell(n)} | {_cell(c.get('dtype'))} | {_cell(c.get('semantic_type'))} | {c.get('missing_ratio', 0):.1%} | {c.get('n_unique')} |" for n, c in report.schema.items()]

    def lines(f) -> list[str]:
        text = [f"- **{f.severity}** `{f.code}` {_cell(f.title)}: {_cell(f.observation)}"]
        return text + [f"  - {k}: {_cell(v)}" for k, v in (("may mean", f.interpretation), ("suggestion", f.suggestion)) if v]

    top = report.filter(min_severity="high")
    out += ["", "## Critical and High", ""] + ([x for f in top for x in lines(f)] or ["None."])
    for c in s["by_category"]:
        out += ["", f"## {TITLES.get(c, c)}", ""] + [x for f in report.filter(category=c) for x in lines(f)]
    out += ["", "## Recommendations", ""] + ([f"- {_cell(r['suggestion'])} ({', '.join(map(_cell, r['columns'])) or 'table'})" for r in report.recommendations()] or ["None."])
    return "\n".join(out) + "\n"


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="default-src 'none'; style-src 'unsafe-inline'; script-src 'unsafe-inline'">
<title>%s</title><style>body{font:14px sans-serif;margin:2em;max-width:70em}li{margin:.4em 0}.critical,.high{color:#a00}.warning{color:#a60}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}</style></head>
<body><h1 id="t"></h1><p id="s"></p><ul id="f"></ul><table id="c"></table><script type="application/json" id="d">%s</script><script>
const d=JSON.parse(document.getElementById('d').textContent),put=(id,tag,text,cls)=>{const e=document.createElement(tag);e.textContent=text;if(cls)e.className=cls;document.getElementById(id).appendChild(e);return e};
document.getElementById('t').textContent=d.dataset.name||'Report';document.getElementById('s').textContent=d.summary.total+' findings';
for(const f of d.findings)put('f','li',f.severity+' '+f.code+': '+f.observation+(f.suggestion?' '+f.suggestion:''),f.severity);
for(const [n,c] of Object.entries(d.schema)){const r=put('c','tr','');for(const v of [n,c.dtype,c.semantic_type,c.n_missing,c.n_unique]){const e=document.createElement('td');e.textContent=v;r.appendChild(e)}}
</script></body></html>"""


def to_html(report) -> str:
    data = json.dumps(report.to_dict(), ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    return PAGE % (html.escape(str(report.dataset.get("name", "Report"))), data)
