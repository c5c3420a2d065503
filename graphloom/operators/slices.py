"""Answers as text: a task's slice under a token budget, lookups, findings and the map of domains."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import minify_block
from graphloom.operators import ranking as K
from graphloom.schema import DEFINITIONS

LEGEND = "# Legend: ast_exact facts are certain; ast_inferred, heuristic and latent ones need a check; at unresolved the static path ends. Cite file:line."
#: Best ranks that a flat slice shows with their source.
FULL_COUNT = 12
_TITLES = {
    "map": "# MAP (which symbols are in play, by file)",
    "signatures": "# SIGNATURES (the symbols at a glance)",
    "detail": "# DETAIL (the source to edit, best at both ends)",
}


def tokens_of(text: str) -> int:
    return -(-len(text) // 4)


def title(task: str) -> str:
    return f"# Slice for: {task}"


def _whole(order: list) -> W:
    return W.partitionBy(F.lit(0)).orderBy(*order)


def _cost() -> Column:
    return F.ceil(F.char_length("line") / 4)


def _tier(lines: DataFrame, budget: float) -> DataFrame:
    """The longest prefix of (rank, line) whose tokens fit."""
    return K.within_budget(lines.withColumn("cost", _cost()).withColumn("g", F.lit(0)), ["g"], ["rank"], "cost", budget).select("rank", "line", "cost")


def facts(ranked: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, full_count: int | None = None) -> DataFrame:
    """rank, kind, covered_by and the rendered body of the nodes of ``ranked`` (id, score), a spine of some tens of nodes.

    From ``full_count`` on a body is a signature line only; so is that of a node whose file's text is gone.
    """
    rank = F.row_number().over(_whole([F.desc("score"), "id"]))
    full = nodes.filter("kind <> 'file'").join(F.broadcast(ranked.select("id", "score")), "id").withColumn("rank", rank)
    on = nodes.join(F.broadcast(ranked.select("id")), "id", "left_semi")
    joined = full.join(K.node_provenance(on, edges), "id").join(K.covered_by(on, edges, files.select("path", "role")), "id", "left").join(K.dynamic_sites(edges), "id", "left")
    joined = joined.join(files.select(F.col("path").alias("file_path"), "text"), "file_path", "left")
    begin = F.greatest("start_line", F.lit(1))
    source = F.array_join(F.slice(F.split("text", "\n"), begin, F.greatest(F.lit(1), F.col("end_line") - begin + 1)), "\n")
    number = F.col("start_line").cast("string")
    skeleton = F.concat(F.lpad(number, F.greatest(F.lit(5), F.char_length(number)), F.lit(" ")), F.lit("  "), F.trim(F.coalesce("signature", "qualified_name")))
    bare = F.coalesce("text", F.lit("")) == ""
    if full_count is not None:
        bare |= F.col("rank") > full_count
    inner = F.when(F.col("kind") == "unresolved", "      (unresolved: the static path ends here)").when(bare, skeleton).otherwise(minify_block(source, begin))
    note = F.when(F.col("sites") > 0, F.concat(F.lit("\n      "), F.col("sites").cast("string"), F.lit(" dynamic call site(s): the static path ends there"))).otherwise("")
    head = F.concat(F.lit("// "), "file_path", F.lit(":"), number, F.lit("-"), F.col("end_line").cast("string"), F.lit("  "), "qualified_name", F.lit("  ["), "provenance", F.lit("]  signal="), F.format_string("%.2f", "score"))
    return joined.select("rank", "id", "kind", "qualified_name", "file_path", "start_line", "signature", "covered_by", F.concat(head, F.lit("\n"), inner, note).alias("body"))


def slice_rows(ranked: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, budget: float = 6000, balance: dict[str, float] = K.BALANCE) -> DataFrame:
    """tier_no, tier, ord, line of a slice: names by file, then signatures, then sources in an order that puts the best at both ends."""
    every = facts(ranked, nodes, edges, files)
    defined = F.col("kind").isin(*DEFINITIONS)
    # where the spine has no definition, the upper tiers show all there is
    upper = every.withColumn("some", F.max(defined).over(W.partitionBy(F.lit(0)))).filter(defined | ~F.col("some")).withColumn("kind", F.lit(DEFINITIONS[0]))
    names = K.map_tier(upper).select(F.col("first_rank").alias("rank"), F.concat(F.lit("  "), "file_path", F.lit(": "), "names").alias("line"))
    signatures = K.signature_lines(upper).select("rank", "line")
    detail = every.select("rank", F.concat("body", F.when(defined, F.concat(F.lit("\n  covered-by: "), F.coalesce("covered_by", F.lit("(none)")))).otherwise("")).alias("line"))
    size = F.count("*").over(W.partitionBy(F.lit(0)))
    out = None
    for n, (name, df) in enumerate((("map", names), ("signatures", signatures), ("detail", detail))):
        best = F.row_number().over(_whole(["rank"])) - 1
        at = K.position(best, size) if name == "detail" else best
        rows = _tier(df, budget * balance[name]).select(F.lit(n).alias("tier_no"), F.lit(name).alias("tier"), at.cast("int").alias("ord"), "line")
        out = rows if out is None else out.unionByName(rows)
    return out


def flat_rows(ranked: DataFrame, nodes: DataFrame, edges: DataFrame, files: DataFrame, budget: float = 6000, full_count: int = FULL_COUNT) -> DataFrame:
    """The same columns for one tier of bodies: taken best first, what no longer fits is skipped, the best at both ends."""
    lines = facts(ranked, nodes, edges, files, full_count).select(F.lit(0).alias("g"), "rank", F.col("body").alias("line")).withColumn("cost", _cost())
    taken = K.greedy_fit(lines, ["g"], ["line"], "rank", "cost", budget)
    best, size = F.row_number().over(_whole(["rank"])) - 1, F.count("*").over(W.partitionBy(F.lit(0)))
    return taken.select(F.lit(2).alias("tier_no"), F.lit("flat").alias("tier"), K.position(best, size).cast("int").alias("ord"), "line")


@dataclass
class Slice:
    task: str
    anchors: list[str]
    rows: DataFrame

    def text(self) -> str:
        """The whole slice; as long as its budget, so it is put together here."""
        got = self.rows.orderBy("tier_no", "ord").collect()
        lines = [title(self.task), LEGEND, ""]
        if any(r["tier"] == "flat" for r in got):
            return "\n".join([*lines, *(r["line"] for r in got)])
        for n, (name, head) in enumerate(_TITLES.items()):
            lines += [""] * (n > 0) + [head] + [r["line"] for r in got if r["tier"] == name]
        return "\n".join(lines)


def lookup_text(found: dict) -> str:
    if found["found"]:
        return f"{found['qualified_name']}  [{found['kind']}]\n{found['signature'] or '(no signature)'}\n{found['file_path']}:{found['start_line']}\ncallers: {found['callers']}"
    if not found["suggestions"]:
        return found["message"]
    return "\n".join([found["message"], "did you mean:", *(f"{s['file']}:{s['line']}  {s['name']}" for s in found["suggestions"])])


def findings_text(findings: list[dict]) -> str:
    lines = [f"{f['file']}:{f['line']}  {f['severity']}  {f['rule']}  {f['message']}" for f in findings]
    count = lambda s: sum(f["severity"] == s for f in findings)
    return "\n".join([*lines, f"{count('error')} error(s), {count('warn')} warning(s), {count('info')} info"])


def _displays(domains: list[dict]) -> dict[str, str]:
    """By label; a name's second and later bearers carry their number."""
    seen: dict[str, int] = {}
    out = {}
    for d in domains:
        seen[d["name"]] = n = seen.get(d["name"], 0) + 1
        out[d["label"]] = d["name"] if n == 1 else f"{d['name']} ({n})"
    return out


def map_markdown(found: dict) -> str:
    """``found``: domains (label, name, entrypoints, symbols) and edges (from_label, to_label, weight), few by nature."""
    lines: list[str] = []
    for d in found["domains"]:
        lines.append(f"## {d['name']}")
        lines += [f"entrypoints: {', '.join(d['entrypoints'])}"] * bool(d["entrypoints"])
        lines += ["top symbols:", *(f"- {s['name']} — {s['file']}:{s['line']}" for s in d["symbols"]), ""]
    names = _displays(found["domains"])
    return "\n".join([*lines, "## dependencies", *(f"{names[e['from_label']]} → {names[e['to_label']]} ({e['weight']})" for e in found["edges"])])


def map_mermaid(found: dict) -> str:
    """A flow chart whose node ids are names and numbers, so that equal names stay apart."""
    ids = {d["label"]: f"{re.sub('[^A-Za-z0-9_]', '_', d['name'])}_{n}" for n, d in enumerate(found["domains"])}
    lines = ["flowchart LR", *(f'  {ids[d["label"]]}["{d["name"]}"]' for d in found["domains"])]
    return "\n".join([*lines, *(f"  {ids[e['from_label']]} -->|{e['weight']}| {ids[e['to_label']]}" for e in found["edges"])])
