"""The library's front: an index of a folder and the questions it answers."""

from __future__ import annotations

import re
import shutil
import subprocess
import uuid
from collections.abc import Callable
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.classify import LANGUAGE_OF
from graphloom.operators import diffs, domains, graph, incremental, ranking, resolve, retrieval, slices, verify
from graphloom.schema import ANALYZER_VERSION
from graphloom.session import cut
from graphloom.sources import extract, scan


#: Where a project keeps its index, and the names that its checks allow.
HOME, ALLOW_FILE = ".graphloom", ".graphloom-allow"


class Engine:
    """Tables of one index. Every question is a plan over them; none changes them.

    An engine stands for one state of its files: ``sync``, ``refresh`` and ``reindex_file`` return another one where something
    moved, and the same one, with what it has worked out so far, where nothing did.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], root: str | None = None):
        self.spark, self.tables, self.root = spark, tables, root
        self.nodes, self.edges, self.files, self.imports = (tables[t] for t in scan.TABLES)

    # --- building

    @classmethod
    def from_files(cls, spark: SparkSession, files: DataFrame) -> Engine:
        """Index a table of files (path, language, text, hash, mtime_ms)."""
        nodes, edges, imports = extract.graph_of(cut(extract.extract_files(files)))
        files = cut(scan.with_roles(files, imports))
        resolved = resolve.resolve_imports(nodes, edges, imports, files.select("path"))
        return cls(spark, {"nodes": cut(nodes), "edges": cut(resolved), "files": files, "imports": cut(imports)})

    @classmethod
    def index(cls, spark: SparkSession, root: str) -> Engine:
        engine = cls.from_files(spark, scan.scan(spark, root))
        engine.root = root
        return engine

    @classmethod
    def open(cls, spark: SparkSession, folder: str, root: str | None = None) -> Engine:
        return cls(spark, scan.load(spark, folder), root)

    @classmethod
    def of_project(cls, spark: SparkSession, root: str) -> tuple[Engine, dict]:
        """The up-to-date index of a folder and what moved: the one it keeps, refreshed, or else a new one."""
        kept = cls._kept(root)
        if kept is None:
            engine = cls.index(spark, root)
            engine.keep()
            return engine, {"reindexed": 0, "removed": 0}
        return cls.open(spark, str(kept), root).refresh()

    @staticmethod
    def _kept(root: str) -> Path | None:
        current = Path(root) / HOME / "current"
        folder = current.parent / current.read_text().strip() if current.exists() else None
        return folder if folder is not None and folder.exists() else None

    @classmethod
    def has_index(cls, root: str) -> bool:
        return cls._kept(root) is not None

    def keep(self) -> None:
        """Write the index beside its files; the older one goes once the new one is complete."""
        home, old, name = Path(self.root) / HOME, self._kept(self.root), f"index-{uuid.uuid4().hex}"
        self.save(str(home / name))
        (home / "current.new").write_text(name)
        (home / "current.new").replace(home / "current")
        if old is not None:
            shutil.rmtree(old, ignore_errors=True)

    def refresh(self) -> tuple[Engine, dict]:
        """The engine of the files as they are now, and the numbers reindexed and removed."""
        after, actions = self.sync(scan.scan(self.spark, self.root))
        return after._kept_after(self, actions)

    def reindex_file(self, path: str) -> tuple[Engine, str]:
        """The engine after an edit of one file, and reindexed, removed or skipped; only code is read again this way."""
        if Path(path).suffix.lower() not in LANGUAGE_OF or not self._indexed(path) and not (Path(self.root) / path).exists():
            return self, "skipped"
        stays = self.files.filter(F.col("path") != path).select(*scan.SCANNED)
        exists = (Path(self.root) / path).exists()
        now = scan.scan_one(self.spark, self.root, path) if exists else None
        after, actions = self.sync(stays.unionByName(now) if exists else stays)
        after, stats = after._kept_after(self, actions)
        return after, "reindexed" if stats["reindexed"] else "removed" if stats["removed"] else "skipped"

    def _indexed(self, path: str) -> bool:
        return not self.files.filter(F.col("path") == path).isEmpty()

    def _kept_after(self, before: Engine, actions: DataFrame) -> tuple[Engine, dict]:
        stats = incremental.sync_stats(actions).first().asDict()
        self.root = before.root
        if self is not before and self.root is not None and self._kept(self.root) is not None:
            self.keep()
        return self, {k: stats[k] for k in ("reindexed", "removed")}

    def save(self, folder: str) -> None:
        scan.save(self.tables, folder)

    def sync(self, scanned: DataFrame) -> tuple[Engine, DataFrame]:
        """An engine over ``scanned`` and the path, action table of what moved; files that did not move are not read again."""
        actions = cut(incremental.sync_actions(self.files, scanned, ANALYZER_VERSION))
        moved = actions.filter("action in ('new', 'changed', 'removed')")
        if moved.isEmpty():
            return self, actions
        gone = moved.filter("action <> 'new'").select("path")
        targets = resolve.resolve_modules(self.imports, self.files.select("path"))
        used = self.imports.join(targets, ["file", "module_spec"]).select("file", "local_name", "imported_name", "target_file", "seq")
        nodes, edges = graph.remove_files(self.nodes, self.edges, used, gone)
        fresh = scanned.join(moved.filter("action <> 'removed'").select("path"), "path", "left_semi")
        new_nodes, new_edges, new_imports = extract.graph_of(cut(extract.extract_files(fresh)))
        nodes = graph.upsert_nodes(nodes.withColumn("o", F.lit(0)).unionByName(new_nodes.withColumn("o", F.lit(1))), "o")
        imports = self.imports.join(gone.withColumnRenamed("path", "file"), "file", "left_anti").unionByName(new_imports)
        files = cut(scan.with_roles(scanned, imports))
        edges = resolve.resolve_imports(nodes, edges.unionByName(new_edges), imports, files.select("path"))
        return Engine(self.spark, {"nodes": cut(nodes), "edges": cut(edges), "files": files, "imports": cut(imports)}, self.root), actions

    # --- lookups

    @cached_property
    def roles(self) -> DataFrame:
        return self.files.select("path", "role", "language")

    def _named(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(name,)], "name string")

    def _documents(self) -> DataFrame:
        real = self.nodes.filter(~F.col("kind").isin("file", "unresolved", "import"))
        return real.select("id", F.concat_ws(" ", "qualified_name", "signature", "docstring").alias("text"))

    def resolve_symbol(self, name: str) -> DataFrame:
        """id of the node meant, of whatever kind: by exact name, by suffix, else the best search hit."""
        found = graph.find_symbols(self.nodes, self._named(name), ()).select("id")
        return found if not found.isEmpty() else self.search(name, 1).select("id")

    def search(self, query: str, k: int = 20) -> DataFrame:
        """id, score, qualified_name, kind, file_path, start_line of the best ``k`` nodes."""
        hits = retrieval.top(retrieval.fts(self._all_documents(), query), k)
        return hits.join(self.nodes.select("id", "qualified_name", "kind", "file_path", "start_line"), "id").orderBy(F.desc("score"), "id")

    def _all_documents(self) -> DataFrame:
        return self.nodes.select("id", F.concat_ws(" ", "qualified_name", "signature", "docstring").alias("text"))

    def lookup(self, name: str) -> DataFrame:
        return graph.lookup(self.nodes, self.edges, self._named(name))

    def lookup_fact(self, name: str) -> dict:
        """One symbol's fact, or that there is none, with up to three names like it."""
        hit = self.lookup(name).join(self.nodes.select("id", "kind", "signature", "file_path", "start_line"), "id", "left").first()
        if hit["found"]:
            return hit.asDict()
        like = self.search(name, 3).collect()
        return {"found": False, "message": f"NOT FOUND: no symbol named '{name}' exists in this codebase. Do not invent it.", "suggestions": [{"name": r["qualified_name"], "file": r["file_path"], "line": r["start_line"]} for r in like]}

    def callers(self, name: str) -> DataFrame:
        return graph.callers(self.nodes, self.edges).join(self.resolve_symbol(name).withColumnRenamed("id", "target"), "target", "left_semi")

    def refs(self, name: str, read_write: str | None = None) -> DataFrame:
        return graph.references(self.edges, read_write).join(self.resolve_symbol(name).withColumnRenamed("id", "target"), "target", "left_semi")

    def deps(self, path: str) -> DataFrame:
        return graph.dependencies(self.nodes, self.edges).filter(F.col("file") == path)

    def impact(self, name: str, depth: int = 3) -> DataFrame:
        return graph.impact(self.nodes, self.edges, self.resolve_symbol(name), depth)

    def tests_for(self, name: str) -> DataFrame:
        return graph.tests_for(self.nodes, self.edges, self.roles, self.resolve_symbol(name)).orderBy("file_path", "start_line")

    def watch(self, on_change: Callable[[str, str], None] | None = None, debounce: float = 0.15):
        """A watcher, started, that keeps an engine up to date with the folder; its ``engine`` is the latest."""
        from graphloom.streaming.watch import FolderWatcher

        return FolderWatcher(self, on_change, debounce).start()

    def inventory_lines(self) -> DataFrame:
        """The inventory as JSON, a line for each file, in order."""
        rows = self.inventory().select("path", "role", "language", "symbols", F.col("inbound_edges").alias("inboundEdges"), "orphaned").orderBy("path")
        return rows.select(F.to_json(F.struct("*")).alias("value"))

    def stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges, self.files)

    def fingerprint(self) -> DataFrame:
        return graph.fingerprint(self.files)

    def inventory(self) -> DataFrame:
        return graph.inventory(self.nodes, self.edges, self.roles)

    def stale_docs(self) -> DataFrame:
        """file, line, name of what documents mention and nothing defines."""
        refs = self.edges.filter("resolver = 'docs-inline'").join(self.nodes.select(F.col("id").alias("target"), F.regexp_replace("qualified_name", "^<docref>[.]", "").alias("name")), "target")
        mentions = refs.join(self.nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file")), "source").select("file", "line", "name")
        return graph.stale_mentions(mentions, self.nodes).select("file", "line", "name")

    # --- domains

    @cached_property
    def labels(self) -> DataFrame:
        return cut(domains.propagate(domains.seed_labels(self.roles), graph.file_pairs(self.nodes, self.edges)))

    def map(self) -> dict[str, DataFrame]:
        named = domains.domains(self.labels, self.roles)
        return {"domains": named.join(domains.display_names(named), "label"), "edges": domains.domain_edges(self.labels, graph.file_pairs(self.nodes, self.edges)), "symbols": domains.top_symbols(self.nodes, self.edges, self.labels)}

    def map_found(self) -> dict:
        """The map put together: domains with entry points and top symbols, and the edges between them."""
        m = self.map()
        entries: dict[str, list[str]] = {}
        for r in self.labels.join(self.roles.filter("role = 'entrypoint'"), "path").orderBy("path").collect():
            entries.setdefault(r["label"], []).append(r["path"])
        symbols: dict[str, list[dict]] = {}
        for r in m["symbols"].join(self.nodes.select("id", "qualified_name", "file_path", "start_line"), "id").orderBy("label", "position").collect():
            symbols.setdefault(r["label"], []).append({"name": r["qualified_name"], "file": r["file_path"], "line": r["start_line"]})
        found = [{"label": r["label"], "name": r["name"], "files": r["n_files"], "entrypoints": entries.get(r["label"], []), "symbols": symbols.get(r["label"], [])} for r in m["domains"].orderBy("name", "label").collect()]
        return {"domains": found, "edges": [r.asDict() for r in m["edges"].orderBy(F.desc("weight"), "from_label", "to_label").collect()]}

    def map_mermaid(self) -> str:
        return slices.map_mermaid(self.map_found())

    def map_markdown(self) -> str:
        return slices.map_markdown(self.map_found())

    # --- slices and checks

    @cached_property
    def semantic(self) -> tuple[DataFrame, DataFrame]:
        """Symbol documents and their latent index, worked out once for a state of the files."""
        docs = cut(self._documents())
        return docs, cut(retrieval.lsa_index(docs))

    def slice(self, task: str, budget: int = 6000, scope: str | None = None, resolution: str = "harmonic", balance: dict[str, float] = ranking.BALANCE, seeds: int = 8, depth: int = 2, max_nodes: int = 60, full_count: int = slices.FULL_COUNT) -> slices.Slice:
        """What matters for a task, restricted to a domain by name; raises where no domain has it."""
        nodes = self.nodes
        if scope is not None:
            display = self.map()["domains"].filter((F.col("display") == scope) | (F.col("name") == scope)).select("label")
            if display.isEmpty():
                known = ", ".join(sorted(r["display"] for r in self.map()["domains"].select("display").collect()))
                raise ValueError(f"no domain {scope!r}; there are: {known}")
            inside = self.labels.join(display, "label", "left_semi").select(F.col("path").alias("file_path"))
            nodes = nodes.join(inside, "file_path", "left_semi")
        docs, lsa = self.semantic
        lists = [cut(retrieval.top(x, 300)) for x in (retrieval.lsa_query(lsa, docs, task), retrieval.bm25(docs, task))]
        best = retrieval.top(retrieval.rrf([retrieval.top(x, 3 * seeds) for x in lists]), seeds)
        if best.isEmpty():
            best = retrieval.top(retrieval.fts(self._all_documents(), task), seeds)
        best = cut(best.join(nodes.select("id"), "id", "left_semi"))
        anchors = best.select("id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")).alias("ord"))
        spine = graph.spine(nodes, self.edges, anchors, depth, max_nodes)
        intent = re.search(ranking.TEST_INTENT, task) is not None
        on = nodes.join(spine.select("id"), "id", "left_semi")
        ranked = cut(ranking.rank_nodes(on, self.edges, self.roles, retrieval.relevance(lists), intent))
        head = slices.tokens_of("\n".join([slices.title(task), slices.LEGEND, ""]))
        if resolution == "flat":
            rows = slices.flat_rows(ranked, nodes, self.edges, self.files, max(0, budget - head), full_count)
        else:
            rows = slices.slice_rows(ranked, nodes, self.edges, self.files, max(200, budget - head - 30), balance)
        return slices.Slice(task, [r["id"] for r in anchors.orderBy("ord").collect()], rows)

    def understand(self, task: str, budget: int = 6000, scope: str | None = None, **more) -> DataFrame:
        """tier, ord, line of the slice for a task."""
        return self.slice(task, budget, scope, **more).rows

    def allowed(self, more: tuple[str, ...] = ()) -> tuple[str, ...]:
        """Names that checks let pass: those given, and the lines of the project's allow file."""
        path = Path(self.root) / ALLOW_FILE if self.root is not None else None
        if path is None or not path.exists():
            return tuple(dict.fromkeys(more))
        return tuple(r["name"] for r in verify.allow_list(self.spark, str(path), tuple(more)).orderBy("name").collect())

    def verify(self, diff: str, allow: tuple[str, ...] = ()) -> DataFrame:
        """Findings of a unified diff against the index, over an overlay that leaves the index as it is."""
        parsed = diffs.parse_diff(diff)
        diff_table = self.spark.createDataFrame([(diff,)], "diff string")
        changed = self.spark.createDataFrame([(f["path"], f["deleted"]) for f in parsed], "path string, deleted boolean")
        posts = diffs.apply_all(self.files.select("path", "text"), diff_table).join(changed.select("path"), "path", "left_semi")
        ranges = diffs.added_ranges(diffs.diff_lines(diff_table)).select(F.col("path").alias("file"), "range_start", "range_end")
        return self._verify(changed, posts, ranges, allow)

    def verify_inputs(self, inputs: list[dict], allow: tuple[str, ...] = ()) -> DataFrame:
        """Findings of given post-images: path, post_image (None where the file goes), ranges of added lines."""
        changed = self.spark.createDataFrame([(i["path"], i["post_image"] is None) for i in inputs], "path string, deleted boolean")
        posts = self.spark.createDataFrame([(i["path"], i["post_image"], None) for i in inputs], "path string, post_image string, error string")
        ranges = self.spark.createDataFrame([(i["path"], int(a), int(b)) for i in inputs for a, b in i["ranges"]], "file string, range_start int, range_end int")
        return self._verify(changed, posts, ranges, allow)

    def staged_inputs(self) -> list[dict]:
        """What git is about to commit, as inputs."""
        if not (Path(self.root) / ".git").exists():
            raise ValueError("not a git repository: give a diff")
        git = lambda *a: subprocess.run(["git", "-C", self.root, *a], capture_output=True, check=True).stdout.decode("utf-8", "replace")
        diff = git("diff", "--cached", "--unified=0")
        ranges: dict[str, list[tuple[int, int]]] = {}
        if diff:
            for r in diffs.added_ranges(diffs.diff_lines(self.spark.createDataFrame([(diff,)], "diff string"))).collect():
                ranges.setdefault(r["path"], []).append((r["range_start"], r["range_end"]))
        out = []
        for f in diffs.parse_diff(diff) if diff else []:
            try:
                post = git("show", f":{f['path']}")
            except subprocess.CalledProcessError:  # it is deleted
                post = None
            out.append({"path": f["path"], "post_image": post, "ranges": ranges.get(f["path"], [])})
        return out

    def skipped_inputs(self, paths: list[str]) -> list[str]:
        """Paths that a check leaves out for their role."""
        given = self.spark.createDataFrame([(p,) for p in paths], "path string")
        return [r["path"] for r in self.roles.filter(F.col("role").isin(*verify.SKIPPED_ROLES)).join(given, "path", "left_semi").orderBy("path").collect()]

    def _verify(self, changed: DataFrame, posts: DataFrame, ranges: DataFrame, allow: tuple[str, ...]) -> DataFrame:
        allow = self.allowed(tuple(allow))
        skipped = self.roles.filter(F.col("role").isin(*verify.SKIPPED_ROLES)).select("path")
        changed = changed.join(skipped, "path", "left_anti")
        posts = cut(posts.join(changed.select("path"), "path", "left_semi"))
        broken = posts.filter("error is not null").select(F.lit("error").alias("severity"), F.lit("parse-failure").alias("rule"), F.col("path").alias("file"), F.lit(1).alias("line"), F.col("error").alias("message"))
        after = posts.filter("post_image is not null").select("path", scan.language_of(F.col("path")).alias("language"), F.col("post_image").alias("text"))
        new_nodes, new_edges, new_imports = extract.graph_of(cut(extract.extract_files(after)))
        files = changed.select(F.col("path").alias("file_path"))
        overlay = self.nodes.join(files, "file_path", "left_anti").unionByName(new_nodes)
        imports = self.imports.join(changed.select(F.col("path").alias("file")), "file", "left_anti").unionByName(new_imports)
        edges = resolve.resolve_imports(overlay, new_edges, imports, self.files.select("path").unionByName(after.select("path")).distinct())
        own = new_nodes.select(F.col("id").alias("source"), F.col("file_path").alias("file"), "language")
        calls = cut(verify.in_ranges(edges.filter("kind = 'calls'").join(own, "source"), ranges))
        callee = overlay.select(F.col("id").alias("target"), F.regexp_replace("qualified_name", "^<unresolved>[.]", "").alias("name"))
        open_calls = calls.filter("provenance = 'unresolved'").join(callee, "target").select("file", "language", "line", "name").distinct()
        allowed = self.spark.createDataFrame([(a,) for a in allow], "name string")
        spans = self.nodes.filter(F.col("kind").isin(*verify.CHANGED_KINDS)).select("id", F.col("file_path").alias("file"), "start_line", "end_line", "qualified_name", "is_exported")
        deleted = spans.join(changed.filter("deleted").select(F.col("path").alias("file")), "file", "left_semi").filter("is_exported")
        touched = verify.overlapping(new_nodes.filter(F.col("kind").isin(*verify.CHANGED_KINDS)).select("id", F.col("file_path").alias("file"), "start_line", "end_line", "qualified_name", "is_exported"), ranges)
        hit = touched.unionByName(deleted).select("id", "file", F.col("start_line").alias("line"), "qualified_name").dropDuplicates(["id"])
        readable = after.select(F.col("path").alias("file"), "text", F.col("language").isNotNull().alias("has_extractor"))
        found = (
            broken.unionByName(verify.parse_failures(readable, new_nodes, new_edges))
            .unionByName(verify.unknown_symbols(open_calls, overlay, imports, allowed))
            .unionByName(verify.signature_echoes(calls.filter("provenance <> 'unresolved'").select("file", "line", "target"), overlay))
            .unionByName(verify.blast_radius(hit, self.nodes, self.edges, changed.select(F.col("path").alias("file"))))
        )
        return verify.ordered(found.distinct())
