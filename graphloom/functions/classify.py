"""Language and role of a file, as column expressions over its path and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.text import basename, dirname, extname

#: Extensions by language, without the dot.
EXTENSIONS: dict[str, str] = {
    "astro": "astro", "bash": "bash sh", "c": "h c", "c_sharp": "cs", "cpp": "hxx hh hpp cxx cc cpp", "elixir": "exs ex", "go": "go",
    "java": "java", "javascript": "cjs mjs jsx js", "kotlin": "kts kt", "lua": "lua", "objc": "mm m", "ocaml": "mli ml", "php": "php",
    "python": "py", "rescript": "resi res", "ruby": "rb", "rust": "rs", "scala": "scala", "solidity": "sol", "svelte": "svelte",
    "swift": "swift", "terraform": "hcl tfvars tf", "typescript": "cts mts tsx ts", "vue": "vue", "zig": "zig",
}
LANGUAGE_OF: dict[str, str] = {f".{e}": lang for lang, es in EXTENSIONS.items() for e in es.split()}
DOC_EXTENSIONS = tuple(f".{e}" for e in "txt rst markdown mdx md".split())
MANIFESTS = tuple("apm.yml cargo.toml go.mod package.json pom.xml pyproject.toml".split())
IGNORED_DIRS = tuple(".cache .git .graphloom .next .nuxt __pycache__ build coverage dist node_modules out target vendor".split())
MAX_BYTES = 1_000_000

VENDORED = r"(?i)(^|/)(vendored|third_party|vendor)(/|$)"
GENERATED = r"@generated|DO NOT EDIT"
TEST_PATH = r"_test\.go$|(^|/)test_[^/]+\.py$|\.(spec|test)\.[^./]+$|(^|/)(spec|tests?|__tests__)/"
MAIN_FILE = r"^(index|main)\.[^.]+$"
CONFIG_PATH = r"(?i)(^|/)(makefile|dockerfile|[^/]+\.config\.(mts|cjs|mjs|ts|js)|\.eslintrc[^/]*|tsconfig[^/]*\.json)$"
_JS = ("supertest", "tap", "ava", "node:test", "chai", "mocha", "@jest/globals", "jest", "vitest")
FRAMEWORKS: dict[str, tuple[str, ...]] = {"go": ("testing",), "javascript": _JS, "python": ("unittest", "pytest"), "ruby": ("minitest", "rspec"), "typescript": _JS}


def language_of(path: Column) -> Column:
    """Manifests and server configurations by name, then documents, then code by extension; null if none fits."""
    base = F.lower(basename(path))
    by_ext = F.create_map(*[F.lit(x) for kv in sorted(LANGUAGE_OF.items()) for x in kv])
    return (
        F.when(base.isin(*MANIFESTS), "manifest")
        .when(base.isin("mcp.json", "mcp_servers.json", "claude_desktop_config.json") | base.endswith(".mcp.json"), "mcp")
        .when(extname(path).isin(*DOC_EXTENSIONS), "markdown")
        .otherwise(F.try_element_at(by_ext, extname(path)))
    )


def is_minified(path: Column) -> Column:
    base = basename(path)
    return base.rlike(r"\.min\.") | base.rlike(r"\.bundle\.(css|cjs|mjs|js)$")


def accepted(path: Column, size: Column) -> Column:
    """Whether a scan takes a file: not too large, not minified, of a known language."""
    return (size <= MAX_BYTES) & ~is_minified(path) & language_of(path).isNotNull()


def in_ignored_dir(path: Column) -> Column:
    return F.exists(F.split(dirname(path), "/"), lambda s: s.isin(*IGNORED_DIRS) | (s.startswith(".") & (s != ".") & (s != "..")))


def role_of(path: Column, text: Column, language: Column, imports: Column, entry_target: Column, in_manifest_dir: Column) -> Column:
    """First that fits: vendored, generated, test, entrypoint, config, doc, library."""
    head = F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n", 21), 1, 20), "\n")
    frameworks = F.create_map(*[x for k, v in sorted(FRAMEWORKS.items()) for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    known = F.coalesce(F.try_element_at(frameworks, language), F.array().cast("array<string>"))
    return (
        F.when(path.rlike(VENDORED), "vendored")
        .when(head.rlike(GENERATED), "generated")
        .when(path.rlike(TEST_PATH) | F.arrays_overlap(F.coalesce(imports, F.array().cast("array<string>")), known), "test")
        .when(entry_target | F.coalesce(text, F.lit("")).startswith("#!"), "entrypoint")
        .when(in_manifest_dir & basename(path).rlike(MAIN_FILE), "entrypoint")
        .when(path.rlike(CONFIG_PATH) | language.isin("mcp", "manifest"), "config")
        .when(language == "markdown", "doc")
        .otherwise("library")
    )
