from pyspark.sql import functions as F

from graphloom.functions import classify as C
from graphloom.functions import text as X


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} string" for k in values) or "n int")
    return row.select(column.alias("r")).first()["r"]


def test_identifier_tokens(spark):
    assert one(spark, X.basic_tokens("t"), t="userSession.parse_HTTP") == ["user", "session", "parse", "http"]
    assert one(spark, X.split_identifier("t"), t="parseHTTPResponse for the user") == ["parse", "http", "response", "user"]
    assert one(spark, X.basic_tokens("t"), t=None) == []


def test_synonyms_keep_first_appearance(spark):
    assert one(spark, X.doc_tokens("t"), t="login login user") == ["login", "user", "auth", "authenticate", "signin", "session", "account", "member", "profile"]


def test_paths(spark):
    assert one(spark, X.normalize_path("p"), p="a/./b/../c") == "a/c"
    assert one(spark, X.normalize_path("p"), p="../a") == "../a"
    assert one(spark, X.dirname("p"), p="a/b.ts") == "a"
    assert one(spark, X.extname("p"), p=".env") == ""
    assert one(spark, X.name_suffixes("p"), p="a.b.c") == ["a.b.c", "b.c", "c"]


def test_minify_block_numbers_and_dedents(spark):
    block = one(spark, X.minify_block("t", 10), t="    a\n\n      b\n    c  ")
    assert block == "   10  a\n   12    b\n   13  c"


def test_node_id_is_a_hash_prefix(spark):
    import hashlib

    assert one(spark, X.node_id("f", "q"), f="a.ts", q="x") == hashlib.sha256(b"a.ts::x").hexdigest()[:24]


def test_languages_and_roles(spark):
    rows = [
        ("package.json", "", "manifest", "config"), ("third_party/a.ts", "", "typescript", "vendored"), ("src/a.gen.ts", "// @generated", "typescript", "generated"),
        ("src/a.test.ts", "", "typescript", "test"), ("tool.py", "#!/usr/bin/env python", "python", "entrypoint"), ("docs/a.md", "", "markdown", "doc"),
        ("src/a.ts", "", "typescript", "library"), ("a.unknown", "", None, "library"),
    ]
    df = spark.createDataFrame(rows, "path string, text string, lang string, role string")
    none, no = F.array().cast("array<string>"), F.lit(False)
    language = C.language_of(F.col("path"))
    got = df.select("path", "lang", "role", language.alias("l"), C.role_of(F.col("path"), F.col("text"), language, none, no, no).alias("r")).collect()
    assert [(r.l, r.r) for r in got] == [(r.lang, r.role) for r in got]
    imports = F.array(F.lit("vitest"))
    assert df.limit(1).select(C.role_of(F.lit("src/x.ts"), F.lit(""), F.lit("typescript"), imports, no, no)).first()[0] == "test"


def test_scan_filter(spark):
    rows = [("a.ts", 10), ("vendor.min.js", 10), ("b.py", 2_000_000), ("src/deep.ts", 5)]
    df = spark.createDataFrame(rows, "path string, size long").filter(C.accepted(F.col("path"), F.col("size")))
    assert sorted(r.path for r in df.collect()) == ["a.ts", "src/deep.ts"]
    ignored = spark.createDataFrame([("node_modules/dep/index.js",), ("src/a.ts",)], "path string").filter(C.in_ignored_dir(F.col("path")))
    assert [r.path for r in ignored.collect()] == ["node_modules/dep/index.js"]
