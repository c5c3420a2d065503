"""The driver's tables as graph, files, symbol documents, links and version feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.classify import CONFIG_PATH, TEST_PATH
from graphloom.functions.text import node_id
from graphloom.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, of: str, key: str, kind: str, name: Column, path: Column, language: str, line: Column, span: int, signature: Column, exported: Column) -> DataFrame:
    return df.select(
        node_id(F.lit(of), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("kind"), name.alias("qualified_name"), path.alias("file_path"), F.lit(language).alias("language"),
        line.cast("int").alias("start_line"), (line + span).cast("int").alias("end_line"), signature.alias("signature"), F.lit(None).cast("string").alias("docstring"), exported.alias("is_exported"),
    )


def _cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """A plan over the tables, not a copy of them: a query reads and hashes the columns that it needs and writes nothing but its result."""
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    c, yes = F.col, F.lit(True)
    named = nation.select(c("n_nationkey").alias("k"), "n_name")
    customer = table(spark, d, "customer").join(F.broadcast(named), c("c_nationkey") == c("k"))
    supplier = table(spark, d, "supplier").join(F.broadcast(named), c("s_nationkey") == c("k"))
    rank = F.substring("o_orderpriority", 1, 1)
    parts = [
        _node(region, "region", "r_regionkey", "module", c("r_name"), F.lit("geo/index.ts"), "typescript", c("r_regionkey") + 1, 0, _cat("region ", c("r_name")), yes),
        _node(nation.join(F.broadcast(region), c("n_regionkey") == c("r_regionkey")), "nation", "n_nationkey", "module", _cat(c("r_name"), ".", c("n_name")), _cat("geo/", F.lower("r_name"), "/nations.ts"), "typescript", c("n_nationkey") + 1, 0, _cat("nation ", c("n_name")), yes),
        _node(customer, "customer", "c_custkey", "class", _cat(c("n_name"), ".", c("c_name")), _cat("sales/", F.lower("n_name"), "/", F.lower("c_mktsegment"), ".py"), "python", c("c_custkey") + 1, 5, _cat("class ", c("c_name"), "(", c("c_mktsegment"), ")"), c("c_acctbal") > 0),
        _node(supplier, "supplier", "s_suppkey", "struct", _cat(c("n_name"), ".", c("s_name")), _cat("supply/", F.lower("n_name"), ".go"), "go", c("s_suppkey") + 1, 3, _cat("type ", c("s_name"), " struct"), c("s_acctbal") > 0),
        _node(spread(table(spark, d, "orders")), "order", "o_orderkey", "function", _cat("order.o", c("o_orderkey").cast("string")), F.when(rank == "1", "tests/urgent_orders.py").otherwise(_cat("orders/p", rank, ".py")), "python", c("o_orderkey") * 10 + 1, 8, _cat("def o", c("o_orderkey").cast("string"), "()"), c("o_orderstatus") == "F"),
        _node(table(spark, d, "part"), "part", "p_partkey", "interface", _cat(c("p_brand"), ".", F.replace("p_name", F.lit(" "), F.lit("_")), ".v", c("p_partkey").cast("string")), _cat("parts/", F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), ".ts"), "typescript", c("p_partkey") + 1, 2, _cat("interface ", c("p_name")), c("p_size") > 25),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edge(df: DataFrame, source: Column, target: Column, kind: str, line: Column, provenance: Column, confidence: Column, rw: Column, boundary: Column) -> DataFrame:
    return df.select(
        source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"), line.cast("int").alias("line"), F.lit(1).alias("col"), provenance.alias("provenance"),
        confidence.alias("confidence"), F.lit("lift").alias("resolver"), rw.alias("read_write"), F.when(boundary.isNotNull(), F.create_map(F.lit("boundary"), boundary)).alias("metadata"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """A plan as nodes(): each branch is of one kind, so a filter of kinds leaves whole tables unread."""
    c = F.col
    of = lambda t, k: node_id(F.lit(t), c(k).cast("string"))
    none, one = F.lit(None).cast("string"), F.lit(1.0)
    exact = F.lit("ast_exact")
    lines = spread(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_discount"))
    by_flag = F.when(c("l_returnflag") == "N", "ast_exact").when(c("l_returnflag") == "A", "ast_inferred").otherwise("unresolved")
    status = F.when(c("o_orderstatus") == "F", "ast_exact").when(c("o_orderstatus") == "O", "ast_inferred").otherwise("heuristic")
    rw = F.when(c("l_linestatus") == "O", "read").otherwise("write")
    dynamic = F.when(c("l_discount") >= 0.09, "dynamic-dispatch")
    parts = [
        _edge(table(spark, d, "nation"), of("region", "n_regionkey"), of("nation", "n_nationkey"), "contains", c("n_nationkey"), exact, one, none, none),
        _edge(table(spark, d, "customer"), of("nation", "c_nationkey"), of("customer", "c_custkey"), "contains", c("c_custkey"), exact, one, none, none),
        _edge(table(spark, d, "supplier"), of("nation", "s_nationkey"), of("supplier", "s_suppkey"), "contains", c("s_suppkey"), exact, one, none, none),
        _edge(spread(table(spark, d, "orders")), of("customer", "o_custkey"), of("order", "o_orderkey"), "calls", c("o_orderkey"), status, F.lit(0.85), F.lit("call"), none),
        _edge(lines, of("order", "l_orderkey"), of("part", "l_partkey"), "references", c("l_linenumber"), by_flag, F.round(1 - c("l_discount"), 2), rw, none),
        _edge(lines, of("supplier", "l_suppkey"), of("part", "l_partkey"), "calls", c("l_linenumber"), by_flag, F.round(1 - c("l_discount"), 2), F.lit("call"), dynamic),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def packed(df: DataFrame, *ids: str) -> DataFrame:
    """Hexadecimal ids as bytes, half as long and in the same order; for plans that shuffle every edge."""
    return df.withColumns({c: F.unhex(c) for c in ids})


def unpacked(df: DataFrame, *ids: str) -> DataFrame:
    return df.withColumns({c: F.lower(F.hex(c)) for c in ids})


def roles(node_table: DataFrame) -> DataFrame:
    """path, role, language of every file that holds a node."""
    path = F.col("file_path")
    role = F.when(path.rlike(TEST_PATH), "test").when(path.rlike(r"(^|/)index\.ts$"), "entrypoint").when(path.rlike(CONFIG_PATH), "config").otherwise("library")
    return node_table.filter(~path.startswith("<")).groupBy("file_path").agg(F.min("language").alias("language")).select(path.alias("path"), role.alias("role"), "language")


def document_path() -> Column:
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".md")))


def document_files(spark: SparkSession, d: str) -> DataFrame:
    """path, text, hash, mtime_ms of the documents."""
    return table(spark, d, "documents").select(document_path().alias("path"), "text", F.sha2("text", 256).alias("hash"), F.col("doc_id").cast("double").alias("mtime_ms"))


def symbol_documents(spark: SparkSession, d: str) -> DataFrame:
    """id, text: what retrieval searches."""
    return table(spark, d, "documents").select(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("id"), "text")


def _page_path() -> Column:
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    return F.concat(host, F.lit("/"), F.lpad(F.col("page_id").cast("string"), 10, "0"), F.lit(".html"))


def page_links(spark: SparkSession, d: str) -> DataFrame:
    """page_id, path, pos, target of every link of the pages."""
    links = F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), 1)
    return table(spark, d, "pages").select("page_id", _page_path().alias("path"), F.posexplode(links).alias("pos", "target"))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    """path of every page and of every target that a page links to."""
    pages = table(spark, d, "pages").select(_page_path().alias("path"))
    return pages.unionByName(page_links(spark, d).select(F.concat(F.lit("site"), "target").alias("path"))).distinct()


def page_graph(spark: SparkSession, d: str) -> DataFrame:
    """a, b, weight: links from the file of a page to the file of its target."""
    return page_links(spark, d).select(F.col("path").alias("a"), F.concat(F.lit("site"), "target").alias("b")).groupBy("a", "b").agg(F.count("*").alias("weight"))


def version_feed(spark: SparkSession, d: str) -> DataFrame:
    """path, ts, hash: one row for each saved version of a file."""
    return table(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("path"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.sha2("props", 256).alias("hash"))
