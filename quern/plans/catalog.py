"""Registered queries over the driver's tables, each beside the SQL that defines its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import chunking, embedding, hashing
from quern.operators import lifecycle, relational, vectors
from quern.operators.incremental import Engine
from quern.plans import routing
from quern.plans.shared import fresh_path
from quern.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
col, lit = F.col, F.lit


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scans, projections, filters ---


@query("SELECT * FROM lineitem")
def scan_all(spark, sf):
    return relational.scan(tables.load(spark, sf, "lineitem"))


@query("SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf):
    return tables.load(spark, sf, "lineitem").agg(F.count(lit(1)).alias("n"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def scan_pushdown(spark, sf):
    return relational.scan(tables.load(spark, sf, "lineitem"), ["l_orderkey", "l_quantity"], col("l_quantity") > 45)


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders")
def project_columns(spark, sf):
    return relational.scan(tables.load(spark, sf, "orders"), ["o_orderpriority", "o_orderkey", "o_totalprice"])


def _filter(name: str, table: str, columns: list[str], where: str, sql: str | None = None) -> None:
    def run(spark, sf):
        return relational.scan(tables.load(spark, sf, table), columns, where)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {sql or where}")(run)


_filter("filter_eq", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], "l_quantity = 30")
_filter("filter_neq", "orders", ["o_orderkey", "o_orderstatus"], "o_orderstatus <> 'O'")
_filter("filter_gt", "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"], "l_extendedprice > 50000")
_filter("filter_gte", "part", ["p_partkey", "p_size"], "p_size >= 40")
_filter("filter_lt", "part", ["p_partkey", "p_retailprice"], "p_retailprice < 1000")
_filter("filter_lte", "lineitem", ["l_orderkey", "l_linenumber", "l_discount"], "l_discount <= 0.02")
_filter("filter_and", "lineitem", ["l_orderkey", "l_linenumber"], "l_quantity > 20 AND l_returnflag = 'R'")
_filter("filter_or", "lineitem", ["l_orderkey", "l_linenumber"], "l_quantity > 49 OR l_tax = 0.08")
_filter("filter_nested", "lineitem", ["l_orderkey", "l_linenumber"], "(l_quantity > 40 OR (l_discount = 0.1 AND l_tax < 0.03)) AND l_linestatus = 'F'")
_filter("filter_literal_left", "lineitem", ["l_orderkey", "l_linenumber"], "5 < l_linenumber AND 10 >= l_quantity")
_filter("filter_string_range", "customer", ["c_custkey", "c_mktsegment"], "c_mktsegment >= 'B' AND c_mktsegment < 'H'")
_filter("filter_timestamp", "orders", ["o_orderkey", "o_orderdate"], "o_orderdate >= timestamp_ntz'1995-01-01 00:00:00'", "o_orderdate >= timestamp '1995-01-01 00:00:00'")

# --- aggregates ---


#: Decimal places of the tables' amounts.
DIGITS = 2


def _sql_fixed(f: str, c: str) -> str:
    """A sum or mean of fixed-point numbers, another aggregate as it is."""
    total = f"sum(floor({c} * 100.0::double + 0.5::double)::bigint)::double / 100.0::double"
    return {"SUM": total, "AVG": f"{total} / count({c})"}.get(f, f"{f}({c})")


def _aggregate(name: str, table: str, aggs: list[tuple[str, str, str]], by: list[str] | None, where: str | None = None) -> None:
    """Sums and means are of fixed-point numbers, as the tables' are: exact in any order."""

    def run(spark, sf):
        return relational.aggregate(relational.scan(tables.load(spark, sf, table), where=where), aggs, by, DIGITS)

    run.__name__ = name
    picks = [*(by or []), *[f"{_sql_fixed(f, c)} AS {n}" for f, c, n in aggs]]
    query(f"SELECT {'' if aggs else 'DISTINCT '}{', '.join(picks)} FROM {table}{f' WHERE {where}' if where else ''}{' GROUP BY ' + ', '.join(by) if by and aggs else ''}")(run)


_aggregate("agg_group_by", "lineitem", [("SUM", "l_quantity", "sum_qty"), ("COUNT", "*", "n")], ["l_returnflag"])
_aggregate("agg_sum", "lineitem", [("SUM", "l_extendedprice", "total"), ("SUM", "l_quantity", "qty")], ["l_linestatus"])
_aggregate("agg_count", "lineitem", [("COUNT", "l_quantity", "n")], ["l_linenumber"])
_aggregate("agg_count_star", "lineitem", [("COUNT", "*", "n")], ["l_returnflag", "l_linestatus"])
_aggregate("agg_avg", "lineitem", [("AVG", "l_discount", "avg_disc"), ("AVG", "l_extendedprice", "avg_price")], ["l_returnflag"])
_aggregate("agg_min_max", "lineitem", [("MIN", "l_extendedprice", "lo"), ("MAX", "l_extendedprice", "hi"), ("MAX", "l_shipdate", "last_ship")], ["l_returnflag"])
_aggregate("agg_global", "lineitem", [("COUNT", "*", "n"), ("SUM", "l_quantity", "qty"), ("MIN", "l_tax", "lo"), ("MAX", "l_tax", "hi"), ("AVG", "l_quantity", "mean")], None)
_aggregate("agg_multi_key", "lineitem", [("SUM", "l_extendedprice", "total"), ("COUNT", "*", "n")], ["l_returnflag", "l_linestatus", "l_linenumber"])
_aggregate("agg_group_numeric", "part", [("COUNT", "*", "n"), ("AVG", "p_retailprice", "price")], ["p_size"])
_aggregate("group_only_distinct", "events", [], ["event_type", "user_id"])
_aggregate("agg_alias", "events", [("COUNT", "*", "how_many"), ("SUM", "value", "total_value")], ["event_type"])
_aggregate("agg_count_string", "customer", [("COUNT", "c_name", "n"), ("MIN", "c_name", "first_name"), ("MAX", "c_name", "last_name")], ["c_mktsegment"])
_aggregate("agg_empty_global", "customer", [("COUNT", "*", "n"), ("SUM", "c_acctbal", "total"), ("MIN", "c_acctbal", "lo")], None, "c_acctbal > 1e12")


@query(f"SELECT l_returnflag, {_sql_fixed('SUM', 'l_extendedprice')} AS revenue, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag")
def pipeline_combined(spark, sf):
    kept = relational.scan(tables.load(spark, sf, "lineitem"), ["l_returnflag", "l_extendedprice"], col("l_quantity") > 10)
    return relational.aggregate(kept, [("SUM", "l_extendedprice", "revenue"), ("COUNT", "*", "n")], ["l_returnflag"], DIGITS)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
def limit_n(spark, sf):
    return tables.load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(15)


@query("SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT * FROM orders WHERE o_orderstatus <> 'F') GROUP BY 1")
def append_batches(spark, sf):
    o = tables.load(spark, sf, "orders")
    both = o.where("o_orderstatus = 'F'").unionByName(o.where("o_orderstatus <> 'F'"))
    return both.groupBy("o_orderstatus").agg(F.count(lit(1)).alias("n"))


@query("SELECT p_partkey, coalesce(try_cast(p_name AS double), 0) AS name_number, coalesce(try_cast(p_size::varchar AS double), 0) AS size_number FROM part")
def cell_coerce(spark, sf):
    number = lambda c: relational.coerce_number(col(c).cast("string"))
    return tables.load(spark, sf, "part").select("p_partkey", number("p_name").alias("name_number"), number("p_size").alias("size_number"))


# --- files and snapshots ---


@query("SELECT s_suppkey, s_name, s_nationkey::bigint AS s_nationkey, s_acctbal FROM supplier")
def csv_load(spark, sf):
    path = fresh_path(spark, "csv")
    tables.load(spark, sf, "supplier").write.option("header", True).csv(path)
    return tables.read_csv(spark, path)


@query("SELECT c_custkey, c_name, c_nationkey::bigint AS c_nationkey, c_mktsegment, c_acctbal FROM customer")
def csv_load_full(spark, sf):
    path = fresh_path(spark, "csv")
    tables.load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", "c_acctbal").write.option("header", True).csv(path)
    return tables.read_csv(spark, path, sample=None)


@query("SELECT count(*) AS files, sum(length(r_name) + 1)::bigint AS chars FROM region")
def text_ingest(spark, sf):
    path = fresh_path(spark, "texts")
    tables.load(spark, sf, "region").repartition(5, "r_regionkey").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(path)
    return tables.read_texts(spark, f"{path}/*").agg(F.count(lit(1)).alias("files"), F.sum(F.length("content")).alias("chars"))


@query("SELECT * FROM orders")
def persist_roundtrip(spark, sf):
    kept = tables.Tables(spark, fresh_path(spark, "tables"))
    kept.replace("orders", tables.load(spark, sf, "orders"), sort_by=["o_orderdate"])
    return kept.open("orders")


@query("SELECT 'nation' AS name, (SELECT count(*) FROM information_schema.columns WHERE table_name = 'nation') AS columns, (SELECT count(*) FROM nation) AS row_count, 1 AS version")
def table_info(spark, sf):
    kept = tables.Tables(spark, fresh_path(spark, "tables"))
    kept.replace("nation", tables.load(spark, sf, "nation"))
    i = kept.info("nation")
    return spark.createDataFrame([(i["name"], len(i["columns"]), i["rows"], i["version"])], "name string, columns bigint, row_count bigint, version int")


@query("""SELECT 'nation' AS name, 3::bigint AS version, (SELECT 2 * count(*) FROM nation) AS row_count UNION ALL SELECT 'part', 2, (SELECT count(*) FROM part WHERE p_size > 25)
  UNION ALL SELECT 'region', 0, 0""")
def table_manager(spark, sf):
    kept = tables.Tables(spark, fresh_path(spark, "tables"))
    nation, part = tables.load(spark, sf, "nation"), tables.load(spark, sf, "part").select("p_partkey", "p_size")
    with kept.step() as step:
        step.create("region", tables.load(spark, sf, "region").schema)
        step.replace("nation", nation)
        step.replace("part", part)
    kept.append("nation", nation.where("n_nationkey % 2 = 0"))
    with kept.step() as step:
        step.append("nation", nation.where("n_nationkey % 2 = 1"))
        step.upsert("part", part.limit(0), part.where("p_size <= 25"), ["p_partkey"])
    rows = [(n, kept.version(n), kept.open(n).count()) for n in kept.names()]
    return spark.createDataFrame(rows, "name string, version bigint, row_count bigint")


# --- hashes, chunks, lifecycle ---

_BYTES = "list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda p: ('0x' || p)::hugeint)"


def _sql_fnv(table: str, key: str, x: str) -> str:
    state = f"list_reduce([14695981039346656037::hugeint] || {_BYTES.format(x)}, lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint)"
    return f"SELECT {key}, printf('%08x%08x', (h // 4294967296)::bigint, (h % 4294967296)::bigint) AS hash FROM (SELECT {key}, {state} AS h FROM {table})"


@query(_sql_fnv("nation", "n_nationkey", "n_name"))
def fnv1a_hash(spark, sf):
    return tables.load(spark, sf, "nation").select("n_nationkey", hashing.fnv1a(col("n_name")).alias("hash"))


@query(_sql_fnv("documents", "doc_id", "text || chr(31)"))
def content_hash(spark, sf):
    return tables.load(spark, sf, "documents").select("doc_id", hashing.content_hash(col("text")).alias("hash"))


def _conversations(spark, sf) -> DataFrame:
    """One document a conversation: its turns, parted by blank lines."""
    c = tables.load(spark, sf, "conversations")
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return c.groupBy(col("conv_id").alias("document_id")).agg(F.array_join(turns, "\n\n").alias("content"))


def _revised(spark, sf) -> DataFrame:
    """The same with the second turn of every tenth conversation revised."""
    c = tables.load(spark, sf, "conversations")
    text = F.when((col("conv_id") % 10 == 0) & (col("turn") == 1), F.concat("text", lit(" REVISED"))).otherwise(col("text"))
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", text.alias("text")))), lambda x: x["text"])
    return c.groupBy(col("conv_id").alias("document_id")).agg(F.array_join(turns, "\n\n").alias("content"))


_SQL_CONV = "SELECT conv_id AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY 1"
_SQL_REV = "SELECT conv_id AS document_id, string_agg(CASE WHEN conv_id % 10 = 0 AND turn = 1 THEN text || ' REVISED' ELSE text END, chr(10) || chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY 1"


def _sql_chunks(source: str) -> str:
    """Chunks by bytes: paragraphs in hex, cut by a pattern over pairs of digits."""
    ws = "20|09|0A|0C|0D"
    pieces = f"list_transform(regexp_extract_all(hex(encode(p)), '((?:[0-9A-F][0-9A-F]){{1,512}})(?:(?:{ws})+|$)', 1), lambda c: decode(unhex(c)))"
    return f"""SELECT document_id, (unnest(range(len(c))))::int AS chunk_id, unnest(c) AS content FROM (SELECT document_id, flatten(list_transform(
      list_filter(string_split_regex(content, '\\n\\n+'), lambda p: p <> ''), lambda p: CASE WHEN octet_length(encode(p)) <= 512 THEN [p] ELSE {pieces} END)) AS c FROM ({source}))"""


@query(f"SELECT document_id, (unnest(range(len(p))))::int AS place, unnest(p) AS paragraph FROM (SELECT document_id, string_split_regex(content, '\\n\\n+') AS p FROM ({_SQL_CONV}))")
def split_paragraphs(spark, sf):
    return _conversations(spark, sf).select("document_id", F.posexplode(chunking.split_paragraphs(col("content"))).alias("place", "paragraph"))


@query(_sql_chunks("SELECT doc_id AS document_id, text AS content FROM documents"))
def chunk_documents(spark, sf):
    d = tables.load(spark, sf, "documents").select(col("doc_id").alias("document_id"), col("text").alias("content"))
    return chunking.chunk_documents(d).drop("content_hash")


def _documents(spark, sf) -> DataFrame:
    return tables.load(spark, sf, "documents").select(col("doc_id").alias("document_id"), col("text").alias("content"))


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


_SOURCES = "document_id bigint, version bigint, content_hash string, state string"


@query("SELECT doc_id AS document_id, 1::bigint AS version, 'Active' AS state FROM documents")
def lifecycle_register(spark, sf):
    d = _documents(spark, sf)
    once = lifecycle.register(_empty(spark, _SOURCES), d)
    return lifecycle.register(once, d).drop("content_hash")


@query("SELECT doc_id AS document_id, CASE WHEN doc_id % 10 = 0 THEN 2 ELSE 1 END::bigint AS version, CASE WHEN doc_id % 10 = 0 THEN 'Stale' ELSE 'Active' END AS state FROM documents")
def lifecycle_update(spark, sf):
    d = _documents(spark, sf)
    v2 = d.withColumn("content", F.when(col("document_id") % 10 == 0, F.concat("content", lit(" REVISED"))).otherwise(col("content")))
    return lifecycle.apply_update(lifecycle.register(_empty(spark, _SOURCES), d), v2).drop("content_hash")


_SQL_DIFF = f"""WITH o AS ({_sql_chunks(_SQL_CONV)}), n AS ({_sql_chunks(_SQL_REV)}),
  d AS (SELECT n.document_id, n.chunk_id, CASE WHEN o.content IS NOT DISTINCT FROM n.content THEN 'Skip' ELSE 'Process' END AS action FROM n LEFT JOIN o USING (document_id, chunk_id))"""


@query(f"{_SQL_DIFF} SELECT * FROM d")
def chunk_diff(spark, sf):
    return lifecycle.chunk_diff(chunking.chunk_documents(_conversations(spark, sf)), chunking.chunk_documents(_revised(spark, sf))).select("document_id", "chunk_id", "action")


@query(f"""{_SQL_DIFF} SELECT document_id, count(*) AS total, sum((action = 'Process')::int)::bigint AS generated, sum((action = 'Skip')::int)::bigint AS skipped,
  round((1 - sum((action = 'Process')::int) / count(*)) * 100, 4) AS work_avoided FROM d GROUP BY 1""")
def incremental_report(spark, sf):
    return lifecycle.work_report(lifecycle.chunk_diff(chunking.chunk_documents(_conversations(spark, sf)), chunking.chunk_documents(_revised(spark, sf))))


_SHARES = (1, 5, 10, 50, 100)


@query(f"""WITH o AS ({_sql_chunks(_SQL_CONV)}), s AS (SELECT unnest({list(_SHARES)}) AS percent), v AS (SELECT percent, document_id, chunk_id, document_id % 100 < percent AND chunk_id = 1 AS made FROM o, s)
  SELECT percent::int AS percent, count(*) AS naive, sum(made::int)::bigint AS incremental, round((1 - sum(made::int) / count(*)) * 100, 4) AS work_avoided FROM v GROUP BY 1""")
def naive_vs_incremental(spark, sf):
    """Chunks to embed when the second chunk of some percent of all documents changes: all of them, or those that changed."""
    old = chunking.chunk_documents(_conversations(spark, sf))
    shares = spark.createDataFrame([(p,) for p in _SHARES], "percent int")
    hit = (col("document_id") % 100 < col("percent")) & (col("chunk_id") == 1)
    new = old.crossJoin(F.broadcast(shares)).withColumn("content_hash", F.when(hit, F.concat(lit("new "), "content_hash")).otherwise(col("content_hash")))
    diff = lifecycle.chunk_diff(old, new).withColumn("made", (col("action") == "Process").cast("bigint"))
    report = diff.groupBy("percent").agg(F.count(lit(1)).alias("naive"), F.sum("made").alias("incremental"))
    return report.withColumn("work_avoided", F.round((1 - col("incremental") / col("naive")) * 100, 4))


@query("SELECT doc_id AS document_id, min(doc_id) OVER (PARTITION BY text) AS canonical, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
def exact_dedup_outcome(spark, sf):
    h = lifecycle.hashed(_documents(spark, sf))
    return vectors.first_seen(h, "content_hash", "document_id").select("document_id", "canonical", "is_duplicate")


@query("SELECT count(*) AS total, count(DISTINCT text) AS unique_documents, count(*) - count(DISTINCT text) AS duplicates, round((count(*) - count(DISTINCT text)) / count(*), 6) AS ratio FROM documents")
def exact_dedup_report(spark, sf):
    return lifecycle.duplicate_report(_documents(spark, sf)).withColumn("ratio", F.round("ratio", 6))


# --- vectors ---


def _vectors(spark, sf) -> DataFrame:
    """The embeddings as a vector table: the label stands for the document."""
    e = tables.load(spark, sf, "embeddings")
    return e.select(
        col("label").cast("bigint").alias("document_id"), col("vec_id").cast("int").alias("chunk_id"), lit(1).cast("bigint").alias("source_version"),
        F.when(col("vec_id") % 3 == 0, lit("model-v2")).otherwise(lit("model-v1")).alias("model_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )


_SQL_PAIRS = """SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) AS similarity
  FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= {}"""


@query(_SQL_PAIRS.format(0.3))
def cosine_pairs(spark, sf):
    v = _vectors(spark, sf).select(col("chunk_id").cast("bigint").alias("id"), "vector")
    return vectors.pairs_above(v, 0.3, ["id"]).withColumn("similarity", F.round("similarity", 6))


@query(_SQL_PAIRS.format(0.35))
def semantic_dedup(spark, sf):
    v = _vectors(spark, sf).withColumns({"document_id": col("chunk_id").cast("bigint"), "chunk_id": lit(0)})
    return vectors.semantic_duplicates(v, 0.35).select(col("document_id_a").alias("id_a"), col("document_id_b").alias("id_b"), F.round("similarity", 6).alias("similarity"))


def _probe(spark, sf) -> list[float]:
    """The query vector of the searches: the one of the least id."""
    return [float(x) for x in tables.load(spark, sf, "embeddings").orderBy("vec_id").first()["embedding"]]


_SQL_SCORED = "SELECT e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) AS score FROM embeddings e, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q"


@query(f"SELECT label::bigint AS document_id, vec_id::int AS chunk_id, round(score, 6) AS score FROM ({_SQL_SCORED}) ORDER BY score DESC, 1, 2 LIMIT 10")
def vector_topk(spark, sf):
    return vectors.top_k(_vectors(spark, sf), _probe(spark, sf), 10).select("document_id", "chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT label::bigint AS document_id, vec_id::int AS chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS k FROM ({_SQL_SCORED})) WHERE k = 1")
def search_best_per_doc(spark, sf):
    hits = vectors.scored(_vectors(spark, sf), _probe(spark, sf))
    return vectors.best_per_document(hits).withColumn("score", F.round("score", 6))


@query("SELECT vec_id::int AS chunk_id, CASE WHEN vec_id % 5 = 0 THEN 2 ELSE 1 END::bigint AS source_version, round(CASE WHEN vec_id % 5 = 0 THEN -1 ELSE 1 END * embedding[1]::double, 6) AS head FROM embeddings")
def vector_upsert(spark, sf):
    v = _vectors(spark, sf)
    new = v.where("chunk_id % 5 = 0").withColumns({"source_version": lit(2).cast("bigint"), "vector": F.transform("vector", lambda x: -x)})
    return vectors.upsert(v, new).select("chunk_id", "source_version", F.round(col("vector")[0], 6).alias("head"))


@query("SELECT label::bigint AS document_id, count(*) AS n FROM embeddings WHERE label % 4 <> 0 GROUP BY 1")
def vector_delete(spark, sf):
    v = _vectors(spark, sf)
    return vectors.remove(v, v.where("document_id % 4 = 0")).groupBy("document_id").agg(F.count(lit(1)).alias("n"))


@query("SELECT sum((vec_id % 3 <> 0)::int)::bigint AS migrated, sum((vec_id % 3 = 0)::int)::bigint AS skipped FROM embeddings")
def model_migration(spark, sf):
    v = _vectors(spark, sf)
    chunks = v.select("document_id", "chunk_id", F.concat(lit("vector "), "chunk_id").alias("content"))
    todo = vectors.to_migrate(v, chunks, "model-v2")
    made = embedding.embed_column(todo.select("document_id", "chunk_id", "source_version", "content"), "content", embedding.HashingProvider("model-v2")).withColumn("model_id", lit("model-v2"))
    after = vectors.upsert(v, made).join(v.select("document_id", "chunk_id", col("model_id").alias("was")), ["document_id", "chunk_id"])
    moved = (col("was") != col("model_id")).cast("bigint")
    return after.agg(F.sum(moved).alias("migrated"), F.sum(1 - moved).alias("skipped"))


@query("SELECT vec_id::int AS chunk_id, len(embedding)::int AS n, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) AS total FROM embeddings")
def vector_roundtrip(spark, sf):
    kept = tables.Tables(spark, fresh_path(spark, "vectors"))
    kept.replace("vectors", _vectors(spark, sf))
    add = F.aggregate("vector", lit(0.0), lambda a, x: a + x)
    return kept.open("vectors").select("chunk_id", F.size("vector").alias("n"), F.round(add, 6).alias("total"))


# --- embeddings and similarity ---

_REL = ", ".join(f"('{k}', '{x}')" for k, v in embedding.RELATED.items() for x in v)


def _sql_embed(source: str) -> str:
    """The built-in embedding of ``source(id, t)`` as ``id, idx, v``: hash each distinct feature once."""
    return f"""inp AS ({source}), low AS (SELECT id, lower(t) AS t FROM inp),
  tok AS (SELECT id, w FROM (SELECT id, unnest(regexp_split_to_array(t, '[^\\p{{L}}\\p{{N}}]+')) AS w FROM low) WHERE w <> ''),
  rel(k, x) AS (VALUES {_REL}),
  st AS (SELECT id, CASE WHEN regexp_matches(w, '^.+ing$') THEN w[:-4] WHEN regexp_matches(w, '^.+es$') THEN w[:-3] WHEN regexp_matches(w, '^.+s$') THEN w[:-2] WHEN regexp_matches(w, '^.+ed$') THEN w[:-3] ELSE w END AS s FROM tok),
  chars AS (SELECT id, regexp_extract_all(t, '(?s).') AS c FROM low),
  g AS (SELECT id, unnest(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]) || list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS f FROM chars),
  feat AS (SELECT id, f, sum(wt) AS wt FROM (SELECT id, w AS f, 2.0::double AS wt FROM tok UNION ALL SELECT id, x, 2.0 FROM st JOIN rel ON s = k UNION ALL SELECT id, f, 0.25 FROM g) GROUP BY 1, 2),
  h AS (SELECT f, list_reduce([14695981039346656037::hugeint] || {_BYTES.format('f')}, lambda h, b: (xor(h, b) * 1099511628211::hugeint) % 18446744073709551616::hugeint) AS hv FROM (SELECT DISTINCT f FROM feat)),
  vec AS (SELECT id, (hv % 128)::int AS idx, sum(CASE WHEN hv >= 9223372036854775808::hugeint THEN wt ELSE -wt END) AS v FROM feat JOIN h USING (f) GROUP BY 1, 2),
  emb AS (SELECT id, idx, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM vec)"""


_Q = "the thing and the other thing"
_SQL_SCORES = f"WITH {_sql_embed(f'''SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT -1, '{_Q}' ''')}, sim AS (SELECT a.id, sum(a.v * b.v) AS score FROM emb a JOIN emb b ON a.idx = b.idx AND b.id = -1 WHERE a.id >= 0 GROUP BY 1)"


@query(f"WITH {_sql_embed('SELECT doc_id AS id, text AS t FROM documents')} SELECT id AS doc_id, idx, round(v, 6) AS v FROM emb WHERE v <> 0")
def embed_documents(spark, sf):
    v = embedding.embed_column(tables.load(spark, sf, "documents").select("doc_id", "text"), "text")
    return v.select("doc_id", F.posexplode("vector").alias("idx", "v")).where("v <> 0").withColumn("v", F.round("v", 6))


@query(f"{_SQL_SCORES} SELECT id AS doc_id, round(score, 6) AS score FROM sim WHERE score > 0.3")
def similarity_filter(spark, sf):
    d = tables.load(spark, sf, "documents").withColumn("score", embedding.similarity_to(col("text"), _Q))
    return d.where("score > 0.3").select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_SQL_SCORES} SELECT doc_id, source FROM sim JOIN documents ON doc_id = id WHERE score > 0.25 AND lang = 'en'")
def hybrid_filter(spark, sf):
    embedding.register_sql(spark)
    tables.load(spark, sf, "documents").createOrReplaceTempView("quern_documents")
    return spark.sql(f"SELECT doc_id, source FROM quern_documents WHERE lang = 'en' AND SIMILARITY(text, '{_Q}') > 0.25")


@query(f"{_SQL_SCORES} SELECT id AS doc_id FROM sim WHERE score >= 0.35")
def vector_search_clause(spark, sf):
    embedding.register_sql(spark)
    tables.load(spark, sf, "documents").createOrReplaceTempView("quern_documents")
    return spark.sql(f"SELECT doc_id FROM quern_documents WHERE VECTOR_SEARCH(text, '{_Q}', 0.35)")


@query(f"SELECT n, route FROM (VALUES (1, 'vector'), (2, 'vector'), (3, 'table')) t(n, route)")
def route_query(spark, sf):
    embedding.register_sql(spark)
    tables.load(spark, sf, "documents").createOrReplaceTempView("quern_documents")
    texts = [f"SELECT doc_id FROM quern_documents WHERE SIMILARITY(text, '{_Q}') > 0.4", f"SELECT doc_id FROM quern_documents WHERE lang = 'en' AND VECTOR_SEARCH(text, '{_Q}', 0.4)", "SELECT doc_id FROM quern_documents WHERE lang = 'similarity('"]
    return spark.createDataFrame([(i, routing.route(spark, t)) for i, t in enumerate(texts, 1)], "n int, route string")


@query(f"""WITH {_sql_embed("SELECT doc_id AS id, text AS t FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark")}
  SELECT item_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS k FROM
  (SELECT -1 - b.id AS item_id, a.id AS doc_id, sum(a.v * b.v) AS score FROM emb a JOIN emb b ON a.idx = b.idx WHERE a.id >= 0 AND b.id < 0 GROUP BY 1, 2)) WHERE k <= 3""")
def semantic_search_documents(spark, sf):
    return routing.search_many(tables.load(spark, sf, "documents").selectExpr("doc_id", "text"), tables.load(spark, sf, "benchmark").selectExpr("item_id", "text"), 3)


_SQL_BEST = "SELECT id AS doc_id, round(score, 6) AS score FROM sim JOIN documents ON doc_id = id"


@query(f"{_SQL_SCORES} {_SQL_BEST} WHERE lang = 'en' AND score >= 0.25 ORDER BY sim.score DESC, 1 LIMIT 20")
def routed_search(spark, sf):
    """A query with a condition, a threshold and a limit: the condition first, then the vectors."""
    found = routing.hybrid_search(tables.load(spark, sf, "documents").select("doc_id", "text", "lang"), "text", _Q, 0.25, "lang = 'en'", 20, by=["doc_id"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


@query(f"{_SQL_SCORES} SELECT doc_id, round(score, 6) AS score FROM (SELECT * FROM sim ORDER BY score DESC, id LIMIT 64) JOIN documents ON doc_id = id WHERE lang = 'en' AND score >= 0.2")
def routed_search_candidates(spark, sf):
    """The same with the condition applied to the 64 best."""
    found = routing.hybrid_search(tables.load(spark, sf, "documents").select("doc_id", "text", "lang"), "text", _Q, 0.2, "lang = 'en'", candidates=routing.CANDIDATES, by=["doc_id"])
    return found.select("doc_id", F.round("score", 6).alias("score"))


# --- the engine ---


def _engine(spark, sf) -> tuple[Engine, DataFrame]:
    e = Engine(spark, fresh_path(spark, "engine"))
    return e, e.ingest(_conversations(spark, sf))


_SQL_INGEST = f"SELECT count(DISTINCT document_id) AS documents, count(*) AS generated, 0::bigint AS skipped, 0::bigint AS removed, 0.0::double AS work_avoided FROM ({_sql_chunks(_SQL_CONV)})"


@query(_SQL_INGEST)
def engine_ingest(spark, sf):
    return _engine(spark, sf)[1]


@query(f"""{_SQL_DIFF} SELECT count(DISTINCT document_id) AS documents, sum((action = 'Process')::int)::bigint AS generated, sum((action = 'Skip')::int)::bigint AS skipped, 0::bigint AS removed,
  round(100.0 * sum((action = 'Skip')::int) / count(*), 6) AS work_avoided FROM d""")
def engine_update(spark, sf):
    e, _ = _engine(spark, sf)
    return e.update(_revised(spark, sf)).withColumn("work_avoided", F.round("work_avoided", 6))


@query(f"SELECT count(DISTINCT document_id) AS documents, count(*) AS chunks, count(*) AS vectors FROM ({_sql_chunks(_SQL_CONV)}) WHERE document_id % 7 = 0")
def engine_delete(spark, sf):
    e, _ = _engine(spark, sf)
    return e.delete(_conversations(spark, sf).where("document_id % 7 = 0").select("document_id"))


@query(f"SELECT 1 AS step, count(*) AS migrated, 0::bigint AS skipped FROM ({_sql_chunks(_SQL_CONV)}) UNION ALL SELECT 2, 0, count(*) FROM ({_sql_chunks(_SQL_CONV)})")
def engine_migrate(spark, sf):
    e, _ = _engine(spark, sf)
    first, again = (e.migrate(embedding.HashingProvider("model-v2")) for _ in range(2))
    return first.select(lit(1).alias("step"), "*").unionByName(again.select(lit(2).alias("step"), "*"))


@query(f"""WITH ch AS ({_sql_chunks(_SQL_CONV)}), {_sql_embed(f"SELECT document_id * 10000 + chunk_id AS id, content AS t FROM ch UNION ALL SELECT -1, '{_Q}'")}
  SELECT document_id, chunk_id, content, round(score, 6) AS score FROM (SELECT a.id, sum(a.v * b.v) AS score FROM emb a JOIN emb b ON a.idx = b.idx AND b.id = -1 WHERE a.id >= 0 GROUP BY 1)
  JOIN ch ON id = document_id * 10000 + chunk_id ORDER BY round(score, 9) DESC, 1, 2 LIMIT 10""")
def search_chunk_text(spark, sf):
    e, _ = _engine(spark, sf)
    return e.search(_Q, 10).select("document_id", "chunk_id", "content", F.round("score", 6).alias("score"))


@query(f"SELECT document_id, chunk_id, content FROM ({_sql_chunks(_SQL_CONV)})")
def engine_roundtrip(spark, sf):
    e, _ = _engine(spark, sf)
    again = Engine(spark, e.tables.root)
    return again.chunks.join(again.vectors, vectors.KEY, "left_semi").select("document_id", "chunk_id", "content")
