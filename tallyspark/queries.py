"""A query for each operator on the driver's tables, and equal SQL for DuckDB wherever SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import run_queries
from .functions import rows, text
from .operators import enrich, metrics, rescore, runs
from .plans import planner
from .registry import ORACLES, QUERIES, query, r6, t
from .schemas import normalize_labels
from .sources import readers, sinks
from .streaming.rescore import stream_rescore

# ---- sources and row normalisation -----------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source FROM documents WHERE lang = 'fr' AND (source = 'src1' OR source = 'src2')")
def filter_component(spark, sf):
    d = t(spark, sf, "documents")
    return d.where(rows.text_equals(F.col("lang"), "fr") & (rows.matches_task(F.col("source"), F.col("source"), "src1") | rows.matches_task(F.col("source"), F.col("source"), "src2"))).select("doc_id", "lang", "source")


@query("SELECT doc_id, o AS ordinal FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents) WHERE lang = 'de'")
def scan_ordinal(spark, sf):
    return readers.read(spark, "parquet", f"{sf}/documents.parquet", columns=["doc_id"], order=["doc_id"], where=F.col("lang") == "de")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50")
def scan_limit(spark, sf):
    return t(spark, sf, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def jsonl_scan(spark, sf):
    """Events written as JSON lines with a malformed one among them, read back tolerantly."""
    path = sinks.work_dir(spark)
    lines = t(spark, sf, "events").select(sinks.canonical_json(event_id=F.col("event_id"), props=F.col("props")).alias("value"))
    lines.unionByName(spark.createDataFrame([("{bad",), ("",)], "value string")).write.mode("append").text(f"{path}/lines")
    got, _ = readers.quarantine(readers.read(spark, "jsonl", f"{path}/lines", schema="event_id long, props string", keep_malformed=True))
    return got.select("event_id", rows.dotted(F.col("props"), "k").cast("long").alias("k"))


@query("SELECT doc_id, 'hf:' || sha256(coalesce(lang, '') || chr(0) || coalesce(source, '') || chr(0) || doc_id::VARCHAR) AS sample_id FROM documents")
def synth_sample_id(spark, sf):
    return t(spark, sf, "documents").select("doc_id", rows.synthetic_id("hf:", F.col("lang"), F.col("source"), F.col("doc_id")).alias("sample_id"))


@query("SELECT conv_id, turn, coalesce(nullif(trim(CASE WHEN turn % 2 = 0 THEN '  ' ELSE ' u' || conv_id || ' ' END), ''), 'x-' || sha256(role)) AS id FROM conversations")
def resolve_sample_id(spark, sf):
    c = t(spark, sf, "conversations")
    own = F.when(F.col("turn") % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" u"), F.col("conv_id"), F.lit(" ")))
    return c.select("conv_id", "turn", rows.resolve_id([own], rows.synthetic_id("x-", F.col("role"))).alias("id"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_metadata_lookup(spark, sf):
    return t(spark, sf, "events").select("event_id", rows.dotted(F.col("props"), "k").alias("k"))


@query("""SELECT conv_id, nullif(trim(arg_max(text, turn) FILTER (role = 'user'), chr(32) || chr(10) || chr(9)), '') AS conversation,
  nullif(trim(arg_max(text, turn) FILTER (role = 'assistant'), chr(32) || chr(10) || chr(9)), '') AS label FROM conversations GROUP BY conv_id""")
def last_messages(spark, sf):
    m = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return m.select("conv_id", rows.last_message(F.col("m"), "user").alias("conversation"), rows.last_message(F.col("m"), "assistant").alias("label"))


@query("""WITH x AS (SELECT conv_id, turn, '<A>' || role || '<A>' || text || CASE WHEN turn % 2 = 0 THEN '<A>' ELSE '' END || '!' AS s FROM conversations),
y AS (SELECT *, (length(s) - length(replace(s, '<A>', ''))) // 3 AS n, length(s) - strpos(reverse(s), '>A<') - 2 AS last FROM x)
SELECT conv_id, turn, n::INT AS n, replace(substr(s, 1, last), '<A>', '[audio]') || substr(s, last + 1) AS shown FROM y""")
def placeholder_ops(spark, sf):
    s = F.concat(F.lit("<A>"), F.col("role"), F.lit("<A>"), F.col("text"), F.when(F.col("turn") % 2 == 0, "<A>").otherwise(""), F.lit("!"))
    return t(spark, sf, "conversations").select("conv_id", "turn", rows.count_placeholders(s, "<A>").alias("n"), rows.keep_last_placeholder(s, "<A>").alias("shown"))


@query("""SELECT c_custkey, array_to_string(CASE WHEN c_custkey % 3 = 0 THEN ['a', c_mktsegment] WHEN c_custkey % 3 = 1 THEN [c_mktsegment] ELSE [c_name] END, '|') AS labels FROM customer""")
def label_precedence(spark, sf):
    c = t(spark, sf, "customer")
    first = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('[" a ","a","'), F.col("c_mktsegment"), F.lit('",""]')))
    second = F.when(F.col("c_custkey") % 3 == 1, F.col("c_mktsegment")).otherwise(F.lit("  "))
    return c.select("c_custkey", F.array_join(rows.first_labels(first, second, F.col("c_name")), "|").alias("labels"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'list' WHEN 2 THEN 'object' ELSE 'none' END AS kind,
  CASE event_id % 4 WHEN 0 THEN event_type END AS txt, CASE event_id % 4 WHEN 1 THEN event_type || ',b' END AS items FROM events""")
def union_labels(spark, sf):
    k = F.col("event_id") % 4
    j = F.when(k == 0, F.to_json(F.array("event_type"))).when(k == 1, F.to_json(F.array(F.col("event_type"), F.lit("b")))).when(k == 2, F.col("props"))
    j = F.when(k == 0, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(j)
    x = t(spark, sf, "events").select("event_id", normalize_labels(j).alias("l"))
    return x.select("event_id", F.col("l.kind").alias("kind"), F.col("l.text").alias("txt"), F.array_join("l.list", ",").alias("items"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'r/s' || l_partkey WHEN l_linenumber = 2 THEN '/abs/s' ELSE 'gs://b/x' END AS path,
  CASE WHEN l_linenumber <= 3 THEN l_linenumber ELSE NULL END::INT AS tier FROM lineitem""")
def audio_paths(spark, sf):
    x = t(spark, sf, "lineitem")
    p = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("s"), F.col("l_partkey"))).when(F.col("l_linenumber") == 2, "/abs/s").otherwise("gs://b/x")
    tier = F.when(F.col("l_linenumber") == 1, "1").when(F.col("l_linenumber") == 2, " tier_2_x").when(F.col("l_linenumber") == 3, "Tier_3").otherwise("none")
    first = F.get(rows.path_candidates(F.lit(""), p, p), F.lit(0))
    return x.select("l_orderkey", "l_linenumber", rows.resolve_path(F.lit("r/"), first).alias("path"), rows.tier_number(tier).alias("tier"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'c1,c2,q' WHEN 2 THEN 'c1,q' WHEN 3 THEN 's1,s2,s3' END AS paths FROM lineitem""")
def multi_paths(spark, sf):
    n = F.lit(3)
    k = F.col("l_linenumber")
    ctx = F.when(k == 1, text.lits(["c1", "c2", "c3"])).when(k == 2, text.lits(["c1"])).otherwise(F.array().cast("array<string>"))
    src = F.when(k == 3, text.lits(["s1", "s2", "s3"])).otherwise(F.array().cast("array<string>"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(rows.choose_paths(ctx, F.lit("q"), src, F.when(k == 2, 2).otherwise(n)), ",").alias("paths"))


@query("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def taxonomy_lookup(spark, sf):
    c, n, r = (t(spark, sf, x) for x in ("customer", "nation", "region"))
    # as many nations and regions as there are
    return c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("""WITH x AS (SELECT o_custkey, n_name, min(o_orderkey) AS o FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey GROUP BY o_custkey, n_name)
SELECT o_custkey, string_agg(n_name, '|' ORDER BY o) AS names FROM x GROUP BY o_custkey""")
def codes_to_names(spark, sf):
    codes = t(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: (k % 25).cast("int")).alias("codes"))
    names = t(spark, sf, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    return readers.codes_to_names(codes, "o_custkey", "codes", names).select("o_custkey", F.array_join("names", "|").alias("names"))


# ---- joins and run management ----------------------------------------------------------------------------------------


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def prediction_target_join(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    targets = t(spark, sf, "labels").select(F.col("doc_id").alias("sample_id"), "quality", F.lit(0).alias("ordinal"))
    twice = targets.withColumn("quality", F.lit(-1)).withColumn("ordinal", F.lit(-1)).unionByName(targets)
    return runs.with_targets(d, twice).select(F.col("sample_id").alias("doc_id"), "quality")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark, sf):
    return runs.pending(t(spark, sf, "documents"), t(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def select_ids_semi(spark, sf):
    return runs.chosen(t(spark, sf, "documents"), t(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def plan_cross(spark, sf):
    return runs.plan_items(t(spark, sf, "region").select("r_name"), t(spark, sf, "nation").select("n_name"))


@query("SELECT n_regionkey AS url, min(n_nationkey) AS first, count(*) AS n FROM nation GROUP BY n_regionkey")
def group_by_endpoint(spark, sf):
    return runs.by_endpoint(t(spark, sf, "nation").withColumnRenamed("n_regionkey", "url"), "url", "n_nationkey")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS sample_id, CASE WHEN b.doc_id IS NULL THEN 'missing' ELSE 'unexpected' END AS problem
FROM documents a FULL JOIN (SELECT CASE WHEN toxic = 1 THEN -1 - doc_id ELSE doc_id END AS doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL""")
def response_check(spark, sf):
    """Documents as requests and labels as responses; those of toxic ones answer ids that nobody asked for."""
    a = t(spark, sf, "documents").select(F.col("doc_id").alias("sample_id"))
    return runs.checked_pairs(a, t(spark, sf, "labels").select(F.when(F.col("toxic") == 1, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("sample_id")))[1]


@query("""WITH a AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1)
SELECT sum(a.n)::BIGINT AS rows_a, sum(b.n)::BIGINT AS rows_b, count(a.n) AS ids_a, count(b.n) AS ids_b, count(*) FILTER (a.n > 1) AS repeated_a,
  count(*) FILTER (b.n > 1) AS repeated_b, count(*) FILTER (b.n IS NULL) AS only_a, count(*) FILTER (a.n IS NULL) AS only_b,
  count(*) FILTER (b.n IS NULL) + count(*) FILTER (a.n IS NULL) + count(*) FILTER (a.n > 1) + count(*) FILTER (b.n > 1) = 0 AS one_to_one FROM a FULL JOIN b ON a.k = b.k""")
def alignment_report(spark, sf):
    return runs.alignment(t(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("""WITH x AS (SELECT o_custkey, o_orderpriority, o_orderkey::VARCHAR AS path, (o_orderkey % 5) AS n, o_orderdate FROM orders)
SELECT o_custkey, o_orderpriority, path, n, n >= 3 AS full FROM x
QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY n >= 3 DESC, CASE WHEN n >= 3 THEN 0 ELSE n END DESC, o_orderdate DESC, path DESC) = 1""")
def select_winner(spark, sf):
    x = t(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") % 5).alias("n"), "o_orderdate", F.lit(3).alias("expected"))
    return runs.winners(x, ["o_custkey", "o_orderpriority"], "expected", "n", "o_orderdate", "path")


@query("""SELECT o_custkey % 50 AS model, round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 6) AS F, round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS O,
  (count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('F', 'O')))::VARCHAR || '/2' AS covered FROM orders GROUP BY 1""")
def results_pivot(spark, sf):
    x = t(spark, sf, "orders").groupBy((F.col("o_custkey") % 50).alias("model"), "o_orderstatus").agg(r6(F.max("o_totalprice"), "v"))
    return runs.results_table(x, "model", "o_orderstatus", "v", ["F", "O"])


@query("SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 3 = 0 THEN l_tax WHEN l_linenumber % 3 = 1 THEN l_discount END, 6) AS v FROM lineitem")
def preferred_metric(spark, sf):
    k = F.col("l_linenumber") % 3
    s = F.when(k == 0, F.create_map(F.lit("f1"), F.col("l_tax"), F.lit("acc"), F.col("l_quantity"))).when(k == 1, F.create_map(F.lit("acc"), F.col("l_discount")))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(runs.pick_metric(s, ["f1", "acc"]), "v"))


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 5")
def first_k(spark, sf):
    return runs.first_k(t(spark, sf, "documents").select("doc_id", "lang"), 5, "lang", ["doc_id"])


@query("SELECT doc_id FROM documents ORDER BY sha256('7:' || doc_id::VARCHAR), doc_id LIMIT 40")
def hash_sample_k(spark, sf):
    return runs.sample_k(t(spark, sf, "documents").select("doc_id"), 40, "doc_id", 7)


@query("""WITH x AS (SELECT doc_id, toxic = 1 AS pos FROM labels), r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY doc_id) AS r FROM x)
SELECT doc_id FROM r WHERE r <= 20 ORDER BY CASE WHEN pos AND r <= 3 THEN 0 ELSE 1 END, pos, doc_id LIMIT 20""")
def stratified_pick(spark, sf):
    return runs.stratified(t(spark, sf, "labels"), F.col("toxic") == 1, 20, 3, "doc_id").select("doc_id")


@query("SELECT batch, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents) GROUP BY batch")
def request_batches(spark, sf):
    x = runs.batches(rows.with_ordinal(t(spark, sf, "documents").select("doc_id"), "doc_id"), "ordinal", 64)
    return x.groupBy("batch").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT doc_id, 'inf:' || doc_id AS value FROM documents WHERE doc_id % 3 = 0")
def cache_hits(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", runs.cache_key("inf", text=F.col("text"), id=F.col("doc_id")).alias("key"))
    old = d.where("doc_id % 3 = 0").select("key", F.concat(F.lit("inf:"), "doc_id").alias("value"), F.lit(1).alias("ordinal"))
    store = old.withColumn("value", F.lit("stale")).withColumn("ordinal", F.lit(0)).unionByName(old)
    return runs.cached(d, store)[0].select("doc_id", "value")


@query("SELECT event_id, json_object('event_type', event_type, 'k', CASE WHEN event_id % 2 = 0 THEN user_id END)::VARCHAR AS j FROM events")
def canonical_json(spark, sf):
    return t(spark, sf, "events").select("event_id", sinks.canonical_json(k=F.when(F.col("event_id") % 2 == 0, F.col("user_id")), event_type=F.col("event_type")).alias("j"))


@query("""SELECT doc_id AS k, count(*) AS n FROM (SELECT doc_id FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id FROM labels WHERE quality = 1) GROUP BY doc_id HAVING count(*) > 1""")
def merge_duplicates(spark, sf):
    a, b = t(spark, sf, "documents").where("lang = 'en'").select("doc_id"), t(spark, sf, "labels").where("quality = 1").select("doc_id")
    return runs.merged([a, b], "doc_id")[1].select(F.col("doc_id").alias("k"), "n")


# ---- text and label alignment ----------------------------------------------------------------------------------------


@query(r"SELECT item_id, trim(regexp_replace(text || chr(10) || ' x  y', '\s+', ' ', 'g')) AS s FROM benchmark")
def normalize_ws(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", text.normalize_whitespace(F.concat("text", F.lit("\n x  y"))).alias("s"))


@query("SELECT item_id, split_part(text || '<|end_of_text|>' || text, '<|end_of_text|>', 1) AS s FROM benchmark")
def strip_eos(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", text.strip_eos(F.concat("text", F.lit("<|end_of_text|>"), "text")).alias("s"))


@query("""SELECT p_partkey, p_type || '|' || p_size || ',' || p_size || '|' || p_brand AS s FROM part""")
def parse_labels_comma(spark, sf):
    s = F.concat(F.col("p_type"), F.lit(", ,"), F.col("p_size"), F.lit(","), F.col("p_size"), F.lit(" ,"), F.col("p_brand"))
    return t(spark, sf, "part").select("p_partkey", F.array_join(text.parse_labels(s), "|").alias("s"))


#: a fixed vocabulary for the alignment queries
VOCAB = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
_PERTURBED = "substr(c_mktsegment, 1 + (c_custkey % 3)::INT) || chr((65 + c_custkey % 5)::INT)"


def perturbed():
    return F.expr("concat(substring(c_mktsegment, 1 + int(c_custkey % 3), 100), char(65 + c_custkey % 5))")


def _values(labels):
    return ", ".join(f"('{v}', {i})" for i, v in enumerate(labels))


@query(f"""WITH x AS (SELECT c_custkey, {_PERTURBED} AS s FROM customer), v(l, i) AS (VALUES {_values(VOCAB)}),
y AS (SELECT c_custkey, min({{'d': levenshtein(s, l), 'l': l}}) AS b FROM x CROSS JOIN v GROUP BY c_custkey)
SELECT c_custkey, b.l AS label, CASE WHEN b.d > 2 THEN 'None' ELSE b.l END AS bounded FROM y""")
def fuzzy_label(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", perturbed().alias("s"))
    return c.select("c_custkey", text.fuzzy_match(F.col("s"), VOCAB).alias("label"), text.fuzzy_match(F.col("s"), VOCAB, 2).alias("bounded"))


@query(f"""WITH x AS (SELECT c_custkey, trim(lower(CASE c_custkey % 3 WHEN 0 THEN '  ' || c_mktsegment WHEN 1 THEN 'it is a ' || c_mktsegment || ' x' ELSE {_PERTURBED} END)) AS s FROM customer),
v(l, i) AS (VALUES {_values(VOCAB)}), y AS (SELECT c_custkey, any_value(s) AS s,
  arg_max(l, length(l) * 100 - i) FILTER (contains(s, lower(l))) AS sub, min({{'d': levenshtein(s, lower(l)), 'l': l}}) AS near FROM x CROSS JOIN v GROUP BY c_custkey)
SELECT c_custkey, coalesce(sub, near.l) AS label FROM y""")
def extract_label(spark, sf):
    s = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("  "), "c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("it is a "), "c_mktsegment", F.lit(" x"))).otherwise(perturbed())
    return t(spark, sf, "customer").select("c_custkey", s.alias("s")).select("c_custkey", text.extract_label(F.col("s"), VOCAB).alias("label"))


@query(f"""WITH x AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) ELSE lower({_PERTURBED}) END AS s FROM customer),
v(l, i) AS (VALUES {_values(VOCAB)}), y AS (SELECT c_custkey, any_value(s) AS s, arg_max(l, length(l) * 100 - i) FILTER (contains(s, lower(l))) AS sub,
  min({{'d': levenshtein(s, lower(l)), 'l': l}}) AS near FROM x CROSS JOIN v GROUP BY c_custkey)
SELECT c_custkey, coalesce(sub, CASE WHEN near.d <= 2 THEN near.l END) AS label FROM y""")
def conservative_label(spark, sf):
    s = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("It sounds like a "), "c_mktsegment", F.lit("!"))).otherwise(F.concat(F.lit("the *"), perturbed(), F.lit("*.")))
    return t(spark, sf, "customer").select("c_custkey", s.alias("s")).select("c_custkey", text.conservative_match(F.col("s"), VOCAB).alias("label"))


@query("""SELECT event_id, chr((65 + event_id % 4)::INT) AS choice FROM events""")
def mcq_choice(spark, sf):
    letter = F.expr("char(65 + event_id % 4)")
    s = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("A: x, B: y. Final answer: "), F.lower(letter))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("a guess: description in option "), letter, F.lit("."))).otherwise(F.concat(F.lit(" **"), F.lower(letter), F.lit("** ")))
    return t(spark, sf, "events").select("event_id", s.alias("s")).select("event_id", text.extract_choice(F.col("s"), ["A", "B", "C", "D"]).alias("choice"))


@query("""WITH v(h) AS (VALUES (950.0), (1200.0), (1500.0), (2000.0)), x AS (SELECT p_partkey, (floor(p_retailprice * 100) / 100)::DOUBLE AS n FROM part)
SELECT p_partkey, arg_min(h::INT || ' Hz', {'d': abs(n - h), 'h': h}) AS bucket FROM x CROSS JOIN v GROUP BY p_partkey""")
def hz_bucket(spark, sf):
    n = F.floor(F.col("p_retailprice") * 100) / 100
    s = F.concat(F.lit("#0.00s - 10.00s#: "), F.format_number(n.cast("decimal(12,2)"), 2))
    return t(spark, sf, "part").select("p_partkey", s.alias("s")).select("p_partkey", text.extract_bucket(F.col("s"), ["2000 Hz", "950 Hz", "1500 Hz", "1200 Hz"]).alias("bucket"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'some ' || split_part(p_name, ' ', 1) || ' thing' ELSE p_name END AS name FROM part""")
def scientific_name(spark, sf):
    """Part names of two words in three kinds of answers, against all part names."""
    p = t(spark, sf, "part")
    labels = sorted(r[0] for r in p.select("p_name").distinct().collect())  # a label set
    first, second, k = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("p_size") % 3
    s = F.when(k == 0, F.concat(F.lit("#0.00s - 10.00s#: The focal species is *"), "p_name", F.lit("* here."))).when(k == 1, F.concat(second, F.lit(", of the genus "), F.upper(first))).otherwise(F.concat(F.lit(" some "), first, F.lit(" thing ")))
    return p.select("p_partkey", s.alias("s")).select("p_partkey", text.extract_scientific_name(F.col("s"), labels).alias("name"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS inline_, CASE c_custkey % 2 WHEN 0 THEN 'Yes' ELSE 'No' END AS offline, CASE c_custkey % 2 WHEN 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM customer""")
def planned_steps(spark, sf):
    s = F.when(F.col("c_custkey") % 2 == 0, "Yes, there is a bird  vocalizing.<|end_of_text|> No").otherwise("no .")
    x = t(spark, sf, "customer").select("c_custkey", s.alias("s"))
    a, b = (text.run_steps(F.col("s"), *plan(["Yes", "No"], "classification"))["text"] for plan in (planner.plan_inline, planner.plan_offline))
    return x.select("c_custkey", a.alias("inline_"), b.alias("offline"), text.parse_yes_no(F.col("s")).alias("score"))


@query("SELECT event_type AS token, min(event_id) AS first FROM events GROUP BY event_type")
def vocab_first_seen(spark, sf):
    v = metrics.vocabulary(t(spark, sf, "events").select("event_id", F.concat(F.lit(" "), "event_type", F.lit(" ,")).alias("s")), "s", "event_id")
    return v.select("token", F.col("first.event_id").alias("first"))


@query("SELECT DISTINCT source FROM documents ORDER BY source")
def vocab_sorted(spark, sf):
    return t(spark, sf, "documents").select("source").distinct().orderBy("source")


@query(r"SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z][A-Za-z\-.]+( [A-Za-z][A-Za-z\-.]+)+') AS looks, regexp_replace(p_type, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part")
def name_checks(spark, sf):
    return t(spark, sf, "part").select("p_partkey", text.looks_scientific(F.col("p_name")).alias("looks"), text.safe_name(F.col("p_type")).alias("safe"))


@query("""SELECT conv_id, turn, 'Say: ' || text || ' <A>' AS content, CASE WHEN turn % 2 = 0 THEN NULL ELSE 'audio slots and inputs differ in number' END AS error FROM conversations""")
def render_prompt(spark, sf):
    tag = rows.PLACEHOLDER
    audio = F.when(F.col("turn") % 2 == 0, F.array(F.lit("a.wav"))).otherwise(F.array().cast("array<string>"))
    x = t(spark, sf, "conversations").select("conv_id", "turn", rows.build_request("s", "Say: {{t}} " + tag, {"t": F.col("text")}, audio).alias("r"))
    return x.select("conv_id", "turn", F.replace(F.col("r.messages")[1]["content"], F.lit(tag), F.lit("<A>")).alias("content"), F.col("r.error").alias("error"))


# ---- metrics ---------------------------------------------------------------------------------------------------------
_PAIRS = "SELECT l.quality AS y, CASE WHEN d.n_chars > 800 THEN 1 ELSE 0 END AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id"
_COUNTS = f"""WITH x AS ({_PAIRS}), c AS (SELECT v AS label, count(*) FILTER (p = v AND y = v) AS tp, count(*) FILTER (p = v AND y <> v) AS fp, count(*) FILTER (p <> v AND y = v) AS fn
  FROM x CROSS JOIN (SELECT DISTINCT unnest([y, p]) AS v FROM x) GROUP BY v),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rc FROM c),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)"""


def pairs(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 800, 1).otherwise(0).alias("p"))
    return t(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")).join(d, "doc_id").select("doc_id", "y", "p")


@query(f"SELECT round(avg((p = y)::INT), 6) AS accuracy FROM ({_PAIRS})")
def accuracy(spark, sf):
    return metrics.accuracy(pairs(spark, sf), "p", "y").select(r6(F.col("accuracy"), "accuracy"))


def _prf(spark, sf, average):
    return metrics.averaged(metrics.counts(pairs(spark, sf), "p", "y"), average).select(*(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


@query(_COUNTS + " SELECT round(avg(pr), 6) AS precision, round(avg(rc), 6) AS recall, round(avg(f1), 6) AS f1 FROM f")
def prf_macro(spark, sf):
    return _prf(spark, sf, "macro")


@query(_COUNTS + ", s AS (SELECT sum(tp) / sum(tp + fp) AS a, sum(tp) / sum(tp + fn) AS b FROM f) SELECT round(a, 6) AS precision, round(b, 6) AS recall, round(2 * a * b / (a + b), 6) AS f1 FROM s")
def prf_micro(spark, sf):
    return _prf(spark, sf, "micro")


@query(_COUNTS + " SELECT round(sum(pr * (tp + fn)) / sum(tp + fn), 6) AS precision, round(sum(rc * (tp + fn)) / sum(tp + fn), 6) AS recall, round(sum(f1 * (tp + fn)) / sum(tp + fn), 6) AS f1 FROM f")
def prf_weighted(spark, sf):
    return _prf(spark, sf, "weighted")


@query(_COUNTS + " SELECT round(pr, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM f WHERE label = 1")
def prf_binary(spark, sf):
    return _prf(spark, sf, "binary")


@query("SELECT round(avg((l_returnflag = 'A' OR l_returnflag = l_linestatus)::INT), 6) AS top1_accuracy FROM lineitem")
def top1_any_of(spark, sf):
    return metrics.top1_accuracy(t(spark, sf, "lineitem").select("l_returnflag", F.concat(F.lit("A , "), "l_linestatus").alias("y")), "l_returnflag", "y").select(r6(F.col("top1_accuracy"), "top1_accuracy"))


_AP = """WITH x AS (SELECT event_id, event_type, value, (user_id % 3 = 0)::INT AS y FROM events),
r AS (SELECT *, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM x WINDOW w AS ({part} ORDER BY value DESC, event_id{tie}))
SELECT round(avg(ap), 6) AS average_precision FROM (SELECT coalesce(sum(tp / k) FILTER (y = 1) / nullif(sum(y), 0), 0) AS ap FROM r {group})"""


def _ap(spark, sf, average):
    x = t(spark, sf, "events").select("event_id", "event_type", "value", (F.col("user_id") % 3 == 0).cast("int").alias("y"))
    return metrics.average_precision(x, "event_type", "value", "y", "event_id", average).select(r6(F.col("average_precision"), "average_precision"))


@query(_AP.format(part="PARTITION BY event_type", tie="", group="GROUP BY event_type"))
def average_precision_macro(spark, sf):
    return _ap(spark, sf, "macro")


@query(_AP.format(part="", tie=", event_type", group=""))
def average_precision_micro(spark, sf):
    return _ap(spark, sf, "micro")


_SETS = """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS o, [o_orderpriority, 'x' || o_orderkey % 4] AS p, ['x' || o_orderkey % 3, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE 'x0' END] AS y FROM orders"""


@query(f"""WITH b AS ({_SETS}), v AS (SELECT DISTINCT unnest(p || y) AS l FROM b), c AS (SELECT l, o, list_contains(p, l)::INT AS s, list_contains(y, l)::INT AS y FROM b CROSS JOIN v),
r AS (SELECT *, row_number() OVER w AS k, sum(y) OVER (w ROWS UNBOUNDED PRECEDING) AS tp FROM c WINDOW w AS (PARTITION BY l ORDER BY s DESC, o))
SELECT round(avg(ap), 6) AS dataset_map FROM (SELECT coalesce(sum(tp / k) FILTER (y = 1) / nullif(sum(y), 0), 0) AS ap FROM r GROUP BY l)""")
def dataset_map(spark, sf):
    k = F.col("o_orderkey")
    x = rows.with_ordinal(t(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    p = F.array(F.col("o_orderpriority"), F.concat(F.lit("x"), k % 4))
    y = F.array(F.concat(F.lit("x"), k % 3), F.when(k % 5 == 0, F.col("o_orderpriority")).otherwise("x0"))
    return metrics.dataset_map(x.select("ordinal", p.alias("p"), y.alias("y")), "p", "y", "ordinal").select(r6(F.col("dataset_map"), "dataset_map"))


@query("""WITH x AS (SELECT lang AS y, CASE WHEN doc_id % 4 = 0 THEN 'en' WHEN doc_id % 9 = 0 THEN 'xx' ELSE lang END AS p FROM documents), v AS (SELECT DISTINCT unnest([y, p]) AS l FROM x),
c AS (SELECT l, count(*) FILTER (p = l AND y = l) AS tp, count(*) FILTER (p = l) AS np, count(*) FILTER (y = l) AS ny FROM x CROSS JOIN v GROUP BY l)
SELECT round(avg(CASE WHEN np + ny > 0 THEN 2 * tp / (np + ny) ELSE 0 END), 6) AS macro_f1 FROM c""")
def macro_f1(spark, sf):
    d = F.col("doc_id")
    x = t(spark, sf, "documents").select(F.when(d % 4 == 0, "en").when(d % 9 == 0, "xx").otherwise(F.col("lang")).alias("p"), F.col("lang").alias("y"))
    return metrics.macro_f1(x, "p", "y").select(r6(F.col("macro_f1"), "macro_f1"))


@query(r"""WITH q AS (SELECT item_id AS i, trim(regexp_replace(text, '[^ ]+$', 'end end')) AS p, text AS y FROM benchmark),
n AS (SELECT unnest([1, 2, 3, 4]) AS n), w AS (SELECT i, list_filter(string_split_regex(p, '\s+'), lambda x: x <> '') AS h, list_filter(string_split_regex(y, '\s+'), lambda x: x <> '') AS r FROM q),
hg AS (SELECT i, n, array_to_string(h[k:k + n - 1], ' ') AS g, count(*) AS c FROM (SELECT i, n, h, unnest(range(1, len(h) - n + 2)) AS k FROM w CROSS JOIN n) GROUP BY ALL),
rg AS (SELECT i, n, array_to_string(r[k:k + n - 1], ' ') AS g, count(*) AS c FROM (SELECT i, n, r, unnest(range(1, len(r) - n + 2)) AS k FROM w CROSS JOIN n) GROUP BY ALL),
d AS (SELECT n, g, count(*) AS df FROM rg GROUP BY n, g), t AS (SELECT ln(count(*)) AS ln_n FROM q),
b AS (SELECT coalesce(hg.i, rg.i) AS i, coalesce(hg.n, rg.n) AS n, coalesce(hg.g, rg.g) AS g, coalesce(hg.c, 0) AS h, coalesce(rg.c, 0) AS r FROM hg FULL JOIN rg ON hg.i = rg.i AND hg.n = rg.n AND hg.g = rg.g),
z AS (SELECT i, b.n, h, r, ln_n - ln(greatest(1, coalesce(df, 0))) AS idf FROM b LEFT JOIN d ON b.n = d.n AND b.g = d.g CROSS JOIN t),
s AS (SELECT i, n, sum(least(h * idf, r * idf) * r * idf) AS dot, sqrt(sum(h * idf * h * idf)) AS a, sqrt(sum(r * idf * r * idf)) AS c, sum(h) - sum(r) AS delta FROM z GROUP BY i, n),
e AS (SELECT i, sum(CASE WHEN a <> 0 AND c <> 0 THEN dot / (a * c) ELSE dot END) AS v, max(delta) FILTER (n = 2) AS delta FROM s GROUP BY i)
SELECT round(avg(10 * v / 4 * exp(-delta * delta / 72)), 6) AS cider FROM e""")
def cider_corpus(spark, sf):
    x = t(spark, sf, "benchmark").select("item_id", F.trim(F.regexp_replace("text", "[^ ]+$", "end end")).alias("p"), "text")
    return metrics.cider(x, "item_id", "p", "text").select(r6(F.col("cider"), "cider"))


@query("""WITH x AS (SELECT l_returnflag AS task, CASE WHEN l_linenumber % 2 = 0 THEN l_discount END AS a, l_tax AS b FROM lineitem)
SELECT coalesce(nullif(task, 'N'), 'default') AS task, 'a' AS metric, round(avg(a), 6) AS mean FROM x GROUP BY task UNION ALL SELECT coalesce(nullif(task, 'N'), 'default'), 'b', round(avg(b), 6) FROM x GROUP BY task""")
def per_task_means(spark, sf):
    m = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("a"), F.col("l_discount"), F.lit("b"), F.col("l_tax"))).otherwise(F.create_map(F.lit("b"), F.col("l_tax")))
    x = t(spark, sf, "lineitem").select(F.nullif("l_returnflag", F.lit("N")).alias("task"), m.alias("m"))
    return metrics.score_means(x, "m", "task").select("task", "metric", r6(F.col("mean"), "mean"))


@query("SELECT 'a' AS metric, round(avg(l_discount), 6) AS mean FROM lineitem WHERE l_linenumber % 2 = 0 UNION ALL SELECT 'b', round(avg(l_tax), 6) FROM lineitem")
def score_means(spark, sf):
    m = F.when(F.col("l_linenumber") % 2 == 0, F.create_map(F.lit("a"), F.col("l_discount"), F.lit("b"), F.col("l_tax"))).otherwise(F.create_map(F.lit("b"), F.col("l_tax")))
    return metrics.score_means(t(spark, sf, "lineitem").select(m.alias("m")), "m").select("metric", r6(F.col("mean"), "mean"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE round(2 / 3, 6) END::DOUBLE AS v, CASE event_id % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 4 END::INT AS n FROM events""")
def score_sample(spark, sf):
    k = F.col("event_id") % 3
    s = metrics.score_sample(F.when(k == 2, "a, z").otherwise(F.col("event_type")), F.lit("raw"), F.when(k == 0, "text").otherwise("list"), F.col("event_type"), text.lits(["a", "b"]), F.when(k == 1, "classification").otherwise("detection"))
    x = t(spark, sf, "events").select("event_id", s.alias("s"))
    return x.select("event_id", r6(F.coalesce(F.try_element_at("s", F.lit("accuracy")), F.try_element_at("s", F.lit("average_precision"))), "v"), F.size("s").alias("n"))


# ---- models, judges, end to end --------------------------------------------------------------------------------------


@query("SELECT conv_id, turn, substr(sha256(text), 1, 20) AS prediction FROM conversations")
def stub_predict(spark, sf):
    return t(spark, sf, "conversations").select("conv_id", "turn", enrich.stub(F.col("text")).alias("prediction"))


@query("SELECT conv_id::VARCHAR AS sample_id, CASE WHEN conv_id % 5 = 0 THEN NULL ELSE 'p' || conv_id END AS prediction FROM (SELECT DISTINCT conv_id FROM conversations)")
def batched_predict(spark, sf):
    def call(part):
        return [{"sample_id": r["sample_id"], "predictions": ["p" + r["sample_id"]]} if int(r["sample_id"]) % 5 else {"sample_id": r["sample_id"], "predictions": [], "error": "no"} for r in reversed(part)]

    x = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("sample_id")).distinct().withColumn("request", F.lit("{}"))
    return enrich.predict(x, call).select("sample_id", "prediction")


@query("SELECT round(avg(CASE WHEN conv_id % 3 = 0 THEN 1 WHEN conv_id % 3 = 1 THEN 0 END), 6) AS judge_accuracy, count(*) FILTER (conv_id % 3 = 2) AS errors FROM conversations")
def yes_no_judge(spark, sf):
    a = F.when(F.col("conv_id") % 3 == 0, " yes, it does").when(F.col("conv_id") % 3 == 1, "NO.").otherwise("perhaps")
    x = enrich.yes_no_scores(t(spark, sf, "conversations").select("conv_id", a.alias("a")), "a")
    return x.agg(r6(F.avg("score"), "judge_accuracy"), F.count("error").alias("errors"))


_RESCORED = """WITH x AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'Yes' ELSE 'No' END AS y, CASE WHEN d.n_chars > 800 THEN 'Yes' ELSE 'No' END AS p, l.quality IS NULL AS none FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def rescore_frames(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("doc_id").alias("ordinal"), F.when(F.col("n_chars") > 800, "Yes, there is  one.").otherwise(" no<|end_of_text|>x").alias("prediction"), F.lit(None).cast("string").alias("error"))
    y = t(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("sample_id"), F.col("doc_id").alias("ordinal"), F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("target"))
    return d, y


@query(_RESCORED + """ SELECT m AS metric, round(avg((p = y)::INT) FILTER (NOT none), 6) AS mean, count(*) AS n_samples, 0::BIGINT AS n_errors FROM x CROSS JOIN (VALUES ('accuracy'), ('top1_accuracy'), ('precision'), ('recall'), ('f1')) v(m) GROUP BY m""")
def rescore_summary(spark, sf):
    d, y = rescore_frames(spark, sf)
    return rescore.summary(rescore.rescore(d, y, ["Yes", "No"], "classification")).select("metric", r6(F.col("mean"), "mean"), "n_samples", "n_errors")


@query(_RESCORED + " SELECT doc_id::VARCHAR AS sample_id, p AS processed, CASE WHEN none THEN NULL ELSE (p = y)::INT::DOUBLE END AS accuracy FROM x")
def rescore_samples(spark, sf):
    d, y = rescore_frames(spark, sf)
    x = rescore.rescore(d, y, ["Yes", "No"], "classification")
    return x.select("sample_id", "processed", F.try_element_at("scores", F.lit("accuracy")).alias("accuracy"))


@query("SELECT event_id, event_type = 'click' AS hit FROM events")
def stream_rescore_events(spark, sf):
    """Events through a stream of files into a table, once more than needed; each event is there once."""
    base = sinks.work_dir(spark)
    t(spark, sf, "events").write.parquet(f"{base}/in")
    source = lambda: spark.readStream.schema(t(spark, sf, "events").schema).parquet(f"{base}/in")
    score = lambda df: df.select(F.col("event_id").alias("sample_id"), (F.col("event_type") == "click").alias("hit"))
    for check in ("a", "b"):  # a second stream that starts afresh adds nothing
        stream_rescore(source(), score, f"{base}/out", f"{base}/check-{check}").awaitTermination()
    return spark.read.parquet(f"{base}/out").select(F.col("sample_id").alias("event_id"), "hit")



__all__ = ["ORACLES", "QUERIES", "run_queries"]
