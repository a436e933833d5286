"""Queries for example assembly, templates, judges, run artifacts, sources and sinks, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import audio, examples, rows, templates, text
from .operators import artifacts, enrich, judges, metrics, pipeline, runs
from .plans import planner
from .registry import query, r6, t
from .sources import readers, sinks

# ---- examples --------------------------------------------------------------------------------------------------------


def _source_rows(spark, sf):
    """Documents as rows of a single-audio source, with nulls and blanks in every known place."""
    d = F.col("doc_id")
    x = t(spark, sf, "documents")
    shown = F.when(d % 3 == 0, F.struct(F.concat(F.lit("a/"), d).alias("path"), F.lit(16000).alias("sampling_rate"), F.array_repeat(F.lit(0.0), (d % 5).cast("int")).alias("array")))
    shown = shown.when(d % 3 == 1, F.struct(F.lit(" ").alias("path"), F.lit(None).cast("int").alias("sampling_rate"), F.lit(None).cast("array<double>").alias("array")))
    own = {"audio": shown, "audio_path": F.when(d % 2 == 0, F.concat(F.lit("p/"), d)), "instruction": F.when(d % 4 == 0, F.lit("  ")).when(d % 4 == 1, F.col("lang")), "instruction_text": F.when(d % 8 < 6, F.col("source")), "output": F.when(d % 5 > 0, F.col("lang")), "task": F.col("source"), "license": F.lit(None).cast("string"), "metadata": F.to_json(F.struct("n_chars"))}
    return x.select("doc_id", *(c.alias(n) for n, c in own.items()))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/' || doc_id WHEN doc_id % 3 = 1 THEN ' ' END AS path, CASE WHEN doc_id % 3 = 0 THEN 16000 END::INT AS rate,
  CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 END::INT AS n FROM documents""")
def audio_summary(spark, sf):
    x = _source_rows(spark, sf)
    return x.select("doc_id", examples.audio_summary(x).alias("a")).select("doc_id", F.col("a.path").alias("path"), F.col("a.sampling_rate").alias("rate"), F.col("a.num_samples").alias("n"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a/' || doc_id WHEN doc_id % 2 = 0 THEN 'p/' || doc_id END AS audio_path,
  json_object('n_chars', n_chars)::VARCHAR AS hf_metadata, concat_ws('|', CASE doc_id % 4 WHEN 0 THEN 'instruction=  ' WHEN 1 THEN 'instruction=' || lang END,
  CASE WHEN doc_id % 8 < 6 THEN 'instruction_text=' || source END, 'task=' || source) AS scalars FROM documents""")
def metadata_projection(spark, sf):
    x = _source_rows(spark, sf)
    m = x.select("doc_id", examples.metadata(x).alias("m"))
    shown = F.array_join(F.transform(F.map_entries("m.scalars"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return m.select("doc_id", F.col("m.audio_path").alias("audio_path"), F.col("m.hf_metadata").alias("hf_metadata"), shown.alias("scalars"))


@query("""SELECT doc_id::VARCHAR AS sample_id, 'test' AS split, CASE WHEN doc_id % 5 > 0 THEN lang END AS labels, CASE WHEN doc_id % 2 = 0 THEN 'p/' || doc_id WHEN doc_id % 3 = 0 THEN 'a/' || doc_id END AS path,
  CASE doc_id % 4 WHEN 0 THEN '  ' WHEN 1 THEN lang ELSE CASE WHEN doc_id % 8 < 6 THEN source END END AS instruction FROM documents""")
def assemble_examples(spark, sf):
    x = _source_rows(spark, sf)
    e = examples.single_examples(x, F.col("doc_id"), "test")
    return e.select("sample_id", "split", "labels", F.try_element_at("metadata", F.lit("audio_path")).alias("path"), F.try_element_at("metadata", F.lit("instruction")).alias("instruction"))


def _talks(spark, sf):
    """Conversations as rows of a multi-audio source: as many placeholders as turns, one path less for every fifth."""
    tag = F.lit(" " + rows.PLACEHOLDER)
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    said = F.transform("m", lambda m: F.struct(m["role"].alias("role"), F.when(m["role"] == "user", F.concat(m["text"], F.repeat(tag, F.size("m")))).otherwise(m["text"]).alias("content")))
    paths = F.transform(F.sequence(F.lit(1), F.size("m") - F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)), lambda i: F.concat(F.lit("s"), i))
    return c.select("conv_id", said.alias("messages"), paths.alias("paths"))


_TALKS = """WITH c AS (SELECT conv_id, count(*) AS n, nullif(trim(arg_max(text, turn) FILTER (role = 'user'), chr(32) || chr(10) || chr(9)), '') AS u,
  nullif(trim(arg_max(text, turn) FILTER (role = 'assistant'), chr(32) || chr(10) || chr(9)), '') AS a FROM conversations GROUP BY conv_id),
k AS (SELECT *, CASE WHEN u IS NULL AND n = 0 THEN 0 ELSE n END AS slots, n - CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS paths FROM c)"""


@query(_TALKS + " SELECT conv_id::VARCHAR AS sample_id, a AS labels, n::VARCHAR AS n_audios, 's' || n AS audio_path, (n - 1)::INT AS shown FROM k WHERE slots = paths")
def multi_audio_examples(spark, sf):
    e, _ = examples.multi_examples(_talks(spark, sf), F.col("conv_id"), F.col("paths"), "test")
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    return e.select("sample_id", "labels", m("n_audios").alias("n_audios"), m("audio_path").alias("audio_path"), rows.count_placeholders(m("conversation_query_only"), rows.SHOWN).alias("shown"))


@query(_TALKS + " SELECT conv_id::VARCHAR AS sample_id, 'placeholders: ' || slots || ', paths: ' || paths AS problem FROM k WHERE slots <> paths")
def multi_audio_quarantine(spark, sf):
    return examples.multi_examples(_talks(spark, sf), F.col("conv_id"), F.col("paths"), "test")[1]


@query("SELECT p_name AS name, p_size AS size FROM part")
def rename_columns(spark, sf):
    return examples.renamed(t(spark, sf, "part"), {"p_name": "name", "p_size": "size"})


@query("""SELECT p_partkey, 'x' AS data_root, coalesce(CASE WHEN p_size % 3 = 0 THEN p_name END, CASE WHEN p_size % 2 = 0 THEN p_type END) AS p16, p_brand AS p32,
  CASE WHEN p_size % 4 = 0 THEN p_brand ELSE '["' || p_type || '"]' END AS output FROM part""")
def alias_columns(spark, sf):
    k = F.col("p_size")
    x = t(spark, sf, "part").select("p_partkey", "p_type", F.when(k % 3 == 0, F.col("p_name")).alias("audio_path_16KHz"), F.when(k % 2 == 0, F.col("p_type")).otherwise(" ").alias("16khz_path"), F.col("p_brand").alias("32khz_path"), F.when(k % 4 == 0, F.col("p_brand")).when(k % 4 == 1, "").alias("output"))
    y = examples.with_aliases(x, "x", F.array("p_type"))
    return y.select("p_partkey", "data_root", F.col("audio_path_16KHz").alias("p16"), F.col("audio_path_32KHz").alias("p32"), "output")


@query("""SELECT p_partkey, array_to_string(list_filter(CASE WHEN p_size % 3 = 0 THEN [p_name, p_type] WHEN p_size % 3 = 1 THEN [p_type] ELSE [p_brand, p_type] END, lambda x: x IS NOT NULL), '|') AS paths FROM part""")
def audio_path_order(spark, sf):
    k = F.col("p_size")
    shown = F.struct(F.concat(F.lit(" "), "p_type").alias("path"))
    x = t(spark, sf, "part").select("p_partkey", shown.alias("audio"), F.when(k % 3 == 2, F.col("p_brand")).alias("gcs_path"), F.when(k % 3 == 0, F.concat("p_name", F.lit(" "))).otherwise(" ").alias("audio_path_16KHz"))
    return x.select("p_partkey", F.array_join(examples.audio_paths(x), "|").alias("paths"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN lang END AS y FROM documents")
def output_else_labels(spark, sf):
    x = _source_rows(spark, sf).withColumn("labels", F.lit("unused"))
    return x.select("doc_id", rows.pick_labels(x).alias("y"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|b' END AS items, event_id % 4 > 1 AS has FROM events""")
def string_lists(spark, sf):
    k = F.col("event_id")
    j = F.when(k % 3 == 0, F.to_json(F.array("event_type", F.lit("b")))).when(k % 3 == 1, F.to_json(F.array("event_type", F.lit("")))).otherwise("no list")
    has = F.when(k % 4 == 0, F.array(F.lit(" None "), F.lit(""))).when(k % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("none"), F.col("event_type")))
    return t(spark, sf, "events").select("event_id", F.array_join(rows.string_list(j), "|").alias("items"), rows.has_labels(has).alias("has"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'm' || l_suppkey ELSE 'o/m' || l_suppkey END AS model, 't' || l_linenumber AS task FROM lineitem""")
def run_paths(spark, sf):
    m, task = F.concat(F.lit("m"), "l_suppkey"), F.concat(F.lit("/t"), "l_linenumber", F.lit("/predictions.jsonl"))
    p = F.when(F.col("l_linenumber") % 2 == 0, F.concat(m, F.lit("/suite/x"), task)).otherwise(F.concat(F.lit("o/"), m, task))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rows.model_of_path(p).alias("model"), rows.task_of_path(p).alias("task"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || ':' || text END AS shown, CASE turn % 3 WHEN 1 THEN 'a message lacks role or content' WHEN 2 THEN 'role and content must be strings' END AS error FROM conversations""")
def message_coercion(spark, sf):
    k = F.col("turn") % 3
    j = F.when(k == 0, F.to_json(F.array(F.struct("role", F.col("text").alias("content"))))).when(k == 1, F.to_json(F.array(F.struct("role")))).otherwise(F.to_json(F.array(F.struct("role", F.col("turn").alias("content")))))
    x = t(spark, sf, "conversations").select("conv_id", "turn", examples.coerced_messages(j).alias("m"))
    first = F.get("m.messages", F.lit(0))
    return x.select("conv_id", "turn", F.concat(first["role"], F.lit(":"), first["content"]).alias("shown"), F.col("m.error").alias("error"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || ', ' || p_brand ELSE '' END AS reference FROM part")
def reference_texts(spark, sf):
    k = F.col("p_size") % 3
    j = F.when(k == 0, F.col("p_type")).when(k == 1, F.to_json(F.array("p_type", F.lit(" "), "p_brand")))
    return t(spark, sf, "part").select("p_partkey", examples.reference_text(j).alias("reference"))


@query("""SELECT p_partkey, 'Is it ' || upper(p_brand) || '? ' || CASE WHEN p_size % 2 = 0 THEN '- ' || p_type || chr(10) || '- x' || chr(10) ELSE 'Say what you hear.' END || ' ' || p_size || ' none' AS prompt FROM part""")
def render_template(spark, sf):
    source = "Is it {{ part.brand | upper }}? {% if candidate_labels %}{% for l in candidate_labels %}- {{ l }}\n{% endfor %}{% else %}Say what you hear.{% endif %} {{ part.size }} {{ part.none | default('none') }}"
    labels = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(", x,")))
    names = {"part": F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.lit(None).cast("string").alias("none")), "candidate_labels": templates.candidate_labels(labels)}
    return t(spark, sf, "part").select("p_partkey", templates.render(source, names, {"candidate_labels"}).alias("prompt"))


# ---- sources and sinks -----------------------------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents WHERE lang = 'de'")
def stream_ordinal(spark, sf):
    return readers.read(spark, "parquet", f"{sf}/documents.parquet", columns=["doc_id"], order=["doc_id"], where=F.col("lang") == "de", after_filter=True)


@query("SELECT event_id AS id, event_type AS kind FROM events")
def jsonl_renamed(spark, sf):
    path = f"{sinks.work_dir(spark)}/lines"
    t(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type", "value")).alias("value")).write.text(path)
    return readers.read(spark, "jsonl", path, schema="event_id long, event_type string", names={"event_id": "id", "event_type": "kind"})


@query("SELECT doc_id::VARCHAR AS sample_id, lang AS labels, 'r/' || doc_id || '.wav' AS path FROM documents WHERE source = 'src1'")
def front_door_examples(spark, sf):
    path = f"{sinks.work_dir(spark)}/hub"
    t(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("task"), F.col("lang").alias("output"), F.concat("doc_id", F.lit(".wav")).alias("audio_path")).write.parquet(path)
    e = readers.front_door(spark, {"src1": 1, "src2": 4}, path, " src1 ", root="r")
    return e.select("sample_id", "labels", F.try_element_at("metadata", F.lit("audio_path")).alias("path"))


@query("SELECT 'found' AS side, doc_id AS audio_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en') UNION ALL SELECT 'missing', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def audio_by_id(spark, sf):
    ids = t(spark, sf, "labels").select(F.col("doc_id").alias("audio_id"))
    found, missing = readers.audio_for(ids, t(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("audio_id")))
    return found.select(F.lit("found").alias("side"), "audio_id").unionByName(missing.select(F.lit("missing").alias("side"), "audio_id"))


@query("SELECT trim(n_name) AS name, n_nationkey::VARCHAR AS code FROM nation UNION ALL SELECT 'NOWHERE', '-1'")
def taxonomy_overlay(spark, sf):
    path = f"{sinks.work_dir(spark)}/taxonomy"
    n = t(spark, sf, "nation")
    n.select(F.col("n_nationkey").alias("SPECIES_CODE"), F.concat(F.lit(" "), "n_name").alias("SCI_NAME")).unionByName(spark.createDataFrame([(None, "x"), (99, " ")], "SPECIES_CODE int, SCI_NAME string")).write.option("header", "true").csv(path)
    more = spark.createDataFrame([("-1", "NOWHERE"), ("3", "OTHER")], "code string, name string")
    return readers.read(spark, "taxonomy", path, overlay=more).select("name", "code")


@query("SELECT 'm' || o_custkey % 3 AS model, 't' || o_orderkey % 2 AS task, count(*) AS n FROM orders GROUP BY ALL")
def run_files_scan(spark, sf):
    path = sinks.work_dir(spark)
    o = t(spark, sf, "orders").select(F.concat(F.lit("m"), F.col("o_custkey") % 3).alias("m"), F.concat(F.lit("t"), F.col("o_orderkey") % 2).alias("k"), F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("sample_id"), F.array("o_orderstatus").alias("predictions"))).alias("value"))
    for m, k in [(m, k) for m in range(3) for k in range(2)]:  # six runs
        o.where((F.col("m") == f"m{m}") & (F.col("k") == f"t{k}")).select("value").write.text(f"{path}/m{m}/suite/t{k}")
    found = readers.read(spark, "run_files", path, schema="sample_id string, predictions array<string>", name="part-*")
    found = found.where(F.col("row.sample_id").isNotNull())
    return found.groupBy(rows.model_of_path(F.col("path")).alias("model"), rows.task_of_path(F.col("path")).alias("task")).agg(F.count("*").alias("n"))


@query("SELECT lang AS tier, source AS subset, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY ALL")
def published_counts(spark, sf):
    path = f"{sinks.work_dir(spark)}/published"
    sinks.publish(t(spark, sf, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select("doc_id", F.col("lang").alias("tier"), F.col("source").alias("subset")), path)
    return spark.read.parquet(path).groupBy("tier", "subset").agg(F.count("*").alias("n"))


@query("SELECT coalesce(user_id, -1) AS user_id, count(*) AS n FROM events GROUP BY ALL")
def append_once(spark, sf):
    """Events appended in two parts that share a half, and again; each is there once."""
    path = f"{sinks.work_dir(spark)}/table"
    e = t(spark, sf, "events").select("event_id", "user_id")
    for part in (e.where("event_id % 2 = 0"), e, e):
        sinks.append_new(part, path, "event_id")
    return spark.read.parquet(path).groupBy(F.coalesce("user_id", F.lit(-1)).alias("user_id")).agg(F.count("*").alias("n"))


# ---- runs, artifacts, judges -----------------------------------------------------------------------------------------


def _answers(spark, sf):
    """Events as answers of calls of four: what predict() gives, with times that SQL can tell."""
    k = F.col("event_id")
    info = F.when(k % 7 == 3, F.concat(F.lit('{"model":"m'), k, F.lit('"}'))).when(k % 7 == 1, "{}")
    return t(spark, sf, "events").select(
        k.cast("string").alias("sample_id"), k.alias("ordinal"), F.col("event_type").alias("task_id"), F.array("event_type").alias("predictions"), F.col("event_type").alias("processed"), F.lit("stop").alias("finish_reason"),
        F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), F.when(k % 5 > 0, F.col("value")).alias("latency_sec"), info.alias("server_info"), F.floor(k / 4).cast("string").alias("batch"),
        (F.floor(k / 4) % 10 / 10).alias("roundtrip_sec"), F.lit("click").alias("target"), F.when(k % 9 > 0, F.create_map(F.lit("accuracy"), (F.col("event_type") == "click").cast("double"), F.lit("v"), F.col("value"))).alias("scores"), F.lit("p").alias("postprocess"), F.when(k % 9 == 0, "no").alias("error"),
    )


@query("SELECT round(avg(s), 6) AS mean_roundtrip_sec, count(*) AS n_batches, round(sum(l) / sum(n), 3) AS mean_latency_sec FROM (SELECT event_id // 4 AS b, max((event_id // 4) % 10 / 10) AS s, sum(value) FILTER (event_id % 5 > 0) AS l, count(*) FILTER (event_id % 5 > 0) AS n FROM events GROUP BY 1)")
def latency_means(spark, sf):
    return artifacts.latency(_answers(spark, sf)).select(r6(F.col("mean_roundtrip_sec"), "mean_roundtrip_sec"), "n_batches", F.round("mean_latency_sec", 3).alias("mean_latency_sec"))


@query("""SELECT '{"model":"m' || min(event_id) FILTER (event_id % 7 = 3) || '"}' AS server_info FROM events""")
def server_info_first(spark, sf):
    return enrich.first_server_info(_answers(spark, sf), "ordinal")


@query("SELECT event_type AS task, count(*) AS n_samples, count(*) FILTER (event_id % 9 = 0) AS n_errors, round(avg((event_type = 'click')::INT) FILTER (event_id % 9 > 0), 6) AS accuracy, round(avg(value) FILTER (event_id % 9 > 0), 6) AS v FROM events GROUP BY event_type")
def task_summaries(spark, sf):
    s = artifacts.task_summary(_answers(spark, sf))
    return s.select("task", "n_samples", "n_errors", *(r6(F.try_element_at("mean", F.lit(m)), m) for m in ("accuracy", "v")))


@query("""SELECT 's' AS suite_id, 'r' AS run_id, string_agg(e || ':' || n || ':' || f, ',' ORDER BY e) AS tasks FROM (SELECT event_type AS e, count(*) AS n, count(*) FILTER (event_id % 9 = 0) AS f FROM events GROUP BY event_type)""")
def suite_summary(spark, sf):
    s = artifacts.suite_summary(_answers(spark, sf), "s", "r")
    j = s.select(F.from_json("value", "suite_id string, run_id string, eval_tasks array<struct<eval_task_id:string,summary:struct<n_samples:long,n_errors:long>>>").alias("j")).select("j.*")
    return j.select("suite_id", "run_id", F.array_join(F.transform("eval_tasks", lambda e: F.concat_ws(":", e["eval_task_id"], e["summary"]["n_samples"], e["summary"]["n_errors"])), ",").alias("tasks"))


@query("SELECT n, count(*) AS rows_, count(DISTINCT event_id) AS ids FROM events CROSS JOIN (VALUES ('predictions'), ('processed_predictions'), ('scored_predictions')) v(n) GROUP BY n")
def run_tables(spark, sf):
    """Three tables of a run that was broken off and resumed."""
    folder = sinks.work_dir(spark)
    a = _answers(spark, sf)
    artifacts.append_run(a.where("ordinal % 3 = 0"), folder)
    out = [x.agg(F.lit(n).alias("n"), F.count("*").alias("rows_"), F.count_distinct("sample_id").alias("ids")) for n, x in artifacts.append_run(a, folder).items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT c_mktsegment AS subset, count(*) AS n FROM customer GROUP BY ALL")
def pairs_manifest(spark, sf):
    c = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("subset"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("target"))
    scored = c.select("sample_id", "ordinal", F.col("target").alias("prediction"), F.lower("target").alias("processed"), F.lit(None).cast("string").alias("error"))
    folder = sinks.work_dir(spark)
    pipeline.write_pairs(pipeline.pairs(c.where("ordinal % 2 = 0"), scored, "m", "r"), folder, "r")
    return pipeline.write_pairs(pipeline.pairs(c, scored, "m", "r"), folder, "r", resume=True).select("subset", "n")


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS r, list_distinct(list_filter(string_split_regex(lower(substr(text, 1, 60)), '\\s+'), lambda x: x <> '')) AS c FROM benchmark)
SELECT item_id::VARCHAR AS sample_id, round(len(list_intersect(r, c)) / len(r), 6) AS score, len(r) || ' words' AS rationale, NULL::VARCHAR AS error FROM w""")
def rubric_judge(spark, sf):
    b = t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("sample_id"), F.lit("t").alias("task_id"), F.col("text").alias("labels"), F.substring("text", 1, 60).alias("prediction"))
    return judges.rubric_judge(judges.rubric_requests(b), judges.echo_judge).select("sample_id", r6(F.col("score"), "score"), "rationale", "error")


@query("SELECT count(*) AS n, count(*) FILTER (item_id % 2 = 1) AS errors FROM benchmark")
def rubric_judge_contract(spark, sf):
    """A judge whose scores are out of range for every second sample."""
    call = lambda part: [{"sample_id": r["sample_id"], "score": 2 if int(r["sample_id"]) % 2 else 1} for r in part]
    b = t(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("sample_id"), F.lit("t").alias("task_id"), F.col("text").alias("labels"), F.lit("").alias("prediction"))
    return judges.rubric_judge(judges.rubric_requests(b, "bioacoustic_classification_v1"), call, 4).agg(F.count("*").alias("n"), F.count("error").alias("errors"))


@query("""SELECT c_custkey::VARCHAR AS sample_id, CASE WHEN c_custkey % 3 = 0 THEN 'BUILDING' ELSE c_mktsegment END AS processed, (c_custkey % 3 > 0 OR c_mktsegment = 'BUILDING')::INT::DOUBLE AS accuracy FROM customer""")
def extractor_rescore(spark, sf):
    vocab = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    said = F.when(F.col("c_custkey") % 3 == 0, "a building, perhaps").otherwise(F.concat(F.lit("I hear "), F.lower("c_mktsegment")))
    c = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("sample_id"), F.lit("t").alias("task_id"), F.col("c_mktsegment").alias("labels"), said.alias("prediction"))
    s = judges.extractor_rescore(c, judges.stub_extractor, "classification", vocab)
    return s.select("sample_id", "processed", F.try_element_at("scores", F.lit("accuracy")).alias("accuracy"))


@query("SELECT conv_id::VARCHAR AS sample_id, 'p' || conv_id AS prediction, 2::INT AS n, 'stop' AS finish_reason, 3::INT AS prompt_tokens, 0.5::DOUBLE AS latency_sec, '{\"model\":\"m\"}' AS server_info FROM (SELECT DISTINCT conv_id FROM conversations)")
def response_mapping(spark, sf):
    call = lambda part: [{"sample_id": r["sample_id"], "predictions": ["p" + r["sample_id"], "q"], "finish_reason": "stop", "usage": {"prompt_tokens": 3}, "latency_sec": 0.5} for r in part]
    x = t(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("sample_id")).distinct().withColumn("request", F.lit("{}"))
    return enrich.predict(x, call, server_info={"model": "m"}).select("sample_id", "prediction", F.size("predictions").alias("n"), "finish_reason", "prompt_tokens", "latency_sec", "server_info")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'base64_wav' ELSE 'file_path' END AS payload_type, CASE WHEN page_id % 2 = 0 THEN to_base64(encode(coalesce(url, ''))) ELSE 'f' || page_id END AS data, 16000::INT AS rate FROM pages""")
def embedded_audio(spark, sf):
    p = t(spark, sf, "pages").select("page_id", F.concat(F.lit("f"), "page_id").alias("path"), F.coalesce("url", F.lit("")).cast("binary").alias("content"), F.lit(None).cast("int").alias("sample_rate"))
    return enrich.embedded(p.select("page_id", "path", "sample_rate"), p.where("page_id % 2 = 0").select("path", "content"), "page_id", "path").select("page_id", "payload_type", "data", F.col("sample_rate").alias("rate"))


@query("SELECT doc_id, lang, CASE lang WHEN 'en' THEN 10 WHEN 'fr' THEN 20 END::INT AS most_seconds FROM documents")
def dimension_lookup(spark, sf):
    clips = spark.createDataFrame([("en", 10), ("fr", 20)], "lang string, most_seconds int")
    return runs.with_dimension(t(spark, sf, "documents").select("doc_id", "lang"), clips, "lang")


@query("SELECT doc_id AS key, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS value FROM documents WHERE doc_id % 5 > 0")
def cache_store(spark, sf):
    """Values stored twice, the second time for even ids; errors are never stored."""
    path = f"{sinks.work_dir(spark)}/cache"
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.when(F.col("doc_id") % 5 == 0, "no").alias("error"))
    runs.store(d.withColumn("value", F.lit("old")), path)
    runs.store(d.where("key % 2 = 0").withColumn("value", F.lit("new")), path)
    return runs.cached(d.select("key"), spark.read.parquet(path))[0].select("key", "value")


@query("SELECT l, count(*) FILTER (y = l AND p = l) AS tp, count(*) FILTER (y <> l AND p = l) AS fp, count(*) FILTER (y = l AND p <> l) AS fn FROM (SELECT l_linenumber AS y, (l_linenumber * 2) % 8 AS p FROM lineitem) CROSS JOIN range(0, 8) r(l) GROUP BY l")
def dense_counts(spark, sf):
    x = t(spark, sf, "lineitem").select(F.col("l_linenumber").alias("y"), ((F.col("l_linenumber") * 2) % 8).cast("int").alias("p"))
    return metrics.counts(x, "p", "y", dense=True).select(F.col("label").cast("long").alias("l"), "tp", "fp", "fn")


@query("SELECT round(avg(CASE WHEN np + ny > 0 THEN 2 * tp / (np + ny) ELSE 0 END), 6) AS v FROM (SELECT l, count(*) FILTER (p = l AND y = l) AS tp, count(*) FILTER (p = l) AS np, count(*) FILTER (y = l) AS ny FROM (SELECT o_orderstatus AS y, CASE WHEN o_orderkey % 3 = 0 THEN 'F' ELSE o_orderstatus END AS p FROM orders) CROSS JOIN (SELECT DISTINCT o_orderstatus AS l FROM orders) GROUP BY l)")
def corpus_metric(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("y"), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("p"))
    return metrics.dataset_metric(o, "classification", "p", "y", "o_orderkey").select(r6(F.col("macro_f1"), "v"))


@query("SELECT p_partkey, list_sort(list_intersect([p_type, p_brand, 'x'], [p_brand, p_name, 'x'])) [1] AS first, len(list_intersect([p_type, p_brand, 'x'], [p_brand, p_name, 'x']))::INT AS n FROM part")
def label_intersection(spark, sf):
    a, b = F.array("p_type", "p_brand", F.lit("x")), F.array("p_brand", "p_name", F.lit("x"))
    both = F.array_sort(F.array_intersect(a, b))
    return t(spark, sf, "part").select("p_partkey", F.get(both, F.lit(0)).alias("first"), F.size(both).alias("n"))


@query("SELECT l_suppkey, least(nullif(l_suppkey % 5, 0), nullif(l_suppkey % 7, 0)) AS size FROM (SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 5 > 0 AND l_suppkey % 7 > 0")
def batch_sizes(spark, sf):
    """What server and user allow, for every pair of limits."""
    table = [(a, b, runs.batch_size(a, b)) for a in range(1, 5) for b in range(1, 7)]
    sizes = spark.createDataFrame(table, "a int, b int, size int")
    s = t(spark, sf, "lineitem").select("l_suppkey").distinct().withColumn("a", (F.col("l_suppkey") % 5).cast("int")).withColumn("b", (F.col("l_suppkey") % 7).cast("int"))
    return s.join(F.broadcast(sizes), ["a", "b"]).select("l_suppkey", F.col("size").cast("long").alias("size"))


@query("""SELECT c_mktsegment AS label, '{"cleaners":[["normalize_whitespace",{}],["strip_eos",{}],["extract_label_from_text",{"labels":["' || c_mktsegment || '"]}]],"parsers":[]}' AS fingerprint FROM (SELECT DISTINCT c_mktsegment FROM customer)""")
def plan_fingerprints(spark, sf):
    labels = [r[0] for r in t(spark, sf, "customer").select("c_mktsegment").distinct().collect()]  # a label set
    return spark.createDataFrame([(x, planner.fingerprint(*planner.plan_offline([x], "classification"))) for x in labels], "label string, fingerprint string")


@query("SELECT conv_id::VARCHAR AS sample_id, (length(r) > 20)::INT::DOUBLE AS long_ FROM (SELECT conv_id, arg_max(text, turn) AS r FROM conversations GROUP BY conv_id)")
def custom_scorer(spark, sf):
    """A run whose scores are the caller's own: how long the answer's target is."""
    from .plans.config import Task

    c = t(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(F.min("conv_id").alias("ordinal"), F.lit("hi").alias("text"), F.max_by("text", "turn").alias("target"))
    score = lambda processed, raw, target: F.create_map(F.lit("long"), (F.length(target) > 20).cast("double"))
    out = pipeline.run_task(c, Task("t", "qa", ["long"], ["x"]), enrich.stub_model, f"{sinks.work_dir(spark)}/scored", scorer=score)
    return out.select("sample_id", F.try_element_at("scores", F.lit("long")).alias("long_"))


@query("SELECT item_id::VARCHAR AS item_id, 32::INT AS n, 16000::INT AS rate, NULL::VARCHAR AS error FROM benchmark")
def audio_decode(spark, sf):
    """A made WAV for each item, written and decoded."""
    import numpy as np

    raw = audio.wav_of(np.zeros(32, dtype=np.float32), 16000)
    b = t(spark, sf, "benchmark").select("item_id", F.lit(bytearray(raw)).alias("content"))
    return audio.decode(b, "item_id", "content", rate=16000).select("item_id", F.size("samples").alias("n"), F.col("sample_rate").cast("int").alias("rate"), "error")


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '|x y|' || event_type ELSE 'a' END AS tokens FROM events""")
def token_lists(spark, sf):
    s = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(" "), "event_type", F.lit(" ,, x  y,"), "event_type")).otherwise("a")
    return t(spark, sf, "events").select("event_id", F.array_join(text.parse_labels(text.normalize_whitespace(s)), "|").alias("tokens"))
