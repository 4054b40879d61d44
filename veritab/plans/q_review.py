"""Review workflow and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import describe
from veritab.operators import coverage, review
from veritab.plans import derived as d
from veritab.plans.derived import RUN_TYPES, load, oracle, pick
from veritab.plans.q_listing import SHOTS
from veritab.plans.q_text import CONTACT, INFERRED, TEAM
from veritab.plans.registry import QUERIES
from veritab.session import scratch_path
from veritab.streaming import descriptors, run_events
from veritab.streaming import feedback as feedback_stream


def _q(name, sql=None):
    return QUERIES.operator(name, group="review", oracle=sql)


def _decisions(spark, root):
    """One decision per line item; lines numbered seven name an unknown suggestion."""
    return load(spark, root, "lineitem").selectExpr(
        "case when l_linenumber = 7 then -1 - l_orderkey else l_orderkey end as id",
        "l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey as seq",
        "case when l_returnflag = 'A' then 'approve' else 'reject' end as action", "concat('user', l_suppkey) as actor").distinct()


DECIDED = (
    "SELECT x.id, x.seq, x.action, x.actor, s.status AS old_status, CASE WHEN s.id IS NULL THEN 'missing' WHEN s.status = 'pending' AND x.seq ="
    " min(x.seq) OVER (PARTITION BY x.id) THEN 'applied' ELSE 'conflict' END AS outcome FROM (SELECT DISTINCT CASE WHEN l_linenumber = 7 THEN -1 -"
    " l_orderkey ELSE l_orderkey END AS id, l_linenumber * 10000000000 + l_partkey * 10000 + l_suppkey AS seq, CASE WHEN l_returnflag = 'A' THEN 'approve'"
    " ELSE 'reject' END AS action, concat('user', l_suppkey) AS actor FROM lineitem) x LEFT JOIN sugg s ON s.id = x.id"
)


def _outcomes(spark, root):
    return review.decide(d.suggestions(spark, root), _decisions(spark, root))


@_q("p1_decisions", oracle(f"SELECT id, seq, action, outcome FROM ({DECIDED})", "sugg"))
def p1_decisions(spark, root):
    return _outcomes(spark, root).select("id", "seq", "action", "outcome")


@_q("p1_reviewed", oracle(
    f"WITH o AS (SELECT * FROM ({DECIDED}) WHERE outcome = 'applied') SELECT s.id, CASE WHEN o.action = 'approve' THEN 'approved' WHEN o.action = 'reject'"
    " THEN 'rejected' ELSE s.status END AS status, o.actor AS reviewed_by FROM sugg s LEFT JOIN o ON o.id = s.id", "sugg"))
def p1_reviewed(spark, root):
    out = review.reviewed(d.suggestions(spark, root), _outcomes(spark, root))
    return out.select("id", "status", "reviewed_by")


@_q("p3_audit_rows", oracle(
    f"SELECT o.actor, concat(o.action, '_suggestion') AS action, CAST(o.id AS VARCHAR) AS resource_id, s.suggestion_type FROM ({DECIDED}) o JOIN sugg s"
    " ON s.id = o.id WHERE outcome = 'applied'", "sugg"))
def p3_audit_rows(spark, root):
    out = review.audit_rows(_outcomes(spark, root), d.suggestions(spark, root))
    return out.select("actor", "action", "resource_id", F.get_json_object("payload", "$.suggestion_type").alias("suggestion_type"))


def _approved(spark, root):
    return d.suggestions(spark, root).filter("status = 'approved'")


_APP = "SELECT * FROM sugg WHERE status = 'approved'"


@_q("p2_table_updates", oracle(
    f"SELECT a.id, concat('text ', s.id) AS description, CASE WHEN s.id % 4 = 0 THEN a.tier ELSE 'important' END AS tier FROM (SELECT target_id, max(id) AS id"
    f" FROM ({_APP}) WHERE suggestion_type = 'description' GROUP BY 1) s JOIN assets a ON a.id = s.target_id", "sugg", "assets"))
def p2_table_updates(spark, root):
    return review.table_updates(_approved(spark, root), d.assets(spark, root))


@_q("p2_column_updates", oracle(
    f"SELECT c.id, 'phone' AS pii_class, s.confidence AS pii_confidence, 'ai_inferred' AS pii_source FROM (SELECT concat(target_id, ':', id % 10) AS cid,"
    f" arg_max(confidence, id) AS confidence FROM ({_APP}) WHERE suggestion_type = 'pii_class' GROUP BY 1) s JOIN cols c ON c.id = s.cid", "sugg", "cols"))
def p2_column_updates(spark, root):
    return review.column_updates(_approved(spark, root), d.columns(spark, root))


@_q("p2_sync_notes", oracle(
    "SELECT s.id, CASE suggestion_type WHEN 'description' THEN CASE WHEN a.id IS NULL THEN 'table missing' ELSE concat('table.description <- ',"
    " length(concat('text ', s.id)), ' chars') END WHEN 'pii_class' THEN CASE WHEN c.id IS NULL THEN 'column missing' ELSE 'column.pii_class <- phone' END"
    " WHEN 'owner' THEN CASE WHEN a.id IS NULL THEN 'table missing' ELSE concat('asset_owners.upsert <- user', s.id % 5, '@example.com') END WHEN 'glossary'"
    " THEN CASE WHEN s.id % 4 = 1 AND EXISTS (SELECT 1 FROM terms WHERE id = 'ring') THEN 'asset_terms.upsert <- ring' ELSE 'term missing' END WHEN 'lineage'"
    f" THEN 'missing fqn' ELSE '(no sync handler for this type yet)' END AS note FROM ({_APP}) s LEFT JOIN assets a ON a.id = s.target_id LEFT JOIN cols c ON"
    " c.id = concat(s.target_id, ':', s.id % 10)", "sugg", "assets", "cols", "terms"))
def p2_sync_notes(spark, root):
    return review.sync_notes(_approved(spark, root), d.assets(spark, root), d.columns(spark, root), d.terms(spark, root))


def _owners(spark, root):
    """Existing owners; one in five has an address that proposals use."""
    mail = "case when table_id % 5 = 0 then 'user0@example.com' else user_email end"
    return d.owners(spark, root).withColumn("user_email", F.expr(mail)).withColumn("role", F.lit("owner"))


@_q("p2_owner_upserts", oracle(
    f"SELECT s.target_id AS table_id, s.user_email, 'owner' AS role, CASE WHEN o.id IS NULL THEN NULL ELSE o.user_name END AS user_name, CASE WHEN o.id IS NULL"
    " THEN 'data-shop' ELSE o.team END AS team, coalesce(o.source, 'ai_inferred') AS source, s.confidence, true AS is_verified FROM (SELECT target_id,"
    f" concat('user', id % 5, '@example.com') AS user_email, arg_max(confidence, id) AS confidence FROM ({_APP}) WHERE suggestion_type = 'owner' GROUP BY 1, 2) s"
    " JOIN assets a ON a.id = s.target_id LEFT JOIN owners o ON o.table_id = s.target_id AND CASE WHEN o.table_id % 5 = 0 THEN 'user0@example.com' ELSE"
    " o.user_email END = s.user_email", "sugg", "assets", "owners"))
def p2_owner_upserts(spark, root):
    return review.owner_upserts(_approved(spark, root), d.assets(spark, root), _owners(spark, root))


@_q("p2_term_upserts", oracle(
    f"SELECT target_id AS table_id, 'ring' AS term_id, arg_max(confidence, id) AS confidence, 'ai_inferred' AS source FROM ({_APP}) WHERE suggestion_type ="
    " 'glossary' AND id % 4 = 1 AND EXISTS (SELECT 1 FROM terms WHERE id = 'ring') GROUP BY 1", "sugg", "terms"))
def p2_term_upserts(spark, root):
    return review.term_upserts(_approved(spark, root), d.terms(spark, root))


@_q("p2_edge_inserts", oracle(
    f"SELECT s.target_id AS upstream_id, s.target_id + 1 AS downstream_id, min(s.confidence) AS confidence, 'ai_inferred' AS transform_type FROM ({_APP}) s"
    " JOIN assets a ON a.id = s.target_id JOIN assets b ON b.id = s.target_id + 1 WHERE s.suggestion_type = 'lineage' AND NOT EXISTS (SELECT 1 FROM edges e"
    " WHERE e.upstream_id = s.target_id AND e.downstream_id = s.target_id + 1 AND e.transform_type = 'copy') GROUP BY 1, 2", "sugg", "assets", "edges"))
def p2_edge_inserts(spark, root):
    a = d.assets(spark, root)
    up = a.selectExpr("id as target_id", "upper(fqn) as uf")
    down = a.selectExpr("id - 1 as target_id", "fqn as df")
    rows = _approved(spark, root).drop("payload").join(up, "target_id").join(down, "target_id")
    rows = rows.withColumn("payload", F.create_map(F.lit("upstream_fqn"), "uf", F.lit("downstream_fqn"), "df"))
    known = d.edges(spark, root).filter("transform_type = 'copy'").withColumn("transform_type", F.lit("ai_inferred"))
    return review.edge_inserts(rows, a, known).drop("source")


@_q("p4_gate", oracle(
    f"SELECT id, description, confidence, CASE WHEN confidence >= 0.7 THEN 'auto_applied' ELSE 'pending' END AS status FROM ({INFERRED}) WHERE confidence >= 0.5"
    " AND description <> '' AND NOT (coalesce(old_description, '') <> '' AND coalesce(old_source, '') = 'manual')", "cols"))
def p4_gate(spark, root):
    told = describe.describe_columns(d.columns(spark, root), F.lit("t"))
    rows = told.select(
        "id", F.col("inferred.description").alias("text"), F.col("inferred.confidence").alias("confidence"),
        F.col("description").alias("current_description"), F.col("description_source").alias("current_source"),
    ).withColumnRenamed("text", "description")
    return review.gate(rows).select("id", "description", "confidence", "status")


def _model_owners(spark, root):
    """Model replies for some tables: one per customer, unusable where the segment says so."""
    return load(spark, root, "customer").selectExpr(
        "c_custkey as table_id", "case when c_mktsegment = 'BUILDING' then '' else concat(' M', c_custkey, '@Example.com') end as user_email",
        "c_name as user_name", "'data-growth' as team", f"{pick(['owner', 'steward', 'boss'], 'c_custkey')} as role",
        "round(abs(c_acctbal) / 10000, 2) as confidence")


_OWN = (
    f"WITH base AS (SELECT id AS table_id, team, {CONTACT} AS user_email FROM (SELECT id, {TEAM} AS team FROM assets WHERE id NOT IN (SELECT table_id FROM"
    " owners WHERE is_verified)) q), both_sides AS (SELECT b.table_id, CASE WHEN c_custkey IS NOT NULL THEN concat('m', c_custkey, '@example.com') ELSE"
    " b.user_email END AS user_email, CASE WHEN c_custkey IS NOT NULL THEN 'data-growth' ELSE b.team END AS team, CASE WHEN c_custkey IS NOT NULL AND c_custkey"
    " % 3 = 1 THEN 'steward' ELSE 'owner' END AS role, CASE WHEN c_custkey IS NOT NULL THEN 'ai_inferred' ELSE 'fqn_inference' END AS source, CASE WHEN"
    " c_custkey IS NOT NULL THEN round(abs(c_acctbal) / 10000, 2) ELSE 0.6 END AS confidence FROM base b LEFT JOIN customer c ON c.c_custkey = b.table_id AND"
    " c_mktsegment <> 'BUILDING'), kept AS (SELECT * FROM both_sides WHERE confidence >= 0.55) "
)


def _inferred_owners(spark, root):
    return review.infer_owners(d.assets(spark, root), d.owners(spark, root), _model_owners(spark, root))


@_q("p6_infer_owners", oracle(_OWN + "SELECT table_id, user_email, team, role, source, confidence FROM kept", "assets", "owners"))
def p6_infer_owners(spark, root):
    return _inferred_owners(spark, root).select("table_id", "user_email", "team", "role", "source", "confidence")


@_q("p6_owner_counts", oracle(_OWN + "SELECT team, source, count(*) AS n FROM kept GROUP BY 1, 2", "assets", "owners"))
def p6_owner_counts(spark, root):
    return coverage.count_by(_inferred_owners(spark, root), "team", "source")


@_q("j11_without_verified_owner", oracle(
    f"SELECT id AS table_id, {TEAM} AS team FROM assets WHERE id NOT IN (SELECT table_id FROM owners WHERE is_verified)", "assets", "owners"))
def j11_without_verified_owner(spark, root):
    return review.infer_owners(d.assets(spark, root), d.owners(spark, root)).select("table_id", "team")


@_q("p5_combine",
    "SELECT coalesce(o.k, c.k) AS k, CASE WHEN c.k IS NOT NULL AND (o.k IS NULL OR o.confidence < 0.65) THEN c.label ELSE o.label END AS label, CASE WHEN"
    " c.k IS NOT NULL AND (o.k IS NULL OR o.confidence < 0.65) THEN c.confidence ELSE o.confidence END AS confidence FROM (SELECT p_partkey AS k, p_name AS label,"
    " p_size / 50.0 AS confidence FROM part) o FULL JOIN (SELECT c_custkey * 2 AS k, c_name AS label, 0.9 AS confidence FROM customer) c ON c.k = o.k")
def p5_combine(spark, root):
    rules = load(spark, root, "part").selectExpr("p_partkey as k", "p_name as label", "p_size / 50.0D as confidence")
    model = load(spark, root, "customer").selectExpr("c_custkey * 2 as k", "c_name as label", "0.9D as confidence")
    return review.combine(rules, model, ["k"], 0.65, "label")


# Streams: the events file is the stream; every run goes to a fresh folder. ------


BATCHES = 4


def _event_stream(spark, root, *order, batches=BATCHES):
    """The events as a stream of files, in time order or by the given columns, a few files for each micro-batch."""
    events = load(spark, root, "events")
    path = scratch_path(spark, "event-files")
    files = max(batches, int(spark.conf.get("spark.sql.shuffle.partitions")))
    events.repartitionByRange(files, *(order or ["ts"])).write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def _run_stream(spark, root):
    kinds = " ".join(f"when '{k}' then '{v}'" for k, v in RUN_TYPES.items())
    rows = _event_stream(spark, root).selectExpr(
        f"case event_type {kinds} end as eventType", "case when event_id % 13 = 0 then concat('at ', event_id) else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end as eventTime",
        "'feed' as producer", "cast(null as string) as schemaURL", "named_struct('namespace', concat('ns_', user_id % 3), 'name', concat('job_', user_id)) as job",
        "named_struct('runId', case when value < 2 then null else concat('run_', event_id) end) as run",
        "array(named_struct('namespace', concat('ns_', user_id % 3), 'name', concat('in_', get_json_object(props, '$.k')))) as inputs",
        "cast(null as array<struct<namespace: string, name: string>>) as outputs",
        "map('k', get_json_object(props, '$.k')) as runFacets", "map('owner', concat('o', user_id)) as jobFacets")
    path = scratch_path(spark, "run-events")
    run_events.ingest(rows, path, scratch_path(spark, "run-events-checkpoint")).awaitTermination()
    return run_events.stored(spark, path)


_REASON = (
    "CASE WHEN event_type = 'OOPS' THEN 'invalid eventType: OOPS' WHEN run_id IS NULL THEN 'missing required: job.namespace, job.name, run.runId' ELSE '' END"
)


@_q("t1_ingest_run_events", oracle(
    "SELECT event_type, CASE WHEN event_id % 13 <> 0 THEN event_s END AS event_s, job_namespace, job_name, run_id, owner, r AS reason, r = '' AS accepted"
    f" FROM (SELECT *, concat('o', substring(job_name, 5)) AS owner, CASE WHEN {_REASON} <> '' THEN {_REASON} WHEN event_id % 13 = 0 THEN"
    " concat('invalid eventTime: at ', event_id) ELSE '' END AS r FROM runs)", "runs"))
def t1_ingest_run_events(spark, root):
    return _run_stream(spark, root).select(
        "event_type", F.unix_timestamp("event_time").alias("event_s"), "job_namespace", "job_name", "run_id",
        F.col("job_facets")["owner"].alias("owner"), "reason", "accepted")


@_q("t2_run_documents", oracle(
    "SELECT run_id, concat('{\"eventType\":\"', event_type, '\",\"eventTime\":\"', iso, '.000000Z\",\"producer\":\"feed\",\"schemaURL\":\"',"
    " 'https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent\",\"job\":{\"namespace\":\"', job_namespace, '\",\"name\":\"', job_name,"
    " '\"},\"run\":{\"runId\":\"', run_id, '\"},\"inputs\":[{\"namespace\":\"', job_namespace, '\",\"name\":\"in_', k, '\"}],\"outputs\":[],\"runFacets\":{\"k\":\"', k,"
    f" '\"}}}}') AS document FROM runs WHERE {_REASON} = ''", "runs"))
def t2_run_documents(spark, root):
    ok = run_events.checked(d.run_events(spark, root)).filter("reason = ''")
    return run_events.to_documents(ok)


CHANGED = (
    "SELECT id, sha, arg_min(prev, (mtime, seq)) AS prev_sha, min(seq) AS seq FROM (SELECT *, lag(sha) OVER (PARTITION BY id ORDER BY mtime, seq) AS prev"
    " FROM versions) WHERE prev IS NOT NULL AND prev <> sha GROUP BY 1, 2"
)


@_q("t3_descriptor_changes", oracle(CHANGED, "versions"))
def t3_descriptor_changes(spark, root):
    return descriptors.changes(d.versions_of(load(spark, root, "events"))).select("id", "sha", "prev_sha", "seq")


def _watched(spark, root, *order, batches=BATCHES):
    path = scratch_path(spark, "changes")
    stream = d.versions_of(_event_stream(spark, root, *order, batches=batches))
    descriptors.watch(stream, path, scratch_path(spark, "changes-checkpoint")).awaitTermination()
    return descriptors.told(spark, path).select("id", "sha", "prev_sha", "seq")


@_q("t3_descriptor_stream", oracle(CHANGED, "versions"))
def t3_descriptor_stream(spark, root):
    return _watched(spark, root)


# The same versions out of order: most are late, and what was told has to be corrected.
@_q("t3_descriptor_late", oracle(CHANGED, "versions"))
def t3_descriptor_late(spark, root):
    return _watched(spark, root, F.xxhash64("event_id"), batches=10)


@_q("t4_feedback_stream", oracle(SHOTS.format(k=5), "fb"))
def t4_feedback_stream(spark, root):
    path = scratch_path(spark, "feedback")
    stream = d.feedback_of(_event_stream(spark, root))
    feedback_stream.update_shots(stream, path, f"{path}/checkpoint").awaitTermination()
    return feedback_stream.shots(spark, path).drop("note")


@_q("t4_feedback_rows", oracle("SELECT seq, skill, case_key, accepted FROM fb", "fb"))
def t4_feedback_rows(spark, root):
    path = scratch_path(spark, "feedback")
    stream = d.feedback_of(_event_stream(spark, root))
    feedback_stream.append_feedback(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/rows").select("seq", "skill", "case_key", "accepted")
