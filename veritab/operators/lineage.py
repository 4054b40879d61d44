"""Edges: name resolution, column expansion, similar names, glossary matches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions import describe, names, sqltext
from veritab.session import materialize, materialize_observed, spread


def resolve_references(refs: DataFrame, assets: DataFrame, service: str, database: str, schema: str) -> DataFrame:
    """Complete table references and look up their ids; unresolved ones keep a null id."""
    full = refs.withColumn(
        "fqn", names.resolve_reference(F.col("ref"), F.lit(service), F.lit(database), F.lit(schema))
    )
    return full.join(assets.select("fqn", F.col("id").alias("table_id")), "fqn", "left")


def _listed(columns: DataFrame, *taken: str) -> DataFrame:
    """<table_id, _columns>: the named columns of a table in one row, each with its name and what is ``taken`` of it."""
    named = columns.where("name is not null and table_id is not null")
    return named.groupBy("table_id").agg(F.collect_list(F.struct("name", *[F.col(c) for c in sorted({*taken} - {"name"})])).alias("_columns"))


def _column_of(name: str) -> Column:
    """The columns in ``_columns`` of the name in column ``name``."""
    return F.explode(F.filter("_columns", lambda c: c["name"] == F.col(name)))


def equal_names(pairs: DataFrame, columns: DataFrame, up: dict[str, str], down: dict[str, str]) -> DataFrame:
    """Rows of ``pairs`` <upstream_id, downstream_id, ..> for each two columns of their tables with one name: ``column_name``, and
    what ``up`` and ``down`` take from the two columns, by its new name.

    The columns of a table lie in one row, which every step meets by table, so that they are shuffled once at most. Pairs take the names
    of the upstream table to the downstream one as a list of 16-bit hashes; what is equal there goes back for the upstream columns,
    where the names themselves are compared.
    """
    listed = _listed(columns, *up, *down)
    short = F.transform("_columns", lambda c: (F.pmod(F.hash(c["name"]), F.lit(65536)) - 32768).cast("short"))
    hashes = listed.select(F.col("table_id").alias("upstream_id"), F.array_distinct(short).alias("_up"))
    below = listed.select(F.col("table_id").alias("downstream_id"), "_columns", short.alias("_down"))
    shared = (
        pairs.join(hashes, "upstream_id").join(below, "downstream_id")
        .select(*pairs.columns, "_columns", "_down", F.array_intersect("_up", "_down").alias("_shared")).where(F.size("_shared") > 0)
    )
    found = shared.select(
        *pairs.columns, F.explode(F.filter("_columns", lambda c, i: F.array_contains("_shared", F.get("_down", i)))).alias("_d")
    ).select(*pairs.columns, F.col("_d.name").alias("column_name"), *[F.col(f"_d.{c}").alias(n) for c, n in down.items()])
    both = found.join(listed.withColumnRenamed("table_id", "upstream_id"), "upstream_id").withColumn("_u", _column_of("column_name"))
    return both.select(*pairs.columns, "column_name", *[F.col(f"_u.{c}").alias(n) for c, n in up.items()], *down.values())


def matched_names(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Equal column names of the tables of table edges without SQL, with what ``name_match_edges`` takes of the edges."""
    pairs = edges.filter(F.col("sql").isNull()).select(
        "upstream_id", "downstream_id", F.col("job_id").alias("edge_job"), "component", "pipeline_stage"
    )
    return equal_names(pairs, columns, {"id": "upstream_column_id", "data_type": "up_type"}, {"id": "downstream_column_id"})


def name_match_edges(edges: DataFrame, columns: DataFrame, min_confidence: float = 0.0, matched: DataFrame | None = None) -> DataFrame:
    """Column edges by equal column name, only for table edges without SQL; confidence 0.7.

    ``matched``: the ``matched_names`` of these edges, if they are known.
    """
    joined = matched_names(edges, columns) if matched is None else matched
    out = joined.select(
        "upstream_id", "downstream_id", "upstream_column_id", "downstream_column_id",
        F.col("column_name").alias("upstream_col"), F.col("column_name").alias("downstream_col"),
        F.lit("direct").alias("transform_type"),
        F.col("column_name").alias("transform_expression"),
        F.coalesce("edge_job", F.lit("lineage_to_column")).alias("job_id"),
        F.coalesce("component", F.lit("lineage_to_column")).alias("component"),
        F.concat(F.lit("原样透传 "), "column_name", F.lit(" ("), "up_type", F.lit(")")).alias("description"),
        F.lit(0.7).alias("confidence"),
        F.lit("lineage_to_column").alias("source"),
        "pipeline_stage",
    )
    return out.filter(F.col("confidence") >= min_confidence)


def drop_outranked(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Drop candidates whose column pair already has a more confident edge."""
    pair = ["upstream_column_id", "downstream_column_id"]
    best = existing.groupBy(*pair).agg(F.max("confidence").alias("_best"))
    c, b = candidates.alias("c"), best.alias("b")
    on = (
        (F.col("c.upstream_column_id") == F.col("b.upstream_column_id"))
        & (F.col("c.downstream_column_id") == F.col("b.downstream_column_id"))
        & (F.col("b._best") > F.col("c.confidence"))
    )
    return c.join(b, on, "left_anti")


def first_by_short_name(assets: DataFrame) -> DataFrame:
    """First full name per short table name, by id."""
    return (
        assets.groupBy(F.element_at(F.split("fqn", r"\."), -1).alias("short_name"))
        .agg(F.min(F.struct("id", "fqn")).alias("f"))
        .select("short_name", F.col("f.id").alias("id"), F.col("f.fqn").alias("fqn"))
    )


def _statement(sql: str) -> Column:
    return F.unhex(F.sha2(sql, 256))


def statement_refs(edges: DataFrame) -> DataFrame:
    """Column references of the statements of table edges, each statement parsed once: ``statement`` (SHA-256 of its text),
    downstream_col, transform_expression, transform_type, upstream_table, upstream_col."""
    texts = edges.filter(F.col("sql").isNotNull()).groupBy(_statement("sql").alias("statement")).agg(F.first("sql").alias("sql"))
    # Few bytes, but costly to parse: kept from being merged into few tasks.
    texts = texts.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), "statement")
    return sqltext.select_column_refs(texts).drop("sql").distinct()


def sql_column_edges(edges: DataFrame, assets: DataFrame, columns: DataFrame) -> DataFrame:
    """Column edges of table edges that carry SQL; confidence 0.95.

    A source column counts when its table is the edge's upstream table and both
    columns exist in the catalog.

    The references of a statement travel as one list to its edges and on to the upstream tables, where most fall away.
    """
    found = statement_refs(edges)
    listed_refs = found.groupBy("statement").agg(F.collect_list(F.struct(*[c for c in found.columns if c != "statement"])).alias("_refs"))
    withsql = (
        edges.filter(F.col("sql").isNotNull())
        .select("upstream_id", "downstream_id", F.col("job_id").alias("edge_job"), "component", "pipeline_stage", _statement("sql").alias("statement"))
        .join(listed_refs, "statement").drop("statement")
    )
    listed = _listed(columns, "id", "data_type")
    short = assets.select(F.col("id").alias("upstream_id"), F.element_at(F.split("fqn", r"\."), -1).alias("_short"))
    edge = [c for c in withsql.columns if c != "_refs"]
    mine = (
        withsql.join(short, "upstream_id").join(listed.withColumnRenamed("table_id", "upstream_id"), "upstream_id")
        .select(*edge, "_columns", F.inline(F.filter("_refs", lambda r: r["upstream_table"] == F.col("_short")))).drop("upstream_table")
        .withColumn("_u", _column_of("upstream_col")).drop("_columns")
        .withColumns({"upstream_column_id": F.col("_u.id"), "up_type": F.col("_u.data_type")}).drop("_u")
    )
    joined = (
        mine.join(assets.select(F.col("id").alias("downstream_id")), "downstream_id").join(listed.withColumnRenamed("table_id", "downstream_id"), "downstream_id")
        .withColumn("_d", _column_of("downstream_col")).drop("_columns")
        .withColumns({"downstream_column_id": F.col("_d.id"), "down_type": F.col("_d.data_type")}).drop("_d")
    )
    out = joined.select(
        "upstream_id", "downstream_id", "upstream_column_id", "downstream_column_id", "upstream_col", "downstream_col",
        "transform_type", "transform_expression",
        F.concat(F.lit("sqlglot:"), F.coalesce("edge_job", F.lit("unknown"))).alias("job_id"),
        F.coalesce("component", F.lit("sqlglot")).alias("component"),
        describe.column_edge_description(
            F.col("transform_type"), F.col("transform_expression"), F.col("upstream_col"), F.col("up_type"),
            F.col("downstream_col"), F.col("down_type"),
        ).alias("description"),
        F.lit(0.95).alias("confidence"),
        F.lit("sqlglot").alias("source"),
        "pipeline_stage",
    )
    return unique_column_edges(out)


EDGE_KEY = ["upstream_column_id", "downstream_column_id", "transform_type", "job_id"]


def unique_column_edges(edges: DataFrame) -> DataFrame:
    """One row per column-edge key."""
    others = [c for c in edges.columns if c not in EDGE_KEY]
    return edges.groupBy(*EDGE_KEY).agg(F.min(F.struct(*others)).alias("_v")).select(*EDGE_KEY, "_v.*").select(*edges.columns)


def infer_column_edges(edges: DataFrame, assets: DataFrame, columns: DataFrame, fallback: bool = True, matched: DataFrame | None = None) -> DataFrame:
    """SQL-derived column edges, and name matches where an edge carries no SQL.

    Name matches found here are certain enough for confidence 1.0. ``matched``: the ``matched_names`` of these edges, if they are known.
    """
    from_sql = sql_column_edges(edges, assets, columns)
    if not fallback:
        return from_sql
    found = matched_names(edges, columns) if matched is None else matched
    by_name = (
        name_match_edges(edges, columns, matched=found.withColumn("edge_job", F.coalesce("edge_job", F.lit("unknown"))))
        .withColumn("job_id", F.concat(F.lit("lineage_to_column:"), "job_id"))
        .withColumn("confidence", F.lit(1.0))
    )
    return from_sql.unionByName(by_name)


_PAIR = ["upstream_id", "downstream_id"]


def edge_marks(edges: DataFrame, assets: DataFrame, columns: DataFrame) -> DataFrame:
    """One row per table pair: <upstream_id, downstream_id, mark>.

    The mark is a hash of all that its column edges depend on: the pair's edges with their statements, and name and
    columns of both tables. Hashes are added up, so that order means nothing and every step is a partial aggregate.
    """
    def total(*values):
        return F.sum(F.xxhash64(*values).cast("decimal(38,0)"))

    own = columns.groupBy(F.col("table_id").alias("id")).agg(total("id", "name", "data_type").alias("cols"))
    tables = assets.join(own, "id", "left").select("id", F.xxhash64("fqn", "cols").alias("of_table"))
    pairs = edges.groupBy(*_PAIR).agg(total("job_id", "component", "pipeline_stage", F.sha2("sql", 256)).alias("of_edges"))
    for side in _PAIR:
        pairs = pairs.join(tables.select(F.col("id").alias(side), F.col("of_table").alias(f"of_{side}")), side, "left")
    return pairs.select(*_PAIR, F.xxhash64("of_edges", *[f"of_{side}" for side in _PAIR]).alias("mark"))


def refresh_column_edges(edges: DataFrame, assets: DataFrame, columns: DataFrame, marks: DataFrame, inferred: DataFrame) -> dict[str, DataFrame]:
    """Column edges after a change, from those and the marks of the run before.

    Only table pairs that are new or whose mark differs are inferred again, and only their statements are parsed. What was inferred for the
    others stays; what belonged to changed or removed pairs goes. ``inferred`` has the columns of ``infer_column_edges``.
    Returns the marks and column edges as they are now, and the pairs that were worked on.
    """
    now = materialize(edge_marks(edges, assets, columns), "edge-marks")
    same = now.join(marks, [*_PAIR, "mark"], "left_semi").select(*_PAIR)
    changed = materialize(now.join(marks, [*_PAIR, "mark"], "left_anti").select(*_PAIR), "changed-pairs")
    # Read several times below.
    again = materialize(edges.join(changed, _PAIR, "left_semi"), "changed-edges")
    fresh = infer_column_edges(again, assets, columns)
    kept = inferred.join(same, _PAIR, "left_semi")
    return {"marks": now, "column_edges": kept.unionByName(fresh.select(*inferred.columns)), "changed": changed}


def name_groups(assets: DataFrame) -> DataFrame:
    """Tables grouped by (token set, layer): member count and first id.

    Copies of one name collapse to one row here, before any join.
    """
    tokens = names.name_tokens(F.col("fqn"))
    return (
        assets.select("id", tokens.alias("tokens"), names.name_layer(F.col("fqn")).alias("layer"))
        .filter(F.size("tokens") > 0)
        .groupBy("tokens", "layer")
        .agg(F.count("*").alias("members"), F.min("id").alias("first_id"))
    )


def similar_name_groups(assets: DataFrame, min_similarity: float = 0.4) -> DataFrame:
    """Pairs of name groups with Jaccard similarity of at least ``min_similarity``.

    Prefix-filter join: two sets of sizes m and n must share at least
    ceil(t/(1+t) * (m+n)) = k tokens, so with tokens ranked from rare to common
    one of the first m-k+1 tokens of the one is among the first n-k+1 of the
    other. Only those are joined, so common tokens rarely meet and no pair is
    lost. A pair of groups stands for all its table pairs (``table_pairs``);
    it is not expanded, because copies of one name would be quadratic. A group
    of two or more tables also pairs with itself.

    ``direction`` says which side feeds the other; 'input_order' means that the
    lower table id of each pair is upstream.
    """
    # Groups are read from both sides and for the token ranks, so they are written out once.
    groups = materialize(
        name_groups(assets).withColumn("gid", F.concat_ws("|", F.array_join("tokens", " "), "layer")), "name-groups"
    )
    set_pairs = _similar_sets(groups.select("tokens").distinct(), None, min_similarity)
    left = groups.select(*[F.col(c).alias(f"left_{c}") for c in groups.columns])
    right = groups.select(*[F.col(c).alias(f"right_{c}") for c in groups.columns])
    same = F.col("left_gid") == F.col("right_gid")
    ordered = (F.col("left_tokens") != F.col("right_tokens")) | (F.col("left_layer") <= F.col("right_layer"))
    pairs = (
        set_pairs.filter(F.col("left_tokens") <= F.col("right_tokens"))
        .join(left, "left_tokens").join(right, "right_tokens").filter(ordered)
        .withColumn(
            "table_pairs",
            F.when(same, F.expr("left_members * (left_members - 1) div 2")).otherwise(
                F.col("left_members") * F.col("right_members")
            ),
        )
        .filter(F.col("table_pairs") > 0)
    )
    return pairs.select(
        F.array_join("left_tokens", " ").alias("left_tokens"), "left_layer",
        F.array_join("right_tokens", " ").alias("right_tokens"), "right_layer",
        F.col("left_members"), F.col("right_members"), "table_pairs",
        F.col("similarity"),
        F.round(F.least(F.lit(0.9), F.lit(0.4) + F.col("similarity")), 3).alias("confidence"),
        names.layer_direction(F.col("left_layer"), F.col("right_layer")).alias("direction"),
    )


def _similar_sets(token_sets: DataFrame, focus: DataFrame | None, min_similarity: float) -> DataFrame:
    """Pairs <left_tokens, right_tokens, similarity> of similar token sets, in both orders.

    With ``focus``, some of the sets, only pairs with one of them on the left are built.
    """
    frequency = token_sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    ranked = (
        token_sets.select("tokens", F.explode("tokens").alias("token"))
        .join(frequency, "token")
        .groupBy("tokens")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("order"))
    )
    n, t, eps = F.size("tokens"), F.lit(min_similarity), F.lit(1e-9)
    partners = F.sequence(F.ceil(n * t - eps).cast("int"), F.floor(n / t + eps).cast("int"))
    needed = F.ceil((n + F.col("other")) * t / (t + 1) - eps).cast("int")
    prefix = (
        ranked.withColumn("other", F.explode(partners))
        .withColumn("mine", n)
        .select("tokens", "mine", "other", F.explode(F.slice("order", F.lit(1), n - needed + 1)).alias("t"))
        .select("tokens", "mine", "other", F.col("t.token").alias("token"))
    )
    mine = prefix if focus is None else prefix.join(focus.select("tokens"), "tokens", "left_semi")
    a = mine.select(F.col("tokens").alias("left_tokens"), "mine", "other", "token")
    b = prefix.select(
        F.col("tokens").alias("right_tokens"), F.col("other").alias("mine"), F.col("mine").alias("other"), "token"
    )
    shared = F.size(F.array_intersect("left_tokens", "right_tokens"))
    either = F.size(F.array_union("left_tokens", "right_tokens"))
    return (
        a.join(b, ["token", "mine", "other"])
        .select("left_tokens", "right_tokens")
        .distinct()
        .withColumn("similarity", shared / either)
        .filter(F.col("similarity") >= min_similarity)
    )


#: Tables of one name that meet others as one row; bounds what a row holds.
NAME_BLOCK = 2048


def similar_tables(assets: DataFrame, focus: DataFrame | None = None, min_similarity: float = 0.4, columns: DataFrame | None = None, block: int = NAME_BLOCK) -> DataFrame:
    """Table edges between all similarly named tables, or with ``focus`` <id> those that touch one of its tables.

    The edges are quadratic in the tables of one name. Tables of one name and side of the layers are dealt to blocks of about ``block``
    tables, and two blocks meet as one row: pairs of blocks are dealt evenly over the tasks, and each task lists its edges
    without holding them. Confidence and direction are those of a pair of blocks.

    With ``columns`` only those of the edges whose tables share a column name (a few more, if hashes of names collide). Tables then meet by
    name and column name together, so that the many that share no column are never paired.
    """
    named = assets.where("id is not null").select("id", names.name_tokens(F.col("fqn")).alias("tokens"), names.name_layer(F.col("fqn")).alias("layer"))
    own = named.filter(F.size("tokens") > 0).groupBy("id").agg(F.collect_set(F.struct("tokens", "layer")).alias("names"))
    chosen = F.lit(True)
    if focus is not None:
        own, chosen = own.join(focus.select("id", F.lit(True).alias("focus")).distinct(), "id", "left"), F.col("focus").isNotNull()
    member, seen = materialize_observed(
        own.select("id", F.size("names").alias("n"), chosen.alias("focus"), F.inline("names")), "named-tables", most=F.max("n"))
    sets = _similar_sets(member.select("tokens").distinct(), None if focus is None else member.where("focus").select("tokens").distinct(), min_similarity)
    sets = sets.select("left_tokens", "right_tokens", F.round(F.least(F.lit(0.9), F.lit(0.4) + F.col("similarity")), 3).alias("confidence"))
    pairs = _pairs_of_blocks(member, sets, block) if columns is None else _pairs_by_column(member, sets, columns)
    least, greatest = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    edges = pairs.select(
        F.when(F.col("turn") == 1, F.col("left_id")).when(F.col("turn") == -1, F.col("right_id")).otherwise(least).alias("upstream_id"),
        F.when(F.col("turn") == 1, F.col("right_id")).when(F.col("turn") == -1, F.col("left_id")).otherwise(greatest).alias("downstream_id"),
        "confidence",
        F.lit("ai_inferred").alias("transform_type"),
        F.lit("ai_inferred").alias("source"),
    )
    # Only a table of several names, or several shared columns, can make an edge twice; else the edges, far more than tables, need no shuffle.
    return edges.distinct() if columns is not None or (seen["most"] or 0) > 1 else edges


def _turn(left_layer, right_layer):
    """1 when left feeds right, -1 the other way, 0 when the lower id feeds the other."""
    way = names.layer_direction(F.col(left_layer), F.col(right_layer))
    return F.when(way == "forward", 1).when(way == "backward", -1).otherwise(0).alias("turn")


def _pairs_of_blocks(member: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Pairs <left_id, right_id, confidence, turn> of the tables of similar names, of which one is in the focus, each once."""
    side = F.when(F.col("layer").isin(names.UPSTREAM_LAYERS), 1).when(F.col("layer").isin(names.DOWNSTREAM_LAYERS), -1).otherwise(0)
    member, group = member.withColumn("side", side), ["tokens", "side", "focus"]
    dealt = member.join(member.groupBy(*group).agg(F.count("*").alias("tables")), group).groupBy(
        *group, F.pmod(F.xxhash64("id"), F.ceil(F.col("tables") / block)).alias("part"))
    # The layers of a side all have one direction, so any of them stands for it.
    blocks = materialize(
        dealt.agg(F.collect_set("id").alias("ids"), F.min("layer").alias("layer")).withColumn("no", F.monotonically_increasing_id()), "name-blocks")

    def end(prefix, *taken):
        return blocks.select(*[F.col(c).alias(f"{prefix}_{c}") for c in taken])

    met = (
        sets.join(end("left", "tokens", "no", "layer", "focus").where("left_focus"), "left_tokens")
        .join(end("right", "tokens", "no", "layer", "focus"), "right_tokens")
        # Two blocks of the focus meet from both sides; one of these is kept.
        .filter(~F.col("right_focus") | (F.col("left_no") <= F.col("right_no")))
        .select("left_no", "right_no", "confidence", _turn("left_layer", "right_layer"))
    )
    # A row of few bytes is much work: dealt by number, which adaptive execution does not merge.
    met = spread(met.join(end("left", "no", "ids"), "left_no").join(end("right", "no", "ids"), "right_no"))
    listed = met.withColumn("left_id", F.explode("left_ids")).withColumn("right_id", F.explode("right_ids"))
    apart = F.when(F.col("left_no") == F.col("right_no"), F.col("left_id") < F.col("right_id")).otherwise(F.col("left_id") != F.col("right_id"))
    return listed.filter(apart)


def _pairs_by_column(member: DataFrame, sets: DataFrame, columns: DataFrame) -> DataFrame:
    """Of the pairs of tables of similar names those that share a column name, once for each."""
    left = member.where("focus").select(F.col("id").alias("left_id"), F.col("tokens").alias("left_tokens"), F.col("layer").alias("left_layer"))
    right = member.select(F.col("id").alias("right_id"), F.col("tokens").alias("right_tokens"), F.col("layer").alias("right_layer"), F.col("focus").alias("right_focus"))
    # Numbers stand for the sets of tokens where one row of each column travels.
    numbered = materialize(member.select(F.col("tokens").alias("right_tokens")).distinct().withColumn("_set", F.monotonically_increasing_id()), "name-sets")
    hashes = columns.where("name is not null and table_id is not null").select("table_id", F.hash("name").alias("_hash")).distinct()
    left = sets.join(left, "left_tokens").join(numbered, "right_tokens").drop("left_tokens", "right_tokens").join(hashes.withColumnRenamed("table_id", "left_id"), "left_id")
    right = right.join(numbered, "right_tokens").drop("right_tokens").join(hashes.withColumnRenamed("table_id", "right_id"), "right_id")
    # Two tables of the focus meet from both sides; one of these is kept.
    apart = (F.col("left_id") < F.col("right_id")) | ((F.col("left_id") != F.col("right_id")) & ~F.col("right_focus"))
    return left.join(right, ["_set", "_hash"]).filter(apart).withColumn("turn", _turn("left_layer", "right_layer"))


#: Letters of the phrases that one automaton is built from; more phrases take more automata and passes.
PHRASE_LETTERS = 4_000_000


def contained_phrases(texts: DataFrame, phrases: DataFrame, letters: int = PHRASE_LETTERS, best: int | None = None) -> DataFrame:
    """Which of the phrases each text contains: the first column of ``texts`` and ``phrase``, once each.

    An automaton with failure links over all phrases runs over each text in one pass, where the text lies; no text
    is shuffled. It is built once per worker, from phrases whose letters are counted first. Beyond ``letters`` the phrases are dealt by
    their order to several automata, each of which passes over the texts. Null and empty phrases are in no text.

    With ``best``, phrases are <phrase, id, term, score> and the result has term_id, term and score instead: of each text
    the ``best`` terms of each automaton by score, term and id. What is best of several automata or texts is among them.
    """
    spark, (key, text) = texts.sparkSession, texts.columns
    wanted = phrases.select("phrase") if best is None else phrases.select("phrase", "id", "term", "score")
    known = materialize(wanted.where("phrase <> ''").distinct(), "phrases")
    groups = max(1, -(-(known.agg(F.sum(F.length("phrase"))).first()[0] or 0) // letters))
    # Dealt by hash: groups of about the same number of letters.
    dealt = known.withColumn("group", F.pmod(F.xxhash64("phrase"), F.lit(groups)))
    kind = texts.schema[key].dataType.simpleString()
    out = None
    for group in range(groups):
        mine = dealt.where(F.col("group") == group).drop("group")
        if best is None:
            found, schema = sorted(r.phrase for r in mine.collect()), f"{key} {kind}, phrase string"
            run = _finder(spark.sparkContext.broadcast(found))
        else:
            # In Spark's own order, so that tasks compare places in it.
            found, schema = mine.orderBy(F.desc("score"), "term", "id").collect(), f"{key} {kind}, place int"
            places: dict[tuple, int] = {}
            entries: dict[str, list[int]] = {}
            for r in found:
                entries.setdefault(r.phrase, []).append(places.setdefault((r.id, r.term, r.score), len(places)))
            run = _ranker(spark.sparkContext.broadcast((entries, [p[:2] for p in places], best)))
        if not found:
            continue
        part = texts.where(F.col(text).isNotNull()).mapInArrow(run, schema)
        if best is not None:
            types = {c: known.schema[c].dataType.simpleString() for c in ("id", "term", "score")}
            listed = spark.createDataFrame(
                [(at, *p) for p, at in places.items()], f"place int, term_id {types['id']}, term {types['term']}, score {types['score']}")
            part = part.join(F.broadcast(listed), "place").drop("place")
        out = part if out is None else out.unionByName(part)
    if out is not None:
        return out
    none = texts.select(key).limit(0)
    if best is None:
        return none.withColumn("phrase", F.lit(""))
    return none.crossJoin(known.limit(0).select(F.col("id").alias("term_id"), "term", "score"))


def _finder(sent):
    def hits(automaton, text):
        return {word for _, word in automaton.iter(text)}

    return _passing(lambda: sent.value, hits, "phrase", pa.string())


def _ranker(sent):
    def hits(automaton, text):
        entries, owner, best = sent.value
        first: dict = {}
        for at in sorted({at for word in {word for _, word in automaton.iter(text)} for at in entries[word]}):
            first.setdefault(owner[at], at)
            if len(first) == best:
                break
        return first.values()

    return _passing(lambda: sent.value[0], hits, "place", pa.int32())


def _passing(words, hits, name, kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word in words():
            automaton.add_word(word, word)
        automaton.make_automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part, at, found = batch.slice(start, 512), [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    own = hits(automaton, text)
                    at += [i] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(found, kind)],
                                                 [part.schema.field(0).name, name])

    return run


def glossary_matches(assets: DataFrame, terms: DataFrame, min_confidence: float = 0.55, best: int = 3, letters: int = PHRASE_LETTERS) -> DataFrame:
    """Terms contained in a table's name and description, best three per table.

    Scores: term name 0.7, synonym 0.65, whole token 0.6.
    """
    text = F.concat_ws(" ", F.lower("fqn"), F.lower(F.coalesce("description", F.lit(""))))
    base = assets.select(F.col("id").alias("table_id"), text.alias("text"))
    phrases = (
        terms.select("id", F.col("name").alias("term"), F.lower("name").alias("phrase"), F.lit(0.7).alias("score"))
        .union(
            terms.select(
                "id", F.col("name"), F.explode("synonyms").alias("s"), F.lit(0.65)
            ).select("id", "name", F.lower("s"), F.lit(0.65))
        )
        .filter(F.col("phrase") != "")
    )
    # A whole-token hit (0.6) is also a contained hit, so it never decides the score.
    # Dealt by table once, and only the best of each text; the ranking that follows needs no other shuffle.
    hits = contained_phrases(base, phrases, letters, best).repartition("table_id")
    scored = hits.groupBy("table_id", "term_id", "term").agg(F.max("score").alias("confidence"))
    w = Window.partitionBy("table_id").orderBy(F.desc("confidence"), "term", "term_id")
    return (
        scored.withColumn("rank", F.row_number().over(w))
        .filter((F.col("rank") <= best) & (F.col("confidence") >= min_confidence))
        .select("table_id", "term_id", "term", "confidence")
    )


def unowned(assets: DataFrame, owners: DataFrame) -> DataFrame:
    """Tables without a verified owner."""
    verified = owners.filter("is_verified").select(F.col("table_id").alias("id"))
    return assets.join(verified, "id", "left_anti")


def with_any_edge(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables that are an end of some table edge."""
    ends = edges.select(F.col("upstream_id").alias("id")).union(edges.select(F.col("downstream_id").alias("id")))
    return assets.join(ends, "id", "left_semi")


def failed_results(results: DataFrame, rules: DataFrame, assets: DataFrame, since, until=None, service: str = "") -> DataFrame:
    """Failed rule results with their rule and table inside a time window."""
    recent = results.filter(~F.col("passed") & (F.col("created_at") >= F.lit(since)))
    if until is not None:
        recent = recent.filter(F.col("created_at") <= F.lit(until))
    out = recent.join(
        rules.select("rule_id", "table_id", F.col("name").alias("rule"), "severity"), "rule_id"
    ).join(assets.select(F.col("id").alias("table_id"), F.col("fqn").alias("table_fqn")), "table_id")
    return out.filter(F.startswith("table_fqn", F.lit(service + "."))) if service else out


def column_lineage_of(column_edges: DataFrame, assets: DataFrame, columns: DataFrame, table_id, column: str | None = None) -> DataFrame:
    """In- and out-edges of one table, or of one of its columns, with names and types."""
    t = F.lit(table_id)
    into, out_of = F.col("downstream_id") == t, F.col("upstream_id") == t
    incoming = column_edges.filter(into).withColumn("direction", F.lit("upstream"))
    outgoing = column_edges.filter(out_of).withColumn("direction", F.lit("downstream"))
    edges = incoming.unionByName(outgoing)

    def side(prefix):
        cols = columns.select(
            F.col("id").alias(f"{prefix}_column_id"), F.col("name").alias(f"{prefix}_column"),
            F.col("data_type").alias(f"{prefix}_data_type"),
        )
        tables = assets.select(F.col("id").alias(f"{prefix}_id"), F.col("fqn").alias(f"{prefix}_fqn"))
        return cols, tables

    uc, ut = side("upstream")
    dc, dt = side("downstream")
    full = (
        edges.drop("upstream_col", "downstream_col")
        .join(uc, "upstream_column_id", "left").join(dc, "downstream_column_id", "left")
        .join(ut, "upstream_id", "left").join(dt, "downstream_id", "left")
    )
    if column is None:
        return full
    return full.filter(
        ((F.col("direction") == "upstream") & (F.col("downstream_column") == column))
        | ((F.col("direction") == "downstream") & (F.col("upstream_column") == column))
    )
