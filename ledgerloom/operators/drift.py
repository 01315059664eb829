"""Schemas that drift between the files of a feed.

Every payload becomes a path-value map: one row per field with its raw JSON type and its raw text. Statistics by
(feed, file, field, type) give the schema of each file; comparing a file with the one before it gives the changes;
following the renames gives one name per field, under which typed columns are projected and failed casts reported.

Defined results: payloads that are null, empty, cut off or no JSON object carry no fields (they are counted in the
report); repeated rows count once; a file without a well-formed record has an empty schema; ties between two equally
good rename partners go to the pair with more equal facts, then by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.durable import durable

#: Share of a claim's comparable facts that must agree for two names to be one field.
RENAME_SHARE = 0.5
#: The JSON types that are one type for the reader.
_TYPE = """CASE WHEN t = 'VOID' THEN 'null' WHEN t = 'BOOLEAN' THEN 'boolean' WHEN t = 'STRING' THEN 'string'
 WHEN t LIKE 'ARRAY%' THEN 'list' WHEN t LIKE 'OBJECT%' THEN 'object' ELSE 'number' END"""
#: Parts of an object that describe the fact rather than being it.
_DESCRIBING = ("confidence", "currency", "unit", "score")


def path_values(raw: DataFrame) -> DataFrame:
    """(feed_id, file_no, claim_id, field_name, json_type, value): one row per field of each well-formed record.

    The wrapper "fields" is opened; fields beside claim_id are taken as they stand. claim_id itself is no field.
    """
    members = raw.sparkSession.tvf.variant_explode
    rows = raw.select("raw_id", "feed_id", "file_no", "payload").distinct().select("raw_id", "feed_id", "file_no", F.try_parse_json("payload").alias("v")).where("v IS NOT NULL AND schema_of_variant(v) LIKE 'OBJECT%'")
    keys = ["raw_id", "feed_id", "file_no", F.try_variant_get("v", "$.claim_id", "string").alias("claim_id")]
    outer = rows.lateralJoin(members(F.col("v").outer())).where("key <> 'claim_id'").select(*keys, F.col("key").alias("k"), F.col("value").alias("x"))
    wrapped = outer.where("k = 'fields' AND schema_of_variant(x) LIKE 'OBJECT%'")
    inner = wrapped.lateralJoin(members(F.col("x").outer())).where("key <> 'claim_id'").select("raw_id", "feed_id", "file_no", "claim_id", F.col("key").alias("k"), F.col("value").alias("x"))
    fields = outer.where("k <> 'fields'").unionByName(inner)
    return fields.withColumn("t", F.expr("schema_of_variant(x)")).select(
        "raw_id",
        "feed_id",
        "file_no",
        "claim_id",
        F.col("k").alias("field_name"),
        F.expr(_TYPE).alias("json_type"),
        F.expr("CASE WHEN t LIKE 'ARRAY%' OR t LIKE 'OBJECT%' THEN to_json(x) ELSE CAST(x AS STRING) END").alias("value"),
    )


def type_statistics(paths: DataFrame) -> DataFrame:
    """(feed_id, file_no, field_name, json_type, cells): how often each field has each type in each file."""
    return paths.groupBy("feed_id", "file_no", "field_name", "json_type").agg(F.count(F.lit(1)).alias("cells"))


def _leaves(kind: Column, value: Column) -> Column:
    """The scalars of a value: itself, the members of a list, the members of an object that aren't describing it."""
    numbers = F.from_json(value, "array<string>")
    as_date = F.when(
        (F.size(numbers) == 3) & value.rlike(r"^\[\d{4},\d{1,2},\d{1,2}\]$"),
        F.array(F.concat(F.get(numbers, F.lit(0)), F.lit("-"), F.lpad(F.get(numbers, F.lit(1)), 2, "0"), F.lit("-"), F.lpad(F.get(numbers, F.lit(2)), 2, "0"))),
    )
    members = F.map_values(F.map_filter(F.from_json(value, "map<string,string>"), lambda k, _: ~F.lower(k).isin(*_DESCRIBING)))
    return F.when(kind == "list", F.coalesce(as_date, numbers)).when(kind == "object", members).otherwise(F.array(value))


def _fact(leaf: Column) -> Column:
    """One way of writing for one fact: ISO dates, plain numbers, truth values, folded text; null for no fact."""
    text = F.lower(F.trim(leaf))
    day_first = F.regexp_extract(text, r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$", 0)
    iso = F.coalesce(
        F.try_to_timestamp(F.when(day_first != "", F.regexp_replace(text, r"[./-]", "/")), F.lit("d/M/yyyy")).cast("date"),
        F.try_to_timestamp(F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text), F.lit("y-M-d")).cast("date"),
        F.try_to_timestamp(F.when(text.rlike(r"^(19|20)\d{6}$"), text), F.lit("yyyyMMdd")).cast("date"),
    )
    plain = F.regexp_replace(text, r"[,\s]", "")
    number = F.when(text.rlike(r"^-?[\d,]+(\.\d+)?(e[+-]?\d+)?$") & plain.rlike(r"\d"), plain.try_cast("double"))
    truth = F.when(text.isin("true", "yes", "y"), F.lit("n:1.0")).when(text.isin("false", "no", "n"), F.lit("n:0.0"))
    return F.when(text.rlike(r"[0-9\p{L}]"), F.coalesce(F.concat(F.lit("d:"), iso.cast("string")), F.concat(F.lit("n:"), number.cast("string")), truth, F.concat(F.lit("s:"), text)))


def file_schemas(paths: DataFrame) -> DataFrame:
    """(feed_id, file_no, field_name, main_type): main_type is the commonest non-null type (ties: by name), null if all are null."""
    order = Window.partitionBy("feed_id", "file_no", "field_name").orderBy(F.col("filled").desc(), "json_type")
    return (
        type_statistics(paths)
        .withColumn("filled", F.when(F.col("json_type") == "null", 0).otherwise(F.col("cells")))
        .withColumn("rank", F.row_number().over(order))
        .where("rank = 1")
        .select("feed_id", "file_no", "field_name", F.when(F.col("json_type") != "null", F.col("json_type")).alias("main_type"))
    )


def schema_changes(raw: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """(feed_id, file_no, field_name, change_kind, old_name): every change of a file against the one before it."""
    paths = durable(path_values(raw)) if paths is None else paths
    files = raw.select("feed_id", "file_no").where("feed_id IS NOT NULL AND file_no IS NOT NULL").distinct()
    # Each of the small tables below is read several times; written once, no branch works it out again.
    files = durable(files.withColumn("before", F.lag("file_no").over(Window.partitionBy("feed_id").orderBy("file_no"))).where("before IS NOT NULL"))
    schemas = durable(file_schemas(paths))
    new = files.join(schemas, ["feed_id", "file_no"]).select("feed_id", "file_no", "field_name", F.col("main_type").alias("new_type"))
    old = files.join(schemas.withColumnRenamed("file_no", "before"), ["feed_id", "before"]).select("feed_id", "file_no", "field_name", F.col("main_type").alias("old_type"), F.lit(True).alias("was"))
    both = durable(new.withColumn("is", F.lit(True)).join(old, ["feed_id", "file_no", "field_name"], "full"))
    gone = both.where("is IS NULL").select("feed_id", "file_no", F.col("field_name").alias("old_name"))
    come = both.where("was IS NULL").select("feed_id", "file_no", F.col("field_name").alias("new_name"))
    retyped = both.where("is AND was AND new_type <> old_type").select("feed_id", "file_no", "field_name", F.lit("retyped").alias("change_kind"), F.lit(None).cast("string").alias("old_name"))

    # Facts of going and coming fields only; the join is by claim within one pair of files.
    filled = paths.where("json_type <> 'null' AND claim_id IS NOT NULL")
    facts = filled.select("feed_id", "file_no", "claim_id", "field_name", F.array_distinct(F.array_compact(F.transform(_leaves(F.col("json_type"), F.col("value")), _fact))).alias("facts")).where(F.size("facts") > 0)
    going = facts.withColumnsRenamed({"file_no": "before", "field_name": "old_name", "facts": "old_facts"}).join(files, ["feed_id", "before"]).join(gone, ["feed_id", "file_no", "old_name"]).drop("before")
    coming = facts.withColumnsRenamed({"field_name": "new_name", "facts": "new_facts"}).join(come, ["feed_id", "file_no", "new_name"])
    pairs = (
        going.join(coming, ["feed_id", "file_no", "claim_id"])
        .groupBy("feed_id", "file_no", "old_name", "new_name")
        .agg(F.count(F.lit(1)).alias("claims"), F.count_if(F.arrays_overlap("old_facts", "new_facts")).alias("equal"))
        .where((F.col("equal") > 0) & (F.col("equal") >= RENAME_SHARE * F.col("claims")))
        .withColumn("share", F.col("equal") / F.col("claims"))
    )
    best = [F.col("share").desc(), F.col("equal").desc(), F.levenshtein(F.lower("old_name"), F.lower("new_name")), "old_name", "new_name"]
    mutual = (
        pairs.withColumn("by_old", F.row_number().over(Window.partitionBy("feed_id", "file_no", "old_name").orderBy(*best)))
        .withColumn("by_new", F.row_number().over(Window.partitionBy("feed_id", "file_no", "new_name").orderBy(*best)))
        .where("by_old = 1 AND by_new = 1")
        .select("feed_id", "file_no", "old_name", "new_name")
    )
    mutual = durable(mutual)
    renamed = mutual.select("feed_id", "file_no", F.col("new_name").alias("field_name"), F.lit("renamed").alias("change_kind"), "old_name")
    added = come.join(mutual, ["feed_id", "file_no", "new_name"], "left_anti").select("feed_id", "file_no", F.col("new_name").alias("field_name"), F.lit("added").alias("change_kind"), F.lit(None).cast("string").alias("old_name"))
    removed = gone.join(mutual, ["feed_id", "file_no", "old_name"], "left_anti").select("feed_id", "file_no", F.col("old_name").alias("field_name"), F.lit("removed").alias("change_kind"), F.lit(None).cast("string").alias("old_name"))
    return renamed.unionByName(added).unionByName(removed).unionByName(retyped)


#: Distinct field names are schema, not data; more than this many means the payloads use data as keys.
MAX_NAMES = 20_000


def unified_names(changes: DataFrame, paths: DataFrame) -> dict[str, str]:
    """Each field name to the name of its group, following renames over all feeds; the commonest name stands for a group.

    Only distinct names reach the driver, and their number is checked against MAX_NAMES. A rename counts if at least a
    tenth of the feeds in which the old name goes agree on it, so that one chance match joins no groups.
    """
    edges = changes.where("change_kind = 'renamed'").groupBy("old_name", "field_name").agg(F.count_distinct("feed_id").alias("n"))
    total = edges.groupBy("old_name").agg(F.sum("n").alias("all"))
    edges = edges.join(total, "old_name").where("n >= 0.1 * all").select("old_name", "field_name", "n").limit(MAX_NAMES + 1).collect()
    names = paths.groupBy("field_name").count().limit(MAX_NAMES + 1).collect()
    if max(len(edges), len(names)) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} field names: payload keys hold data")
    weight = {r["field_name"]: r["count"] for r in names}
    parent = {n: n for n in weight}
    # Ways of writing one name (policyNumber, policy_number) are one field without any rename.
    written: dict[str, str] = {}
    for n in sorted(weight, key=lambda n: (-weight[n], n)):
        parent[n] = written.setdefault("".join(c for c in n.lower() if c.isalnum()) or n, n)

    def root(n: str) -> str:
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for e in sorted(edges, key=lambda e: (-e["n"], e["old_name"], e["field_name"])):
        a, b = root(e["old_name"]), root(e["field_name"])
        if a != b:
            keep, drop = sorted((a, b), key=lambda n: (-weight[n], n))
            parent[drop] = keep
    return {n: root(n) for n in weight}


def unified_cells(raw: DataFrame) -> DataFrame:
    """(raw_id, feed_id, file_no, claim_id, field_name, raw_name, json_type, value, main_kind, value_text, value_number, value_whole, value_date, cast_failed).

    main_kind is what most non-null cells of the unified field are: date, whole, number, boolean or text; numbers are
    whole if all cells of the field that are numbers are, so that long ids keep their digits. A cell whose fact is of
    another kind keeps its raw value, has null typed values and cast_failed.
    """
    paths = durable(path_values(raw))
    names = unified_names(schema_changes(raw, paths), paths)
    if not names:
        names = {"": ""}
    mapping = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    cells = paths.withColumn("raw_name", F.col("field_name")).withColumn("field_name", F.try_element_at(mapping, F.col("raw_name")))
    leaves = _leaves(F.col("json_type"), F.col("value"))
    facts = F.array_compact(F.transform(leaves, _fact))
    cells = cells.withColumn("facts", F.when(F.col("json_type") != "null", facts)).withColumn("first", F.get("facts", F.lit(0)))
    kind = F.when(F.col("json_type") == "boolean", "boolean").when(F.col("first").startswith("d:"), "date").when(F.col("first").startswith("n:"), "number").when(F.col("first").isNotNull(), "text")
    whole = F.regexp_replace(F.get(F.filter(leaves, lambda x: _fact(x).isNotNull()), F.lit(0)), r"[,\s]", "").try_cast("bigint")
    cells = cells.withColumn("kind", kind).withColumn("whole", F.when(F.col("kind") == "number", whole))
    order = Window.partitionBy("field_name").orderBy(F.col("n").desc(), "main_kind")
    counted = cells.where("kind IS NOT NULL").groupBy("field_name", F.col("kind").alias("main_kind")).agg(F.count(F.lit(1)).alias("n"), F.every(F.col("whole").isNotNull()).alias("all_whole"))
    kinds = counted.withColumn("r", F.row_number().over(order)).where("r = 1").select("field_name", F.when(F.col("all_whole"), "whole").otherwise(F.col("main_kind")).alias("main_kind"))
    cells = cells.join(kinds, "field_name", "left")
    main = F.col("main_kind")
    ok = (main == "text") | (F.col("kind") == main) | ((main == "whole") & F.col("whole").isNotNull()) | ((main == "boolean") & F.col("first").isin("n:1.0", "n:0.0"))
    typed = lambda k, c: F.when((main == k) & ok, c)
    number = F.substring("first", 3, 40).try_cast("double")
    return cells.select(
        "raw_id",
        "feed_id",
        "file_no",
        "claim_id",
        "field_name",
        "raw_name",
        "json_type",
        "value",
        "main_kind",
        F.when(main == "text", F.array_join(F.transform("facts", lambda f: F.substring(f, 3, 2_147_483_647)), "; ")).alias("value_text"),
        F.coalesce(typed("number", number), typed("boolean", number)).alias("value_number"),
        typed("whole", F.col("whole")).alias("value_whole"),
        typed("date", F.substring("first", 3, 10).try_cast("date")).alias("value_date"),
        ((F.col("json_type") != "null") & ~F.coalesce(ok, F.lit(False))).alias("cast_failed"),
    )


#: More fields than this make no table that anyone could use; unified_cells has them as rows.
MAX_COLUMNS = 2_000
#: The typed value and the column type of each kind.
_KINDS = {"text": ("value_text", "string"), "number": ("value_number", "double"), "boolean": ("value_number", "boolean"), "whole": ("value_whole", "bigint"), "date": ("value_date", "date")}


def typed_table(raw: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(raw_id, feed_id, file_no, claim_id, failed_casts, one typed column a unified field): one row per exported record.

    Where a record has a field more than once, under several raw names, the value counts that could be cast, then the one
    under the unified name, then the first by raw name. Records without any field are not in the table. The columns'
    names are the unified names; one that clashes with a key gets "field_" before it.
    """
    cells = durable(unified_cells(raw)) if cells is None else cells
    fields = cells.groupBy("field_name").agg(F.max("main_kind").alias("kind")).orderBy("field_name").limit(MAX_COLUMNS + 1).collect()
    if len(fields) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} fields; use unified_cells")
    keys = ["raw_id", "feed_id", "file_no", "claim_id"]
    # Fixed order of preference; min() keeps the best, combined before the shuffle.
    rank = F.struct(F.col("cast_failed"), (F.col("raw_name") != F.col("field_name")).alias("other"), "raw_name")
    columns = []
    for f in fields:
        value, kind = _KINDS[f["kind"] or "text"]
        name = f["field_name"] if f["field_name"] not in (*keys, "failed_casts") else f"field_{f['field_name']}"
        mine = (F.col("field_name") == f["field_name"]) & F.col(value).isNotNull()
        columns.append(F.min(F.when(mine, F.struct(rank.alias("rank"), F.col(value).alias("v"))))["v"].cast(kind).alias(name))
    return cells.groupBy(*keys).agg(F.count_if("cast_failed").alias("failed_casts"), *columns)


def consistent_table(raw: DataFrame) -> DataFrame:
    """(raw_id, feed_id, file_no, claim_id, cells MAP<name, text>, failed_casts): the same rows for any number of fields.

    Which value of a field that a record has more than once counts is as in typed_table.
    """
    keys = ["raw_id", "feed_id", "file_no", "claim_id"]
    cell = F.coalesce(F.col("value_date").cast("string"), F.col("value_whole").cast("string"), F.col("value_number").cast("string"), F.col("value_text"))
    rank = F.struct(F.col("cast_failed"), (F.col("raw_name") != F.col("field_name")).alias("other"), "raw_name")
    one = unified_cells(raw).withColumn("cell", cell).groupBy(*keys, "field_name").agg(F.min_by("cell", rank).alias("cell"), F.count_if("cast_failed").alias("failed"))
    entries = F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("field_name", "cell")))
    return one.groupBy(*keys).agg(F.map_from_entries(F.array_sort(entries)).alias("cells"), F.sum("failed").alias("failed_casts"))


def cast_report(cells: DataFrame) -> DataFrame:
    """(field_name, main_kind, raw_name, json_type, cells, failed, example): what of each field could not be cast, with an example."""
    failed = F.when(F.col("cast_failed"), F.col("value"))
    return cells.groupBy("field_name", "main_kind", "raw_name", "json_type").agg(F.count(F.lit(1)).alias("cells"), F.count_if("cast_failed").alias("failed"), F.min(failed).alias("example"))
