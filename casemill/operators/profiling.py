"""Column profiling.

Most figures come from one long table (column, value, n): every row turns into one pair per column
and partial aggregation folds the pairs before the shuffle. Type and date patterns then run once per
distinct value instead of once per row, and a hot value is one pair per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from casemill.functions.numbers import count_when, round_to, share
from casemill.functions.quantiles import quantiles_of_counts
from casemill.functions.severity import null_severity
from casemill.functions.text import similarity_ratio, strip
from casemill.operators.statistics import iqr_outliers
from casemill.schema import CATEGORICAL_LIMIT, IQR_FENCE, MIN_GROUP, SIMILARITY, TYPE_SHARE
from casemill.session import durable

# Words read as booleans, and the shapes read as dates.
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "si", "verdadero", "falso")
DATE_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2})?)?$",
    r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{4}$",
    r"^\d{1,2}[/\-]\d{1,2}[/\-]\d{2}$",
    r"^\d{1,2}\.\d{1,2}\.\d{4}$",
    r"^\d{4}[/\-]\d{1,2}[/\-]\d{1,2}$",
)
NUMBER_SHAPE = r"(?i)^[+-]?((\d+(_\d+)*)?\.?(\d+(_\d+)*)([eE][+-]?\d+)?|(\d+(_\d+)*)\.([eE][+-]?\d+)?|inf|infinity|nan)$"

# Recognised date formats, in the order they are tried.
DATE_FORMATS = (
    "%Y-%m-%d",
    "%Y-%m-%dT%H:%M:%S",
    "%Y-%m-%d %H:%M:%S",
    "%Y-%m-%dT%H:%M",
    "%Y-%m-%d %H:%M",
    "%d/%m/%Y",
    "%d/%m/%Y %H:%M:%S",
    "%d/%m/%Y %H:%M",
    "%m/%d/%Y",
    "%m/%d/%Y %H:%M:%S",
    "%m/%d/%Y %H:%M",
    "%d.%m.%Y",
    "%d.%m.%Y %H:%M:%S",
    "%d-%m-%Y",
    "%d-%m-%Y %H:%M:%S",
)
NATIVE_DATES = "native_datetime"
SAMPLE_SIZE = 10

_NUMERIC = (T.NumericType,)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


# Types whose values are equal exactly where their texts are.
_SAME_AS_TEXT = ("tinyint", "smallint", "int", "bigint", "date", "boolean", "string")


def column_values(df: DataFrame, columns: Sequence[str] | None = None, stored: bool = False) -> DataFrame:
    """(column_name, value, n) over the given columns, values as text, null included.

    ``stored`` tells that ``df`` is a stored table: each column is then read alone and counted in its own type, and only
    distinct values are turned into text.
    """
    names = list(columns or df.columns)
    if stored:
        kinds = dict(df.dtypes)
        parts = []
        for c in names:
            value = F.col(f"`{c}`") if kinds[c] in _SAME_AS_TEXT else F.col(f"`{c}`").cast("string")
            counted = df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))
            parts.append(counted.select(F.lit(c).alias("column_name"), F.col("value").cast("string").alias("value"), "n"))
        return reduce(DataFrame.unionByName, parts)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in names]
    )
    return df.select(F.inline(pairs)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def null_stats(df: DataFrame) -> DataFrame:
    """Nulls per column, one pass without a shuffle of rows."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(f"`{c}`").alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("present")) for c in df.columns])
    return counted.select("_n", F.inline(pairs)).select(
        "column_name",
        (F.col("_n") - F.col("present")).alias("null_count"),
        F.coalesce(round_to(share(F.col("_n") - F.col("present"), F.col("_n")), 2), F.lit(0.0)).alias(
            "null_percentage"
        ),
        F.col("_n").alias("total_count"),
    )


def duplicate_report(df: DataFrame, id_column: str = "case_id") -> DataFrame:
    """One row: rows, distinct non-null ids, rows beyond them. Null ids raise the duplicate count."""
    return _repeats(df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n")), id_column)


def _repeats(per_id: DataFrame, id_column: str) -> DataFrame:
    """The duplicate report of (id, n)."""
    present = F.col(id_column).isNotNull()
    row = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        count_when(present).alias("distinct_identifiers"),
        count_when(present & (F.col("n") > 1)).alias("repeated_identifiers"),
    )
    extra = F.col("total_records") - F.col("distinct_identifiers")
    return row.select(
        "total_records",
        "distinct_identifiers",
        extra.alias("duplicate_count"),
        F.coalesce(round_to(share(extra, F.col("total_records")), 2), F.lit(0.0)).alias("duplication_rate"),
        "repeated_identifiers",
    )


def duplicate_ids(df: DataFrame, id_column: str = "case_id") -> DataFrame:
    """Ids that occur more than once, with their row counts, sorted."""
    return (
        df.where(F.col(id_column).isNotNull())
        .groupBy(id_column)
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("count") > 1)
        .orderBy(id_column)
    )


def value_kind(text: Column) -> Column:
    """Kind of one text value: boolean, numeric, datetime or string; null for a blank one."""
    bare = strip(text)
    dates = reduce(lambda a, b: a | b, [bare.rlike(shape) for shape in DATE_SHAPES])
    return (
        F.when(F.length(bare) == 0, F.lit(None).cast("string"))
        .when(F.lower(bare).isin(*BOOLEAN_WORDS), F.lit("boolean"))
        .when(F.regexp_replace(bare, ",", ".").rlike(NUMBER_SHAPE), F.lit("numeric"))
        .when(dates, F.lit("datetime"))
        .otherwise(F.lit("string"))
    )


def _native_kind(data_type: T.DataType) -> str | None:
    if isinstance(data_type, _NUMERIC):
        return "numeric"
    if isinstance(data_type, _TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    return None


_KINDS = ("boolean", "numeric", "datetime", "string")


def infer_types(
    df: DataFrame, values: DataFrame | None = None, categorical_limit: int = CATEGORICAL_LIMIT
) -> DataFrame:
    """Semantic type per column: the kind held by at least 80 % of the non-blank values, else mixed.

    Text with fewer than ``categorical_limit`` distinct values is categorical.
    """
    values = column_values(df) if values is None else values
    known = F.lit(None).cast("string")
    for kind in ("numeric", "datetime", "boolean"):
        names = [f.name for f in df.schema.fields if _native_kind(f.dataType) == kind]
        if names:
            known = F.when(F.col("column_name").isin(names), F.lit(kind)).otherwise(known)
    present = F.col("value").isNotNull()
    counted = (
        values.withColumn("_kind", F.when(present, F.coalesce(known, value_kind(F.col("value")))))
        .groupBy("column_name")
        .agg(
            count_when(present).alias("distinct_count"),
            *[F.coalesce(F.sum(F.when(F.col("_kind") == k, F.col("n"))), F.lit(0)).alias(f"_{k}") for k in _KINDS],
        )
        .withColumn("_all", sum((F.col(f"_{k}") for k in _KINDS), F.lit(0)))
    )
    pct = {k: F.col(f"{k}_pct") for k in _KINDS}
    shares = counted.withColumns(
        {f"{k}_pct": F.coalesce(round_to(share(F.col(f"_{k}"), F.col("_all")), 2), F.lit(0.0)) for k in _KINDS}
    ).withColumn("confidence", F.greatest(*pct.values()))
    leader = F.lit(None).cast("string")
    for k in reversed(_KINDS):
        leads = (pct[k] == F.col("confidence")) & (pct[k] >= TYPE_SHARE * 100)
        leader = F.when(leads, F.lit(k)).otherwise(leader)
    lead = F.col("_leader")
    inferred = (
        F.when(F.col("_all") == 0, F.lit("unknown"))
        .when(lead.isNull(), F.lit("mixed"))
        .when((lead == "string") & (F.col("distinct_count") < categorical_limit), F.lit("categorical"))
        .when(lead == "string", F.lit("text"))
        .otherwise(lead)
    )
    return (
        shares.withColumn("_leader", leader)
        .select("column_name", inferred.alias("inferred_type"), "confidence", "distinct_count", *[f"{k}_pct" for k in _KINDS])
        .orderBy("column_name")
    )


def _date_parts(fmt: str) -> tuple[str, str]:
    """Shape (a regular expression) and Spark pattern of a ``strptime`` format."""
    shapes = {"%Y": r"\d{4}", "%m": r"\d{1,2}", "%d": r"\d{1,2}", "%H": r"\d{1,2}", "%M": r"\d{1,2}", "%S": r"\d{1,2}"}
    fields = {"%Y": "yyyy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s"}
    shape, pattern = fmt.replace(".", r"\."), fmt.replace("T", "'T'")
    for token in shapes:
        shape = shape.replace(token, shapes[token])
        pattern = pattern.replace(token, fields[token])
    return f"^{shape}$", pattern


def _bare_date(text: Column) -> Column:
    return F.regexp_replace(strip(text), r"\s+", " ")


def date_format_of(bare: Column) -> Column:
    """First recognised format a trimmed value parses with, null when none does."""
    found = F.lit(None).cast("string")
    for fmt in reversed(DATE_FORMATS):
        shape, pattern = _date_parts(fmt)
        fits = bare.rlike(shape) & F.try_to_timestamp(bare, F.lit(pattern)).isNotNull()
        found = F.when(fits, F.lit(fmt)).otherwise(found)
    return found


def validate_dates(df: DataFrame, column: str, samples: int = SAMPLE_SIZE) -> DataFrame:
    """One row: how many values of a column are dates, in which formats, and the first ``samples`` that are not."""
    native = isinstance(df.schema[column].dataType, _TEMPORAL)
    values = column_values(df, [column]).where(F.col("value").isNotNull())
    found = F.lit(NATIVE_DATES) if native else date_format_of(F.col("_bare"))
    dated = values.withColumn("_bare", _bare_date(F.col("value"))).withColumn("fmt", found)
    bad = F.col("fmt").isNull()
    total = F.coalesce(F.sum("n"), F.lit(0))
    invalid = F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0))
    summary = dated.agg(
        total.alias("total_count"),
        (total - invalid).alias("valid_count"),
        invalid.alias("invalid_count"),
        F.coalesce(round_to(share(invalid, total), 2), F.lit(0.0)).alias("invalid_percentage"),
        # At most one entry per known format.
        F.sort_array(F.collect_set("fmt")).alias("recognized_formats"),
    )
    shown = dated.where(bad).select("value").orderBy("value").limit(samples)
    listed = shown.agg(F.sort_array(F.collect_list("value")).alias("sample_invalid_values"))
    return summary.crossJoin(F.broadcast(listed)).select(  # one row of at most ``samples`` values
        F.lit(column).alias("column_name"), *summary.columns, "sample_invalid_values"
    )


def _similar_pairs(names: DataFrame, ratio: float) -> DataFrame:
    """Edges (a, b) between names (g, v) of one set g with at least the given Levenshtein ratio.

    No all-pairs comparison: when two strings differ by at most k edits, one of k + 1 segments of the
    shorter occurs in the longer one, moved by at most k places. Both sides emit their segments as
    keys of an equi-join, and only pairs that share a key are compared. k follows from the ratio:
    (1 - ratio) x longer length.
    """

    def edits(length: str) -> str:
        return f"cast(floor({1.0 - ratio!r} * {length} + 1e-9) as int)"

    base = names.select("g", "v", F.length("v").alias("len"))
    # Segment i of a string of length len cut into k + 1 parts starts at i * len / (k + 1).
    start = "cast(floor(i * len / (k + 1.0)) as int)"
    stop = "cast(floor((i + 1) * len / (k + 1.0)) as int)"
    longest = f"greatest(len, cast(floor(len * {1.0 / ratio!r} + 1e-9) as int))"
    indexed = (
        base.withColumn("lb", F.explode(F.expr(f"sequence(len, {longest})")))
        .withColumn("k", F.expr(edits("lb")))
        .withColumn("i", F.explode(F.expr("sequence(0, k)")))
        .select(
            "g",
            F.col("v").alias("x"),
            F.col("len").alias("la"),
            "lb",
            "i",
            F.expr(f"substring(v, {start} + 1, {stop} - {start})").alias("piece"),
        )
    )
    shortest = f"least(lb, cast(ceil({ratio!r} * lb - 1e-9) as int))"
    places = "sequence(greatest(0, s - k), greatest(greatest(0, s - k), least(s + k, lb - w)))"
    probes = (
        base.select("g", "v", F.col("len").alias("lb"))
        .withColumn("len", F.explode(F.expr(f"sequence({shortest}, lb)")))
        .withColumn("k", F.expr(edits("lb")))
        .withColumn("i", F.explode(F.expr("sequence(0, k)")))
        .withColumn("s", F.expr(start))
        .withColumn("w", F.expr(f"{stop} - {start}"))
        .withColumn("at", F.explode(F.expr(places)))
        .select(
            "g",
            F.col("v").alias("y"),
            F.col("len").alias("la"),
            "lb",
            "i",
            F.expr("substring(v, at + 1, w)").alias("piece"),
        )
        .distinct()
    )
    met = indexed.join(probes, ["g", "la", "lb", "i", "piece"]).where(
        (F.col("la") < F.col("lb")) | (F.col("x") < F.col("y"))
    )
    close = similarity_ratio(F.col("x"), F.col("y")) >= ratio
    return (
        met.select("g", "x", "y")
        .distinct()
        .where(close)
        .select(F.struct("g", F.col("x").alias("v")).alias("a"), F.struct("g", F.col("y").alias("v")).alias("b"))
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of undirected edges (a, b); the component is its smallest node.

    Labels shrink to the smallest neighbour label and then jump to their label's label, so the number
    of rounds grows with the logarithm of a component's diameter. Each round is written to the shared
    folder, which cuts the lineage.
    """
    both = durable(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select(
        "node", F.least("node", "_b").alias("component")
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        lower = labels.join(near, "node").select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("old")
        )
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = durable(
            lower.join(jump, "component", "left").select(
                "node", F.least("component", F.coalesce("root", "component")).alias("component"), "old"
            )
        )
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("old")).isEmpty():
            return labels


_BLOCK = 500


def _group_scores(members: DataFrame) -> DataFrame:
    """Mean similarity over all pairs of a group, without making a row per pair.

    Members go into blocks of bounded size; two blocks meet in one row, whose distances are summed by
    a nested array expression.
    """
    ranked = members.withColumn(
        "_block", F.floor((F.row_number().over(Window.partitionBy("component").orderBy("v")) - 1) / _BLOCK)
    )
    blocks = ranked.groupBy("component", "_block").agg(F.collect_list("v").alias("vs"))  # at most _BLOCK values
    other = blocks.select("component", F.col("_block").alias("_other"), F.col("vs").alias("ws"))
    met = blocks.join(other, "component").where(F.col("_block") <= F.col("_other"))

    def row_sum(total: Column, v: Column) -> Column:
        return total + F.aggregate("ws", F.lit(0.0), lambda t, w: t + similarity_ratio(v, w))

    raw = F.aggregate("vs", F.lit(0.0), row_sum)
    same = F.col("_block") == F.col("_other")
    total = F.when(same, (raw - F.size("vs")) / 2.0).otherwise(raw)
    n = F.sum(F.when(same, F.size("vs"))).cast("double")
    return met.groupBy("component").agg((F.sum(total) / (n * (n - 1.0) / 2.0)).alias("score"))


def _similar_names(values: DataFrame, ratio: float) -> DataFrame:
    """Groups of near-equal names inside each set: (g, component, value, score) from distinct (g, value)."""
    originals = durable(values.withColumn("v", F.lower(strip(F.col("value")))))
    labels = connected_components(_similar_pairs(originals.select("g", "v").distinct(), ratio))
    node = F.struct("g", "v")
    grouped = originals.withColumn("node", node).join(labels, "node", "left").select(
        F.coalesce("component", "node").alias("component"), "g", "value", "v"
    )
    sizes = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") > 1)
    members = grouped.join(sizes, "component")
    return members.join(_group_scores(members.select("component", "v")), "component").select(
        "g", F.col("component.v").alias("component"), "value", "score"
    )


def similar_values(df: DataFrame, column: str, ratio: float = SIMILARITY) -> DataFrame:
    """Groups of near-equal category names: (component, value, similarity_score), groups of two or more."""
    distinct = (
        df.where(F.col(column).isNotNull())
        .select(F.lit(column).alias("g"), F.col(column).cast("string").alias("value"))
        .distinct()
    )
    return (
        _similar_names(distinct, ratio)
        .select("component", "value", round_to(F.col("score"), 4).alias("similarity_score"))
        .orderBy("component", "value")
    )


def dataset_metrics(
    df: DataFrame,
    id_column: str = "case_id",
    values: DataFrame | None = None,
    types: DataFrame | None = None,
) -> DataFrame:
    """One row: size, filled cells, mean type confidence and duplication rate."""
    if values is not None and dict(df.dtypes).get(id_column) in _SAME_AS_TEXT:
        per_id = values.where(F.col("column_name") == id_column).select(F.col("value").alias(id_column), "n")
        repeats = _repeats(per_id, id_column).select("duplication_rate")
    else:
        repeats = duplicate_report(df, id_column).select("duplication_rate")
    values = column_values(df) if values is None else values
    columns = len(df.columns)
    nulls = values.agg(
        (F.sum("n") / columns).cast("long").alias("total_record_count"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("_nulls"),
    )
    confidence = (infer_types(df, values) if types is None else types).agg(F.avg("confidence").alias("_confidence"))
    cells = F.col("total_record_count") * columns
    return (
        nulls.crossJoin(F.broadcast(confidence)).crossJoin(F.broadcast(repeats))  # one row each
        .select(
            F.coalesce("total_record_count", F.lit(0)).alias("total_record_count"),
            F.lit(columns).cast("long").alias("total_column_count"),
            F.coalesce(round_to(share(cells - F.col("_nulls"), cells), 2), F.lit(0.0)).alias(
                "overall_completeness_pct"
            ),
            F.coalesce(round_to(F.col("_confidence"), 2), F.lit(100.0)).alias("overall_validity_pct"),
            "duplication_rate",
        )
    )


def profile_columns(
    df: DataFrame, values: DataFrame | None = None, types: DataFrame | None = None, categorical_limit: int = CATEGORICAL_LIMIT
) -> DataFrame:
    """One row per column: semantic type, nulls, distinct values, outliers, bad dates, null severity.

    Outliers are counted for numeric columns, bad dates for datetime columns, and similar names for
    categorical columns (only groups of at least five names are listed; ``categorical_limit`` tells up to how many
    distinct values a column is one, where ``types`` are not given). ``values`` and ``types``, if
    given, are read several times and should be stored results.
    """
    values = durable(column_values(df)) if values is None else values
    types = durable(infer_types(df, values, categorical_limit)) if types is None else types
    kinds = {r["column_name"]: r["inferred_type"] for r in types.select("column_name", "inferred_type").collect()}
    present = F.col("value").isNotNull()
    nulls = values.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_count"), F.sum("n").alias("_rows")
    )
    numbers = [c for c, k in kinds.items() if k == "numeric"]
    dates = [c for c, k in kinds.items() if k == "datetime" and not isinstance(df.schema[c].dataType, _TEMPORAL)]
    numeric = values.where(F.col("column_name").isin(numbers or [""]) & present)
    outliers = _outliers_of_values(numeric)
    bad_dates = (
        values.where(F.col("column_name").isin(dates or [""]) & present)
        .withColumn("_bare", _bare_date(F.col("value")))
        .where(date_format_of(F.col("_bare")).isNull())
        .groupBy("column_name")
        .agg(F.sum("n").alias("invalid_date_count"))
    )
    categorical = [c for c, k in kinds.items() if k == "categorical"]
    names = values.where(F.col("column_name").isin(categorical or [""]) & present)
    groups = (
        _similar_names(names.select(F.col("column_name").alias("g"), "value"), SIMILARITY)
        .groupBy(F.col("g").alias("column_name"), "component")
        .agg(F.sort_array(F.collect_list("value")).alias("names"))  # fewer names than the limit of a categorical column
        .where(F.size("names") >= MIN_GROUP)
        .groupBy("column_name")
        .agg(F.to_json(F.sort_array(F.collect_list("names"))).alias("similar_groups"))
    )
    profile = (
        types.join(nulls, "column_name")
        .join(outliers, "column_name", "left")
        .join(bad_dates, "column_name", "left")
        .join(groups, "column_name", "left")
    )
    pct = share(F.col("null_count"), F.col("_rows"))
    return profile.select(
        "column_name",
        F.col("inferred_type").alias("data_type"),
        "null_count",
        round_to(pct, 2).alias("null_percentage"),
        F.col("distinct_count").alias("unique_count"),
        F.coalesce("outlier_count", F.lit(0)).alias("outlier_count"),
        F.coalesce("invalid_date_count", F.lit(0)).alias("invalid_date_count"),
        F.coalesce("similar_groups", F.lit("[]")).alias("similar_groups"),
        null_severity(pct).alias("severity"),
    ).orderBy("column_name")


def _outliers_of_values(values: DataFrame) -> DataFrame:
    """Outlier rows per column from (column_name, value, n)."""
    number = F.replace(strip(F.col("value")), F.lit(","), F.lit(".")).try_cast("double")
    # Stored, since a filter over the expression would read each text several times. Texts of one number stay apart:
    # neither quantiles nor sums need them together.
    read = durable(values.select("column_name", number.alias("v"), "n"))
    counts = read.where(F.col("v").isNotNull() & ~F.isnan("v"))
    fences = quantiles_of_counts(counts, {"q1": 0.25, "q3": 0.75}, ("column_name",), few_groups=True)
    iqr = F.col("q3") - F.col("q1")
    outside = (iqr != 0) & (
        (F.col("v") < F.col("q1") - IQR_FENCE * iqr) | (F.col("v") > F.col("q3") + IQR_FENCE * iqr)
    )
    return (
        counts.join(F.broadcast(fences), "column_name")  # one row per column
        .where(outside)
        .groupBy("column_name")
        .agg(F.sum("n").alias("outlier_count"))
    )


__all__ = [
    "column_values",
    "connected_components",
    "dataset_metrics",
    "duplicate_ids",
    "duplicate_report",
    "infer_types",
    "iqr_outliers",
    "null_stats",
    "profile_columns",
    "similar_values",
    "validate_dates",
]
