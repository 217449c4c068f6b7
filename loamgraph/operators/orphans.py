"""References to records that do not exist, are deleted, or arrive later.

A reference is a tuple of columns that may be partly null. Distinct references
are grouped by their null mask; each mask is looked up on its non-null columns
only, under a declared match rule:

``simple``   a reference with any null column refers to nothing and is never an orphan;
``full``     all null refers to nothing, partly null is an orphan by itself;
``exact``    all null refers to nothing, otherwise a null agrees with a null only;
``partial``  all null refers to nothing, otherwise some key must agree in the non-null columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from loamgraph.operators.ids import qname, read_context, split_qname
from loamgraph.runtime import join_checked, materialize, table

MATCHES = ("simple", "full", "exact", "partial")


def resolve_references(refs: DataFrame, ref_cols: list[str], keys: DataFrame, key_cols: list[str], match: str = "full", facts: dict | None = None) -> DataFrame:
    """``refs`` plus ``found`` (null where the tuple refers to nothing) and the aggregated ``facts`` of its keys.

    ``facts`` maps an output name to an aggregate over ``keys`` (for example the
    least load time). Per mask the orphans are those that an anti-join on its
    non-null columns leaves; the others take their facts from the keys they meet.
    Nulls follow ``match``; repeated keys are one key; repeated reference rows are
    kept; empty tables give no matches or no rows. Columns of ``keys`` never reach
    the output except through ``facts``, so names may clash. Only masks that some
    row has are joined; ``refs`` and ``keys`` are read once a mask, so give tables.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}, not {match!r}")
    if len(ref_cols) != len(key_cols) or not ref_cols:
        raise ValueError("ref_cols and key_cols must pair up")
    facts = facts or {}
    n, everything = len(ref_cols), (1 << len(ref_cols)) - 1
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f"`{c}`").isNull(), F.lit(1 << i)).otherwise(0) for i, c in enumerate(ref_cols)])
    marked = refs.withColumn("__mask", mask)
    present = {r[0] for r in marked.select("__mask").distinct().collect()}  # at most 2 ** n
    parts, types = [], None
    for m in sorted(present | {0}):
        rows = marked.where(F.col("__mask") == m).drop("__mask")
        use = [i for i in range(n) if not m >> i & 1]
        if m == everything or (m and match == "simple"):
            parts.append((rows, None))
        elif m and match == "full":
            parts.append((rows, False))
        else:
            known = [f"__k{i}" for i in use]
            side = keys
            for i in range(n):
                if match != "partial" or i in use:
                    side = side.where(F.col(f"`{key_cols[i]}`").isNotNull() if i in use else F.col(f"`{key_cols[i]}`").isNull())
            side = side.select([F.col(f"`{key_cols[i]}`").alias(f"__k{i}") for i in use] + [F.col(f"`{c}`").alias(f"__f_{c}") for c in _inputs(facts)])
            side = side.groupBy(*known).agg(F.lit(True).alias("found"), *[a(side, "__f_").alias(k) for k, a in facts.items()])
            cond = reduce(lambda a, b: a & b, [rows[f"`{ref_cols[i]}`"] == side[f"__k{i}"] for i in use])
            met = rows.join(side, cond).drop(*known)
            types = dict(met.dtypes)
            parts += [(met, True), (rows.join(side, cond, "left_anti"), False)]
    out = []
    for p, kind in parts:
        if kind is not True:
            p = p.withColumn("found", F.lit(kind).cast("boolean"))
            for k in facts:
                p = p.withColumn(k, F.lit(None).cast(types[k]))
        out.append(p.select(*[f"`{c}`" for c in refs.columns], "found", *facts))
    return reduce(DataFrame.unionByName, out)


def _inputs(facts: dict) -> list[str]:
    return sorted({c for a in facts.values() for c in a.reads})


def fact(fn, column: str):
    """An aggregate ``fn`` over one key column, for ``resolve_references``."""

    def build(side: DataFrame, prefix: str):
        return fn(side[f"{prefix}{column}"])

    build.reads = (column,)
    return build


REASONS = ("missing", "later", "deleted")


def _records(df: DataFrame, context, deleted: bool) -> DataFrame:
    """One row a record: its QName parts, least load time and deletion time."""
    gone = F.min("deleted_at") if deleted else F.lit(None).cast("timestamp")
    per_id = df.groupBy(F.col("_id").alias("id")).agg(F.min("loaded_at").cast("timestamp").alias("first_loaded"), gone.cast("timestamp").alias("deleted_at"))
    ns, local = split_qname(qname(F.col("id"), context))
    return per_id.select(ns.alias("ns"), local.alias("local"), "first_loaded", "deleted_at")


def _reasons(found, first_loaded, deleted_at, when):
    """The reasons that hold for a reference made at ``when``; several may."""
    return F.array_compact(
        F.array(
            F.when(~found, F.lit("missing")),
            F.when(found & (first_loaded > when), F.lit("later")),
            F.when(found & (deleted_at <= when), F.lit("deleted")),
        )
    )


_FACTS = {"first_loaded": fact(F.min, "first_loaded"), "deleted_at": fact(F.min, "deleted_at")}


def orphan_references(reports: DataFrame, imports: DataFrame, individuals: DataFrame, observations: DataFrame, context: DataFrame) -> DataFrame:
    """Every reference of reports and import errors that was not there at its time.

    An id is a prefix and a local part; an id without a prefix is a whole id too, so
    nulls agree with nulls only (``exact``). The heavy side is never joined on its
    (skewed) target beyond a lookup of written forms: distinct forms are resolved
    first, and the reports are then brought together once, by record id, which gives
    each record its first load, its doubtful references and whether an import error
    names it. Null, blank and 'unknown' targets are no references. Empty tables give
    missing references or none.
    """
    ctx = read_context(context)
    reports = reports.select("_id", "bold_animal", F.col("loaded_at").cast("timestamp").alias("loaded_at"))

    # Distinct written forms, and the reasons that any delivery of them could have.
    forms = reports.where("bold_animal is not null").groupBy("bold_animal").agg(F.min("loaded_at").alias("least"))
    forms = forms.withColumn("target_id", qname(F.col("bold_animal"), ctx)).where("length(target_id) > 0")
    ns, local = split_qname(F.col("target_id"))
    forms = materialize(forms.withColumns({"ns": ns, "local": local, "form": F.monotonically_increasing_id()}))  # every null mask reads it
    people = materialize(_records(individuals, ctx, True))
    resolved = resolve_references(forms, ["ns", "local"], people, ["ns", "local"], "exact", _FACTS).where("found is not null")
    # A record's first load may be earlier than the delivery that names the target.
    earliest = forms.agg(F.min("least")).first()[0]
    suspect = resolved.where(~F.col("found") | (F.col("first_loaded") > F.lit(earliest)) | F.col("deleted_at").isNotNull())
    suspect = materialize(suspect.select("bold_animal", "form", "target_id", "found", "first_loaded", "deleted_at"))

    # Import errors: few runs with lists of very different length.
    runs = imports.select("run_id", F.col("finished_at").cast("timestamp").alias("finished_at"), "errors")
    first = runs.groupBy("run_id").agg(F.min("finished_at").alias("finished_at"))
    wanted = runs.select("run_id", F.explode("errors").alias("e")).select("run_id", qname(F.col("e.resource"), ctx).alias("target_id"))
    wanted = wanted.where("length(target_id) > 0 and target_id <> 'unknown'").distinct().join(first, "run_id")
    ns, local = split_qname(F.col("target_id"))
    wanted = materialize(wanted.withColumns({"ns": ns, "local": local}))
    named = materialize(wanted.select(F.col("target_id").alias("__named"), F.lit(True).alias("named")).distinct())

    # One exchange by record id; what travels is an id, a time and the number of a form.
    rows = join_checked(reports, suspect.select("bold_animal", "form"), ["bold_animal"], "left").select("_id", "loaded_at", "form")
    record = W.Window.partitionBy("_id")
    rows = rows.where("_id is not null").withColumn("first_seen", F.min("loaded_at").over(record)).withColumn("id", qname(F.col("_id"), ctx))
    rows = join_checked(rows, named, F.col("id") == F.col("__named"), "left").where("form is not null or named")
    rows = materialize(rows.dropDuplicates(["_id", "form"]).select("_id", "id", "form", "first_seen", "named"))

    doubtful = join_checked(rows.where("form is not null"), suspect.drop("bold_animal"), ["form"])
    from_reports = doubtful.select(
        F.lit("tracking_report").alias("ref_table"),
        F.col("_id").alias("record_id"),
        "target_id",
        F.explode(_reasons(F.col("found"), F.col("first_loaded"), F.col("deleted_at"), F.col("first_seen"))).alias("reason"),
        F.date_format("first_seen", "yyyy-MM").alias("ref_month"),
    )

    ns, local = split_qname(F.col("id"))
    known = rows.where("named").select(ns.alias("ns"), local.alias("local"), F.col("first_seen").alias("first_loaded"), F.lit(None).cast("timestamp").alias("deleted_at"))
    known = known.unionByName(people).unionByName(_records(observations, ctx, False))
    looked = resolve_references(wanted, ["ns", "local"], known, ["ns", "local"], "exact", _FACTS)
    from_imports = looked.where("found is not null").select(
        F.lit("import_result").alias("ref_table"),
        F.col("run_id").alias("record_id"),
        "target_id",
        F.explode(_reasons(F.col("found"), F.col("first_loaded"), F.col("deleted_at"), F.col("finished_at"))).alias("reason"),
        F.date_format("finished_at", "yyyy-MM").alias("ref_month"),
    )
    return from_reports.distinct().unionByName(from_imports.distinct())


def orphans_of(spark, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    return orphan_references(t("tracking_report"), t("import_result"), t("individual"), t("observation"), t("jsonld_context"))


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, month and reason."""
    return orphans.groupBy("ref_table", "ref_month", "reason").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("target_id").alias("n_targets"))
