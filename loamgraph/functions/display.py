"""Labels, descriptions, images, dates and group colours as Column expressions."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgraph.operators.timestamps import instant_of
from loamgraph.runtime import numbered

#: Label properties in order, the colours of individuals, the colour of none.
LABEL_PROPERTIES = ("dcterms:title", "foaf:name", "rdfs:label")
DESCRIPTION_PROPERTIES = ("dcterms:description", "skos:definition", "rdfs:comment")
COLOURS = ("#4e79a7", "#f28e2c", "#76b7b2", "#59a14f", "#edc949", "#af7aa1", "#9c755f", "#bab0ab")
NO_GROUP = ("No Group", "#cccccc")
DEFAULT_ZONE = "America/Los_Angeles"


def id_tail(id_: Column) -> Column:
    """What follows the last ``#``, ``/`` or ``:`` of an id."""
    return F.element_at(F.split(id_, "[#/:]"), -1)


def label(id_: Column, *candidates: Column, type_label: Column | None = None, override: Column | None = None) -> Column:
    """The first non-empty of an override and the candidates, else the type's label and the id's tail, else Unknown."""
    given = [F.nullif(c, F.lit("")) for c in ([override] if override is not None else []) + list(candidates)]
    tail = id_tail(id_) if type_label is None else F.concat_ws(" ", type_label, id_tail(id_))
    return F.coalesce(*given, F.when(F.length(id_) > 0, tail), F.lit("Unknown"))


def _filled(values: Column, name: Column) -> Column:
    """The text of a property in a map of JSON values, its first element if it has many; null if there is none."""
    v = F.try_element_at(values, name)
    one = F.when(v.startswith("["), F.get(F.from_json(v, "array<string>"), F.lit(0))).otherwise(v)
    return F.nullif(F.when(one.startswith("{"), F.coalesce(F.get_json_object(one, "$['@value']"), F.get_json_object(one, "$['@id']"))).otherwise(one), F.lit(""))


def first_filled(doc: Column, names: Column) -> Column:
    """struct(property, text) of the first of the named properties that a JSON resource carries; null if it has none."""
    values = F.from_json(doc, "map<string,string>")
    found = F.filter(F.transform(names, lambda n: F.struct(n.alias("property"), _filled(values, n).alias("text"))), lambda s: s["text"].isNotNull())
    return F.get(found, F.lit(0))


def _settings(resources: DataFrame, settings: DataFrame | None) -> DataFrame:
    """``resources`` with what the first of their types that has settings says of labels and descriptions."""
    if settings is None:
        empty = F.lit(None).cast("array<string>")
        return resources.withColumns({"set_label": F.lit(None).cast("string"), "set_labels": empty, "set_descriptions": empty})
    s = settings.select(F.col("class").alias("__class"), F.struct(F.col("label").alias("set_label"), F.col("label_properties").alias("set_labels"), F.col("description_properties").alias("set_descriptions")).alias("__set"))
    each = resources.select(F.col("_id").alias("__id"), F.posexplode("types").alias("__nth", "__class")).join(s, "__class")
    first = each.groupBy("__id").agg(F.min_by("__set", "__nth").alias("__set"))
    return resources.join(first, F.col("_id") == F.col("__id"), "left").select(*resources.columns, "__set.*")


def resource_labels(resources: DataFrame, settings: DataFrame | None = None, type_labels: DataFrame | None = None, resolver: Column | None = None) -> DataFrame:
    """(_id, label, label_property, description, description_property) of resources (_id, types, doc).

    ``settings`` (class, label, label_properties, description_properties) is what the
    schemas of classes say: a label for all, or properties that come before the
    usual ones. A resource without any of the properties takes ``resolver``, else
    the label of its first type, from ``type_labels`` (class, label), and the tail of
    its id, else Unknown. Property columns name the most general one if none is there.
    """
    named = _settings(resources, settings)
    usual = lambda names: F.array(*[F.lit(n) for n in names])
    kind = F.get("types", F.lit(0))
    if type_labels is not None:
        t = type_labels.select(F.col("class").alias("__type"), F.col("label").alias("__type_label"))
        named = named.withColumn("__first", kind).join(t, F.col("__first") == F.col("__type"), "left")
    else:
        named = named.withColumn("__type_label", F.lit(None).cast("string"))
    named = named.withColumn("__l", first_filled(F.col("doc"), F.concat(F.coalesce("set_labels", F.array().cast("array<string>")), usual(LABEL_PROPERTIES))))
    named = named.withColumn("__d", first_filled(F.col("doc"), F.coalesce("set_descriptions", usual(DESCRIPTION_PROPERTIES))))
    tail = F.concat_ws(" ", "__type_label", F.nullif(id_tail(F.col("_id")), F.lit("")))
    fallback = F.coalesce(resolver, F.nullif(tail, F.lit(""))) if resolver is not None else F.nullif(tail, F.lit(""))
    return named.select(
        "_id",
        F.coalesce(F.nullif("set_label", F.lit("")), F.col("__l.text"), fallback, F.lit("Unknown")).alias("label"),
        F.coalesce(F.col("__l.property"), F.lit(LABEL_PROPERTIES[-1])).alias("label_property"),
        F.coalesce(F.col("__d.text"), F.lit("")).alias("description"),
        F.coalesce(F.col("__d.property"), F.element_at(F.coalesce("set_descriptions", usual(DESCRIPTION_PROPERTIES)), -1)).alias("description_property"),
    )


def labels_of_ids(ids: DataFrame, labels: DataFrame) -> DataFrame:
    """(_id, label) of every distinct wanted id: its label, or the id itself where there is no such resource."""
    known = labels.groupBy("_id").agg(F.min("label").alias("label"))
    return ids.select("_id").where("_id is not null").distinct().join(known, "_id", "left").withColumn("label", F.coalesce("label", "_id"))


def grouped(df: DataFrame, group: Column, include_ungrouped: bool = True) -> DataFrame:
    """``df`` with ``group_id``: the group as text, null where it is null, empty, 0 or false; those rows may be left out.

    Rows stay rows, so a group of any size is never gathered.
    """
    text = group.cast("string")
    out = df.withColumn("group_id", F.when(~text.isin("", "0", "0.0", "false"), text))
    return out if include_ungrouped else out.where("group_id is not null")


def first_url(*candidates: Column) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in candidates])


def format_date(ts: Column, zone: str = DEFAULT_ZONE, pattern: str = "M/d/yyyy") -> Column:
    """An instant as wall-clock text in a zone; null gives ''. A trailing ``ZZ`` appends the zone's short name."""
    name = pattern.endswith("ZZ")
    local = F.from_utc_timestamp(ts, zone)
    text = F.date_format(local, pattern[:-2].strip() if name else pattern)
    return F.coalesce(F.concat(text, F.lit(" "), zone_name(ts, zone)) if name else text, F.lit(""))


def format_text_date(value: Column, zone: str = DEFAULT_ZONE, pattern: str = "M/d/yyyy") -> Column:
    """A written date - text of any format of ``timestamps``, a value object, or an epoch - as ``format_date`` gives it.

    Text without a zone is wall-clock time in ``zone``; what names no instant gives ''.
    """
    return format_date(F.timestamp_millis(instant_of(value, zone)), zone, pattern)


def format_date_time(ts: Column, zone: str = DEFAULT_ZONE, pattern: str = "M/d/yyyy h:mm a ZZ") -> Column:
    return format_date(ts, zone, pattern)


#: Short names of zones, standard and summer.
ZONE_NAMES = {"America/Los_Angeles": ("PST", "PDT"), "America/Denver": ("MST", "MDT"), "America/Phoenix": ("MST", "MST"), "America/Chicago": ("CST", "CDT"), "America/New_York": ("EST", "EDT"), "UTC": ("UTC", "UTC"), "Etc/UTC": ("UTC", "UTC"), "Europe/London": ("GMT", "BST")}


def zone_name(ts: Column, zone: str) -> Column:
    """The zone's short name at an instant; ``GMT±h[:mm]`` where it has none."""
    minutes = ((F.unix_seconds(F.from_utc_timestamp(ts, zone)) - F.unix_seconds(ts)) / 60).cast("int")
    if zone in ZONE_NAMES:
        standard, summer = ZONE_NAMES[zone]
        winter = F.unix_seconds(F.to_utc_timestamp(F.make_timestamp(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), zone)) - F.unix_seconds(F.make_timestamp(F.year(ts), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
        return F.when(minutes == -(winter / 60).cast("int"), standard).otherwise(summer)
    rest = F.abs(minutes) % 60
    return F.concat(F.lit("GMT"), F.when(minutes < 0, "-").otherwise("+"), F.floor(F.abs(minutes) / 60).cast("string"), F.when(rest > 0, F.concat(F.lit(":"), F.lpad(rest.cast("string"), 2, "0"))).otherwise(""))


def group_options(df: DataFrame, group: Column, labels: DataFrame | None = None) -> DataFrame:
    """(group_id, label, colour, n): groups in order of id with the colours in turn; rows without a group are ``No Group``.

    ``labels`` is (_id, label). The number of options is the number of groups, which
    is numbered after the count, never the rows.
    """
    counts = df.groupBy(F.nullif(group.cast("string"), F.lit("")).alias("group_id")).agg(F.count(F.lit(1)).alias("n"))
    named = counts.where("group_id is not null")
    colours = F.array(*[F.lit(c) for c in COLOURS])
    named = numbered(named, ["group_id"], "__rank").withColumn("colour", F.element_at(colours, ((F.col("__rank") - 1) % len(COLOURS) + 1).cast("int"))).drop("__rank")
    if labels is not None:
        named = named.join(labels.select(F.col("_id").alias("group_id"), "label"), "group_id", "left")
    else:
        named = named.withColumn("label", F.lit(None).cast("string"))
    named = named.withColumn("label", F.coalesce("label", id_tail(F.col("group_id"))))
    none = counts.where("group_id is null").select("group_id", "n", F.lit(NO_GROUP[1]).alias("colour"), F.lit(NO_GROUP[0]).alias("label"))
    return named.select("group_id", "label", "colour", "n").unionByName(none)


def sunrise_sunset(lng: float, lat: float, day: dt.date) -> tuple[dt.datetime, dt.datetime] | None:
    """Sunrise and sunset in UTC by the public solar equations; None in polar day or night.

    Raises for coordinates out of range.
    """
    if not (-180 <= lng <= 180 and -90 <= lat <= 90):
        raise ValueError(f"no such place: {lng}, {lat}")
    n = day.toordinal() - dt.date(2000, 1, 1).toordinal() + 0.0008
    mean = n - lng / 360
    anomaly = math.radians((357.5291 + 0.98560028 * mean) % 360)
    centre = 1.9148 * math.sin(anomaly) + 0.02 * math.sin(2 * anomaly) + 0.0003 * math.sin(3 * anomaly)
    ecliptic = math.radians((math.degrees(anomaly) + centre + 180 + 102.9372) % 360)
    noon = mean + 0.0053 * math.sin(anomaly) - 0.0069 * math.sin(2 * ecliptic)
    declination = math.asin(math.sin(ecliptic) * math.sin(math.radians(23.4397)))
    cos_hour = (math.sin(math.radians(-0.833)) - math.sin(math.radians(lat)) * math.sin(declination)) / (math.cos(math.radians(lat)) * math.cos(declination))
    if abs(cos_hour) > 1:
        return None
    half = math.degrees(math.acos(cos_hour)) / 360
    epoch = dt.datetime(2000, 1, 1, 12, tzinfo=dt.UTC)
    return epoch + dt.timedelta(days=noon - half), epoch + dt.timedelta(days=noon + half)
