"""Raw JSON pages: each file holds a list of objects or one object.

Files are read whole because a page is one JSON document; the scan is parallel over
files. A file that does not parse is reported, never fatal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierlift.functions.clean import clean_string, strict_flag_variant, truthy_variant


# Key names of the raw record format.
@dataclass(frozen=True)
class RecordFields:
    entity_id: str = "user_id"
    handle: str = "username"
    display_name: str = "public_name"
    region: str = "country"
    locality: str = "city"
    rate: str = "hourlyrate"
    metric: str = "total_earnings"
    reputation: str = "freelancer_reputation"
    event_count: str = "no_reviews"
    stars: str = "stars"
    score: str = "score"
    location: str = "location"
    latitude: str = "lat"
    longitude: str = "lon"
    items: str = "skills"
    item_id: str = "skill_id"
    item_name: str = "skill_name"
    item_flag: str = "is_user_skill"
    profile: str = "user_profile"
    tagline: str = "tagline"
    children: str = "portfolios"
    child_title: str = "title"
    child_description: str = "description"


FIELDS = RecordFields()

# Keys removed from a record before it is stored.
UNUSED_KEYS = [
    "hidden", "penalty", "penalty_status", "exams", "pool_ids", "custom_fields", "idx",
    "is_online", "rating_stars", "rating_stars_width", "earnings_display", "logo_url",
    "profile_logo", "flag_icon", "flag_name", "membership_badge", "is_sponsored",
    "is_hilighted", "invited", "profile_url", "rating_stars_count", "eh_stars",
    "eh_no_reviews",
]


# A variant holds at most this many bytes.
PAGE_LIMIT = 128 << 20


def read_pages(spark: SparkSession, path: str | list[str], glob: str = "*") -> DataFrame:
    """One row per file: ``file`` (orders arrivals lexicographically) and parsed ``doc``.

    NaN and infinity literals are read, and of a repeated key the last value counts. A file that
    does not parse has a null ``doc``; a page too large for a variant is an error.
    """
    return parsed_pages(spark, spark.read, path, pathGlobFilter=glob)


def parsed_pages(spark: SparkSession, reader, path: str | list[str], **options) -> DataFrame:
    """Pages through a batch or a stream reader."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    # The text of a file that does not parse; files may be compressed, so their size says little.
    found = (
        reader.format("json").schema("doc variant, _corrupt_record string")
        .option("multiLine", True).option("singleVariantColumn", "doc")
        .option("recursiveFileLookup", True).options(**options).load(path))
    size = F.octet_length("_corrupt_record")
    too_large = F.raise_error(F.concat(F.lit("page too large: "), F.col("_metadata.file_path")))
    return found.select(
        F.col("_metadata.file_path").alias("file"),
        F.when(size > F.lit(PAGE_LIMIT), too_large.cast("variant"))
        .otherwise(F.col("doc")).alias("doc"))


def bad_files(pages: DataFrame) -> DataFrame:
    """Files that hold no valid JSON document."""
    return pages.where(F.col("doc").isNull()).select("file")


def file_counts(pages: DataFrame) -> DataFrame:
    return pages.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("doc").isNull()).alias("malformed_files"),
    )


def explode_records(pages: DataFrame) -> DataFrame:
    """``(file, pos, rec)`` for every JSON object; elements of other kinds are skipped."""
    listed = F.try_variant_get("doc", "$", "array<variant>")
    elements = F.coalesce(listed, F.array(F.col("doc")))
    return (
        pages.where(F.col("doc").isNotNull())
        .select("file", F.posexplode(elements).alias("pos", "rec"))
        .where(is_object(F.col("rec")))
    )


def is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def type_records(raw: DataFrame, fields: RecordFields = FIELDS,
                 python_truthy: bool = True) -> DataFrame:
    """Flatten ``rec`` into named columns, still uncleaned strings, plus nested arrays."""
    rec = F.col("rec")

    def text(key: str) -> Column:
        return F.try_variant_get(rec, f"$.{key}", "string")

    def structs(key: str, shape: str) -> Column:
        """An array of objects in one typed read; elements of other kinds are null."""
        found = F.try_variant_get(rec, f"$.{key}", f"array<struct<{shape}>>")
        return F.coalesce(found, F.array().cast(f"array<struct<{shape}>>"))

    flag = truthy_variant if python_truthy else strict_flag_variant
    raw_items = structs(fields.items, f"{fields.item_id}: string, {fields.item_name}: string, "
                                      f"{fields.item_flag}: variant")
    raw_children = structs(
        fields.children, f"{fields.child_title}: string, {fields.child_description}: string")
    items = F.transform(F.filter("_items", lambda s: s.isNotNull()), lambda s: F.struct(
        s[fields.item_id].alias("item_id"),
        clean_string(s[fields.item_name]).alias("item_name"),
        flag(s[fields.item_flag]).alias("explicit")))
    children = F.transform("_children", lambda p: F.struct(
        p[fields.child_title].alias("title"), p[fields.child_description].alias("description")))
    scalars = ["handle", "display_name", "region", "locality", "rate", "metric",
               "reputation", "event_count", "stars", "score", "profile", "tagline"]
    # The arrays are read in a step of their own, so once for all that uses them.
    read = raw.select(
        "file", "pos",
        clean_string(text(fields.entity_id)).alias("entity_id"),
        *[text(getattr(fields, s)).alias(s) for s in scalars],
        text(f"{fields.location}.{fields.latitude}").alias("latitude"),
        text(f"{fields.location}.{fields.longitude}").alias("longitude"),
        raw_items.alias("_items"), raw_children.alias("_children"),
    )
    return read.select(
        *[c for c in read.columns if c not in ("_items", "_children")],
        items.alias("items"),
        F.size("_items").cast("bigint").alias("n_items"),
        children.alias("children"),
    )


def json_fields(raw: DataFrame) -> DataFrame:
    """Top-level keys of every record with their values as JSON text."""
    return raw.select(
        F.transform_values(
            F.try_variant_get("rec", "$", "map<string,variant>"),
            lambda _, v: F.coalesce(F.to_json(v), F.lit("null")),
        ).alias("fields"))
