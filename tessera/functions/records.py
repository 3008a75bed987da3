"""JSON expressions: cleaning model output, strict and lenient parsing, metadata, dossiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXTRACTION = "struct<entities:array<struct<name:string,type:string,description:string>>,relationships:array<struct<source:string,target:string,type:string,exact_quote:string>>>"
FOUNDERS = "array<struct<name:string,role:string,linkedin_url:string>>"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def clean_json(raw: Column) -> Column:
    """Model output without code fence, outer text and control characters."""

    def inner(text: Column) -> Column:
        return once(F.regexp_extract(text, r"(?s)\{.*\}", 0), lambda found: F.when(found != "", found).otherwise(text))

    text = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", "")
    text = F.trim(F.regexp_replace(text, r"\s*```$", ""))
    return F.regexp_replace(once(text, inner), r"[\x00-\x1f]", "")


def parse_strict(raw: Column) -> Column:
    """The extraction, or null when any record lacks a required field."""
    whole = lambda names: lambda r: F.reduce(F.array(*[r[n].isNotNull() for n in names]), F.lit(True), lambda a, b: a & b)

    def sound(parsed: Column) -> Column:
        fine = F.forall(F.coalesce(parsed["entities"], F.array()), whole(["name", "type"])) & F.forall(
            F.coalesce(parsed["relationships"], F.array()), whole(["source", "target", "type", "exact_quote"])
        )
        return F.when(parsed["entities"].isNotNull() & parsed["relationships"].isNotNull() & fine, parsed)

    return once(F.from_json(clean_json(raw), EXTRACTION), sound)


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def parse_lenient(raw: DataFrame, key: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of all records whose required fields are strings; a missing quote is ''."""
    root = raw.select(key, F.try_parse_json(clean_json(F.col(column))).alias("v"))

    def items(field: str) -> DataFrame:
        found = root.select(key, F.try_variant_get("v", f"$.{field}", "array<variant>").alias("items"))
        return found.select(key, F.explode("items").alias("r"))

    def field(name: str) -> Column:
        value = F.try_variant_get("r", f"$.{name}", "variant")
        return F.when(_is_text(value), F.try_variant_get("r", f"$.{name}", "string"))

    entities = items("entities").select(key, field("name").alias("name"), field("type").alias("type"))
    links = items("relationships").select(key, *[field(n).alias(n) for n in ("source", "target", "type")], F.coalesce(F.try_variant_get("r", "$.exact_quote", "string"), F.lit("")).alias("exact_quote"))
    return entities.where("name IS NOT NULL AND type IS NOT NULL"), links.where("source IS NOT NULL AND target IS NOT NULL AND type IS NOT NULL")


def metadata_field(meta: Column, path: str) -> Column:
    """A field of metadata held as JSON text, also when that text is itself quoted."""
    plain = F.get_json_object(meta, f"$.{path}")
    return F.coalesce(plain, F.get_json_object(F.get_json_object(F.concat(F.lit('{"x":'), meta, F.lit("}")), "$.x"), f"$.{path}"))


def flatten_record(df: DataFrame, column: str, prefix: str = "") -> DataFrame:
    """Nested struct fields as prefixed columns with '' / 0 / [] for nulls; maps and record lists as JSON."""

    def walk(kind: T.StructType, base: str, pre: str) -> list[Column]:
        out = []
        for f in kind.fields:
            value, name = F.col(f"{base}.{f.name}"), f"{pre}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, f"{base}.{f.name}", f"{name}_")
            elif isinstance(f.dataType, T.MapType):
                out.append(F.coalesce(F.to_json(value), F.lit("{}")).alias(f"{name}_json"))
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                out.append(F.coalesce(F.to_json(value), F.lit("[]")).alias(f"{name}_json"))
            elif isinstance(f.dataType, T.ArrayType):
                out.append(F.coalesce(value, F.array().cast(f.dataType)).alias(name))
            elif isinstance(f.dataType, T.StringType):
                out.append(F.coalesce(value, F.lit("")).alias(name))
            else:
                out.append(F.coalesce(value, F.lit(0).cast(f.dataType)).alias(name))
        return out

    return df.select(*[c for c in df.columns if c != column], *walk(df.schema[column].dataType, column, prefix))


def parse_founders(text: Column) -> Column:
    return F.coalesce(F.from_json(text, FOUNDERS), F.array().cast(FOUNDERS))


def parse_scores(text: Column) -> Column:
    return F.from_json(text, "map<string,double>")


def has_field(meta: Column, name: str) -> Column:
    """Whether metadata held as a JSON object has a key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(meta), name), F.lit(False))


def set_field(meta: Column, name: str, value: Column) -> Column:
    """Metadata (a JSON object of texts) with one field set; null metadata is an empty object."""
    held = F.coalesce(F.from_json(meta, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(held, lambda k, _: k != name), F.create_map(F.lit(name), value)))


def iso_time(stamp: Column) -> Column:
    """UTC time as ISO 8601 text; now, if it is null."""
    return F.date_format(F.coalesce(stamp, F.current_timestamp()), "yyyy-MM-dd'T'HH:mm:ss")


def add_once(items: Column, item: Column) -> Column:
    """A list with an item at its end, unless it is there already."""
    held = F.coalesce(items, F.array().cast("array<string>"))
    return F.when(F.array_contains(held, item), held).otherwise(F.array_append(held, item))
