"""Reading result rows and shards. Schemas are always given; a malformed row stops the read."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _I, _L, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
RECT = T.StructType([T.StructField(n, _D) for n in ("x", "y", "width", "height")])

# Fields of a benchmark result row (fixed values). An infinite PSNR is written as text, so it is read as text.
RESULT_ROW = T.StructType([T.StructField(name, kind) for name, kind in (
    ("schema_version", _I), ("row_id", _S), ("corpus_contract_sha256", _S), ("profile_contract_sha256", _S),
    ("attack_matrix_sha256", _S), ("benchmark_plan_sha256", _S), ("seed", T.DecimalType(20, 0)), ("case_seed", T.DecimalType(20, 0)),
    ("fixture_id", _S), ("fixture_kind", _S), ("page_index", _I), ("profile_id", _S), ("candidate_id", _S), ("attack_id", _S),
    ("attack_kind", _S), ("attack_parameters", _S), ("ordered_operations", T.ArrayType(_S)), ("expected_id", _S), ("decoded_id", _S),
    ("reason", _S), ("outcome", _S), ("confidence", _D), ("bit_error_rate", _D), ("valid_vote_count", _I), ("psnr_db", _S), ("ssim", _D),
    ("quality_data_range", _D), ("quality_scope", _S), ("localization_iou", _D), ("tamper_ground_truth", T.ArrayType(RECT)),
    ("elapsed_ms", _D), ("peak_rss_bytes", _L), ("temp_peak_bytes", _L), ("eligible", _B), ("remaining_embedded_tiles", _I),
    ("eligibility_reason", _S), ("limitations", T.ArrayType(_S)))])


def read_results(spark: SparkSession, path: str, schema: T.StructType = RESULT_ROW) -> DataFrame:
    """Result rows of JSON lines; a line that does not fit the schema fails the job instead of vanishing.

    Unknown, missing and repeated members cannot be seen by a schema read; callers that must refuse them use ``read_strict``.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def unknown_members(spark: SparkSession, path: str, schema: T.StructType = RESULT_ROW) -> DataFrame:
    """Members of result lines that the closed schema does not have, with how many lines carry them."""
    names = F.array(*[F.lit(f.name) for f in schema.fields])
    extra = F.array_except(F.json_object_keys("value"), names)
    return spark.read.text(path).select(F.explode(extra).alias("member")).groupBy("member").agg(F.count("*").alias("lines"))


#: How a variant names the kinds of JSON values.
_NUMBER = r"BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)"
_KINDS = {T.StringType: "STRING", T.BooleanType: "BOOLEAN", T.IntegerType: "BIGINT", T.LongType: "BIGINT", T.DoubleType: _NUMBER,
          T.DecimalType: r"BIGINT|DECIMAL\(\d+,0\)"}
#: Members of a result line that are text in the schema but may be something else in the file.
RESULT_KINDS = {"attack_parameters": "STRING|OBJECT<.*>", "psnr_db": f"STRING|{_NUMBER}"}


#: Names of the members of an object, as long as none of them is itself an object, an array or needs quotes.
_FLAT = "[^<>`]*"


def _kind(kind: T.DataType) -> str:
    """Pattern of the variant type a value of this Spark type has; members of an object are neither missing, unknown nor null."""
    if isinstance(kind, T.StructType):
        inner = ", ".join(f"{f.name}: (?:{_kind(f.dataType)})" for f in sorted(kind.fields, key=lambda f: f.name))
        return f"OBJECT<{inner}>"
    return _KINDS[type(kind)]


def _elements_fit(value: Column, kind: T.DataType) -> Column:
    """Whether the elements of a variant have the kind; they are looked at one by one, for together they hide what one lacks."""
    def fits(element: Column) -> Column:
        return F.coalesce(F.schema_of_variant(element).rlike(f"^({_kind(kind)})$"), F.lit(False))

    # Spark compiles no loop over an array, so an array of one element, which needs none, is looked at without.
    first, second = (F.try_variant_get(value, f"$[{n}]", "variant") for n in (0, 1))
    each = F.try_variant_get(value, "$", "array<variant>")
    return F.when(second.isNull(), first.isNull() | fits(first)).otherwise(F.coalesce(F.forall(each, fits), F.lit(False)))


def _has_kind(value: Column, kind: T.DataType, pattern: str | None) -> Column:
    """Whether a variant is null or of the kind."""
    named = F.schema_of_variant(value)
    if isinstance(kind, T.ArrayType):
        return (named == "VOID") | (named.startswith("ARRAY<") & _elements_fit(value, kind.elementType))
    return named.rlike(f"^(VOID|{pattern or _kind(kind)})$")


def _all_fit(value: Column, own: Mapping[str, Column], schema: T.StructType, patterns: Mapping[str, str]) -> Column:
    """Whether an object surely keeps all rules of its members, seen from one text, its type. False if that text cannot tell."""
    kinds = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            kinds[f.name] = f"ARRAY<(?:VOID|{_kind(f.dataType.elementType)})>"
            continue
        kinds[f.name] = patterns.get(f.name, _kind(f.dataType)).replace(".*", _FLAT)
        if re.search(r"\.|\[\^|\\[A-Z]", kinds[f.name].replace(_FLAT, "")):
            return F.lit(False)  # such a pattern may run on into the members that follow
    members = ", ".join(f"{re.escape(name)}: (?:VOID|{kinds[name]})" for name in sorted(kinds))
    whole = F.schema_of_variant(value).rlike(f"^OBJECT<{members}>$")
    # The type of an array of one element is that element's; only an array of a null has the type of an empty one.
    arrays = []
    for f in schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            first, second = (F.try_variant_get(own[f.name], f"$[{n}]", "variant") for n in (0, 1))
            one = ~F.coalesce(F.is_variant_null(first), F.lit(False))
            arrays.append(F.when(second.isNull(), one).otherwise(_elements_fit(own[f.name], f.dataType.elementType)))
    return reduce(Column.__and__, arrays, whole)


def _named(*rules: tuple[str, Column]) -> Column:
    """``codes`` without a loop, which Spark would not compile: the names of the rules that hold, in order."""
    return F.array_except(F.array(*[F.when(test, F.lit(name)) for name, test in rules]), F.array(F.lit(None).cast("string")))


def parse_strict(lines: DataFrame, schema: T.StructType = RESULT_ROW, kinds: Mapping[str, str] | None = None, column: str = "value") -> DataFrame:
    """``lines`` with ``errors`` and ``row``, the line's values (null where there are errors).

    A line must be one JSON object that names no member twice, at any depth, and holds every member of the schema, no other,
    each null or of its type: 1 is no boolean and 1.0 no integer. Codes: ``empty_line``, ``malformed``, ``not_object``,
    ``repeated_member``, and after those ``missing:x``, ``type:x`` and ``unknown:x``. ``kinds`` replaces the pattern of some members.

    Variants refuse repeated members while they are parsed, so types, members and repetition all come from one parse. The parser
    overlooks what follows a value, so the line is parsed as the first of two elements, the other being its digest, which no line
    can hold: if that comes second, the line was one value and nothing else. The type of the whole object tells of most good lines
    that they are good; only the others are asked member by member.
    """
    patterns = RESULT_KINDS if kinds is None else kinds
    names = [f.name for f in schema.fields]
    hashed = lines.withColumn("_digest", F.sha2(F.col(column), 256))
    whole = F.try_parse_json(F.concat(F.lit("["), F.col(column), F.lit(',"'), "_digest", F.lit('"]')))
    parsed = hashed.select("*", F.explode(F.array(F.struct(whole.alias("v")))).alias("_p"))
    first = F.try_variant_get("_p.v", "$[0]", "variant")
    alone = F.coalesce(F.try_variant_get("_p.v", "$[1]", "string") == F.col("_digest"), F.lit(False))
    readable = F.get_json_object(F.concat(F.lit('{"v":['), F.col(column), F.lit("]}")), "$.v").isNotNull()
    own = {f.name: F.try_variant_get("_p.v", f"$[0].{f.name}", "variant") for f in schema.fields}
    unknown = F.transform(F.array_sort(F.array_except(F.json_object_keys(column), F.array(*[F.lit(n) for n in names]))), lambda n: F.concat(F.lit("unknown:"), n))
    members = F.concat(
        _named(*[(f"missing:{n}", own[n].isNull()) for n in names]),
        _named(*[(f"type:{f.name}", own[f.name].isNotNull() & ~_has_kind(own[f.name], f.dataType, patterns.get(f.name))) for f in schema.fields]), unknown)
    errors = (F.when(F.trim(F.coalesce(F.col(column), F.lit(""))) == "", F.array(F.lit("empty_line")))
              .when(F.col("_p.v").isNull() & readable, F.array(F.lit("repeated_member"))).when(~alone, F.array(F.lit("malformed")))
              .when(_all_fit(first, own, schema, patterns), F.array().cast("array<string>"))
              .when(~F.schema_of_variant(first).startswith("OBJECT"), F.array(F.lit("not_object"))).otherwise(members))
    # The rules are a projection of their own: one loop among the expressions of a generator keeps all of them from being compiled.
    kept = [F.col(c) for c in lines.columns]
    judged = parsed.select(*kept, errors.alias("_errors")).select(*kept, F.explode(F.array("_errors")).alias("errors"))
    return judged.withColumn("row", F.when(F.size("errors") == 0, F.from_json(column, schema)))


def read_strict(spark: SparkSession, path: str, schema: T.StructType = RESULT_ROW, kinds: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of a file of JSON lines that keep all its rules, and a reject branch: the other lines with their broken rules and file."""
    parsed = parse_strict(spark.read.text(path).withColumn("file", F.input_file_name()), schema, kinds)
    return parsed.filter(F.size("errors") == 0).select("row.*"), parsed.filter(F.size("errors") > 0).select("file", "value", "errors")


def union_shards(spark: SparkSession, pattern: str, schema: T.StructType = RESULT_ROW) -> DataFrame:
    """Rows of every shard file, each with the shard it came from."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(pattern)
    return rows.withColumn("shard", F.regexp_extract(F.input_file_name(), r"shard-(\d+)", 1))


def shard_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """Rows and execution errors of each shard."""
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), F.count_if(F.col(reason) == "execution_error").alias("errors"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Stored objects as (path, length, content), one row per file."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
