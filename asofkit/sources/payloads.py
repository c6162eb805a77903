"""Landed raw feeds -> rows. Explicit schemas, exploded in the plan, nothing inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def _strings(fields: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def paged_schema(fields: Sequence[str]) -> T.StructType:
    """pages[].body.data[] with string records."""
    body = T.StructType([T.StructField("data", T.ArrayType(_strings(fields)))])
    page = T.StructType([T.StructField("url", T.StringType()), T.StructField("body", body)])
    return T.StructType([T.StructField("pages", T.ArrayType(page))])


def series_schema() -> T.StructType:
    """series[].body.pd.timeseries[]; period is NULL for the current period."""
    obs = _strings(["asofdate", "keyid", "value"])
    pd = T.StructType([T.StructField("timeseries", T.ArrayType(obs))])
    body = T.StructType([T.StructField("pd", pd)])
    one = T.StructType([*_strings(["keyid", "url", "period"]).fields, T.StructField("body", body)])
    return T.StructType([T.StructField("series", T.ArrayType(one))])


def contract_schema(fields: Sequence[str]) -> T.StructType:
    """contracts[].body[], keeping only the listed fields."""
    one = T.StructType([
        T.StructField("contract_code", T.StringType()), T.StructField("url", T.StringType()),
        T.StructField("body", T.ArrayType(_strings(fields))),
    ])
    return T.StructType([T.StructField("contracts", T.ArrayType(one))])


def read_payloads(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Whole-document JSON files; one file is one payload."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def parse_payloads(df: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """Payload documents held in a text column."""
    return df.select(F.from_json(F.col(text), schema).alias("p")).select("p.*")


def paged_records(payload: DataFrame) -> DataFrame:
    return payload.select(F.explode("pages").alias("page")).select(F.inline("page.body.data"))


def series_records(payload: DataFrame) -> DataFrame:
    one = payload.select(F.explode("series").alias("s"))
    obs = one.select(
        F.col("s.keyid").alias("series_keyid"), F.col("s.url").alias("source_url"), F.col("s.period").alias("period"),
        F.inline("s.body.pd.timeseries"),
    )
    return obs.select(
        F.coalesce("keyid", "series_keyid").alias("keyid"), "asofdate", "value", "source_url", "period"
    )


def contract_records(payload: DataFrame) -> DataFrame:
    one = payload.select(F.explode("contracts").alias("c"))
    return one.select(F.col("c.url").alias("source_url"), F.inline("c.body"))


def read_text_csv(
    spark: SparkSession, path: str | list[str], *, first_column: str, year_pattern: str = r"(\d{4})"
) -> DataFrame:
    """CSV files whose columns differ by year: every column as text, headers merged by name.

    One job finds the header line of every file (the line that begins with `first_column`);
    files sharing a header are then one scan. The year comes from the file name.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    headers = lines.where(
        F.col("value").startswith(first_column) | F.col("value").startswith(f'"{first_column}"')
    ).groupBy("value").agg(F.collect_set("file").alias("files"))
    frames = []
    for row in headers.orderBy("value").collect():  # one row per distinct header
        names = [h.strip().strip('"') for h in row["value"].split(",")]
        frame = spark.read.option("header", True).schema(_strings(names)).csv(row["files"])
        year = F.regexp_extract(F.col("_metadata.file_name"), year_pattern, 1).try_cast("int")
        frames.append(frame.select("*", year.alias("source_year")))
    if not frames:
        raise ValueError(f"no header line beginning with {first_column!r} under {path}")
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def read_processed(spark: SparkSession, path: str, make_hint: str) -> DataFrame:
    """Parquet table, or a clear error naming the step that makes it."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(f"{path} is missing; make it with: {make_hint}") from exc
        raise
