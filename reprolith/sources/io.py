"""Readers and writers (S1-S17) with declared schemas; nothing is inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_METRICS = ["R_raw", "R_anchor_pre", "R_anchor_post", "Delta_rescue", *(f"R_repair_at_{k}_{s}" for k in ("0.05", "0.1", "0.15", "0.2") for s in ("pre", "post")), "mean_distance_pre", "std_distance_pre", "mean_distance_post", "std_distance_post", "Delta_mu", *(f"Delta_P_tau_{k}" for k in ("0.05", "0.1", "0.15", "0.2")), "canon_coverage", "rescue_rate", "R_behavioral", "R_structural"]
_TEXT = ["experiment_id", "repo_commit", "contract_id", "canon_id", "model"]
#: The 35 columns of a metrics summary, in file order.
SUMMARY = T.StructType([*(T.StructField(c, T.StringType()) for c in _TEXT), T.StructField("decoding_temperature", T.DoubleType()), T.StructField("runs", T.IntegerType()), T.StructField("timestamp", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in _METRICS), T.StructField("sweep_id", T.StringType()), T.StructField("notes", T.StringType())])

_CASE = "struct<input:string, expected:string, description:string>"
#: Contracts; values of test cases stay as JSON text, open parts are maps.
CONTRACT = f"""contract_id string, task_intent string, prompt string, algorithm_family string, language string, constraints map<string,string>,
environment map<string,string>, output_format string, oracle_requirements struct<test_cases:array<{_CASE}>, required_pass_rate:double>,
normalization_rules map<string,string>, domain string, out_of_domain struct<policy:string, exception:string, return_value:string, examples:array<string>, max_checks:int>,
rescue_bounds map<string,string>, created_timestamp string"""
CANON = "contract_id string, canonical_code string, created_timestamp string, canon_version string, oracle_validated boolean, oracle_pass_rate double"
EXPERIMENT = "experiment_id string, contract_id string, model string, temperature double, timestamp string, num_runs int, successful_runs int, llm_results array<struct<run_id:int, raw_output:string, success:boolean, error:string>>, raw_outputs array<string>, repaired_outputs array<string>, transformation_results array<struct<run_id:int, transformation_needed:boolean, transformation_success:boolean, final_distance:double, transformations_applied:array<string>, error:string>>, canon_data struct<canonical_code:string>"


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Metrics summaries with the declared types and an ordinal in file order.

    The ordinal is the place of the row: file, then row. Later duplicates are larger, as `keep_last` needs.
    """
    rows = spark.read.schema(SUMMARY).option("header", True).csv(path)
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def read_experiments(spark: SparkSession, path: str, skip_broken: bool = True) -> DataFrame:
    """Experiment documents of a glob with their file; broken ones are left out, or fail."""
    mode = "PERMISSIVE" if skip_broken else "FAILFAST"
    rows = spark.read.schema(f"{EXPERIMENT}, _corrupt_record string").option("multiLine", True).option("mode", mode).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.select("*", F.col("_metadata.file_name").alias("file")).filter(F.col("_corrupt_record").isNull() & F.col("experiment_id").isNotNull()).drop("_corrupt_record")


def generations_of(experiments: DataFrame) -> DataFrame:
    """The runs of experiments as rows; run numbers are kept, so failed runs shift nothing."""
    return experiments.select("experiment_id", "contract_id", "model", "temperature", F.explode("llm_results").alias("r")).select("experiment_id", "contract_id", "model", "temperature", "r.*")


def read_contracts(spark: SparkSession, path: str) -> DataFrame:
    """Contract documents with defaults where fields are missing."""
    rows = spark.read.schema(CONTRACT).option("multiLine", True).json(path)
    return rows.withColumns({"language": F.coalesce("language", F.lit("python")), "algorithm_family": F.coalesce("algorithm_family", F.lit("unknown")), "output_format": F.coalesce("output_format", F.lit("code"))})


def contract(contracts: DataFrame, contract_id: str) -> DataFrame:
    """One contract; an unknown id is an error."""
    one = contracts.filter(F.col("contract_id") == contract_id)
    if one.isEmpty():
        raise ValueError(f"no contract {contract_id}")
    return one


def invalid_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts with the required fields that they lack."""
    need = ("contract_id", "task_intent", "prompt", "constraints", "oracle_requirements", "algorithm_family")
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in need)), lambda x: x.isNotNull())
    return contracts.select("contract_id", missing.alias("missing")).filter(F.size("missing") > 0)


def read_canons(spark: SparkSession, path: str) -> DataFrame:
    """Canons, one row a contract; joined to generations on contract_id."""
    return spark.read.schema(CANON).option("multiLine", True).json(path)


def provider(model: Column) -> Column:
    """By name; anything unknown is the first provider's."""
    return F.when(model.startswith("claude-"), "anthropic").otherwise("openai")


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A folder for each value of the keys; only those written are replaced.

    Rows of a key are gathered by a rebalance that splits large keys, so files are neither tiny nor huge.
    """
    df.hint("rebalance", *keys).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*keys).format(fmt).save(path)


def append_summary(df: DataFrame, path: str, digits: int = 3) -> None:
    """Append rows of the 35 columns; missing ones are null, doubles are rounded."""
    have = set(df.columns)
    columns = [(F.round(F.col(f"`{f.name}`"), digits) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")) if f.name in have else F.lit(None) for f in SUMMARY]
    df.select(*(c.cast(f.dataType).alias(f.name) for c, f in zip(columns, SUMMARY, strict=True))).write.mode("append").option("header", True).csv(path)


def report_lines(df: DataFrame, template: str, *columns: str) -> DataFrame:
    """A line of text for each row."""
    return df.select(F.format_string(template, *columns).alias("line"))
