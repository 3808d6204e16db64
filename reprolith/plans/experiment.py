"""An experiment end to end: generations and contracts in, repaired code and metrics out.

    generations -> tests (once a distinct code) -> canon -> distances -> repair -> tests -> metrics

Each Python step works on distinct texts and is written once, so no plan evaluates it again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.code_properties import with_properties
from ..functions.distance import total_distance
from ..functions.oracles import tested_codes
from ..functions.rewrite import repair_column
from ..operators import metrics as M
from ..operators.reports import sweep_conclusion

GROUP = ["contract_id", "model", "temperature"]


def run_experiment(generations: DataFrame, contracts: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> dict[str, DataFrame]:
    """Frames "tested", "canon", "repaired" and "metrics".

    generations: contract_id, model, temperature, run_id, code. contracts: contract_id, family, cases (JSON),
    function, strict. `keep(frame, name)` writes a frame and reads it again.
    """
    g = generations.join(contracts, "contract_id").withColumn("digest", F.sha2(F.col("code").cast("binary"), 256))
    tests = keep(tested_codes(g, "code", "family", "cases"), "tests").select("digest", "family", "passed", F.transform("test_results", lambda r: F.when(r["passed"], "P").otherwise("F")).alias("row"))
    tested = keep(g.join(tests, ["digest", "family"]), "tested")
    canon = keep(M.anchors(tested, ["contract_id"], F.col("passed"), "run_id", "code").select("contract_id", F.col("anchor_run_id"), F.col("anchor_code").alias("canon")), "canon")
    met = tested.join(canon, "contract_id", "left")
    pairs = met.select("digest", "code", "canon", "contract_id", "function", "family", "cases").dropDuplicates(["digest", "contract_id"])
    fixed = keep(pairs.withColumn("r", repair_column(F.col("code"), F.col("canon"), F.col("function"), F.col("family"), F.col("cases"))).select("digest", "contract_id", "r.*"), "repairs")
    out = met.join(fixed.select("digest", "contract_id", F.col("code").alias("repaired"), "level", "success", "applied"), ["digest", "contract_id"])
    for column, name in (("code", "p_code"), ("canon", "p_canon"), ("repaired", "p_fixed")):
        out = with_properties(out, column, name)
    none = F.col("canon").isNull()
    distance = lambda c: F.when(none, 1.0).otherwise(total_distance(F.col(c), F.col("p_canon"), F.col("strict")))
    signature = F.sha2(F.to_json(F.struct(*(F.col(f"p_fixed.{p}") for p in ("control_flow_signature", "normalized_ast_structure", "data_dependency_graph", "statement_ordering")))), 256)
    out = keep(out.withColumns({"distance_pre": distance("p_code"), "distance_post": distance("p_fixed"), "signature": signature}).drop("p_code", "p_canon", "p_fixed"), "repaired")
    metrics = M.anchor_metrics(out, GROUP).join(M.repeatability(out, GROUP, F.col("code"), "run_id").select(*GROUP, "r_raw", "entropy", "unique_outputs"), GROUP)
    metrics = metrics.join(M.signature_groups(out, GROUP, M.behaviour_signature(F.col("passed"), F.array_join("row", ""), F.col("run_id")), "run_id").select(*GROUP, F.col("r_signature").alias("r_behavioral")), GROUP)
    metrics = metrics.join(M.signature_groups(out, GROUP, F.col("signature"), "run_id").select(*GROUP, F.col("r_signature").alias("r_structural")), GROUP)
    return {"tested": tested, "canon": canon, "repaired": out, "metrics": keep(metrics, "metrics")}


def sweep(metrics: DataFrame) -> DataFrame:
    """F18 over the temperatures of each contract and model."""
    return sweep_conclusion(metrics, ["contract_id", "model"], F.col("r_structural") - F.col("r_raw"))
