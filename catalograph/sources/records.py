"""Readers of reports, logs, cases, runs, skills and processes; every one with an explicit schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import confirmed_ids, front_matter_value, process_step_tags, process_title, run_ordinal, skill_steps
from ..operators.certification import expected_ids
from ..schema import CERT_RUN, LOG_EVENT, PAIR_CSV

RUNTIME_CASE = "case_id string, mode string, query_class string, prompt string, expected_ordIds array<string>, gap_resources array<string>, skill_id string, evolution_log array<struct<outcome:string,note:string>>"
PROVENANCE = "case_id string, mode string, selected_resources array<struct<ordId:string>>, gap_resources array<struct<ordId:string>>, evolution_log array<struct<attempt:int,outcome:string,note:string,prompt:string>>, accepted_case struct<expected_ordIds:array<string>,prompt:string>, block string"
REPORT = "resources array<struct<ordId:string,title:string,type:string,namespace:string,ambiguity_score:double,difficulty_band:string,top_neighbors:array<struct<ordId:string,sim:double>>,n_neighbors_above_threshold:long,coverage_gap:boolean,can_be_ground_truth:boolean>>"
DESIGN_CASE = "case_id string, process_id string, step_index int, step_id string, input string, expected_ordId string, is_gt boolean"


def json_array(spark: SparkSession, path: str, schema, strict: bool = True) -> DataFrame:
    """A file holding one array; not strict: broken records are left out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def json_lines(spark: SparkSession, path: str, schema) -> DataFrame:
    """One record a line; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def or_empty(spark: SparkSession, read, schema) -> DataFrame:
    """What read() gives, or an empty frame where its path does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def ambiguity_report(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, REPORT).select(F.explode("resources").alias("r")).select("r.*")


def generation_log(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, LOG_EVENT, strict=False).withColumn("ts", F.try_to_timestamp("timestamp"))


def frozen_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=PAIR_CSV)


def _files(spark: SparkSession, path: str, suffix: str, by: Column | None) -> DataFrame:
    """(id, value) of whole files: all below path with the id `by`, or those with the suffix by their names."""
    if by is not None:
        return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(by.alias("id"), "value")
    return spark.read.text(path, wholetext=True, pathGlobFilter=f"*.{suffix}").select(F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{suffix}$", 1).alias("id"), "value")


def skills(spark: SparkSession, path: str, compat: bool = False, skill_id: Column | None = None) -> DataFrame:
    """(skill_id, name, description, process_type, confirmed[], steps[], text) of Markdown files; skill_id: their id by the path, else by the file name. compat: only unindented keys count, so that the type reads as bpmn."""
    files = _files(spark, path, "md", skill_id).select(F.col("id").alias("skill_id"), F.col("value").alias("text"))
    value = lambda k: front_matter_value(F.col("text"), k, nested=not compat)
    return files.select("skill_id", value("name").alias("name"), value("description").alias("description"), F.coalesce(value("process-type"), F.lit("bpmn")).alias("process_type"), confirmed_ids(F.col("text")).alias("confirmed"), skill_steps(F.col("text")).alias("steps"), "text")


def skills_with_enrichment(skills_: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Skills with the ids of their process (process_id, gt_ids), else those that the text confirms."""
    return skills_.join(enrichment.select(F.col("process_id").alias("skill_id"), "gt_ids"), "skill_id", "left").withColumn("gt_ids", F.coalesce("gt_ids", "confirmed"))


def processes(spark: SparkSession, path: str, process_id: Column | None = None) -> DataFrame:
    """(process_id, xml, title) of XML files; process_id: their id by the path, else by the file name."""
    files = _files(spark, path, "xml", process_id).select(F.col("id").alias("process_id"), F.col("value").alias("xml"))
    return files.filter(~F.col("process_id").contains("enrichment")).withColumn("title", process_title(F.col("xml")))


def process_steps(processes_: DataFrame) -> DataFrame:
    """(process_id, step_index from 1, step_id, label, description, id)."""
    return processes_.select("process_id", F.posexplode(process_step_tags(F.col("xml"))).alias("i", "s")).select("process_id", (F.col("i") + 1).alias("step_index"), F.col("s.id").alias("step_id"), "s.label", "s.description", F.col("s.ordId").alias("id"))


def design_cases(steps: DataFrame, gt: DataFrame) -> DataFrame:
    """Test cases from process steps; gt: (process_id, gt_ids[])."""
    j = steps.join(gt, "process_id", "left")
    return j.select(F.format_string("%s_s%02d", "process_id", "step_index").alias("case_id"), "process_id", "step_index", "step_id", F.concat("label", F.lit(" — "), "description").alias("input"), F.col("id").alias("expected_ordId"), F.coalesce(F.array_contains("gt_ids", F.col("id")), F.lit(False)).alias("is_gt"))


def loaded_cases(cases: DataFrame, titles: DataFrame, gt_only: bool = False) -> DataFrame:
    """Cases with the title of their process and their expected id as a list; titles: (process_id, title)."""
    kept = cases.filter("is_gt") if gt_only else cases
    j = kept.join(titles.select("process_id", "title"), "process_id", "left")
    return j.withColumns({"label": F.concat_ws(" / ", "title", "input"), "expected": F.when(F.col("expected_ordId").isNotNull(), F.array("expected_ordId")).otherwise(F.array().cast("array<string>"))})


def runtime_cases(spark: SparkSession, by_mode: dict[str, str]) -> DataFrame:
    """The union of one file per mode, with the mode."""
    return reduce(DataFrame.unionByName, [json_array(spark, path, RUNTIME_CASE).withColumn("mode", F.lit(mode)) for mode, path in by_mode.items()])


def of_known_modes(cases: DataFrame, modes: tuple[str, ...] = ("SG", "SA", "DY", "OOS")) -> DataFrame:
    return cases.filter(F.col("mode").isin(*modes))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """Provenance with expected ids by mode; out-of-scope cases have none."""
    p = json_array(spark, path, PROVENANCE)
    ids = lambda c: F.transform(c, lambda x: x["ordId"])
    fallback: Column = F.coalesce(F.col("accepted_case.expected_ordIds"), ids("selected_resources"))
    return p.filter("mode <> 'OOS'").withColumn("expected", expected_ids(F.col("mode"), F.coalesce(ids("gap_resources"), ids("selected_resources")), fallback))


def certification_runs(spark: SparkSession, path: str, case_id: Column | None = None) -> DataFrame:
    """(case_id, run, solved, cached, latency_s, tokens) of run files <case_id>/run_<n>.json; unreadable files are left out. case_id: by `_path`, else the folder."""
    runs = spark.read.schema(CERT_RUN).option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path).withColumn("_path", F.col("_metadata.file_path"))
    return runs.filter("nonce IS NOT NULL").select((F.element_at(F.split("_path", "/"), -2) if case_id is None else case_id).alias("case_id"), run_ordinal(F.col("nonce")).alias("run"), "solved", "cached", "latency_s", "tokens", "expected_ordIds", F.col("output.picked_ordId").alias("picked"))
