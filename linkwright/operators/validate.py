"""Checks of result lists, as relations (offenders per rule) and for files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

EXAMPLES = 5


def _ids(lists: DataFrame, column: str) -> DataFrame:
    """(s1, id): entries as written, neither stripped nor filtered, of lists that are not blank."""
    some = lists.filter(F.trim(F.coalesce(column, F.lit(""))) != "")
    return some.select(F.col("source1_entity_id").alias("s1"), F.explode(F.split(column, ",", -1)).alias("id"))


def duplicate_rows(lists: DataFrame) -> DataFrame:
    """(rule, offender): source1 ids on several rows."""
    d = lists.groupBy("source1_entity_id").count().filter("count > 1")
    return d.select(F.lit("duplicate_row").alias("rule"), F.col("source1_entity_id").alias("offender"))


def repeated_ids(lists: DataFrame, column: str) -> DataFrame:
    """(rule, offender): source1 ids whose list names an id twice."""
    ids = F.split(F.coalesce(column, F.lit("")), ",", -1)
    d = lists.filter(F.size(ids) != F.size(F.array_distinct(ids)))
    return d.select(F.lit("repeated_id").alias("rule"), F.col("source1_entity_id").alias("offender")).distinct()


def wrong_prefixes(lists: DataFrame, column: str) -> DataFrame:
    """(rule, offender): source1 ids as matches, and ids without a known prefix."""
    ids = _ids(lists, column)
    rule = F.when(F.col("id").startswith("S1-"), "self_match").when(~F.col("id").rlike("^S[23]-"), "wrong_prefix")
    return ids.select(rule.alias("rule"), F.col("id").alias("offender")).filter("rule is not null").distinct()


def missing_rows(lists: DataFrame, required: DataFrame) -> DataFrame:
    """(rule, offender): required ids without a row, and rows of ids that are not required."""
    have = lists.select(F.col("source1_entity_id").alias("offender")).distinct()
    need = required.select(F.trim("entity_id").alias("offender")).distinct()
    lost = need.join(have, "offender", "left_anti").select(F.lit("missing").alias("rule"), "offender")
    return lost.unionByName(have.join(need, "offender", "left_anti").select(F.lit("not_required").alias("rule"), "offender"))


def unknown_ids(lists: DataFrame, column: str, targets: DataFrame) -> DataFrame:
    """(rule, offender): well-formed ids that no target table has."""
    ids = _ids(lists, column).filter(F.col("id").rlike("^S[23]-")).select(F.col("id").alias("offender")).distinct()
    return ids.join(targets.select(F.trim("entity_id").alias("offender")), "offender", "left_anti").select(F.lit("unknown_id").alias("rule"), "offender")


def not_candidates(matches: DataFrame, cands: DataFrame) -> DataFrame:
    """(rule, offender): source1 ids with a match that is no candidate of theirs."""
    m = _ids(matches, "matched_entity_ids").distinct()
    c = _ids(cands, "candidate_entity_ids").distinct()
    return m.join(c, ["s1", "id"], "left_anti").select(F.lit("not_candidate").alias("rule"), F.col("s1").alias("offender")).distinct()


def all_findings(lists: DataFrame, column: str, required: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(rule, offender) of all rules for one list table."""
    out = duplicate_rows(lists).unionByName(repeated_ids(lists, column)).unionByName(wrong_prefixes(lists, column)).unionByName(missing_rows(lists, required))
    return out if targets is None else out.unionByName(unknown_ids(lists, column, targets))


def summary(findings: DataFrame) -> DataFrame:
    """(rule, n_offenders, sample): counts with the smallest few offenders."""
    return findings.groupBy("rule").agg(F.count("*").alias("n_offenders"), F.array_join(F.slice(F.array_sort(F.collect_set("offender")), 1, EXAMPLES), ",").alias("sample"))


@dataclass
class Report:
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return not self.errors


def read_lists(spark: SparkSession, path: str, column: str, report: Report) -> DataFrame | None:
    """The rows of a tab-separated list file; problems of the file itself go to `report`, fatal ones return None."""
    try:
        lines = spark.read.text(path)
        first = lines.limit(1).collect()
    except AnalysisException:
        report.errors.append(f"file not found: {path}")
        return None
    if not first:
        report.errors.append(f"{path} is empty")
        return None
    header = first[0]["value"] or ""
    if "\t" not in header and "," in header:
        report.errors.append(f"{path}: separated by commas, not by tabs")
        return None
    if [c.strip().lower() for c in header.split("\t")] != ["source1_entity_id", column]:
        report.errors.append(f"{path}: unexpected header {header!r}")
        return None
    if not lines.filter(~F.is_valid_utf8("value")).isEmpty():
        report.errors.append(f"{path}: not UTF-8")
        return None
    body = lines.filter(F.col("value") != header)
    bad = body.filter((F.instr("value", "\t") == 0) & (F.trim("value") != ""))
    examples = bad.limit(EXAMPLES).collect()
    for r in examples:
        report.errors.append(f"{path}: malformed row (no tab): {r['value']!r}")
    report.counts[f"{column}_malformed"] = bad.count() if len(examples) == EXAMPLES else len(examples)
    if report.counts[f"{column}_malformed"] > EXAMPLES:
        report.errors.append(f"{path}: {report.counts[f'{column}_malformed']} malformed rows in all")
    rows = body.filter(F.instr("value", "\t") > 0)
    parts = F.split("value", "\t", 2)
    return rows.select(parts[0].alias("source1_entity_id"), F.rtrim(parts[1]).alias(column))


def validate_files(spark: SparkSession, matches: str, cands: str | None, required: DataFrame, targets: DataFrame | None = None) -> Report:
    """Every rule over the result files. A missing candidate file is a warning, as are matches outside it.

    targets: known record ids; without them the check of unknown ids is skipped with a warning.
    """
    report = Report()
    if targets is None:
        report.warnings.append("no target tables: matched ids are not checked for existence")
    tables = {}
    for path, column in ((matches, "matched_entity_ids"), (cands, "candidate_entity_ids")):
        if path is None:
            report.warnings.append("no candidate file")
            continue
        own = Report() if column == "candidate_entity_ids" else report
        rows = read_lists(spark, path, column, own)
        if rows is None and own is not report and own.errors[0].startswith("file not found"):
            report.warnings.append(f"no candidate file: {path}")
            continue
        if own is not report:
            report.errors += own.errors
        if rows is None:
            continue
        tables[column] = rows
        n = rows.agg(F.count("*").alias("n"), F.count_if(F.trim(column) == "").alias("e")).collect()[0]
        report.counts |= {f"{column}_rows": n["n"], f"{column}_empty": n["e"]}
        for r in summary(all_findings(rows, column, required, targets)).orderBy("rule").collect():
            report.errors.append(f"{path}: {r['rule']}: {r['n_offenders']}, e.g. {r['sample']}")
    if len(tables) == 2:
        for r in summary(not_candidates(tables["matched_entity_ids"], tables["candidate_entity_ids"])).collect():
            report.warnings.append(f"{r['rule']}: {r['n_offenders']}, e.g. {r['sample']}")
    return report
