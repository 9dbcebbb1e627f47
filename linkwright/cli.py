"""Command line: runs one phase of the pipeline, or all, over folders of tab-separated files.

Layout: DATA/train/train_source{1,2,3}.tsv, DATA/train/train_ground_truth.tsv, DATA/test/test_source{1,2,3}.tsv.
"""

from __future__ import annotations

import argparse
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.config import DEFAULT, LABEL_COLUMNS, PREFIX, SOURCE_COLUMNS
from linkwright.operators import blocking, emit, evaluate, features, pairs, profile, tfidf, validate
from linkwright.operators.model import PairClassifier, auc
from linkwright.sources import files, tsv
from linkwright.sources import store as st


class Run:
    """The phases over one data folder and one output folder."""

    def __init__(self, spark: SparkSession, data: str, out: str, *, force: bool = False, threshold: float | None = None) -> None:
        self.spark, self.data, self.out, self.force, self.threshold = spark, data, out, force, threshold
        self.store = st.Store(spark, f"{out}/tables")
        self._trained: set[str] = set()

    def source(self, split: str, name: str) -> DataFrame:
        return tsv.read_source(self.spark, f"{self.data}/{split}/{split}_{name}.tsv")

    def labels(self) -> DataFrame:
        return tsv.read_labels(self.spark, f"{self.data}/train/train_ground_truth.tsv")

    def norm(self, split: str, name: str) -> DataFrame:
        return self.store.materialize(f"norm_{split}_{name}", lambda: blocking.normalized(blocking.latest(self.source(split, name))), force=self.force)

    def others(self, split: str) -> DataFrame:
        return self.norm(split, "source2").unionByName(self.norm(split, "source3"))

    def candidates(self, split: str) -> DataFrame:
        return self.store.materialize(f"candidates_{split}", lambda: blocking.candidates(*[self.norm(split, s) for s in PREFIX]), force=self.force)

    def truth(self) -> DataFrame:
        return pairs.label_sets(self.labels())

    def labelled(self) -> DataFrame:
        return self.store.materialize("pairs", lambda: pairs.labelled_pairs(self.candidates("train"), self.truth(), pairs.label_entities(self.labels())), force=self.force, by=["split"])

    def vocabulary(self, column: str) -> DataFrame:
        return self.store.materialize(f"terms_{column}", lambda: tfidf.fit(self.norm("train", "source1").unionByName(self.others("train")), column), force=self.force)

    def matrix(self, name: str, of: DataFrame, split: str) -> DataFrame:
        def build() -> DataFrame:
            m = features.feature_matrix(of, self.norm(split, "source1"), self.others(split), self.vocabulary("name_norm"), self.vocabulary("address_norm"))
            bad = features.null_features(m, features.ALL).collect()[0]["n_null"]
            if bad:
                raise ValueError(f"{bad} null features")
            return m

        return self.store.materialize(f"features_{name}", build, force=self.force)

    def train_matrix(self) -> DataFrame:
        return self.matrix("train", self.labelled(), "train")

    def model(self) -> PairClassifier:
        path = self.store.path("model")
        if self.force and "model" not in self._trained or not files.exists(f"{path}/metadata"):
            m, aside = self.train_matrix(), f"{path}-{uuid.uuid4().hex}"
            PairClassifier().fit(m.filter("split = 'train'"), m.filter("split = 'val'")).save(aside)
            files.replace(aside, path)
            self._trained.add("model")
        return PairClassifier.load(path)

    def validation(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        val = self.model().score(self.train_matrix().filter("split = 'val'"))
        ents = val.select("source1_entity_id").distinct()
        return val, ents, self.truth().join(ents, "source1_entity_id", "left_semi")

    def chosen_threshold(self) -> float:
        if self.threshold is not None:
            return self.threshold
        t, warning = st.load_threshold(f"{self.out}/threshold.json")
        if warning:
            print(f"warning: {warning}", file=sys.stderr)
        return t

    # phases; each returns the number for the exit status

    def file(self, split: str, name: str) -> str:
        return f"{self.data}/{split}/{split}_{name}.tsv"

    def p1(self) -> int:
        lines, whole = [], {}
        for split in ("train", "test"):
            for s, prefix in PREFIX.items():
                if split == "test" and not files.exists(self.file(split, s)):
                    continue
                issues = tsv.source_issues(self.spark, self.file(split, s), s)
                if issues:
                    lines += issues
                    whole.setdefault(split, {})[s] = {"issues": issues}
                    continue
                df = self.source(split, s)
                parts = {
                    "profile": profile.source_profile(df, prefix), "missing": profile.null_profile(df, list(SOURCE_COLUMNS)), "duplicates": profile.duplicate_ids(df),
                    "countries": profile.country_histogram(df).orderBy(F.desc("n_rows"), "country"), "sample": profile.sample_rows(df),
                }
                whole.setdefault(split, {})[s] = {k: st.report_rows(v) for k, v in parts.items()}
        labels = self.labels()
        parts = {"profile": profile.label_profile(labels), "matches": profile.match_histogram(labels).orderBy("n_matches"), "coverage": profile.id_coverage(self.source("train", "source1"), labels)}
        whole["labels"] = {k: st.report_rows(v) for k, v in parts.items()}
        for split, tables in whole.items():
            for name, rows in tables.items():
                per = rows.items() if isinstance(rows, dict) else [("", rows)]
                for part, found in per:
                    lines += [f"{split} {name} {part}".strip(), *[f"  {r}" if isinstance(r, str) else "  " + "  ".join(f"{c}={v}" for c, v in r.items()) for r in found], ""]
        st.write_text(f"{self.out}/reports/profile.txt", lines)
        st.write_json(f"{self.out}/reports/profile.json", whole)
        return 0

    def p2(self) -> int:
        for split in ("train", "test"):
            for s in PREFIX:
                path = self.file(split, s)
                if not files.exists(path):
                    continue
                built = self.store.stale(f"norm_{split}_{s}", self.force)
                rows = self.norm(split, s)
                print(f"norm_{split}_{s}: {rows.count()} rows", file=sys.stderr)
                if built and (n := tsv.surplus_rows(self.spark, path, SOURCE_COLUMNS)):
                    print(f"warning: {path}: {n} rows with too many fields dropped", file=sys.stderr)
        path = self.file("train", "ground_truth")
        if files.exists(path) and (n := tsv.surplus_rows(self.spark, path, LABEL_COLUMNS)):
            print(f"warning: {path}: {n} rows with too many fields dropped", file=sys.stderr)
        return 0

    def p3(self) -> int:
        self.candidates("train")
        return 0

    def p4(self) -> int:
        r = pairs.blocking_recall(self.truth(), self.candidates("train"))
        st.write_text(f"{self.out}/reports/blocking_recall.txt", st.report_lines("recall", r) + st.report_lines("strategies", pairs.strategy_counts(self.candidates("train"))))
        recall = r.collect()[0]["recall"]
        if recall < 0.8:
            print(f"warning: blocking recall {recall:.3f} is below 0.8", file=sys.stderr)
        return 0

    def p5(self) -> int:
        self.labelled()
        return 0

    def p6(self) -> int:
        self.train_matrix()
        return 0

    def p7(self) -> int:
        m = self.model()
        val = m.score(self.train_matrix().filter("split = 'val'"))
        m.importances(val).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{self.out}/reports/importances")
        st.write_json(f"{self.out}/reports/training.json", {"auc": auc(val), "features": m.features})
        return 0

    def p8(self) -> int:
        val, ents, truth = self.validation()
        st.write_text(f"{self.out}/reports/validation.txt", st.report_lines("macro", evaluate.macro(evaluate.entity_metrics(evaluate.predictions(val, self.chosen_threshold()), truth, ents))))
        return 0

    def p9(self) -> int:
        val, ents, truth = self.validation()
        swept = evaluate.sweep(val, truth, ents)
        best = evaluate.best_threshold(swept).collect()[0]
        st.save_threshold(f"{self.out}/threshold.json", best["threshold"], best["macro_f05"])
        st.write_text(f"{self.out}/reports/thresholds.txt", st.report_lines("sweep", swept.orderBy("threshold")))
        return 0

    def p10(self) -> int:
        val, ents, truth = self.validation()
        t = self.chosen_threshold()
        lines = st.report_lines("false positives", evaluate.false_positives(val, truth, t)) + st.report_lines("false negatives", evaluate.false_negatives(val, truth, ents, t))
        st.write_text(f"{self.out}/reports/errors.txt", lines + st.report_lines("singletons merged", evaluate.singleton_merges(evaluate.predictions(val, t), truth, ents)))
        return 0

    def p11(self) -> int:
        c = self.candidates("test")
        scored = self.model().score(self.matrix("test", c, "test"))
        results = emit.matching_results(self.source("test", "source1"), evaluate.predictions(scored, self.chosen_threshold()), c)
        tsv.write_tsv(emit.candidate_lists(c), f"{self.out}/candidate_pairs.tsv")
        tsv.write_tsv(results, f"{self.out}/matching_results.tsv")
        return 0

    def p12(self) -> int:
        targets = self.source("test", "source2").select("entity_id").unionByName(self.source("test", "source3").select("entity_id"))
        r = validate.validate_files(self.spark, f"{self.out}/matching_results.tsv", f"{self.out}/candidate_pairs.tsv", self.source("test", "source1"), targets)
        for w in r.warnings:
            print(f"warning: {w}", file=sys.stderr)
        for e in r.errors:
            print(f"error: {e}", file=sys.stderr)
        return 0 if r.passed else 1


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="linkwright")
    a.add_argument("--data", required=True)
    a.add_argument("--out", required=True)
    a.add_argument("--phase", default="all", help="1 to 12, or all (2 to 12)")
    a.add_argument("--force", action="store_true", help="rebuild tables that exist")
    a.add_argument("--threshold", type=float, help=f"instead of the tuned one (else {DEFAULT.default_threshold})")
    args = a.parse_args(argv)
    phases = range(2, 13) if args.phase == "all" else [int(args.phase)]
    spark = SparkSession.builder.appName("linkwright").getOrCreate()
    run = Run(spark, args.data, args.out, force=args.force, threshold=args.threshold)
    for p in phases:
        code = getattr(run, f"p{p}")()
        if code:
            return code
    return 0


if __name__ == "__main__":
    sys.exit(main())
