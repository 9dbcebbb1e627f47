"""The command line from files to lists, a second time with --force."""

import json
import random

from linkwright import cli


def data(folder):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ra", "so", "tu"]) for _ in range(4))
    for split in ("train", "test"):
        (folder / split).mkdir()
        firms = [(word(), word(), f"{i + 1} {word()} road", "US") for i in range(60)]
        lines = {s: ["entity_id\tbusiness_name\tbusiness_address\tcountry"] for s in (1, 2, 3)}
        labels = ["source1_entity_id\tmatched_entity_ids"]
        for i, (a, b, at, c) in enumerate(firms):
            lines[1].append(f"S1-{i}\t{a} {b} ltd\t{at}\t{c}")
            lines[2].append(f"S2-{i}\t{a} {b}\t{at}\t{c}")
            lines[3].append(f"S3-{i}\t{b} {a} limited\t{at}\t{c}")
            labels.append(f"S1-{i}\tS2-{i},S3-{i}")
        lines[2].append("S2-x\ta\tb\tc\ttoo many")
        for s, rows in lines.items():
            (folder / split / f"{split}_source{s}.tsv").write_text("\n".join(rows) + "\n", encoding="utf-8")
    (folder / "train" / "train_ground_truth.tsv").write_text("\n".join(labels) + "\n", encoding="utf-8")


def test_all_phases_twice(spark, tmp_path, capsys, monkeypatch):
    data(tmp_path)
    args = ["--data", str(tmp_path), "--out", str(tmp_path / "out")]
    built = []
    fit = cli.PairClassifier.fit
    monkeypatch.setattr(cli.PairClassifier, "fit", lambda self, *a: built.append(1) or fit(self, *a))
    assert cli.main([*args, "--phase", "all"]) == 0
    assert len(built) == 1 and "too many fields" in capsys.readouterr().err
    first = sorted(x for p in (tmp_path / "out" / "matching_results.tsv").glob("part-*") for x in p.read_text().splitlines())
    assert cli.main([*args, "--phase", "11"]) == 0 and len(built) == 1  # the model is found again
    assert cli.main([*args, "--phase", "all", "--force"]) == 0 and len(built) == 2
    again = sorted(x for p in (tmp_path / "out" / "matching_results.tsv").glob("part-*") for x in p.read_text().splitlines())
    assert first == again and any("S2-" in x for x in first)
    assert cli.main([*args, "--phase", "1"]) == 0
    p = json.loads((tmp_path / "out" / "reports" / "profile.json").read_text())
    assert p["train"]["source1"]["profile"][0]["n_rows"] == 60 and p["labels"]["profile"][0]["n_distinct_matched"] == 120
