"""Shared helpers: gapless ranks, pre-filtered keys, and the entry file without this part."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from ratecard.llm import common


def test_ranks_are_gapless_in_every_group(spark):
    rows = [(g, i) for g, n in (("a", 300), ("b", 1), ("c", 40), (None, 7)) for i in range(n)] + [("a", 5)]
    df = common.stored(spark.createDataFrame(rows, "g string, i long"), "t")
    for size in (7, 50_000):
        by = defaultdict(list)
        for r in common.ranked(df.filter("g IS NOT NULL"), ["g"], ["i"], "at", size).collect():
            by[r["g"]].append(r["at"])
        assert {g: sorted(x) for g, x in by.items()} == {"a": list(range(301)), "b": [0], "c": list(range(40))}
    whole = common.ranked(df, [], ["g", "i"], "at", 11).collect()
    assert sorted(r["at"] for r in whole) == list(range(len(rows)))
    assert common.ranked(df.limit(0), ["g"], ["i"], "at").count() == 0


def test_likely_in_keeps_every_match(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("x"))
    keys = spark.createDataFrame([(i,) for i in range(0, 1000, 50)], "id long")
    for slots in (4, 1 << 20):
        got = {r["id"] for r in common.likely_in(df, keys, ["id"], slots).collect()}
        rest = {r["id"] for r in common.likely_in(df, keys, ["id"], slots, others=True).collect()}
        assert got >= set(range(0, 1000, 50)) and got | rest == set(range(1000)) and not got & rest
    assert common.likely_in(df, keys.limit(0), ["id"]).count() == 0


def test_buffers_of_slices():
    for kind in (pa.string(), pa.large_string(), pa.binary()):
        a = pa.array(["ab", None, "", "cde", "f"], pa.string()).cast(kind)
        for lo, hi in ((0, 5), (1, 4), (3, 5), (2, 2)):
            raw, off = common.buffers(a.slice(lo, hi - lo))
            want = [(x.as_py() or "") for x in a.slice(lo, hi - lo)]
            want = [w.encode() if isinstance(w, str) else w for w in want]
            assert [bytes(raw[i:j]) for i, j in zip(off[:-1], off[1:])] == want


def test_entry_without_this_part(tmp_path):
    """The entry file and its queries work with this subpackage and the pipeline file deleted."""
    root = Path(common.__file__).parents[2]
    (tmp_path / "ratecard").mkdir()
    for p in (root / "ratecard").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "ratecard" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=tmp_path,
                          capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    names = said.stdout.split()
    assert "churn_labels" in names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), said.stderr
