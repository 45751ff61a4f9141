"""A kept band index: no exchange on its side, inserts equal to a rebuild, opened again."""

import re

from linkforge.operators import minhash
from linkforge.operators.band_index import BandIndex

NAMES = [(i, f"{a} {b} number {i % 9}") for i, (a, b) in enumerate((a, b) for a in ("acme", "globex", "initech", "umbrella", "hooli") for b in ("trading", "corporation", "holdings", "systems"))] + [(100, "ab"), (101, "")]


def rows(df):
    return sorted(map(str, df.collect()))


def test_kept_index(spark, tmp_path):
    names = spark.createDataFrame(NAMES, "id long, name string")
    asked = spark.createDataFrame([(1, "acme trading number 0"), (2, "nothing alike at all"), (3, ""), (4, None)], "q long, name string")
    first = BandIndex.create(names.filter("id % 2 = 0"), "id", "name", f"file://{tmp_path}/index", buckets=6)
    before = rows(first.search(asked, "q", "name"))
    first.insert(names.filter("id % 2 = 1"), "id", "name")
    want = rows(minhash.lsh_search(minhash.lsh_index(names, "id", "name"), asked, "q", "name"))
    assert rows(first.search(asked, "q", "name")) == want != before
    again = BandIndex.open(spark, f"file://{tmp_path}/index")
    assert rows(again.search(asked, "q", "name")) == want
    whole = again.compact()
    assert rows(whole.search(asked, "q", "name")) == want
    assert len(list((tmp_path / whole.folder.rsplit("/", 1)[1] / "bands").glob("*.parquet"))) <= 6 < len(list((tmp_path / "index" / "bands").glob("*.parquet")))
    # nothing between the scan of the index and the join but a filter and a projection
    plan = again.search(asked, "q", "name")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "HashJoin" in line and "Inner" in line)
    own = len(re.match(r"[ :+\-]*", lines[scan])[0])
    above = [line for line in lines[join + 1 : scan] if len(re.match(r"[ :+\-]*", line)[0]) < own and not line.lstrip(" ").startswith(":")]
    assert not any("Exchange" in line for line in above)
    for index in (first, again, whole):
        index.close()
