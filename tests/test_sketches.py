"""Merged buckets against the rows themselves."""

import bisect
import math
import random
import statistics

from tidemark.operators import sketches


def test_merged_buckets(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.8 else r.choice("ab"), r.randrange(0, 5000), None if r.random() < 0.1 else 1e9 + r.gauss(0, 3)) for _ in range(20000)] + [("none", 5, None), ("one", 7, 4.0)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    fine = sketches.buckets(df, ["k"], "t", "v", 10)
    wide = sketches.coarser(sketches.coarser(fine, ["k"], 5), ["k"], 20)
    quantiles = {"q01": 0.01, "q50": 0.5, "q99": 0.99}
    for parts, key in ((sketches.merged(wide, ["k"]), lambda k, t: (k,)), (wide, lambda k, t: (k, t // 1000))):
        by = {}
        for k, t, v in rows:
            by.setdefault(key(k, t), []).append(v)
        found = sketches.statistics(parts, quantiles).collect()
        assert len(found) == len(by)
        for x in found:
            values = by[(x["k"],) if "bucket" not in x else (x["k"], x["bucket"])]
            known = sorted(v for v in values if v is not None)
            assert (x["readings"], x["n"]) == (len(values), len(known))
            if not known:
                assert x["mean"] is None and x["q50"] is None and x["stdev"] is None
                continue
            assert (x["least"], x["greatest"]) == (known[0], known[-1]) and math.isclose(x["mean"], statistics.fmean(known), rel_tol=1e-12)
            assert len(known) == 1 or math.isclose(x["stdev"], statistics.stdev(known), rel_tol=1e-6)
            for name, p in quantiles.items():  # a rank that is off by 3 % at most
                rank = bisect.bisect_left(known, x[name]) / len(known), bisect.bisect_right(known, x[name]) / len(known)
                assert rank[0] - 0.03 <= p <= rank[1] + 0.03
