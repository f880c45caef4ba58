"""An index of path rules against the rules tried one by one."""

import random
import time

from pyspark.sql import functions as F

from gneissflow.functions import paths as P
from gneissflow.operators import rules as R


def test_index_against_patterns(spark):
    rng = random.Random(2)
    names = ["a", "b", "src", "Key", "x.ts", "ä.PEM", "", "..", "lib", "b*d", "id_rsa.1"]
    paths = sorted({"/".join(rng.choice(names) for _ in range(rng.randrange(1, 5))) for _ in range(400)}) + ["A\\b\\x.TS"]
    patterns = ["Key", "*.ts", "*.pem", "id_*", "src/**", "A/B/**", "a/b", "a/*/b", "**/lib", "*i*", "b\\src", "", "*", "x.ts", "src/**/a", "lib/"]
    for some in ([p] for p in patterns):
        want = dict((r.path, r.d) for r in spark.createDataFrame([(p,) for p in paths], "path string").select("path", P.denied("path", some).alias("d")).collect()) if some[0] in ("", "*", "*i*", "lib/") else None
        if want is not None:
            got = {r.path: r.denied for r in R.denied_by(spark.createDataFrame([(p,) for p in paths], "path string"), R.rule_index(spark.createDataFrame([(x,) for x in some], "pattern string"))).collect()}
            assert got == want, some
    table = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    got = {r.path: r.denied for r in R.denied_by(table, R.rule_index(spark.createDataFrame([(x,) for x in [*patterns[:11], None, *patterns[13:]]], "pattern string"))).collect()}
    want = {r.path: r.d for r in table.select("path", F.coalesce(P.denied("path", [*patterns[:11], *patterns[13:]]), F.lit(False)).alias("d")).distinct().collect()}
    assert got == want and not got[None]


def test_ten_thousand_rules_take_no_longer_for_each_path(spark):
    def took(n):
        began = time.time()
        rules = spark.range(n).select(F.concat(F.lit("*-"), "id", F.lit(".pem")).alias("pattern")).union(spark.range(n).select(F.concat(F.lit("src/d"), "id", F.lit("/**"))))
        paths = spark.range(20_000).select(F.concat(F.lit("lib/x"), "id", F.lit("/k-"), "id", F.lit(".PEM")).alias("path"))
        assert R.denied_by(paths, R.rule_index(rules)).where("denied").count() == min(n, 20_000)
        return time.time() - began

    took(10)
    assert took(10_000) < 4 * max(took(100), 1.5)
    none = spark.createDataFrame([], "path string")
    assert R.denied_by(none, R.rule_index(none.toDF("pattern"))).collect() == []
