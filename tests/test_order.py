"""Row order and partitioning of the input must not show in any result."""

from conftest import rows
from pyspark.sql import functions as F

from checks import views
from trackuse.plans.site_use import find_sites, full_tables, recent_tables


def tables(locations):
    found = find_sites(locations, views.COARSE)
    out = full_tables(found, views.COARSE) | {
        f"recent_{k}": t for k, t in recent_tables(found, views.COARSE).items()
    }
    # sums of shares may differ in the last bit
    return {
        name: sorted(
            repr(r)
            for r in rows(
                df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
            )
        )
        for name, df in out.items()
    }


def test_shuffled_input_gives_the_same_tables(spark):
    fixes = views.fixes(spark, "/root/testdata/sf0.001")
    one = tables(fixes.orderBy("X", "timestamp").coalesce(1))
    other = tables(fixes.repartition(7).orderBy(F.desc("Y"), "timestamp"))
    assert len(one) == 9
    for name in one:
        assert one[name], name
        assert one[name] == other[name], name
