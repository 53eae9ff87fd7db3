"""Commands of one tenant are decided one after the other."""

from foldspark.operators import views


def test_later_commands_see_the_accepted_ones(spark):
    given = [
        (1, 1, "rename", "a", "ok", 4), (1, 2, "rename", "b", "ok", 5), (1, 3, "create", "c", "conflict", None), (1, 4, "rename", " ", "validation-error", None), (1, 5, "rename", "d", "ok", 6),
        (2, 1, "rename", "a", "not-found", None), (2, 2, "create", "\t", "validation-error", None), (2, 3, "rename", "b", "not-found", None), (2, 4, "create", "c", "ok", 1), (2, 5, "create", "d", "conflict", None), (2, 6, "rename", "e", "ok", 2),
    ]
    commands = spark.createDataFrame([r[:4] for r in reversed(given)], "tenant_id long, arrival long, kind string, company string")
    heads = spark.createDataFrame([(1, 3)], "tenant_id long, version long")
    out = views.tenant_commands(commands, heads).select("tenant_id", "arrival", "kind", "company", "status", "new_version")
    assert sorted(map(tuple, out.collect())) == given
