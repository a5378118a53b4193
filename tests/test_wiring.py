"""Mounts, modules, exposure and schema history on small made-up tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from evigraph.functions.paths import column_hint, documented_route, is_migration_path, is_store_list, own_origin, snake, with_api_prefix
from evigraph.operators import exposure as X
from evigraph.operators import modules as M
from evigraph.operators import mounts as R
from evigraph.operators import schema_history as H

LINKS = "parent string, child string, place int, prefix string, dependencies array<string>, inherit boolean"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def routers(spark, *names):
    return spark.createDataFrame([(n, f"/{n}", [f"d{n}"]) for n in names], "router string, prefix string, dependencies array<string>")


def test_mounts_on_circles(spark):
    links = spark.createDataFrame([("app", "a", 0, "", ["x"], True), ("a", "b", 0, "", [], True), ("b", "a", 1, "/r", [], True), ("p", "q", 0, "", [], True), ("q", "p", 0, "", [], True), ("q", "z", 0, "", [], True)], LINKS)
    ways, issues = R.mount_variants(routers(spark, "app", "a", "b", "p", "q", "z"), links)
    assert rows(ways, "router", "prefix") == [("a", "/app/a"), ("app", "/app"), ("b", "/app/a/b")]
    assert rows(issues, "router", "issue") == [("p", "cycle"), ("q", "cycle"), ("z", "cycle")]
    found = {r.router: r for r in R.effective_mounts(routers(spark, "app", "a", "b", "p", "q", "z"), links).collect()}
    assert found["p"].cyclic and found["p"].prefix == "/q/p" and found["q"].prefix == "/p/q" and not found["z"].cyclic
    assert found["z"].prefix == "/p/q/z" and found["app"].dependencies == ["dapp"]


def test_shared_dependencies_and_many_ways(spark):
    links = spark.createDataFrame([("app", m, i, f"/{i}", [f"only{i}"], True) for i, m in enumerate(("l", "m", "n"))] + [(m, "k", i, "", ["all"], True) for i, m in enumerate(("l", "m", "n"))] + [("k", "j", 0, "", [], False)], LINKS)
    some = routers(spark, "app", "l", "m", "n", "k", "j")
    found = {r.router: (r.prefix, r.dependencies) for r in R.effective_mounts(some, links).collect()}
    assert found["k"] == ("/app/0/l/k", ["dapp", "all", "dk"])
    ways, issues = R.mount_variants(some, links, most=2)
    assert rows(issues, "router", "issue") == [("j", "too_many"), ("k", "too_many")]
    assert rows(R.served_routes(spark.createDataFrame([(1, "l", "/x", ["own"])], "route int, router string, path string, dependencies array<string>"), ways), "path", "dependencies") == [("/app/0/l/x", ["dapp", "only0", "dl", "own"])]


def test_chain_of_sixty_four_reexports_settles(spark):
    named = spark.createDataFrame([(f"f{i}", 0, "x", f"f{i + 1}", "x") for i in range(64)] + [("a", 0, "*", "b", "*"), ("a", 1, "*", "c", "*"), ("b", 0, "*", "a", "*"), ("a", 0, "mine", "b", "gone")], "file string, place int, public string, target string, imported string")
    defs = spark.createDataFrame([("f64", "x"), ("c", "y"), ("c", "default"), ("a", "own"), ("c", "own")], "file string, name string")
    wanted = spark.createDataFrame([("f0", "x"), ("b", "y"), ("a", "default"), ("b", "own"), ("a", "mine")], "file string, name string")
    got = {(r.file, r.name): (r.origin, r.origin_name, r.state) for r in M.export_origins(wanted, defs, named).collect()}
    assert got == {("f0", "x"): ("f64", "x", "found"), ("b", "y"): ("c", "y", "found"), ("a", "default"): (None, None, "missing"), ("b", "own"): ("a", "own", "found"), ("a", "mine"): (None, None, "missing")}


def test_configurations_inherit_and_circles_end(spark):
    kind = "folder string, extends string, base_url string, patterns array<struct<pattern: string, targets: array<string>>>"
    configs = spark.createDataFrame([("a", "b", None, None), ("b", "c", None, [("@/*", ["x/*"])]), ("c", None, "src", [("no/*", ["y"])]), ("p", "q", None, None), ("q", "p", None, None)], kind)
    assert {r.folder: (r.base, r.base_url) for r in M.inherited(configs).collect()} == {"a": ("b", "c/src"), "b": ("b", "c/src"), "c": ("c/src", "c/src"), "p": ("p", None), "q": ("q", None)}
    paths = spark.createDataFrame([("a/./b//../c",), ("../x",), ("a/..",)], "p string")
    assert [r[0] for r in paths.select(M.normal_path(F.col("p"))).collect()] == ["a/c", None, ""]


def test_what_may_be_reached_at_run_time_is_not_dead(spark):
    imports = spark.createDataFrame([(1, 2), (3, 4)], "src int, dst int")
    files = spark.createDataFrame([(i, True, i == 1, False, i == 2) for i in range(1, 5)], "id int, routes boolean, app boolean, entry boolean, dynamic boolean")
    assert X.route_exposure(files, imports).collect() == []
    assert {r.id: r.state for r in X.liveness(files, imports, files.where("app")).collect()} == {1: "reached", 2: "reached", 3: "unknown", 4: "unknown"}
    still = files.withColumn("dynamic", F.lit(False))
    assert rows(X.route_exposure(still, imports), "id", "exposure", "reason") == [(3, "unreachable", "nothing imports it"), (4, "unreachable", "3")]
    assert X.route_exposure(still.withColumn("app", F.lit(False)), imports).collect() == []


def test_a_reference_before_and_after_a_rename(spark):
    kind = "package string, table_name string, seq int, kind string, columns array<string>, column_name string, new_name string, path string"
    changes = spark.createDataFrame([("p", "t", 1, "create", ["a", "b"], None, None, "s.sql"), ("p", "t", 5, "rename", None, "a", "c", "s.sql"), ("p", "t", 9, "reshape", None, None, None, "s.sql")], kind)
    refs = spark.createDataFrame([(i, "p", "t", c, seq, "app.py", None, False) for i, (c, seq) in enumerate([("a", 0), ("a", 3), ("a", 6), ("c", 3), ("c", 6), ("z", 10)])], "ref_id int, package string, table_name string, column_name string, seq int, path string, outer_tables array<string>, redirected boolean")
    assert [r.verdict for r in H.judge_references(refs, changes).orderBy("ref_id").collect()] == ["no_table", "declared", "unknown", "unknown", "declared", "opaque"]


def test_path_functions(spark):
    one = lambda value, f: spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]
    for route, path, names in (
        ("/d/:from-:to", "/d/{from}-{to}", ["from", "to"]), ("orders/[id]", "/orders/{id}", ["id"]), ("/o/{id:int}/x", "/o/{id}/x", ["id"]), ("/[[...slug]]", "/{slug}", ["slug"]),
        ("/a/:id(\\d+)?/b", "/a/{id}/b", ["id"]), ("/a:/:1", "/a:/:1", []), ("/u/{user-id}", "/u/{user-id}", ["user-id"]),
    ):
        assert one(route, lambda c: documented_route(c)[0]) == path and one(route, lambda c: documented_route(c)[1]) == names, route
    for name, own in (("NEXT_PUBLIC_API_URL", True), ("apiBaseUrl", True), ("STRIPE_URL", False), ("public", False), ("VITE_SERVER", True), ("", True)):
        assert one(name, own_origin) == own, name
    assert one("STRIPE_URL", lambda c: own_origin(c, ("stripe_url",)))
    for path, yes in (("db/migrations/1.sql", True), ("alembic/versions/2.py", True), ("versions/2.py", False), ("migrations.py", False), ("my_migration_x/versions/a", True)):
        assert one(path, is_migration_path) == yes, path
    for route, below in (("/x", "/api/v1/x"), ("/api/v1/x", "/api/v1/x"), ("", "/api/v1"), ("api/v1", "api/v1"), ("/api/v10/", "/api/v1/api/v10/")):
        assert one(route, lambda c: with_api_prefix(c, "/api/v1/")) == below, route
    assert one("fooBar2ID", snake) == "foo_bar2_id"
    assert one("users, orders(read); a.b", is_store_list) and not one("writes users", is_store_list)
    hint = lambda columns, written: spark.createDataFrame([(columns, written)], "c array<string>, w string").select(column_hint(F.col("c"), F.col("w"))).first()[0]
    assert tuple(hint(["Name", "id"], "name")) == ("case", "Name") and tuple(hint(["user_id"], "userId")) == ("similar", "user_id") and hint(["Id", "ID"], "id") is None and hint(["a"], "b") is None
