"""Dependency graphs of modules, from facts of a resolver.

Tables may have scope_id; then all scopes are built at once, each for itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixpoint import discard, settled
from ..functions.exprs import dependency_edge_id, glob_regex, package_name, parent_path, source_href

EXTERNAL = "group:external-packages"


def _key(df: DataFrame, *names: str) -> list[str]:
    """names, within a scope where tables have one: all tables of a call then
    have scope_id, and equal paths of two scopes have nothing to do with each other."""
    return [*(["scope_id"] if "scope_id" in df.columns else []), *names]


def choose_dependency(candidates: DataFrame) -> DataFrame:
    """One candidate for each (source, specifier) of up to three passes.

    candidates: (source, specifier, pass, could_not_resolve, type_only, and
    optionally commonjs). The order of passes depends on whether any candidate
    is type-only, on the source's extension and on the module system; the first
    resolvable one wins, else the first.
    """
    key = Window.partitionBy(*_key(candidates, "source", "specifier"))
    source = F.col("source").cast("string")
    cjs = F.col("commonjs") if "commonjs" in candidates.columns else F.lit(False)
    types_first = F.max("type_only").over(key)
    require_first = F.when(source.rlike(r"\.[cm][tj]s$"), source.rlike(r"\.c[tj]s$")).otherwise(F.max(cjs).over(key))
    rank = lambda *order: F.array_position(F.array(*map(F.lit, order)), F.col("pass"))
    preferred = F.when(types_first, rank("types", "import", "require")).when(require_first, rank("require", "import", "types")).otherwise(rank("import", "require", "types"))
    ranked = candidates.withColumn("_p", preferred).withColumn("_n", F.row_number().over(key.orderBy("could_not_resolve", "_p")))
    return ranked.filter("_n = 1").drop("_p", "_n")


def classify_targets(chosen: DataFrame, inventory: DataFrame) -> DataFrame:
    """(source, kind, target_type, target): chosen dependencies (source,
    specifier, resolved, could_not_resolve, type_only, core, external, boundary)
    against the collected files (path). A collected file, or a local module
    beyond the collection, wins; else the external package; others go."""
    files = inventory.select(*_key(inventory), F.col("path").alias("resolved"), F.lit(True).alias("collected")).distinct()
    d = chosen.filter("NOT could_not_resolve AND NOT core").join(files, _key(chosen, "resolved"), "left")
    local = F.coalesce("collected", F.lit(False)) | (~F.col("external") & F.col("boundary"))
    kind = F.when(F.col("type_only"), "type-only").otherwise("runtime")
    package = F.when(F.col("external"), package_name("specifier", "resolved"))
    out = d.select(*_key(chosen), "source", kind.alias("kind"), F.when(local, "local-module").otherwise("external-package").alias("target_type"), F.when(local, F.col("resolved")).otherwise(package).alias("target"))
    return out.filter("target IS NOT NULL")


def ancestor_directories(path: str) -> Column:
    """All directories above a path, with their depth, the top one (empty) too."""
    parts = F.split(parent_path(path), "/")
    deep = F.when(parent_path(path) == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))
    return F.transform(deep, lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("directory")))


def nearest_package(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """files (path) with package_root and package_name: the deepest directory
    above that holds a manifest (directory, name); the scope, '.', if none does.
    A manifest at the top is the scope itself."""
    key = _key(files, "path")
    up = files.select(*key, F.explode(ancestor_directories("path")).alias("a")).select(*key, "a.depth", "a.directory")
    # an equi-join on every directory above: no scan of ranges
    near = up.join(manifests.filter("directory <> ''"), _key(files, "directory")).groupBy(*key).agg(F.max_by(F.struct("directory", "name"), "depth").alias("m"))
    return files.join(near, key, "left").select(*files.columns, F.coalesce("m.directory", F.lit(".")).alias("package_root"), F.coalesce("m.name", F.lit("scope")).alias("package_name"))


def local_grouping(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From files (path, package_root, package_name): groups (group_id, title,
    parent_group_id) and the group of each file (path, group_id). A root that is
    alone at the top, with no ungrouped file beside it, is left out."""
    in_package = F.col("package_root") != "."
    root = F.when(in_package, F.col("package_root")).otherwise("")
    rest = F.when(in_package, F.substr(parent_path("path"), F.length(root) + 2)).otherwise(parent_path("path"))
    parts = F.filter(F.split(rest, "/"), lambda p: p != "")
    base = F.when(in_package, F.concat(F.lit("group:package:"), F.col("package_root")))
    full = lambda n: F.concat(F.lit("group:directory:"), F.array_join(F.concat(F.when(root == "", F.array().cast("array<string>")).otherwise(F.array(root)), F.slice(parts, 1, n)), "/"))
    # the places of the directories below the package, none if there is none
    places = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    chain = F.transform(places, lambda n: F.struct(full(n).alias("group_id"), F.element_at(parts, n).alias("title"), F.when(n > 1, full(n - 1)).otherwise(base).alias("parent_group_id")))
    package = F.when(in_package, F.array(F.struct(base.alias("group_id"), F.col("package_name").alias("title"), F.lit(None).cast("string").alias("parent_group_id")))).otherwise(F.array().cast("array<struct<group_id:string,title:string,parent_group_id:string>>"))
    scope = _key(files)
    files = files.withColumn("chain", F.concat(package, chain))
    groups = files.select(*scope, F.inline("chain")).dropDuplicates([*scope, "group_id"])
    own = files.select(*scope, "path", F.try_element_at("chain", F.lit(-1))["group_id"].alias("group_id"))
    # one row a scope at most: its sole root, with nothing beside it
    tops = groups.filter("parent_group_id IS NULL").select(*scope, "group_id", F.lit(1).alias("n")).unionByName(own.filter("group_id IS NULL").select(*scope, F.lit(None).cast("string").alias("group_id"), F.lit(1).alias("n")))
    omit = tops.groupBy(*scope).agg(F.sum("n").alias("n"), F.min("group_id").alias("omitted")).filter("n = 1 AND omitted IS NOT NULL").select(*scope, "omitted")
    at = lambda c: omit.withColumnRenamed("omitted", c).withColumn("gone", F.lit(True))
    kept = groups.join(at("group_id"), [*scope, "group_id"], "left_anti").join(at("parent_group_id"), [*scope, "parent_group_id"], "left")
    kept = kept.select(*scope, "group_id", "title", F.when(F.col("gone").isNull(), F.col("parent_group_id")).alias("parent_group_id"))
    own = own.join(at("group_id"), [*scope, "group_id"], "left").select(*scope, "path", F.when(F.col("gone").isNull(), F.col("group_id")).alias("group_id"))
    return kept, own


def boundary_nodes(targets: DataFrame, inventory: DataFrame) -> DataFrame:
    """(path): local targets that were not collected."""
    local = targets.filter("target_type = 'local-module'").select(*_key(targets), F.col("target").alias("path")).distinct()
    return local.join(inventory.select(*_key(inventory, "path")), _key(targets, "path"), "left_anti")


def external_nodes(targets: DataFrame) -> DataFrame:
    """(node_id, title, group_id, synthetic), one a package."""
    names = targets.filter("target_type = 'external-package'").select(*_key(targets, "target")).distinct()
    return names.select(*_key(targets), F.concat(F.lit("external:"), "target").alias("node_id"), F.col("target").alias("title"), F.lit(EXTERNAL).alias("group_id"), F.lit(True).alias("synthetic"))


def dependency_edges(targets: DataFrame) -> DataFrame:
    """(edge_id, source_node_id, target_node_id, kind), one a pair and kind."""
    node = F.when(F.col("target_type") == "local-module", F.concat(F.lit("file:"), "target")).otherwise(F.concat(F.lit("external:"), "target"))
    pairs = targets.select(*_key(targets), F.concat(F.lit("file:"), F.col("source").cast("string")).alias("source_node_id"), node.alias("target_node_id"), "kind").distinct()
    return pairs.select(dependency_edge_id("source_node_id", "target_node_id", "kind").alias("edge_id"), "*")


def build_module_graph(candidates: DataFrame, inventory: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(groups, nodes, edges) of a scope, or of all with scope_id: files collected
    and local modules beyond them by package and directory, external packages in
    one group, dependencies of collected files."""
    scope = _key(candidates)
    # each is made once, and its shuffles go before those of the next
    inventory = settled(inventory.select(*scope, "path").distinct())
    sources = inventory.select(*scope, F.col("path").alias("source"))
    chosen = settled(choose_dependency(candidates.join(sources, [*scope, "source"], "left_semi")))
    targets = settled(classify_targets(chosen, inventory))
    discard(chosen)
    outside = boundary_nodes(targets, inventory).withColumn("outside", F.lit(True))
    files = settled(nearest_package(inventory.withColumn("outside", F.lit(False)).unionByName(outside), manifests))
    groups, own = local_grouping(files)
    local = files.join(own, [*scope, "path"], "left").select(*scope, F.concat(F.lit("file:"), "path").alias("node_id"), F.element_at(F.split("path", "/"), -1).alias("title"), "group_id", F.lit(False).alias("synthetic"), "outside", source_href("path").alias("href"))
    external = external_nodes(targets)
    top = external.select(*scope, F.lit(EXTERNAL).alias("group_id"), F.lit("External packages").alias("title"), F.lit(None).cast("string").alias("parent_group_id"), F.lit(True).alias("synthetic")).distinct()
    nodes = local.unionByName(external, allowMissingColumns=True)
    return groups.withColumn("synthetic", F.lit(False)).unionByName(top), nodes, dependency_edges(targets)


def last_match(items: DataFrame, rules: list[tuple[str, bool]], column: str, default: bool) -> DataFrame:
    """items with selected: what the last rule (glob, whether it includes) that
    matches says. Rules are settings of a run, so they become one expression."""
    chosen = F.lit(default)
    for pattern, includes in rules:
        chosen = F.when(F.col(column).rlike(glob_regex(pattern)), includes).otherwise(chosen)
    return items.withColumn("selected", chosen)


def ignore_regex(pattern: str) -> str:
    """An ignore pattern, without its !, for paths that begin with a slash: it is
    anchored if it has a slash before its end, and takes whole segments."""
    directory = pattern.endswith("/")
    core = pattern.strip("/")
    anchored = "/" in pattern.rstrip("/")
    body = glob_regex(core)[1:-1]
    return ("^/" if anchored else "^/(?:.*/)?") + body + ("/$" if directory else "/?$")


def apply_ignore_rules(paths: DataFrame, rules: list[str], column: str = "path") -> DataFrame:
    """Paths (with a leading slash) that are not ignored. Later rules win, !
    includes again, and nothing comes back below an ignored directory."""
    def ignored(path: Column) -> Column:
        out = F.lit(False)
        for rule in rules:
            out = F.when(path.rlike(ignore_regex(rule.removeprefix("!"))), not rule.startswith("!")).otherwise(out)
        return out

    above = F.filter(ancestor_directories(column), lambda a: (a["directory"] != ""))
    blocked = F.exists(above, lambda a: ignored(F.concat(a["directory"], F.lit("/"))))
    return paths.filter(~blocked & ~ignored(F.col(column)))


def ignore_pattern(pattern: Column) -> Column:
    """ignore_regex of a column, for paths without a leading slash; directories
    end with one. The pattern is without its !."""
    escaped = F.regexp_replace(F.btrim(pattern, F.lit("/")), r"([\\.+()\[\]{}^$|])", r"\\$1")
    for plain, regex in (("**/", "\u0001"), ("**", "\u0002"), ("*", "[^/]*"), ("?", "[^/]"), ("\u0001", "(?:.*/)?"), ("\u0002", ".*")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(regex))
    anchored = F.contains(F.rtrim(pattern, F.lit("/")), F.lit("/"))
    return F.concat(F.when(anchored, "^").otherwise("^(?:.*/)?"), escaped, F.when(F.endswith(pattern, F.lit("/")), "/$").otherwise("/?$"))


def apply_directory_rules(paths: DataFrame, rules: DataFrame, always: tuple[str, ...] = (".git", "node_modules")) -> DataFrame:
    """paths (scope_id, path) that no rule ignores.

    rules (scope_id, directory, ordinal, pattern): a directory's ignore file, in
    order; '' is the scope's top, and a null directory stands for rules of the
    call, which come after all others. A directory's rules hold for what is in it,
    after those of the directories above, and are matched with paths from the
    scope's top; the last that matches decides, ! includes again. What is in an
    ignored directory stays ignored. Blank lines and comments are no rules.

    Directories are looked at once, however many files they hold; rules meet them
    by an equi-join on the directories above.
    """
    text = F.regexp_replace(F.rtrim("pattern"), "^!", "")
    rules = rules.filter("rtrim(pattern) <> '' AND NOT startswith(pattern, '#')").select("scope_id", "directory", "ordinal", ignore_pattern(text).alias("regex"), (~F.startswith("pattern", F.lit("!"))).alias("ignores"))
    parts = F.split("path", "/")
    level = lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("entry"), (n < F.size(parts)).alias("is_directory"))
    steps = paths.select("scope_id", "path").distinct().select("scope_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), level)).alias("s")).select("scope_id", "path", "s.*")
    entries = steps.select("scope_id", "entry", "is_directory").distinct()
    # what an entry is tested with: itself and the directories above, as rules below them see them too
    up = F.split("entry", "/")
    tested = lambda n: F.concat(F.array_join(F.slice(up, 1, n), "/"), F.when((n < F.size(up)) | F.col("is_directory"), "/").otherwise(""))
    above = entries.select("scope_id", "entry", F.explode(F.filter(ancestor_directories("entry"), lambda a: a["depth"] < F.size(up))).alias("a")).select("scope_id", "entry", "a.depth", "a.directory")
    of_directories = above.join(rules.filter("directory IS NOT NULL"), ["scope_id", "directory"]).select("scope_id", "entry", "depth", "ordinal", "regex", "ignores")
    of_call = entries.join(rules.filter("directory IS NULL"), "scope_id").select("scope_id", "entry", F.lit(1 << 30).alias("depth"), "ordinal", "regex", "ignores")
    tests = entries.select("scope_id", "entry", F.explode(F.transform(F.sequence(F.lit(1), F.size(up)), tested)).alias("test"))
    matched = of_directories.unionByName(of_call).join(tests, ["scope_id", "entry"]).filter(F.rlike("test", F.col("regex")))
    last = matched.groupBy("scope_id", "entry", "test").agg(F.max_by("ignores", F.struct("depth", "ordinal")).alias("ignores"))
    named = entries.filter(F.col("is_directory") & F.element_at(up, -1).isin(*always))
    ignored = last.filter("ignores").select("scope_id", "entry").union(named.select("scope_id", "entry")).distinct()
    blocked = steps.join(ignored, ["scope_id", "entry"], "left_semi").select("scope_id", "path").distinct()
    return paths.join(blocked, ["scope_id", "path"], "left_anti")
