"""Call graphs: ``functions(key, filepath, callees, lineno, end_lineno, ord)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.session import staged


class AmbiguousEntry(ValueError):
    """Several functions fit an entry point."""


def calls(functions: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``pos``; ``dst`` may be a bare name that is no key."""
    return functions.select(F.col("key").alias("src"), F.posexplode("callees").alias("pos", "dst")).select("src", "dst", "pos")


def short_name(c: str | Column = "key") -> Column:
    return F.element_at(F.split(F.col(c) if isinstance(c, str) else c, r"\."), -1)


def entry_points(functions: DataFrame, filepath: str, name: str) -> DataFrame:
    return functions.where((F.col("filepath") == filepath) & F.col("key").endswith("." + name))


def module_keys(functions: DataFrame, module: str | None = None, filepath: str | None = None) -> DataFrame:
    """Distinct keys of a file and of a module (inside, at either end of the dotted key)."""
    key = F.col("key")
    fits = F.lit(False)
    if filepath:
        fits = fits | (F.col("filepath") == filepath)
    if module:
        fits = fits | key.contains(f".{module}.") | key.startswith(module + ".") | key.endswith("." + module)
    return functions.where(fits).select("key").distinct()


def reachable(functions: DataFrame, start: DataFrame, rounds: int = 1000, hops: int = 4) -> DataFrame:
    """``key``, ``depth`` (least) of all functions that ``start`` (key) leads to, itself at 0.

    Calls of names that begin with an underscore aren't followed. The calls are
    staged once; a round takes ``hops`` joins along them and stages what is new,
    so the lineage doesn't grow, and visited keys are only ever anti-joined.
    """
    spark = functions.sparkSession
    links = staged(
        calls(functions).where(~F.col("dst").startswith("_")).join(functions.select(F.col("key").alias("dst")), "dst", "left_semi").select("src", "dst").distinct(), "calls"
    )
    seen = frontier = staged(start.select("key").distinct().withColumn("depth", F.lit(0)), "level")
    files = list(seen.inputFiles())
    for _ in range(rounds):
        level, found = frontier.select("key", "depth"), None
        for _ in range(hops):
            level = level.join(links, level["key"] == links["src"]).groupBy(F.col("dst").alias("key")).agg(F.min(F.col("depth") + 1).alias("depth"))
            found = level if found is None else found.unionByName(level)
        fresh = found.groupBy("key").agg(F.min("depth").alias("depth")).join(seen.select("key"), "key", "left_anti")
        frontier = staged(fresh, "level")
        if frontier.isEmpty():
            break
        files += frontier.inputFiles()
        seen = spark.read.schema("key string, depth int").parquet(*files)
    else:
        raise RuntimeError(f"calls go deeper than {rounds * hops} levels; allow more rounds")
    return seen


def enrich(functions: DataFrame, filepath: str, name: str) -> DataFrame | None:
    """The subgraph that an entry point leads to; None if there is no such function."""
    start = entry_points(functions, filepath, name).select("key")
    found = [r["key"] for r in start.limit(2).collect()]
    if not found:
        return None
    if len(found) > 1:
        raise AmbiguousEntry(f"several functions named {name} in {filepath}")
    return functions.join(reachable(functions, start).select("key"), "key", "left_semi")


def direct_callers(functions: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of functions that call a key in ``targets``, without the targets themselves."""
    keys = targets.select("key").distinct()
    callers = calls(functions).join(keys.withColumnRenamed("key", "dst"), "dst", "left_semi").select(F.col("src").alias("key")).distinct()
    return functions.join(callers, "key", "left_semi").join(keys, "key", "left_anti").select(functions.columns)


def dependents(functions: DataFrame, targets: DataFrame) -> DataFrame:
    """``filepath`` and the sorted distinct ``names`` of functions in it that call a target."""
    keys = targets.select(F.col("key").alias("dst")).distinct()
    callers = calls(functions).join(keys, "dst", "left_semi").select(F.col("src").alias("key")).distinct()
    return functions.join(callers, "key", "left_semi").groupBy("filepath").agg(F.sort_array(F.collect_set(short_name())).alias("names"))


def indirect_callers(functions: DataFrame, start: DataFrame, depth: int = 3) -> DataFrame:
    """``key``, ``depth`` (least) of functions from which ``start`` is reached in up to ``depth`` calls; ``start`` excluded."""
    edges = calls(functions).select("src", "dst").distinct()
    keys = start.select("key").distinct()
    found = None
    frontier = keys
    for level in range(1, depth + 1):
        up = edges.join(frontier.withColumnRenamed("key", "dst"), "dst", "left_semi").select(F.col("src").alias("key")).distinct().join(keys, "key", "left_anti")
        if found is not None:
            up = up.join(found.select("key"), "key", "left_anti")
        here = up.withColumn("depth", F.lit(level))
        found = here if found is None else found.unionByName(here)
        frontier = up
    return found


def external_calls(functions: DataFrame) -> DataFrame:
    """Calls whose target is no key of the graph."""
    return calls(functions).join(functions.select(F.col("key").alias("dst")), "dst", "left_anti").select("src", "dst", "pos")


def is_test(filepath: str | Column = "filepath") -> Column:
    return (F.col(filepath) if isinstance(filepath, str) else filepath).rlike("(?i)test")


def impact_level(total: Column) -> Column:
    """High above ten affected functions, Medium above three, else Low."""
    return F.when(total > 10, "High").when(total > 3, "Medium").otherwise("Low")


def change_impact(functions: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """One row: ``direct``, ``indirect``, ``files``, ``tests``, ``level`` for a change of ``targets``."""
    near = direct_callers(functions, targets).select("key", "filepath").withColumn("_direct", F.lit(True))
    # depth 1 of the indirect callers calls a direct caller
    far = indirect_callers(functions, near.select("key"), depth).select("key").join(functions.select("key", "filepath"), "key").withColumn("_direct", F.lit(False))
    return near.unionByName(far).agg(
        F.count(F.when(F.col("_direct"), 1)).alias("direct"),
        F.count(F.when(~F.col("_direct"), 1)).alias("indirect"),
        F.countDistinct("filepath").alias("files"),
        F.countDistinct(F.when(is_test(), F.col("filepath"))).alias("tests"),
    ).select("direct", "indirect", "files", "tests", impact_level(F.col("direct") + F.col("indirect")).alias("level"))


def callers_by_file(functions: DataFrame, targets: DataFrame) -> DataFrame:
    """``filepath``, ``callers`` (``name``, ``lineno``, in order) of the direct callers of ``targets``."""
    named = direct_callers(functions, targets).select("filepath", F.struct("ord", short_name().alias("name"), "lineno").alias("c"))
    return named.groupBy("filepath").agg(F.transform(F.sort_array(F.collect_list("c")), lambda c: F.struct(c["name"].alias("name"), c["lineno"].alias("lineno"))).alias("callers"))


def callers_by_depth(functions: DataFrame, targets: DataFrame, depth: int = 3) -> DataFrame:
    """``depth``, ``callers`` (``key``, ``name``, ``filepath``, by key as people sort) of the indirect callers of ``targets``."""
    near = direct_callers(functions, targets).select("key")
    far = indirect_callers(functions, near, depth).join(functions.select("key", "filepath"), "key")
    place = F.row_number().over(Window.partitionBy("depth").orderBy(F.expr("collate(key, 'UNICODE')")))
    sorted_ = far.select("depth", F.struct(place.alias("k"), "key", short_name().alias("name"), "filepath").alias("c"))
    shown = lambda c: F.struct(c["key"].alias("key"), c["name"].alias("name"), c["filepath"].alias("filepath"))
    return sorted_.groupBy("depth").agg(F.transform(F.sort_array(F.collect_list("c")), shown).alias("callers"))


def impact_text(functions: DataFrame, targets: DataFrame, title: str, root: str = "") -> str:
    """The impact of a change as text: direct callers by file, indirect ones by depth, tests, level. It is for a person to read, so it is read whole."""
    short = lambda p: p.removeprefix(root.rstrip("/") + "/") if root else p
    near = sorted(callers_by_file(functions, targets).collect(), key=lambda r: r["filepath"])
    far = sorted(callers_by_depth(functions, targets).collect(), key=lambda r: r["depth"])
    total = change_impact(functions, targets).first()
    out = [f"# Change impact: {title}", "", "## Direct callers"]
    for r in near:
        out += [f"### {short(r['filepath'])}", *(f"- {c['name']} (line {'?' if c['lineno'] is None else c['lineno']})" for c in r["callers"])]
    out += ["" if near else "none", "## Indirect callers"]
    for r in far:
        out += [f"### Depth {r['depth']}", *(f"- {c['name']} in {short(c['filepath'])}" for c in r["callers"])]
    paths = {r["filepath"] for r in near} | {c["filepath"] for r in far for c in r["callers"]}
    out += ["" if far else "none", "## Tests", *(f"- {short(p)}" for p in sorted(paths) if "test" in p.lower())]
    return "\n".join([*out, "", f"Level {total['level']}: {total['direct']} direct, {total['indirect']} indirect, {total['tests']} test files"])


def call_report(subgraph: DataFrame) -> DataFrame:
    """Per function of a subgraph: callees in order, and callers within the subgraph."""
    inside = calls(subgraph).join(subgraph.select(F.col("key").alias("dst")), "dst", "left_semi").where("src <> dst")
    by = inside.groupBy(F.col("dst").alias("key")).agg(F.sort_array(F.collect_set("src")).alias("called_by"))
    return subgraph.join(by, "key", "left").select("key", "filepath", "lineno", "end_lineno", "callees", F.coalesce("called_by", F.array().cast("array<string>")).alias("called_by"))


def callee_locations(functions: DataFrame, of: DataFrame) -> DataFrame:
    """Callees of the functions in ``of`` with their file, or ``(external)``."""
    mine = calls(functions.join(of.select("key"), "key", "left_semi"))
    where = functions.select(F.col("key").alias("dst"), F.col("filepath").alias("_f"))
    return mine.join(where, "dst", "left").select(F.col("src").alias("key"), "pos", F.col("dst").alias("callee"), F.coalesce("_f", F.lit("(external)")).alias("location"))


def node_id(c: str | Column) -> Column:
    return F.regexp_replace(F.col(c) if isinstance(c, str) else c, "[^a-zA-Z0-9_]", "_")


def flowchart_edges(subgraph: DataFrame) -> DataFrame:
    """``src``, ``dst`` (drawing ids), ``label``, ``external``; self loops are left out."""
    links = calls(subgraph).join(subgraph.select(F.col("key").alias("dst"), F.lit(True).alias("_in")), "dst", "left")
    outside = F.col("_in").isNull()
    return (
        links.select(
            node_id("src").alias("src"), F.when(outside, node_id(F.concat(F.lit("ext_"), "dst"))).otherwise(node_id("dst")).alias("dst"), short_name("dst").alias("label"), outside.alias("external")
        )
        .where(F.col("external") | (F.col("src") != F.col("dst")))
        .distinct()
    )


def sequence_calls(subgraph: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``message`` of calls between different functions of a subgraph."""
    links = calls(subgraph).join(subgraph.select(F.col("key").alias("dst")), "dst", "left_semi").where("src <> dst")
    return links.select(node_id("src").alias("src"), node_id("dst").alias("dst"), short_name("dst").alias("message")).distinct()


#: Functions of a drawing, at most; larger ones are refused.
DRAWN = 2_000


def _drawn(subgraph: DataFrame) -> list:
    rows = subgraph.select("key", "ord").orderBy("ord").limit(DRAWN + 1).collect()
    if len(rows) > DRAWN:
        raise ValueError(f"more than {DRAWN} functions can't be drawn")
    return rows


def flowchart(subgraph: DataFrame, entry: str) -> str:
    """A flowchart as text; a subgraph is something a person looks at, so it is read whole. Its lines are fixed values."""
    rows = _drawn(subgraph)
    flat = lambda s: "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in s)
    out = ["graph TD", f'    {flat(entry)}["{entry.rsplit(".", 1)[-1]}"]', f"    style {flat(entry)} fill:#4CAF50,color:#fff,stroke:#2E7D32,stroke-width:3px"]
    out += [f'    {flat(r["key"])}["{r["key"].rsplit(".", 1)[-1]}"]' for r in rows if r["key"] != entry]
    for r in flowchart_edges(subgraph).orderBy("src", "dst").collect():
        if r["external"]:
            out += [f'    {r["dst"]}["{r["label"]}"]:::external', f"    {r['src']} -.-> {r['dst']}"]
        else:
            out.append(f"    {r['src']} --> {r['dst']}")
    return "\n".join([*out, "    classDef external fill:#f9f9f9,stroke:#ccc,stroke-dasharray: 5 5"])


def sequence(subgraph: DataFrame, entry: str) -> str:
    """A sequence diagram as text; its lines are fixed values."""
    keys = [r["key"] for r in _drawn(subgraph)]
    flat = lambda s: "".join(c if c.isascii() and (c.isalnum() or c == "_") else "_" for c in s)
    out = ["sequenceDiagram", *(f"    participant {flat(k)} as {k.rsplit('.', 1)[-1]}" for k in [entry, *(k for k in keys if k != entry)])]
    for r in sequence_calls(subgraph).orderBy("src", "dst").collect():
        out += [f"    {r['src']}->>+{r['dst']}: {r['message']}", f"    {r['dst']}-->>-{r['src']}: ok"]
    return "\n".join(out)


def summary(functions: DataFrame) -> DataFrame:
    """``functions``, ``files``, ``calls``, ``external``."""
    known = functions.select(F.col("key").alias("dst"), F.lit(1).alias("_in"))
    outside = calls(functions).join(known, "dst", "left").groupBy(F.col("src").alias("key")).agg(F.count(F.when(F.col("_in").isNull(), 1)).alias("_out"))
    return functions.select("key", "filepath", "callees").join(outside, "key", "left").agg(
        F.count("*").alias("functions"), F.countDistinct("filepath").alias("files"), F.coalesce(F.sum(F.size("callees")), F.lit(0)).alias("calls"), F.coalesce(F.sum("_out"), F.lit(0)).alias("external")
    )


def unique_keys(found: DataFrame) -> DataFrame:
    """Repeated keys get ``__2``, ``__3`` ... in order; the first keeps its name."""
    n = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    return found.withColumn("_n", n).withColumn("key", F.when(F.col("_n") > 1, F.concat("key", F.lit("__"), F.col("_n").cast("string"))).otherwise(F.col("key"))).drop("_n")


def resolve_names(functions: DataFrame) -> DataFrame:
    """Bare callee names replaced by a key that ends in them, of the same file first, else the first of all; unknown names
    stay; order kept, repeats dropped."""
    last = functions.groupBy(short_name().alias("name")).agg(F.min_by("key", "ord").alias("target"))
    near = functions.groupBy("filepath", short_name().alias("name")).agg(F.min_by("key", "ord").alias("own"))
    named = functions.select("key", "filepath", F.posexplode("callees").alias("pos", "name")).join(near, ["filepath", "name"], "left").join(last, "name", "left")
    done = named.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("own", "target", "name").alias("c")))).alias("_c"))
    return functions.drop("callees").join(done, "key", "left").withColumn("callees", F.coalesce(F.array_distinct(F.col("_c.c")), F.array().cast("array<string>"))).drop("_c").select(functions.columns)
