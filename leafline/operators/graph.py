"""The link graph: resolution, broken links, suggestions, reciprocal edges, traces, cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import close_enough


def edges(records: DataFrame, styles: tuple[str, ...] = ("wikilink",), types: list[str] | None = None) -> DataFrame:
    """source, target (as written), type, line, style and anchor of the links of some styles and, if given, types."""
    e = records.select(F.col("path").alias("source"), "dir", F.explode("links").alias("l")).select("source", "dir", "l.target", "l.type", "l.line", "l.style", "l.anchor")
    e = e.filter(F.col("style").isin(*styles))
    return e if types is None else e.filter(F.col("type").isin(*types))


def clean(path):
    """A slash path without dots, from the root; null if it leaves the root."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    none = F.lit(None).cast("array<string>")

    def step(held, x):
        up = F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.lit(0), F.size(held) - 1))).otherwise(none)
        return F.when(held.isNull(), none).when(x == "..", up).otherwise(F.concat(held, F.array(x)))

    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def decoded(c):
    """%xx decoded; text that isn't valid stays, and + is itself."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def resolve(e: DataFrame, nodes: DataFrame, *, basename_fallback: bool = False) -> DataFrame:
    """edges with to, the path of the record that the target names, or null.

    A target counts from its record's directory (from the root with a leading slash), decoded; without an exact record .md is added
    for wikilinks, then a directory's README.md is tried, then, if allowed, the only record of that base name. Three equi-joins.
    """
    t = decoded(F.col("target"))
    rel = F.when(t.startswith("/"), t).when(F.col("dir") == "", t).otherwise(F.concat_ws("/", "dir", t))
    e = e.withColumn("rel", clean(rel))
    tries = F.array(F.col("rel"), F.when(F.col("style") == "wikilink", F.concat("rel", F.lit(".md"))), F.when(F.col("rel") == "", F.lit("README.md")).otherwise(F.concat("rel", F.lit("/README.md"))))
    e = e.withColumn("eid", F.monotonically_increasing_id())
    each = e.select("eid", F.posexplode(tries).alias("rank", "path")).filter("path is not null")
    hit = each.join(nodes.select("path"), "path").groupBy("eid").agg(F.min(F.struct("rank", "path")).alias("h"))
    out = e.join(hit, "eid", "left").withColumn("to", F.col("h.path"))
    if basename_fallback:
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
        unique = nodes.groupBy(stem.alias("name")).agg(F.count("*").alias("n"), F.first("path").alias("only")).filter("n = 1").select("name", "only")
        out = out.join(unique, F.regexp_replace("target", r"\.md$", "") == unique["name"], "left").withColumn("to", F.coalesce("to", F.when(~F.col("target").contains("/"), F.col("only")))).drop("name", "only")
    return out.drop("eid", "h", "rel")


def broken(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target, …) whose target is no node."""
    return e.join(nodes.select(F.col("path").alias("target")), "target", "left_anti")


def near_names(wanted: DataFrame, names: DataFrame) -> DataFrame:
    """word and name, each pair once, of names within max(2, a third of the length) edits of a word, case aside.

    So many edits leave one of a word's pieces whole, if it has a piece more than edits, and move it by no more places than there are
    edits: pieces meet names by characters and place. Words too short for pieces of two characters meet names of like length, which
    are short as well. Both are equi-joins, and only pairs near enough are shuffled again.
    """
    low = F.lower("word")
    edits = F.greatest(F.lit(2), F.floor(F.length("word") / 3)).cast("int")
    wanted = wanted.select("word", low.alias("low"), edits.alias("edits"), F.length(low).alias("long")).distinct()
    names = names.select("name", F.lower("name").alias("low_name"), F.length(F.lower("name")).alias("size")).distinct()
    short = F.col("long") < 2 * (F.col("edits") + 1)
    sizes = wanted.filter(short).withColumn("size", F.explode(F.sequence(F.greatest(F.lit(0), F.col("long") - F.col("edits")), F.col("long") + F.col("edits"))))
    alike = sizes.join(names, "size").filter(close_enough(F.col("word"), F.col("name"))).select("word", "name")

    begin = lambda i: F.floor(i * F.col("long") / (F.col("edits") + 1)).cast("int")
    piece = lambda i: F.struct(begin(i).alias("at"), F.col("low").substr(begin(i) + 1, F.least(F.lit(3), begin(i + 1) - begin(i))).alias("gram"))
    pieces = wanted.filter(~short).select("word", "long", "edits", F.explode(F.transform(F.sequence(F.lit(0), F.col("edits")), piece)).alias("p"))
    pieces = pieces.select("word", "long", "edits", "p.gram", F.explode(F.sequence(F.greatest(F.lit(0), F.col("p.at") - F.col("edits")), F.col("p.at") + F.col("edits"))).alias("at"))
    grams = lambda i: F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.struct(i.alias("at"), F.col("low_name").substr(i + 1, n).alias("gram"), n.alias("n")))
    held = names.filter("size > 1").select("name", "size", F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.col("size") - 2), grams))).alias("g"))
    held = held.filter(F.col("g.at") + F.col("g.n") <= F.col("size")).select("name", "size", "g.at", "g.gram")
    met = pieces.join(held, ["gram", "at"]).filter(F.abs(F.col("long") - F.col("size")) <= F.col("edits"))
    return alike.unionByName(met.filter(close_enough(F.col("word"), F.col("name"))).select("word", "name").distinct())


def suggestions(broken_: DataFrame, names: DataFrame, *, most: int = 3, column: str = "target") -> DataFrame:
    """source, target, rank and suggestion: at most the nearest names of each broken target, each once, ties in lexical order."""
    wanted = broken_.select(F.col(column).alias("word")).distinct()
    near = near_names(wanted, names.select("name")).withColumn("distance", F.levenshtein(F.lower("word"), F.lower("name")))
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("distance", "name"))).filter(F.col("rank") <= most)
    return broken_.join(top.select(F.col("word").alias(column), "rank", F.col("name").alias("suggestion"), "distance"), column)


def missing_back_references(e: DataFrame, exempt: tuple[str, ...] = ("blocks", "parent", "depends")) -> DataFrame:
    """Edges of other types without an edge the other way."""
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return e.filter(~F.col("type").isin(*exempt)).join(back, ["source", "target"], "left_anti")


def trace(e: DataFrame, starts: DataFrame, *, depth: int = 0, reverse: bool = False, edge_type: str | None = None) -> DataFrame:
    """start, node and depth of what is reachable, each at its first depth; depth 0 has no limit. One join a level, visited nodes out."""
    if edge_type is not None:
        e = e.filter(F.col("type") == edge_type)
    step = e.select(F.col("target" if reverse else "source").alias("node"), F.col("source" if reverse else "target").alias("next")).distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    front, level = seen, 0
    durable = e.sparkSession.sparkContext.getCheckpointDir() is not None
    while not depth or level < depth:
        level += 1
        front = front.join(step, "node").select("start", F.col("next").alias("node")).distinct().join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(level))
        front = front.checkpoint() if durable else front.persist()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def reachable_pairs(e: DataFrame, nodes: DataFrame, *, depth: int = 0) -> DataFrame:
    return trace(e, nodes, depth=depth).filter("depth > 0")


def cycle_members(e: DataFrame) -> DataFrame:
    """Nodes on a cycle, loops included.

    Nodes without an edge in or out are stripped round by round (they lie on no cycle); a node of what stays is on a cycle if it
    reaches itself, which a forward closure over the rest tells.
    """
    e = e.select("source", "target").distinct()
    durable = e.sparkSession.sparkContext.getCheckpointDir() is not None
    loops = e.filter("source = target").select(F.col("source").alias("node"))
    e = e.filter("source <> target")
    before = -1
    while True:
        e = e.join(e.select(F.col("source").alias("target")).distinct(), "target", "left_semi").join(e.select(F.col("target").alias("source")).distinct(), "source", "left_semi").select("source", "target")
        e = e.checkpoint() if durable else e.persist()
        n = e.count()
        if n == before:
            break
        before = n
    closure, size = e.select("source", "target"), before
    while True:  # path doubling: the closure's size bounds the rounds by the logarithm of the longest path
        longer = closure.join(closure.select(F.col("source").alias("target"), F.col("target").alias("end")), "target").select("source", F.col("end").alias("target"))
        closure_ = closure.unionByName(longer).distinct()
        closure_ = closure_.checkpoint() if durable else closure_.persist()
        n = closure_.count()
        if n == size:
            break
        closure, size = closure_, n
    return closure.filter("source = target").select(F.col("source").alias("node")).unionByName(loops).distinct()


def dfs_cycles(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles that back edges of one lexical depth-first forest close, each from its smallest member, sorted. For one graph on the driver."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(pairs)):
        out.setdefault(a, []).append(b)
    color: dict[str, int] = {}
    found = set()
    for start in sorted({*out, *(b for _, b in pairs)}):
        if start in color:
            continue
        path, stack = [start], [iter(out.get(start, ()))]
        color[start] = 1
        while stack:
            nxt = next(stack[-1], None)
            if nxt is None:
                stack.pop()
                color[path.pop()] = 2
            elif color.get(nxt) == 1:
                ring = path[path.index(nxt) :]
                k = ring.index(min(ring))
                found.add(tuple(ring[k:] + ring[:k]))
            elif nxt not in color:
                color[nxt] = 1
                path.append(nxt)
                stack.append(iter(out.get(nxt, ())))
    return [list(c) for c in sorted(found)]


#: Edges that cycles() takes to the driver at most; cycle_members() has no such bound.
DRIVER_EDGES = 1_000_000


def cycles(e: DataFrame, *, most_edges: int = DRIVER_EDGES) -> list[list[str]]:
    """The cycles of dfs_cycles among the edges between cycle members."""
    members = cycle_members(e)
    kept = e.select("source", "target").distinct().join(members.select(F.col("node").alias("source")), "source", "left_semi").join(members.select(F.col("node").alias("target")), "target", "left_semi")
    if (n := kept.count()) > most_edges:
        raise ValueError(f"{n} edges on cycles: use cycle_members()")
    return dfs_cycles([(r.source, r.target) for r in kept.collect()])


def dot(e: DataFrame) -> DataFrame:
    """One line of Graphviz for each edge."""
    q = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return e.select(F.concat(F.lit("  "), q(F.col("source")), F.lit(" -> "), q(F.col("target")), F.lit(";")).alias("value"))


def mermaid_id(c):
    return F.concat(F.lit("n_"), F.lower(F.hex(c.cast("binary"))))
