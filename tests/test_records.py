import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafline.functions.scalars import edit_distance
from leafline.operators import derive, evolve, graph, infer, query, schema, sinks, validate
from leafline.plans.vault import Vault
from leafline.sources import markdown, records

STEM = """version: 2
root: true
scope: {match: "*.md"}
schema:
  estado: {type: enum, values: [todo, done], required: true}
  title: {type: string, severity: warn}
derive: {slug: slugify(title), ready: 'all(deps, {# == "done"})'}
aggregate: {done_count: 'len(filter(descendants, {.estado == "done"}))'}
links: {blocks: {target: "^T", field: deps, value_field: estado}}
"""
FILES = {
    ".stem": STEM, "README.md": "---\nestado: todo\n---\n# Root\n", "a/README.md": "---\nestado: done\ndone_count: 5\n---\n",
    "a/T1.md": "---\nestado: done\ntitle: Uno Dos\n---\n# One\n\ntext\n\n## Notes\n[[blocks:T2]] `[[no]]`\n", "a/T2.md": "---\nestado: todo\n---\n[[blocks:T1]] [x](T1.md) ![i](p.png)\n",
    "a/_T3.md": "---\nestado: wrong\n---\n[[missing]]\n", "b/x.txt": "no", ".stemignore": "ignored*\n", "ignored.md": "x", "b/T9.md": "no metadata\n",
}


@pytest.fixture(scope="module")
def vault(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, text in FILES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(text)
    return Vault.from_tree(spark, str(root))


def test_scan_sees_hidden_names_and_ignores(vault):
    assert [r.path for r in vault.records.orderBy("scan_ord").collect()] == ["README.md", "a/README.md", "a/T1.md", "a/T2.md", "a/_T3.md", "b/T9.md"]


def test_derive_rollup_and_query(vault):
    v = vault.derived()
    got = {r.path: r for r in query.select(v.records, ["path", "slug", "ready", "done_count", "isIndex"]).collect()}
    assert got["a/T1.md"].slug == "uno-dos" and got["a/T1.md"].ready == "false" and got["a/T2.md"].ready == "true"
    assert got["README.md"].done_count == "1" and got["a/README.md"].done_count == "1" and got["a/README.md"].isIndex == "true"
    assert [r.path for r in v.query('estado == "done"', sort="path:desc", select=["path"]).collect()] == ["a/T1.md", "a/README.md"]
    assert v.count("isIndex") == 2


def test_validation_and_proposals(vault):
    v = vault.derived()
    bad = {(r.path, r.field, r.rule) for r in v.violations().collect()}
    assert ("a/_T3.md", "estado", "enum") in bad and ("b/T9.md", "estado", "required") in bad and ("a/README.md", "done_count", "aggregate") in bad
    kinds = {(r["type"], r["path"], r["to"]) for r in v.proposals().collect()}
    assert ("add_field", "b/T9.md", "todo") in kinds and ("propagate_aggregate", "a/README.md", "1") in kinds
    assert {r.target for r in vault.broken_links().collect()} == {"missing"}
    assert not [h for h in vault.health() if h["status"] == "fail"]


TREE = {
    ".stem": "version: 2\nroot: true\nscope: {match: '*.md'}\nschema: {estado: {type: string}}\n",
    "tasks/.stem": "version: 2\nderive: {blockers: len(deps)}\nlinks: {blocks: {field: deps, value_field: estado}, checks: {anchors: true, encoding: true}}\n",
    "tasks/A.md": "---\nestado: todo\n---\n[[blocks:../docs/B.md]] [[blocks:C]] [[../docs/B#part-one]] [[../docs/B#none]] [[pic.png]] [[no where]]\n", "tasks/C.md": "---\nestado: done\n---\n",
    "tasks/pic.png": "", "docs/B.md": "---\nestado: done\n---\n# Part One\n", "docs/README.md": "---\nestado: x\n---\n",
    "other/.stem": "version: 2\naggregate: {leak: len(descendants), inner: 'len(children)'}\nschema: {num: {type: sequence, prefix: A, digits: 2, match: {'T*': {prefix: T, digits: 3}}}}\n",
    "other/README.md": "---\nestado: x\n---\n", "other/deep/README.md": "---\nestado: x\n---\n", "other/deep/T1.md": "---\nestado: y\nnum: T001\n---\n", "other/deep/T2.md": "---\nnum: A01\n---\n", "other/deep/X.md": "---\nnum: oops\n---\n",
}


def test_schemas_see_other_scopes_records_but_not_their_rules(spark, tmp_path):
    for p, text in TREE.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(text)
    v = Vault.from_tree(spark, str(tmp_path)).derived()
    got = {r.path: r for r in query.select(v.records, ["path", "blockers", "leak", "inner"]).collect()}
    assert got["tasks/A.md"].blockers == "2"  # one of them under another schema
    assert got["docs/README.md"].leak is None and got["other/README.md"].leak == "3" and got["other/deep/README.md"].leak == "3"
    assert got["other/README.md"].inner == "1" and got["other/deep/README.md"].inner == "0"
    bad = {(r.path, r.rule, r.message) for r in v.violations().collect()}
    assert {x for x in bad if x[0] == "tasks/A.md"} == {("tasks/A.md", "link_anchor", "none not found in docs/B.md"), ("tasks/A.md", "link_resolve", "no where"), ("tasks/A.md", "link_encoding", "no where")}
    assert {x[0] for x in bad if x[1] == "sequence-format"} == {"other/deep/T2.md"}  # X.md isn't matched
    assert {r.target for r in v.broken_links().collect()} == {"no where"}


def test_analyze_runs_every_category(vault):
    for name, df in vault.analyze().items():
        assert not isinstance(df, str), (name, df)
        df.collect()


def test_sinks(vault, tmp_path):
    sinks.write_jsonl(vault.records, ["path", "estado"], str(tmp_path / "j"))
    sinks.write_csv(vault.records, ["path", "title"], str(tmp_path / "c"))
    assert "README.md" in sinks.tree_text(vault.records) and "estado" in sinks.text_table(query.select(vault.records, ["path", "estado"]))
    assert sinks.path_values({"a": {"b": [{"c": 1}, {"c": 2}]}}, "a.b[].c") == [1, 2]


def test_headings():
    body = "# A #\n\ntext\nmore\n===\n\n- # no\n\n> # no\n\n```\n# no\n```\n##NoSpace\n## B\n### C\n"
    assert [(s["heading"], s["level"]) for s in markdown.sections(body)] == [("A", 1), ("text more", 1), ("B", 2), ("C", 3)]
    assert [s["level"] for s in markdown.sections("plain")] == [0]


def test_metadata():
    got = markdown.extract("﻿---\na: yes\nb: 1\nc: [x, y]\nd: true\n---\n\nbody")
    assert got["fm"] == {"a": "yes", "b": 1, "c": ["x", "y"], "d": True} and got["body"] == "body"
    assert markdown.extract("---\na: 1\n# never closed [[x]]")["links"] == []
    assert markdown.extract("---\na: [1\nb: x\n---\n")["errors"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="-#=`~ >\n[]()ab:\"'|\t", max_size=80))
def test_extraction_never_crashes(text):
    assert markdown.extract(text)["body"] is not None


def test_schema_merge_and_health():
    parent = schema.parse_schema("version: 2\nroot: true\nschema: {a: {type: enum, values: [x], severity: error, source: body.h1}}\n", ".stem")
    child = schema.parse_schema("version: 2\nschema: {a: {type: enum, values: [x, y], severity: warn}, b: {type: sequence, match: {'T*': {prefix: T, digits: 3}}}}\n", "d/.stem")
    merged = schema.merge([parent, child])
    assert merged.fields["a"].severity == "error" and merged.fields["a"].source == "body.h1" and merged.fields["a"].values == ("x", "y")
    assert schema.compatibility(parent.fields["a"], child.fields["a"]) == ["values", "severity"]
    assert schema.for_record(merged, "d/T001.md").fields["b"].digits == 3 and "b" not in schema.for_record(merged, "d/x.md").fields
    with pytest.raises(schema.SchemaError):
        schema.parse_schema("version: 1\n")
    changes = schema.diff(parent, child)
    assert [c["kind"] for c in changes][:1] == ["source_changed"] and changes[0]["breaking"]


def test_cycles_and_traces(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("c", "d", "t"), ("e", "e", "t")], "source string, target string, type string")
    for n in (1, 4):
        assert graph.cycles(e.repartition(n)) == [["a", "b", "c"], ["e"]]
    assert sorted(r.node for r in graph.cycle_members(e).collect()) == ["a", "b", "c", "e"]
    starts = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.trace(e, starts).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}


def test_edits():
    text = "---\n# note\na: 1 # kept\nb: x\n---\nbody\n## S\nold\n## T\n"
    assert evolve.set_field(text, "b", "y: z") == text.replace("b: x", 'b: "y: z"')
    assert markdown.extract(evolve.set_section(text, "## S", "new"))["sections"]["## S"] == "new"
    assert "[[x]]" in evolve.insert_links(text, ["[[x]]"]) and evolve.title_of("my-new_file.md") == "My New File"


def test_empty_table(spark):
    df = spark.createDataFrame([], "id int, s string")
    r = records.lift(df, F.col("id").cast("string"), ["id", "s"])
    assert query.where(r, 's == "x"').count() == 0 and infer.field_stats(r).count() == 0 and derive.tree_totals(r).count() == 0
    assert validate.violations(r, schema.Schema(fields={"s": schema.Field("string", required=True)})).count() == 0


def test_suggestions_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abC") for _ in range(rng.randint(0, 14))) for _ in range(150)]

    def edited(w):
        for _ in range(rng.randint(0, len(w) // 3 + 1)):
            i = rng.randint(0, len(w))
            w = rng.choice([w[:i] + rng.choice("abc") + w[i:], w[:i] + w[i + 1 :], w[:i] + "x" + w[i + 1 :]])
        return w

    names = [edited(w) for w in words for _ in range(3)] + words[:20] + ["éa", "É" * 9, "ß" * 7]
    words += ["é" * 9, "ß" * 7 + "a"]
    bad = spark.createDataFrame([(w,) for w in words] + [(None,)], "target string")
    held = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = sorted((r.word, r.name) for r in graph.near_names(bad.select(F.col("target").alias("word")), held).collect())
    want = sorted((w, n) for w in set(words) for n in set(names) if edit_distance(w, n) <= max(2, len(w) // 3))
    assert got == want and len(want) > 1000
    top = {}
    for r in graph.suggestions(bad.distinct(), held).collect():
        top.setdefault(r.target, []).append((r["rank"], r.suggestion))
    for w in set(words):
        best = sorted((edit_distance(w, n), n) for x, n in want if x == w)[:3]
        assert sorted(top.get(w, [])) == [(i, n) for i, (_, n) in enumerate(best, 1)]


def test_text_renderings_say_what_they_leave_out(spark):
    df = spark.createDataFrame([(f"{d}/{i}",) for d in "ab" for i in range(3)], "path string")
    recs = records.lift(df, "path", [])
    assert sinks.tree_text(recs).split("\n")[:2] == [". [6]", "  a/ [3]"] and "more" not in sinks.tree_text(recs)
    assert sinks.tree_text(recs, 4).split("\n") == [". [6]", "  a/ [3]", "    0", "    1", "    2", "  b/ [3]", "    0", "... more than 4 records"]
    assert sinks.text_table(df.orderBy("path"), 2).split("\n") == ["path", "a/0", "a/1", "... more than 2 rows"]
    assert sinks.text_table(df.limit(0)) == "path"


def most_rows_read(spark, run) -> int:
    """The most rows that a stage read from shuffles while run() ran."""
    sc = spark.sparkContext
    store, gateway = sc._jsc.sc().statusStore(), sc._gateway
    stages = lambda: {s.stageId(): s.shuffleReadRecords() for s in (lambda x: [x.apply(i) for i in range(x.size())])(store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList()))}
    before = stages()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return max(n for k, n in stages().items() if k not in before)


def test_rollups_aggregate_before_rows_travel(spark):
    df = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("d/T"), F.col("id").cast("string"), F.lit(".md")).alias("path"), F.col("id").alias("n"))
    df = df.unionByName(spark.createDataFrame([(p, None) for p in ("README.md", "d/README.md", "e/README.md")], "path string, n long"))
    rules = {"all_": "len(descendants)", "even": "count(descendants, {.n % 2 == 0})", "low": "min(descendants, {.n})", "sum": "sum(map(filter(descendants, {.n > 3990}), {.n}))", "any_": "any(descendants, {.n == 7})", "none_": "none(descendants, {.n == 7})", "every": "all(descendants, {.n >= 0})"}
    out = derive.rollup(records.lift(df, "path", ["n"]), rules).filter("base = 'README.md'").select("path", *[derive.effective_text(n).alias(n) for n in rules])
    kids = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("d/"), F.col("id").cast("string"), F.lit("/README.md")).alias("path"))
    kids = records.lift(kids.unionByName(df.filter("n is null").select("path")), "path", [])
    below = derive.rollup_children(kids, {"kids": "len(children)"}).filter("depth < 3").select("path", derive.effective_text("kids").alias("kids"))
    found, limit = {}, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert most_rows_read(spark, lambda: found.update({r.path: tuple(r)[1:] for r in out.collect()})) < 100
        full = ("4000", "2000", "0", str(sum(range(3991, 4000))), "true", "false", "true")
        assert found == {"README.md": full, "d/README.md": full, "e/README.md": ("0", "0", None, "0", "false", "true", "true")}
        assert {r.path: r.kids for r in below.collect()} == {"README.md": "4002", "d/README.md": "4000", "e/README.md": "0"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_extraction_goes_by_frames(spark, monkeypatch):
    texts = [f"---\nn: {i}\n---\n# H{i}\n{'x' * i}\n[[T{i}]]\n" for i in range(60)]
    assert [len(x) for x in markdown.frames(["x" * 10] * 10 + ["x" * 90, ""], 25)] == [3, 3, 3, 2, 1]
    monkeypatch.setattr(records, "FRAME_CHARS", 100)
    df = spark.createDataFrame([(f"D{i}.md", t, i) for i, t in enumerate([*texts, "", None])], "path string, content string, scan_ord long").coalesce(1)
    got = {r.path: r for r in records.from_contents(df).collect()}
    assert len(got) == 62 and got["D60.md"].body == got["D61.md"].body == ""
    for i, t in enumerate(texts):
        r, want = got[f"D{i}.md"], markdown.extract(t)
        assert r.body == want["body"] and r.fm["n"]["text"] == str(i) and r.links[0].target == f"T{i}" and [s.heading for s in r.body_sections] == [f"H{i}"]


def test_linked_values_ask_for_all_their_targets_at_once(spark):
    rows = [
        ("a/S.md", None, ["T", "T.md", "b/T", "x", "../T9", "u", "twice", "none"]), ("T", "root", []), ("a/T.md", "own", []), ("a/b/T", "below", []), ("b/T", "other", []),
        ("c/x.md", "name", []), ("T9", "up", []), ("c/u.md", "one", []), ("d/u.md", "two", []), ("twice", "1", []), ("twice", "2", []), ("e/none", None, []),
    ]
    df = spark.createDataFrame(rows, "path string, v string, to array<string>")
    recs = records.lift(df, "path", ["v"], links=F.transform("to", lambda x: records.link(x, "uses")))
    out = derive.linked_values(recs, "vs", "uses", "v")
    assert {r.path: r.linked_vs for r in out.select("path", "linked_vs").collect() if r.linked_vs is not None} == {"a/S.md": ["root", "own", "below", "name", "up", "1", "2"]}
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # links travel to their targets once, and back to their records
        assert out.select("path", "linked_vs")._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
