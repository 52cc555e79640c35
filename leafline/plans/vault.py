"""A collection of records with the schemas that govern it: scan, derive, query, validate, analyse."""

from __future__ import annotations

import posixpath
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import derive, graph, infer, propose, query, validate
from ..operators import schema as schemas
from ..sources import records as sources


class Vault:
    """Records, and one effective schema for each directory that has any; a table's vault has one schema for all."""

    def __init__(self, spark: SparkSession, records: DataFrame, effective: dict[str, schemas.Schema], texts: dict[str, str] | None = None, listing: list | None = None):
        self.spark, self.records, self.effective, self.texts, self.listing = spark, records, effective, texts or {}, listing or []

    @classmethod
    def from_tree(cls, spark: SparkSession, root: str, *, allow_ungoverned: bool = False) -> Vault:
        listing = sources.inventory(root)
        texts = sources.schema_files(root, listing)
        parsed = {d: schemas.parse_schema(t, posixpath.join(d, ".stem")) for d, t in texts.items()}
        dirs = {posixpath.dirname(p) for p, is_dir in listing if not is_dir}
        effective = {d: schemas.merge(c) for d in dirs if (c := schemas.chain_for(parsed, d))}
        if not effective and not allow_ungoverned:
            raise schemas.SchemaError(f"no schema governs {root}")
        keep = lambda p: posixpath.dirname(p) in effective and schemas.in_scope(posixpath.basename(p), effective[posixpath.dirname(p)]) if effective else True
        return cls(spark, sources.scan_tree(spark, root, listing=listing, keep=keep), effective, texts, listing)

    @classmethod
    def from_table(cls, records: DataFrame, schema: schemas.Schema | None = None) -> Vault:
        return cls(records.sparkSession, records, {"": schema or schemas.Schema()})

    def groups(self) -> list[tuple[schemas.Schema, list[str] | None]]:
        """Distinct effective schemas and their directories: rules are compiled once for each."""
        out: dict[str, tuple[schemas.Schema, list[str]]] = {}
        for d, s in sorted(self.effective.items()):
            out.setdefault(repr(s), (s, []))[1].append(d)
        return [(s, None if len(out) == 1 else ds) for s, ds in out.values()]

    def each(self, f) -> DataFrame:
        parts = [f(self.records if dirs is None else self.records.filter(F.col("dir").isin(*dirs)), s) for s, dirs in self.groups()]
        return reduce(lambda a, b: a.unionByName(b), parts)

    def derived(self) -> Vault:
        """With derive, enrichment and roll-ups of every schema."""

        def one(df, s):
            linked = {r.field: (k, r.value_field or "estado") for k, r in s.links.rules.items() if r.field}
            for name, (kind, value_field) in linked.items():
                df = derive.linked_values(df, name, kind, value_field, among=self.records)
            df = derive.enrich(derive.derive(df, {k: str(v) for k, v in s.derive.items()}, linked=set(linked)), index_base=s.index_base)
            return df.drop(*[f"linked_{n}" for n in linked])

        out = self.each(one) if self.groups() else self.records
        kids: dict[str, list] = {}
        for s, dirs in self.groups():  # each schema's rules hold for its own index records, over all records below them
            r = {k: str(v) for k, v in s.aggregate.items()}
            own = {n: e for n, e in r.items() if not derive.names_in(derive.parse(e), "children")}
            where = F.lit(True) if dirs is None else F.col("dir").isin(*dirs)
            out = derive.rollup(out, own, index_base=s.index_base, where=where) if own else out
            if len(r) > len(own):
                kids.setdefault(s.index_base, []).append((where, {n: e for n, e in r.items() if n not in own}))
        for base, groups in kids.items():
            out = derive.rollup_children(out, {}, index_base=base, groups=groups)
        return Vault(self.spark, out, self.effective, self.texts, self.listing)

    def query(self, *where: str, sort: str | None = None, limit: int = 0, select: list[str] | None = None, enums: dict | None = None) -> DataFrame:
        """Filter, then sort, then limit, then projection; a limit after a sort becomes one top-k."""
        out = query.where(self.records, *where)
        if sort:
            root = self.effective.get("", schemas.Schema())
            out = query.sort(out, sort, enums=enums or {n: list(f.values) for n, f in root.fields.items() if f.type == "enum"})
        if limit:
            out = (out if sort else out.orderBy("scan_ord", "path")).limit(limit)
        return query.select(out, select) if select else out

    def count(self, *where: str) -> int:
        return query.where(self.records, *where).count()

    def files(self) -> DataFrame:
        """Paths that links may lead to: every file of the tree, records or not; a table's records."""
        found = [(p,) for p, is_dir in self.listing if not is_dir]
        return self.spark.createDataFrame(found, "path string") if found else self.records.select("path")

    def violations(self) -> DataFrame:
        """Violations of each record's schema, and its links checked against the files."""
        files = self.files()
        return self.each(lambda df, s: validate.violations(df, s).unionByName(validate.link_checks(df, s.links, files, self.records)))

    def drift(self) -> DataFrame:
        return self.each(lambda df, s: validate.drift(df, [n for n, f in s.fields.items() if not f.match], index_base=s.index_base))

    def health(self) -> list[dict]:
        return schemas.health(self.texts, [p for p, is_dir in self.listing if not is_dir])

    def edges(self) -> DataFrame:
        return self.each(lambda df, s: graph.edges(df, s.links.effective_styles))

    def resolved_edges(self) -> DataFrame:
        fallback = any(s.links.basename_fallback for s in self.effective.values())
        return graph.resolve(self.edges(), self.files(), basename_fallback=fallback)

    def broken_links(self) -> DataFrame:
        return self.resolved_edges().filter("to is null")

    def proposals(self) -> DataFrame:
        return self.each(lambda df, s: propose.propose(df, validate.violations(df, s), s))

    def analyze(self, only: list[str] | None = None) -> dict:
        return infer.analyze(self.records, only)
