"""Where each output column of a query comes from, and the policy that follows from it.

Spark has analysed the query already; this reads the answer off the analysed plan, as metadata on the
driver, and changes nothing in it. Masks then go on top of the query as one projection, so the query
itself runs on raw values and keeps its pushdown, joins and groupings.

Needs a classic session: Spark Connect does not hand out plans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskweave.functions import policy as P
from maskweave.functions.text import unique_names
from maskweave.operators.masking import UNKNOWN, ColumnPolicy, Masking, mask


@dataclass(frozen=True, order=True)
class Relation:
    """A relation by all parts of its name: catalog, schema and table, or the folders and the name of its files."""

    parts: tuple[str, ...]
    mark: str = "."

    @property
    def name(self) -> str:
        return self.parts[-1]

    def last(self, n: int) -> str:
        return self.mark.join(self.parts[-n:])


Source = tuple[Relation, str]

# Operators that hand their children's columns on unchanged.
PASSES = frozenset(
    "SubqueryAlias Filter Sort GlobalLimit LocalLimit Limit Offset Tail Distinct Deduplicate ResolvedHint "
    "Repartition RepartitionByExpression RebalancePartitions Sample EventTimeWatermark WithCTE "
    "CTERelationDef Join Subquery DeduplicateWithinWatermark CollectMetrics".split()
)
TABLES = frozenset("LogicalRelation HiveTableRelation DataSourceV2Relation StreamingRelation StreamingRelationV2".split())
NO_DATA = frozenset("LocalRelation OneRowRelation Range".split())
# Expressions whose inside cannot be seen.
OPAQUE = frozenset(
    "PythonUDF PythonUDAF ScalaUDF ScalaAggregator HiveSimpleUDF HiveGenericUDF HiveUDAFFunction "
    "CallMethodViaReflection ApplyFunctionExpression V2ScalarUDF".split()
)


@dataclass(frozen=True)
class Flow:
    """Table columns that reach a value. ``identity`` is set when it is one such column, unchanged."""

    sources: frozenset[Source] = frozenset()
    identity: Source | None = None
    opaque: bool = False

    def __or__(self, other: Flow) -> Flow:
        return Flow(self.sources | other.sources, None, self.opaque or other.opaque)


@dataclass
class Lineage:
    """What a query reads: its output columns, all flows, the columns it filters by, its relations."""

    outputs: list[tuple[str, Flow]] = field(default_factory=list)
    statement: set[Source] = field(default_factory=set)
    filters: list[Source] = field(default_factory=list)
    identities: list[Relation] = field(default_factory=list)
    opaque: bool = False
    uncertain: bool = False

    @property
    def relations(self) -> list[str]:
        return [self.label(r) for r in self.identities]

    def label(self, relation: Relation) -> str:
        """The shortest end of a relation's name that no other relation of the statement has."""
        others = [r.parts for r in self.identities if r != relation]
        n = next((n for n in range(1, len(relation.parts)) if all(o[-n:] != relation.parts[-n:] for o in others)), len(relation.parts))
        return relation.last(n)


def _items(seq) -> Iterator:
    for i in range(seq.length()):
        yield seq.apply(i)


def _class(obj) -> str:
    return obj.getClass().getSimpleName().rstrip("$")


class _Reader:
    def __init__(self, tables: frozenset[str]):
        self.tables = tables
        self.flows: dict[int, Flow] = {}
        self.shared: dict[int, list[Flow]] = {}
        self.out = Lineage()

    def flow(self, attribute) -> Flow:
        return self.flows.get(attribute.exprId().id(), Flow(opaque=True))

    def outputs(self, node) -> list[Flow]:
        return [self.flow(a) for a in _items(node.output())]

    def assign(self, node, flows: list[Flow]) -> None:
        for a, f in zip(_items(node.output()), flows):
            self.flows[a.exprId().id()] = f

    def expression(self, e) -> Flow:
        """Everything that flows into an expression; a bare column keeps its identity."""
        name = _class(e)
        if name in ("AttributeReference", "OuterReference"):
            return self.flow(e if name == "AttributeReference" else e.e())
        if name == "Alias":
            return self.expression(e.child())
        total = Flow()
        if name in OPAQUE:
            total = Flow(opaque=True)
            if not e.deterministic():
                self.out.uncertain = True
        if hasattr(e, "plan") and name in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
            self.walk(e.plan())
            for f in self.outputs(e.plan()):
                total = total | f
        for child in _items(e.children()):
            total = total | self.expression(child)
        return total

    def reads(self, e) -> Flow:
        f = self.expression(e)
        self.out.statement |= f.sources
        self.out.opaque |= f.opaque
        return f

    def filters(self, e) -> None:
        for s in sorted(self.expression(e).sources):
            if s not in self.out.filters:
                self.out.filters.append(s)

    def relation(self, found: Relation) -> None:
        if found not in self.out.identities:
            self.out.identities.append(found)

    def walk(self, node) -> None:
        name = _class(node)
        if name == "UnionLoop":
            return self.recursion(node)
        if name == "View":
            return self.view(node)
        for child in _items(node.children()):
            self.walk(child)
        if name in TABLES:
            table = self.table_identity(node)
            self.relation(table)
            return self.assign(node, [Flow(frozenset({s}), s) for s in ((table, a.name()) for a in _items(node.output()))])
        if name in NO_DATA:
            return self.assign(node, [Flow() for _ in _items(node.output())])
        if name == "Project":
            return self.named(node.projectList())
        if name == "Aggregate":
            for e in _items(node.groupingExpressions()):
                self.reads(e)
            return self.named(node.aggregateExpressions())
        if name == "Window":
            return self.named(node.windowExpressions())
        if name == "Generate":
            f = self.reads(node.generator())
            for a in _items(node.generatorOutput()):
                self.flows[a.exprId().id()] = Flow(f.sources, None, f.opaque)
            return None
        if name in ("Union", "Intersect", "Except"):
            return self.positions(node, [self.outputs(c) for c in _items(node.children())])
        if name == "Expand":
            rows = [[self.reads(e) for e in _items(row)] for row in _items(node.projections())]
            return self.positions(node, rows)
        if name == "CTERelationRef":
            return self.assign(node, self.shared.get(node.cteId(), []))
        if name == "UnionLoopRef":
            return self.assign(node, self.shared.get(node.loopId(), []))
        if name == "LateralJoin":
            self.walk(node.right().plan())
            if node.condition().isDefined():
                self.filters(node.condition().get())
            return None
        if name == "CTERelationDef":
            self.shared[node.id()] = self.outputs(node.child())
        elif name in ("Filter", "Join"):
            condition = node.condition()
            if name == "Filter":
                self.filters(condition)
            elif condition.isDefined():
                self.filters(condition.get())
                self.reads(condition.get())
        elif name == "Sort":
            for e in _items(node.order()):
                self.reads(e)
        elif name not in PASSES:
            self.out.opaque = True
            self.assign(node, [Flow(opaque=True) for _ in _items(node.output())])
        return None

    def named(self, expressions) -> None:
        for e in list(_items(expressions)):
            self.flows[e.exprId().id()] = self.reads(e)

    def positions(self, node, rows: list[list[Flow]]) -> None:
        """Columns of a set operation: all sides flow, and no identity is left."""
        merged = []
        for column in zip(*rows):
            total = Flow()
            for f in column:
                total = total | f
            merged.append(total)
            self.out.statement |= total.sources
        self.assign(node, merged)

    def recursion(self, node) -> None:
        """A recursive query: what the recursion adds flows back in, until nothing new arrives."""
        self.walk(node.anchor())
        current = [Flow() | f for f in self.outputs(node.anchor())]
        while True:
            self.shared[node.id()] = current
            self.walk(node.recursion())
            grown = [a | b for a, b in zip(current, self.outputs(node.recursion()))]
            if grown == current:
                break
            current = grown
        self.assign(node, current)

    def view(self, node) -> None:
        """A view is its own relation: direct columns are the view's, computed ones see what is below.
        Names the caller lists as tables are tables, however they were registered."""
        table = _table(node.desc().identifier())
        own = [(table, a.name()) for a in _items(node.output())]
        if table.name in self.tables:
            self.relation(table)
            return self.assign(node, [Flow(frozenset({s}), s) for s in own])
        for child in _items(node.children()):
            self.walk(child)
        self.assign(node, [Flow(f.sources, s, f.opaque) for s, f in zip(own, self.outputs(node))])
        return None

    def table_identity(self, node) -> Relation:
        """A relation's whole name: from its catalog, or its path. One that has neither goes by its class, which no
        catalog entry has, so its columns are redacted. A Java object claims every attribute: go by class."""
        kind = _class(node)
        try:
            if kind == "HiveTableRelation":
                return _table(node.tableMeta().identifier())
            if kind in ("DataSourceV2Relation", "StreamingRelationV2"):
                known, catalog = node.identifier(), node.catalog()
                if known.isDefined():
                    above = [catalog.get().name()] if catalog.isDefined() else []
                    return Relation((*above, *known.get().namespace(), known.get().name()))
                # A table without a catalog is called by its format and its paths.
                return _files(node.table().name().partition(" ")[2].split(","))
            if kind == "StreamingRelation":
                source = node.dataSource()
                known = source.catalogTable()
                return _table(known.get().identifier()) if known.isDefined() else _files([source.options().get("path").get()])
            if node.catalogTable().isDefined():
                return _table(node.catalogTable().get().identifier())
            return _files([p.toString() for p in _items(node.relation().location().rootPaths())])
        except Exception:  # noqa: BLE001 - other sources have no path
            return Relation((kind,))


def _table(identifier) -> Relation:
    above = [x.get() for x in (identifier.catalog(), identifier.database()) if x.isDefined()]
    return Relation((*above, identifier.table()))


def _path(path: str) -> tuple[str, ...]:
    """The parts of a path, the last without its endings."""
    *folders, last = [x for x in path.split("/") if x]
    return (*folders, last.split(".")[0] or last)


def _files(paths: list[str]) -> Relation:
    """The files of one path, or the folder that holds those of all."""
    first, *more = map(_path, paths)
    n = len(first)
    for other in more:
        n = min(n, next((i for i, (a, b) in enumerate(zip(first, other)) if a != b), min(len(first), len(other))))
    return Relation(first[:n], "/")


def lineage(df: DataFrame, tables: frozenset[str] = frozenset()) -> Lineage:
    """Lineage of a DataFrame or of ``spark.sql(...)``. No job runs.

    ``tables`` are temporary views that stand for base tables, such as files registered under a name.
    """
    return lineage_of(df._jdf.queryExecution().analyzed(), tables)


def lineage_of(plan, tables: frozenset[str] = frozenset()) -> Lineage:
    """:func:`lineage` of an analysed plan."""
    reader = _Reader(tables)
    reader.walk(plan)
    reader.out.outputs = [(a.name(), reader.flow(a)) for a in _items(plan.output())]
    return reader.out


#: Entries by relation and column. A relation is named by the end of its whole name: ``orders``, ``sales.orders``,
#: ``spark_catalog.sales.orders``, or for files ``orders``, ``sales/orders``, ``/data/sales/orders.parquet``.
Catalog = dict[tuple[str, str], ColumnPolicy]


class Entries:
    """The entries of a catalog that apply to the relations of a statement.

    Of all names that a relation's whole name ends with, the longest counts. One name that is the longest for two
    relations doesn't say which it means, so neither has an entry and both are redacted.
    """

    def __init__(self, catalog: Catalog, relations: list[Relation]):
        self.catalog = catalog
        keys = {k: _path(k) if "/" in k else tuple(k.split(".")) for k in {r for r, _ in catalog}}
        whole = {parts: k for k, parts in keys.items()} | {(k,): k for k in keys}
        self.key: dict[Relation, str] = {}
        for r in relations:
            ends = [r.parts[-n:] for n in range(len(r.parts), 0, -1)]
            if found := next((whole[e] for e in ends if e in whole), None):
                self.key[r] = found
        named = list(self.key.values())
        self.key = {r: k for r, k in self.key.items() if named.count(k) == 1}

    def get(self, source: Source, default: ColumnPolicy | None = None) -> ColumnPolicy | None:
        relation, column = source
        return self.catalog.get((self.key.get(relation), column), default)


def _all_relations(found: Lineage) -> list[Relation]:
    """Relations that a statement reads, and views that its columns belong to."""
    views = {f.identity[0] for _, f in found.outputs if f.identity is not None}
    return [*found.identities, *sorted(views - set(found.identities))]


def _trusted(entry: ColumnPolicy) -> str:
    """An allowed column with paths hides parts of itself, so nothing computed from it may show."""
    return P.REDACT if entry.policy == P.ALLOW and entry.paths else entry.policy


def _inherited(sources: set[Source], entries: Entries) -> str:
    ranks = [P.POLICIES.index(_trusted(entries.get(s, UNKNOWN))) for s in sources]
    strictest = P.POLICIES[max(ranks, default=0)]
    return P.REDACT if strictest in (P.TOKEN, P.REDACT) else strictest


def output_policies(
    found: Lineage, catalog: Catalog, grain: str = "statement", parameter_policy: str = P.ALLOW
) -> list[ColumnPolicy]:
    """Policy of each output column.

    A direct column has its own entry. A computed one takes the strictest policy among the columns that
    flow: with ``statement`` grain those of the whole query, with ``column`` grain those that reach it.
    What cannot be followed is redacted.
    """
    entries = Entries(catalog, _all_relations(found))
    strange = any(r not in entries.key for r in found.identities)
    out = []
    for _, f in found.outputs:
        if f.identity is not None:
            out.append(entries.get(f.identity, UNKNOWN))
        elif grain == "statement" and (found.opaque or found.uncertain):
            out.append(ColumnPolicy(P.REDACT, basis="inherited"))
        elif f.opaque or found.uncertain:
            out.append(ColumnPolicy(P.REDACT, basis="inherited"))
        elif not found.identities:
            raised = P.REDACT if parameter_policy in (P.TOKEN, P.REDACT) else parameter_policy
            out.append(ColumnPolicy(raised, basis="parameter" if parameter_policy != P.ALLOW else "inherited"))
        elif strange and grain == "statement":
            out.append(ColumnPolicy(P.REDACT, basis="inherited"))
        else:
            flowing = set(f.sources) | found.statement if grain == "statement" else set(f.sources)
            out.append(ColumnPolicy(_inherited(flowing, entries), basis="inherited"))
    return out


def masked(
    df: DataFrame,
    catalog: Catalog,
    settings: Masking,
    tables: frozenset[str] = frozenset(),
    grain: str = "statement",
) -> DataFrame:
    """A query's result with every output column masked by what flows into it."""
    found = lineage(df, tables)
    names = unique_names([name for name, _ in found.outputs])
    policies = dict(zip(names, output_policies(found, catalog, grain, settings.floor)))
    return mask(df.toDF(*names), replace(settings, policies=policies))


FLOW_SCHEMA = "position int, output string, relation string, column string, direct boolean, opaque boolean"
IDENTITY_SCHEMA = "position int, output string, schema string, relation string, column string, direct boolean, opaque boolean"


def flow_rows(spark: SparkSession, found: Lineage) -> DataFrame:
    """Lineage as rows, one per output column and source column."""
    rows = []
    for i, (name, f) in enumerate(found.outputs, start=1):
        for relation, column in sorted(f.sources) or [(None, None)]:
            rows.append((i, name, relation and found.label(relation), column, f.identity == (relation, column), f.opaque))
    return spark.createDataFrame(rows, FLOW_SCHEMA)


def identity_rows(spark: SparkSession, found: Lineage) -> DataFrame:
    """:func:`flow_rows` with the whole name of each relation: ``schema`` is all above its last part."""
    rows = []
    for i, (name, f) in enumerate(found.outputs, start=1):
        for relation, column in sorted(f.sources) or [(None, None)]:
            above = relation and relation.mark.join(relation.parts[:-1])
            rows.append((i, name, above, relation and relation.name, column, f.identity == (relation, column), f.opaque))
    return spark.createDataFrame(rows, IDENTITY_SCHEMA)


def inherit(flows: DataFrame, policies: DataFrame, by: list[str]) -> DataFrame:
    """Relational form of the rule, for lineage kept as a table: the strictest policy of each group's
    source columns, as a computed column inherits it. An unknown column counts as redact. Where both tables have a
    ``schema``, it is part of a column's identity."""
    keys = [k for k in ("schema", "relation", "column") if k != "schema" or (k in flows.columns and k in policies.columns)]
    joined = flows.join(policies.select(*keys, "policy"), keys, "left")
    entry = F.coalesce("policy", F.lit(P.REDACT))
    return joined.groupBy(*by).agg(P.inherited(P.strictest_of_group(entry)).alias("policy"))


def flagged_filters(found: Lineage, catalog: Catalog) -> list[tuple[str, str, str, str]]:
    """Filter columns a reviewer should notice: (relation, column, flag, policy)."""
    out, entries = [], Entries(catalog, [*found.identities, *{r for r, _ in found.filters if r not in found.identities}])
    for source in found.filters:
        entry, named = entries.get(source), (found.label(source[0]), source[1])
        if entry is None:
            out.append((*named, "unclassified", ""))
        elif entry.policy != P.ALLOW:
            out.append((*named, "sensitive", entry.policy))
    return out


# Spark's parsed nodes of statements that write rows, and of queries. What is on neither list is DDL.
WRITES = {
    "InsertIntoStatement": "INSERT", "InsertIntoDir": "INSERT", "UpdateTable": "UPDATE", "DeleteFromTable": "DELETE",
    "MergeIntoTable": "MERGE",
}
QUERIES = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Tail Distinct Deduplicate Union Except Intersect Join LateralJoin "
    "AsOfJoin SubqueryAlias UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedInlineTable ResolvedInlineTable "
    "UnresolvedTableValuedFunction UnresolvedTVFAliases LocalRelation OneRowRelation Range Generate UnresolvedHaving "
    "WithWindowDefinition UnresolvedWith Pivot UnresolvedPivot Unpivot UnresolvedUnpivot Sample Window "
    "RepartitionByExpression Repartition RebalancePartitions UnresolvedHint RelationTimeTravel ScriptTransformation "
    "UnresolvedOrdinal UnionLoop UnresolvedWithCTERelations TimeTravelRelation".split()
)


def statement_kind(spark: SparkSession, sql: str) -> str:
    """Kind of one statement as Spark's own parser reads it; nothing is executed.

    The whole parsed tree counts, so a write behind WITH or FROM is a write. Only a tree made of known query nodes
    is a SELECT; scripts, commands and all else are DDL.
    """
    nodes, names = [spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)], []
    while nodes:
        node = nodes.pop()
        names.append(_class(node))
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    written = [WRITES[n] for n in names if n in WRITES]
    if written:
        return written[0]
    return "SELECT" if all(n in QUERIES for n in names) else "DDL"


def query_only(spark: SparkSession, sql: str) -> str:
    """``sql`` if it is a query; anything that Spark would execute at once is refused."""
    kind = statement_kind(spark, sql)
    if kind != "SELECT":
        raise ValueError(f"only a query can run here, not {kind}")
    return sql


def dry_run(
    spark: SparkSession, sql: str, catalog: Catalog, tables: frozenset[str] = frozenset(),
    decide: Callable[[str, bool], str] | None = None, params: dict | None = None,
) -> dict:
    """What a query would return and whether it would run, without reading a row."""
    kind = statement_kind(spark, sql)
    writes = kind in ("INSERT", "UPDATE", "DELETE", "MERGE")
    report = {"statement_type": kind, "outcome": decide(kind, writes) if decide else "run"}
    if kind != "SELECT":
        return report
    df = spark.sql(sql, args=params or {})
    found = lineage(df, tables)
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    names = unique_names([n for n, _ in found.outputs])
    policies = output_policies(found, catalog)
    return report | {
        "relations": found.relations,
        "estimated_bytes": int(str(size)),
        "columns": [(n, p.policy, p.basis) for n, p in zip(names, policies)],
        "filters": flagged_filters(found, catalog),
        "uncertain": found.uncertain,
        "opaque": found.opaque,
    }
