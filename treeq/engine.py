"""The engine: queries in, DataFrames out."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.errors import NoContext, ProfileBlocked, ShapeError
from treeq.operators.computes import Callbacks
from treeq.plans.builder import PROFILES, Plan, names
from treeq.plans.federation import FederatedPlan
from treeq.plans.federation import plan as plan_federated
from treeq.plans.gql import Node, parse
from treeq.plans.stages import run_command
from treeq.policy import Context, Policy
from treeq.schema import Model, Registry
from treeq.sources.registry import Source, Sources

PAGE_SIZE, MAX_PAGE_SIZE = 50, 5000
NAMED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::|:(?P<name>[A-Za-z_]\w*)", re.DOTALL)


@dataclass
class Page:
    """One page of documents. total and hasMore are counted when they are asked for."""

    items: DataFrame
    every: DataFrame
    page: int
    page_size: int

    @property
    def total(self) -> int:
        return self.every.count()

    @property
    def has_more(self) -> bool:
        return self.page * self.page_size < self.total

    def with_total(self) -> DataFrame:
        """The items with a column total, in one plan."""
        return self.items.join(F.broadcast(self.every.agg(F.count(F.lit(1)).alias("total"))), how="cross")


#: Rows of a model in a federated query of the text profile.
TEXT_FEDERATED = 10_000
#: Words that statements begin with which only read; the last three follow a bracket.
READS = ("select", "values", "show", "describe", "desc", "explain", "table", "from", "union", "intersect", "except")
LITERAL = re.compile(r"--[^\n]*|/\*.*?\*/|'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`", re.DOTALL)


def statement(text: str) -> str:
    """read or write, by the statement's verb: the first word, or after WITH the first verb outside of brackets."""
    bare = LITERAL.sub(" ", text)
    while (flat := re.sub(r"\([^()]*\)", " ", bare)) != bare:
        bare = flat
    words = re.findall(r"[a-z_]+", bare.lower())
    if words[:1] == ["with"]:
        words = [w for w in words if w in ("select", "values", "insert", "update", "delete", "merge")]
    return "read" if (words[0] in READS if words else "(" in text) else "write"


class Engine:
    def __init__(self, spark: SparkSession, sources: dict[str, Source] | Source, policy: Policy | None = None, *, profile: str = "standard", sum_empty: str = "null", limit_rows: int | None = None, federated_rows: int | None = None, vector_rows: int | None = None) -> None:
        """limit_rows: rows that any table may have, federated_rows: that a model of a federated query may have, vector_rows: that $near may rank. More are an error when the query runs."""
        if profile not in PROFILES:
            raise ShapeError(f"unknown profile {profile}")
        self.spark, self.registry, self.policy, self.callbacks = spark, Registry(), policy or Policy(), Callbacks()
        self.sources = Sources(spark, sources if isinstance(sources, dict) else {"default": sources}, limit_rows)
        self.profile, self.sum_empty = profile, sum_empty
        self.federated_rows = TEXT_FEDERATED if federated_rows is None and profile == "text2query" else federated_rows
        self.vector_rows = vector_rows

    # models and callbacks

    def register(self, *specs: dict, ctx: Context | dict | None = None) -> list[Model]:
        self.policy.check_define(Context.of(ctx))
        if self.profile == "text2query" and any(s.get("triggers") for s in specs):
            raise ProfileBlocked("triggers are not for this profile")
        return self.registry.register_batch(list(specs))

    def set_fn(self, name: str, f: Callable, *, column: bool = False) -> None:
        self.callbacks.set_fn(name, f, column=column)

    def set_async_fn(self, name: str, f: Callable) -> None:
        self.callbacks.set_batch(name, f)

    def table(self, model: str) -> DataFrame:
        """All rows of a model, without a policy."""
        return self.sources.scan(self.registry[model])

    def with_policy(self, policy: Policy) -> Engine:
        """A view of this engine with other rules; models and sources are shared."""
        other = object.__new__(Engine)
        other.__dict__.update(self.__dict__, policy=policy)
        return other

    # reading

    def _plan(self, params: dict | None, ctx: Context | dict | None, route: dict | None) -> Plan:
        if self.profile == "text2query":
            if ctx is None:
                raise NoContext("this profile takes a context")
            if route:
                raise ProfileBlocked("routes are not for this profile")
        c = Context.of(ctx)
        self.policy.need_context(c)
        return Plan(self.registry, self.policy, lambda m: self.sources.scan(m, route), self.callbacks, params or {}, c, self.profile, self.sum_empty, lambda df, m: df if self.vector_rows is None else self.sources.capped(df, m, self.vector_rows))

    def query(self, gql: str, params: dict | None = None, ctx: Context | dict | None = None, *, route: dict | None = None) -> DataFrame:
        """The documents of a query, as one lazy plan."""
        return self._plan(params, ctx, route).query(parse(gql))

    def query_one(self, gql: str, params: dict | None = None, ctx: Context | dict | None = None, *, route: dict | None = None) -> DataFrame:
        """The first document."""
        node, params = parse(gql), dict(params or {})
        if node.value("$limit", params) is None and "$near" not in str(node.value("$condition", params)):
            node.clauses["$limit"] = "__one"
            params["__one"] = 1
        return self._plan(params, ctx, route).query(node)

    @staticmethod
    def resolve_page(node: Node, params: dict) -> tuple[int, int]:
        """page and page size, given by name or from $skip and $limit."""
        limit, skip = node.value("$limit", params), node.value("$skip", params)
        size = params.get("pageSize", limit or PAGE_SIZE)
        if not isinstance(size, int) or size < 1:
            raise ShapeError("a page has one row at least")
        size = min(size, MAX_PAGE_SIZE)
        page = params.get("page")
        if page is None:
            page = (skip or 0) // size + 1
        if not isinstance(page, int) or page < 1:
            raise ShapeError("pages are counted from 1")
        return page, size

    def query_with_count(self, gql: str, params: dict | None = None, ctx: Context | dict | None = None, *, route: dict | None = None) -> Page:
        node, params = parse(gql), dict(params or {})
        model = self.registry[node.name]
        if node.value("$group", params) is not None:
            raise ShapeError("pages are of documents, not of groups")
        self._no_relations(model, node.value("$condition", params))
        page, size = self.resolve_page(node, params)
        if "page" in params or node.value("$skip", params) is None:
            node.clauses["$skip"], params["__skip"] = "__skip", (page - 1) * size
        node.clauses["$limit"], params["__limit"] = "__limit", size
        plan = self._plan(params, ctx, route)
        every = plan.where(plan.rows(model), model, node.value("$condition", params)).select("_id")
        return Page(plan.query(node), every, page, size)

    def _no_relations(self, model: Model, condition: object) -> None:
        if any(k.partition(".")[0] in model.relations for k in names(condition)):
            raise ShapeError("relation predicates are not counted here")

    def matching(self, model: str, condition: object = None, ctx: Context | dict | None = None, *, route: dict | None = None) -> DataFrame:
        """The rows of a model that a condition keeps."""
        m, plan = self.registry[model], self._plan({}, ctx, route)
        self._no_relations(m, condition)
        return plan.where(plan.rows(m), m, condition)

    def count(self, model: str, condition: object = None, ctx: Context | dict | None = None, *, route: dict | None = None) -> int:
        return self.matching(model, condition, ctx, route=route).count()

    def exists(self, model: str, condition: object = None, ctx: Context | dict | None = None, *, route: dict | None = None) -> bool:
        return not self.matching(model, condition, ctx, route=route).select("_id").isEmpty()

    def explain(self, gql: str, params: dict | None = None, ctx: Context | dict | None = None, mode: str = "formatted") -> str:
        df = self.query(gql, params, ctx)
        jvm = self.spark.sparkContext._jvm
        return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def sql(self, text: str, params: dict | list | None = None, ctx: Context | dict | None = None) -> DataFrame:
        """Raw SQL over the registered models as views, with positional or named parameters. Named ones are all given and all used.

        It is for contexts that the policy leaves free: rows aren't filtered here.
        """
        c = Context.of(ctx)
        self.policy.need_context(c)
        if c is not None and not c.internal:
            raise ProfileBlocked("raw SQL is for internal contexts")
        if self.profile == "text2query":
            raise ProfileBlocked("raw SQL is not for this profile")
        if statement(text) != "read":
            raise ShapeError("raw SQL reads; models are written by their verbs")
        used = {m["name"] for m in NAMED.finditer(text) if m["name"]}
        if isinstance(params, list):
            if used:
                raise ShapeError("named and positional parameters are mixed")
        elif used != set(params or {}):
            missing, extra = used - set(params or {}), set(params or {}) - used
            raise ShapeError(f"parameters without a value: {sorted(missing)}; never used: {sorted(extra)}")
        for m in self.registry.models.values():
            if re.search(rf"\b{re.escape(m.name)}\b", text):
                self.sources.scan(m).createOrReplaceTempView(m.name)
        return self.spark.sql(text, args=params or None)

    def command(self, command: dict) -> DataFrame:
        """A reading command over collections by name; see plans.stages."""
        by_collection = {m.collection: m for m in self.registry.models.values()}
        return run_command(command, lambda name: self.sources.scan(by_collection[name] if name in by_collection else self.registry[name]))

    def federated(self, gql: str, params: dict | None = None, ctx: Context | dict | None = None) -> DataFrame:
        """A query whose models may lie in several sources, read from the links that plan() chooses."""
        node = parse(gql)
        chosen = self.federated_plan(gql).links
        plan = self._plan(params, ctx, None)

        def scan(m: Model) -> DataFrame:
            where = chosen.get(m.name)
            df = self.sources.scan(m) if where is None else self.sources.scan(m, {"source": where.source, "database": where.database, "schema": where.schema})
            return df if self.federated_rows is None else self.sources.capped(df, m, self.federated_rows)

        plan.scan = scan
        return plan.query(node)

    def federated_plan(self, gql: str) -> FederatedPlan:
        return plan_federated(parse(gql), self.registry, {n: s.reachable for n, s in self.sources.sources.items()})
