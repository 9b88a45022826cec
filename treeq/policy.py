"""Who may read and write what: roles, owners, grants and access lists, as row filters and column lists."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeq.errors import NoContext, PermissionDenied, ShapeError
from treeq.schema import Model

ACTIONS = ("read", "insert", "update", "remove")


@dataclass(frozen=True)
class Context:
    user_id: str | None = None
    roles: tuple[str, ...] = ()
    internal: bool = False
    lists: dict[str, list] = field(default_factory=dict)

    @staticmethod
    def of(given: Context | dict | None) -> Context | None:
        if given is None or isinstance(given, Context):
            return given
        roles = [*given.get("roles", []), *([given["role"]] if given.get("role") else [])]
        rest = {k: v for k, v in given.items() if k not in ("userId", "roles", "role", "internal")}
        return Context(given.get("userId"), tuple(roles), bool(given.get("internal")), rest)


SYSTEM = Context(internal=True)


@dataclass(frozen=True)
class Grant:
    role: str
    model: str
    actions: frozenset[str]
    read_fields: frozenset[str] | None = None
    write_fields: frozenset[str] | None = None
    owner_only: bool = False
    condition: dict | None = None


def grants_of(spec: dict) -> tuple[str, frozenset[str], tuple[Grant, ...]]:
    """mode, managed roles and grants of {mode, managedRoles, grants: [{role, model, actions, readFields, writeFields, ownerOnly, condition}]}."""
    if unknown := set(spec) - {"mode", "managedRoles", "grants"}:
        raise ShapeError(f"policy: unknown keys {sorted(unknown)}")
    mode = spec.get("mode", "overlay")
    if mode not in ("overlay", "enforce"):
        raise ShapeError(f"policy: unknown mode {mode}")
    out = []
    for g in spec.get("grants", []):
        if unknown := set(g) - {"role", "model", "actions", "readFields", "writeFields", "ownerOnly", "condition"}:
            raise ShapeError(f"grant: unknown keys {sorted(unknown)}")
        actions = {a for x in g["actions"] for a in (ACTIONS[1:] if x == "write" else [x])}
        if actions - set(ACTIONS):
            raise ShapeError(f"grant: unknown actions {sorted(actions - set(ACTIONS))}")
        if any(isinstance(v, (dict, list)) for v in (g.get("condition") or {}).values()):
            raise ShapeError("grant: a condition is made of equal values")
        fields = [frozenset(g[k]) if g.get(k) is not None else None for k in ("readFields", "writeFields")]
        out.append(Grant(g["role"], g["model"], frozenset(actions), *fields, bool(g.get("ownerOnly")), g.get("condition")))
    return mode, frozenset(spec.get("managedRoles", ())), tuple(out)


class Policy:
    """The rules of one engine. Without a context everything is allowed, unless one is required."""

    def __init__(self, *, exempt_roles: tuple[str, ...] = (), closed: bool = False, require_context: bool = False, rbac: dict | None = None, deny_write_roles: tuple[str, ...] = (), define_roles: tuple[str, ...] | None = None) -> None:
        self.exempt, self.closed, self.require_context = frozenset(exempt_roles), closed, require_context
        self.deny_write, self.define_roles = frozenset(deny_write_roles), define_roles
        self.mode, self.managed, self.grants = grants_of(rbac) if rbac else ("overlay", frozenset(), ())

    def need_context(self, ctx: Context | None) -> None:
        if self.require_context and ctx is None:
            raise NoContext("a context is required")

    def _free(self, ctx: Context | None) -> bool:
        return ctx is None or ctx.internal or bool(self.exempt.intersection(ctx.roles))

    def _matched(self, model: Model, ctx: Context | None) -> list[Grant] | None:
        """The grants that decide; None if grants have no say."""
        if self._free(ctx):
            return None
        found = [g for g in self.grants if g.role in ctx.roles and g.model in (model.name, "*")]
        if self.mode == "overlay":
            return found or None
        return found if self.managed.intersection(ctx.roles) else None

    def allowed(self, roles: tuple[str, ...] | None, ctx: Context | None) -> bool:
        """Static roles, with creator counted as allowed: its rows are told apart by a filter."""
        if self._free(ctx):
            return True
        if not roles:
            return not self.closed
        return bool(set(roles).intersection(ctx.roles)) or "creator" in roles

    def check_read(self, model: Model, ctx: Context | None) -> None:
        self.need_context(ctx)
        if ctx is not None and not ctx.internal and model.deny_read:
            raise PermissionDenied(f"{model.name} can't be read")
        if not self.allowed(model.read, ctx):
            raise PermissionDenied(f"no role may read {model.name}")
        grants = self._matched(model, ctx)
        if grants is not None and not any("read" in g.actions for g in grants):
            raise PermissionDenied(f"no grant lets read {model.name}")

    def readable(self, model: Model, name: str, roles: tuple[str, ...] | None, ctx: Context | None) -> bool:
        """A field, relation or computed column of this name and roles."""
        if not self.allowed(roles, ctx):
            return False
        grants = self._matched(model, ctx)
        if grants is None or name == "_id":
            return True
        sets = [g.read_fields for g in grants if "read" in g.actions]
        return any(s is None for s in sets) or not any(sets) or name.split(".")[0] in frozenset().union(*sets)

    def _only_creator(self, roles: tuple[str, ...] | None, ctx: Context | None) -> bool:
        return not self._free(ctx) and "creator" in (roles or ()) and not set(roles).intersection(ctx.roles)

    def row_filter(self, model: Model, ctx: Context | None, kinds: T.StructType, action: str = "read") -> Column | None:
        """The rows that this context may see, or change."""
        parts: list[Column] = []
        owner = F.col(f"`{model.owner_key}`") == F.lit(ctx.user_id) if ctx is not None and model.owner_key in kinds.names else F.lit(False)
        if self._only_creator(model.read if action == "read" else model.write, ctx):
            parts.append(owner if ctx.user_id else F.lit(False))
        grants = self._matched(model, ctx)
        if grants is not None:
            rows = []
            for g in (g for g in grants if action in g.actions):
                own = [owner] if g.owner_only else []
                own += [F.col(f"`{k}`") == F.lit(v) for k, v in (g.condition or {}).items()]
                if not own:
                    rows = []
                    break
                rows.append(functools.reduce(operator.and_, own))
            if rows:
                parts.append(functools.reduce(operator.or_, rows))
        for key in model.access_keys:
            if self._free(ctx) or set(key.bypass).intersection(ctx.roles):
                continue
            if not isinstance(ctx.lists.get(key.list_key), list):
                raise PermissionDenied(f"the context has no list {key.list_key} for {model.name}.{key.field}")
            kind = kinds[key.field].dataType
            values = ctx.lists[key.list_key]
            if not values:
                parts.append(F.lit(False))
            elif isinstance(kind, T.ArrayType):
                parts.append(F.arrays_overlap(F.col(f"`{key.field}`"), F.array(*map(F.lit, values)).cast(kind)))
            else:
                parts.append(F.col(f"`{key.field}`").isin(values))
        return functools.reduce(operator.and_, parts) if parts else None

    def rows(self, df: DataFrame, model: Model, ctx: Context | None, action: str = "read") -> DataFrame:
        found = self.row_filter(model, ctx, df.schema, action)
        return df if found is None else df.where(found)

    def owned_field(self, model: Model, roles: tuple[str, ...] | None, ctx: Context | None, col: Column) -> Column:
        """A field that only its creator may read is null on the rows of others."""
        if self._only_creator(roles, ctx):
            return F.when(F.col(f"`{model.owner_key}`") == F.lit(ctx.user_id), col)
        return col

    def check_write(self, model: Model, ctx: Context | None, action: str) -> None:
        self.need_context(ctx)
        if ctx is not None and not ctx.internal and self.deny_write.intersection(ctx.roles):
            raise PermissionDenied(f"a role of this context may write nothing, {model.name} neither")
        if not self.allowed(model.write, ctx):
            raise PermissionDenied(f"no role may {action} {model.name}")
        if self._only_creator(model.write, ctx) and not ctx.user_id:
            raise PermissionDenied(f"{model.name} is written by its creators, and the context has no user")
        grants = self._matched(model, ctx)
        if grants is not None and not any(action in g.actions for g in grants):
            raise PermissionDenied(f"no grant lets {action} {model.name}")

    def check_define(self, ctx: Context | None) -> None:
        """Who may register models: anyone, unless roles are named for it."""
        if self.define_roles is not None and not (ctx is not None and (ctx.internal or set(self.define_roles).intersection(ctx.roles))):
            raise PermissionDenied("no role may define models")

    # what hosts ask

    def can_read(self, model: Model, ctx: Context | None) -> bool:
        return self._passes(lambda: self.check_read(model, ctx))

    def can_write(self, model: Model, ctx: Context | None, action: str = "update") -> bool:
        return self._passes(lambda: self.check_write(model, ctx, action))

    @staticmethod
    def _passes(check: Callable[[], None]) -> bool:
        try:
            check()
        except PermissionDenied:
            return False
        return True

    def owner_only(self, model: Model, ctx: Context | None) -> bool:
        """Whether this context sees only the rows that it owns."""
        return self._only_creator(model.read, ctx)

    def readable_fields(self, model: Model, ctx: Context | None) -> list[str]:
        return [f.name for f in model.fields.values() if self.readable(model, f.name, f.read, ctx)]

    def readable_relations(self, model: Model, ctx: Context | None) -> list[str]:
        return [r.name for r in model.relations.values() if self.readable(model, r.name, r.read, ctx)]

    def writable_fields(self, model: Model, ctx: Context | None) -> list[str]:
        return [f for f in model.fields if self.writable(model, f, ctx)]

    def writable_data(self, model: Model, ctx: Context | None, data: dict) -> dict:
        return {k: v for k, v in data.items() if k == "_id" or self.writable(model, k, ctx)}

    def writable(self, model: Model, name: str, ctx: Context | None) -> bool:
        f = model.field_at(name)
        if f is not None and not self.allowed(f.write, ctx):
            return False
        grants = self._matched(model, ctx)
        if grants is None:
            return True
        sets = [g.write_fields for g in grants if g.actions - {"read"}]
        return any(s is None for s in sets) or not any(sets) or name.split(".")[0] in frozenset().union(*sets)

    def check_values(self, model: Model, ctx: Context | None, data: dict) -> None:
        """Values of access-listed fields are in the context's lists."""
        for key in model.access_keys:
            if self._free(ctx) or set(key.bypass).intersection(ctx.roles) or key.field not in data:
                continue
            allowed = ctx.lists.get(key.list_key)
            if not isinstance(allowed, list):
                raise PermissionDenied(f"the context has no list {key.list_key} for {model.name}.{key.field}")
            v = data[key.field]
            if not set(v if isinstance(v, list) else [v]) <= set(allowed):
                raise PermissionDenied(f"{model.name}.{key.field} gets a value outside {key.list_key}")
